"""Where lines come from: blame hunks out of the versions of files."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .attribution import align, line_tokens
from .tables import Scratch

#: Letters and digits that a block must hold to count as moved.
MOVE_SIGNS = 20
#: Versions of a file that one task follows.
BLOCK = 64
_RANGE = "first long, n long, to_seq long, to_first long, done boolean"


def _blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Pairs of lines (old, new) as blocks (new, old, lines)."""
    out: list[tuple[int, int, int]] = []
    for a, b in sorted(pairs, key=lambda p: p[1]):
        if out and out[-1][0] + out[-1][2] == b and out[-1][1] + out[-1][2] == a:
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((b, a, 1))
    return out


def moved(old: list[str], new: list[str], pairs: list[tuple[int, int]], signs: int) -> list[tuple[int, int]]:
    """Lines taken out in one place and put in at another: those whose text is taken out
    and put in once each, in blocks of so many letters and digits at least."""
    kept_old, kept_new = {a for a, _ in pairs}, {b for _, b in pairs}
    once: dict[str, list] = {}
    for side, (lines, kept) in enumerate(((old, kept_old), (new, kept_new))):
        for k, line in enumerate(lines):
            if k not in kept:
                once.setdefault(line, [[], []])[side].append(k)
    same = [(a[0], b[0]) for a, b in once.values() if len(a) == len(b) == 1]
    out = []
    for b, a, n in _blocks(same):
        if sum(c.isalnum() for line in new[b : b + n] for c in line) >= signs:
            out += [(a + k, b + k) for k in range(n)]
    return out


def line_map(old: str | None, new: str, signs: int | None = None) -> list[tuple[int, int, int | None]]:
    """Ranges (first, lines, first in the old version or None) that cover the new version."""
    b = line_tokens(new)
    pairs = []
    if old is not None:
        a = line_tokens(old)
        pairs = align(a, b)
        if signs is not None:
            pairs += moved(a, b, pairs, signs)
    out, at = [], 0
    for first, source, n in _blocks(pairs):
        if first > at:
            out.append((at, first - at, None))
        out.append((first, n, source))
        at = first + n
    return out + [(at, len(b) - at, None)] * (at < len(b))


def _through(ranges: list[tuple], starts: list[int], source: int, n: int):
    """Where lines source to source + n of a version stand by its ranges: (to_seq, to_first, lines, done, key)."""
    k = bisect_right(starts, source) - 1
    while n > 0:
        first, there, seq, at, done, key = ranges[k]
        skip = source - first
        took = min(n, there - skip)
        yield seq, at + skip, took, done, key
        source, n, k = source + took, n - took, k + 1


def _followed(version, before: list[tuple], maps: list[tuple[int, int, int | None]]) -> list[tuple]:
    """Ranges (first, n, to_seq, to_first, done, key) of a version (seq, key), by its line_map
    and the ranges of the version before. Neighbours that go on in one another are one."""
    out: list[tuple] = []
    starts = [r[0] for r in before]
    for first, n, source in maps:
        for seq, at, took, done, key in [(version[0], first, n, True, version[1])] if source is None else _through(before, starts, source, n):
            if out and out[-1][2] == seq and out[-1][3] + out[-1][1] == at:
                out[-1] = (out[-1][0], out[-1][1] + took, *out[-1][2:])
            else:
                out.append((first, took, seq, at, done, key))
            first += took
    return out


def line_maps(versions: DataFrame, by: list[str], signs: int | None = None) -> DataFrame:
    """versions(by, seq, commit_key, content): ranges(by, seq, first, n, to_seq, to_first, done,
    commit_key) of each version's lines, numbered from 0. BLOCK versions of a file are followed
    one after another by one task, which holds the last of them only, so a text is moved once
    and a file of many versions is spread. Done ranges begin in the version named, of which
    they have the commit; open ones stand in the last version of the block before, which
    comes to both blocks. Null content is a file that is not there."""
    block = F.floor(F.col("seq") / BLOCK)
    blocks = F.when(F.col("seq") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    rows = versions.where("content is not null").select(*by, F.explode(blocks).alias("_block"), "seq", "commit_key", "content")
    rows = rows.repartition(*by, "_block").sortWithinPartitions(*by, "_block", "seq")
    keys = len(by)

    def run(batches):
        now, last, text, ranges = None, None, None, []
        for b in batches:
            at, cols = [], [[], [], [], [], [], []]
            names = [b.column(k).to_pylist() for k in range(keys + 1)]
            commits, texts = b.column(keys + 2).to_pylist(), b.column(keys + 3).to_pylist()
            for k, seq in enumerate(b.column(keys + 1).to_pylist()):
                group = tuple(c[k] for c in names)
                if group != now:
                    now, last = group, None
                if seq // BLOCK != group[-1]:  # ends the block before
                    n = len(line_tokens(texts[k]))
                    ranges = [(0, n, seq, 0, False, None)] * (n > 0)
                else:
                    known = last == seq - 1 and None not in group
                    ranges = _followed((seq, commits[k]), ranges, line_map(text if known else None, texts[k], signs))
                    at += [k] * len(ranges)
                    for r in ranges:
                        for col, x in zip(cols, r):
                            col.append(x)
                last, text = seq, texts[k]
            kept = [b.column(k).take(pa.array(at, pa.int64())) for k in (*range(keys), keys + 1)]
            found = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.bool_(), b.column(keys + 2).type])]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*by, "seq", "first", "n", "to_seq", "to_first", "done", "commit_key"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, "seq"])
    return rows.mapInArrow(run, f"{fields}, {_RANGE}, commit_key {rows.schema['commit_key'].dataType.simpleString()}")


def _composed(ranges: DataFrame, through: DataFrame, by: list[str]) -> DataFrame:
    """Every open range, cut at the borders of the ranges of the version it stands in, and
    put where those go. A task holds the ranges of one version and streams what stands there."""
    a = ranges.where("not done").select(*by, F.col("to_seq").alias("_at"), "seq", "first", "n", "to_seq", "to_first", "done", "commit_key")
    b = through.select(*by, F.col("seq").alias("_at"), F.lit(-1).cast("long").alias("seq"), "first", "n", "to_seq", "to_first", "done", "commit_key")
    rows = a.unionByName(b).repartition(*by, "_at").sortWithinPartitions(*by, "_at", "seq", "first")
    keys = len(by)

    def run(batches):
        now, held, starts, last, schema = None, [], [], None, None
        for batch in batches:
            if schema is None:
                schema = pa.schema([f for k, f in enumerate(batch.schema) if k != keys])
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[: keys + 1] != now:
                    now, held, starts = row[: keys + 1], [], []
                seq, first, n, to_seq, to_first, done, key = row[keys + 1 :]
                if seq < 0:
                    held.append((first, n, to_seq, to_first, done, key))
                    starts.append(first)
                    continue
                for there, at, took, ended, commit in _through(held, starts, to_first, n):
                    goes_on = last is not None and last[:-6] == (*now[:-1], seq) and last[-6] + last[-5] == first and last[-4] == there and last[-3] + last[-5] == at
                    if goes_on:
                        last = (*last[:-5], last[-5] + took, *last[-4:])
                    else:
                        if last is not None:
                            out.append(last)
                        last = (*now[:-1], seq, first, took, there, at, ended, commit)
                    first += took
            yield _batch(out, schema)
        if last is not None:
            yield _batch([last], schema)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns if c != "_at")
    return rows.mapInArrow(run, fields)


def _batch(rows: list[tuple], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def origins(versions: DataFrame, by: list[str], signs: int | None = None) -> DataFrame:
    """Ranges (by, seq, first, n, to_seq, to_first, commit_key) of every version's lines, with
    the version, its commit and the line where they first stood without a break since.

    Ranges that are open go through the last versions of blocks. Of these, the maps to the one
    2**k blocks before are put together from two of 2**(k - 1), so a history of n blocks takes
    log(n) rounds over one version in BLOCK; all others are put through them once."""
    t = Scratch(versions.sparkSession, "provenance")
    found = t.write(line_maps(versions, by, signs))
    if found.where("not done").head(1):
        ends = F.col("seq") % BLOCK == BLOCK - 1
        now = t.write(found.where(ends))
        while now.where("not done").head(1):
            then = t.write(now.where("done").unionByName(_composed(now, now, by)))
            t.drop(now)
            now = then
        others = found.where(~ends)
        found = others.where("done").unionByName(now).unionByName(_composed(others, now, by))
    return found.drop("done")


def hunks(versions: DataFrame, by: list[str], signs: int | None = None) -> DataFrame:
    """versions(by, seq, commit_key, content), seq from 0 without gaps: blame hunks (by, seq,
    commit_key, final_start, orig_start, n_lines) of every version, lines numbered from 1.
    commit_key is that of the version in which the lines first stood."""
    out = origins(versions, by, signs)
    return out.select(*by, "seq", "commit_key", (F.col("first") + 1).alias("final_start"), (F.col("to_first") + 1).alias("orig_start"), F.col("n").alias("n_lines"))


def at_revision(found: DataFrame, versions: DataFrame, by: list[str], seq: int | None = None) -> DataFrame:
    """The hunks of each file's version at seq or before, the last one if there is none."""
    v = versions if seq is None else versions.where(F.col("seq") <= seq)
    return found.join(v.groupBy(*by).agg(F.max("seq").alias("seq")), [*by, "seq"]).drop("seq")

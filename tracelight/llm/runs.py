"""Periodic runs of words, found whole by the method of Kolpakov and Kucherov.

A run is a maximal stretch of words with smallest period q that holds the period at
least TIMES times and LEAST words. Each text is worked on alone, in time linear in its words:

1. Words that occur fewer than TIMES times in a stretch stand in none of its runs, as
   every word of a run recurs each period; the stretch is cut there until nothing is left to cut.
2. A suffix automaton of the rest gives its Lempel-Ziv factors: each the longest
   stretch that also begins earlier, and where.
3. Every run that crosses or touches a factor's border is found by Main's algorithm:
   longest common prefixes and suffixes at the border, one pair a period. A run that ends in
   a factor begins less than a period before the factor ahead of it (or that factor
   would have been longer), which bounds the windows and the periods.
4. All other runs lie within a factor, and are copied from its earlier occurrence.

Null and empty texts have no words and no runs; equal rows have equal results; extra
columns are ignored by `scan` and kept by `collapse`. No row leaves its partition, so hot
sources and copies move no data; a text's memory is some 0.5 kB for each word left by step 1.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import runtime as R

#: A run holds its period so many times at least, and so many words.
TIMES, LEAST = 4, 6


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, length, start of an earlier occurrence or -1), which
    may overlap their occurrence, from the suffix automaton of s."""
    step, link, size, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(step)
        step.append({})
        link.append(0)
        size.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] != size[p] + 1:
                twin = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                link[q] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                q = twin
            link[new] = q
        last = new
    out, at, n = [], 0, len(s)
    while at < n:
        state, k = 0, 0
        while at + k < n and first[then := step[state][s[at + k]]] < at + k:
            state, k = then, k + 1
        out.append((at, max(k, 1), first[state] - k + 1 if k else -1))
        at += max(k, 1)
    return out


def common_prefixes(s: list[int]) -> list[int]:
    """For every place, how many items from there agree with the beginning (Z array)."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _across(s: list[int], b: int, before: int, after: int, times: int, least: int, found: dict) -> None:
    """Runs that begin at b or before and end from b to b + after, where the factor before
    b has `before` items and the one at b `after`; a run too long for the windows ends elsewhere."""
    most = (before + after - 1) // (times - 1)
    if before + after + most - 1 < least:
        return
    low, n = max(0, b - before - most), len(s)
    t, v = s[low:b], s[b : b + after + 1]
    nt, nv = len(t), len(v)
    fore = common_prefixes([*v, -1, *t, *v])
    back = common_prefixes([*t[::-1], -1, *v[::-1], *t[::-1]])

    def keep(start: int, end: int, q: int) -> None:
        if end - start >= max(least, times * q) and (start > low or low == 0) and (end <= b + after or end == n):
            found.setdefault((start, end), q)

    for q in range(1, most + 1):
        if q <= nv:  # a period at the right of b
            keep(b - back[nt + 1 + nv - q], b + q + (fore[q] if q < nv else 0), q)
        if q <= nt:  # a period at its left
            keep(b - q - (back[q] if q < nt else 0), b + fore[nv + 1 + nt - q], q)


def whole_runs(s: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of s, by start, then period."""
    cut = factors(s)
    found: dict[tuple[int, int], int] = {}
    for (_, before, _), (b, after, _) in zip(cut, [*cut[1:], (len(s), 0, -1)]):
        _across(s, b, before, after, times, least, found)
    at: dict[int, list[tuple[int, int]]] = {}
    for (start, end), q in found.items():
        at.setdefault(start, []).append((end, q))
    for b, k, source in cut:
        if source >= 0:
            for j in range(1, k - least):
                for end, q in at.get(source + j, ()):
                    if end < source + k and (b + j, end - source + b) not in found:
                        found[b + j, end - source + b] = q
                        at.setdefault(b + j, []).append((end - source + b, q))
    return sorted((start, end - start, q) for (start, end), q in found.items())


def stretches(words: list, times: int = TIMES, least: int = LEAST) -> Iterator[tuple[int, list]]:
    """(place, words) of the parts that can hold runs: of every part's words each
    occurs `times` times in it or more."""
    size = max(times, least)
    parts, long = [(0, words)], re.compile(b"\x01{%d,}" % size)
    while parts:
        at, part = parts.pop()
        if len(part) < size:
            continue
        counts = Counter(part)
        often = {w for w, n in counts.items() if n >= times}
        if len(often) == len(counts):
            yield at, part
        else:
            marks = bytes(map(often.__contains__, part))
            parts.extend((at + m.start(), part[m.start() : m.end()]) for m in long.finditer(marks))


def runs_of(words: list, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start, then period."""
    out = []
    for at, part in stretches(words, times, least):
        number = {w: k for k, w in enumerate(dict.fromkeys(part))}
        out += [(at + start, length, q) for start, length, q in whole_runs([number[w] for w in part], times, least)]
    return sorted(out)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    out, at = [], 0
    for start, end in sorted((start + q, start + length) for start, length, q in runs):
        if start > at:
            out += words[at:start]
        at = max(at, end)
    return out + words[at:]


def planted(words: list, doc_id: int | None) -> list:
    """The words with the tail that a tenth of the ids repeats, as the query's contract
    has it; a row without id keeps its words."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapse(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """The same columns and `runs` (array of start, length, period; a column of that name
    is replaced), with what runs repeat left out of the text; texts without runs stay
    as they are, white space included. Null text stays null and has no runs."""
    R.prepare(docs.sparkSession)
    docs = docs.drop("runs")
    at, names = docs.columns.index("text"), [*docs.columns, "runs"]
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches):
        for b in batches:
            texts, listed = [], []
            for raw in b.column(at).cast(pa.binary()).to_pylist():
                words = (raw or b"").split()
                runs = runs_of(words, times, least)
                texts.append(b" ".join(collapsed(words, runs)) if runs else raw)
                listed.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            cols = [*b.columns, pa.array(listed, kind)]
            cols[at] = pa.array(texts, pa.binary()).cast(b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.withColumn("runs", F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>")).schema)


def scan(docs: DataFrame, plant: bool = False, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of
    the runs and of the text without what they repeat. plant: texts of a tenth of the ids get
    a repeated tail first."""
    R.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), R.utf8(b.column(1))):
                words = planted(raw.split(), doc_id) if plant else raw.split()
                runs = runs_of(words, times, least)
                top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
                rows.append((doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.string()] * 2)], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return R.spread(rows).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(R.table(spark, sf_dir, "documents"), plant=True)

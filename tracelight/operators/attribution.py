"""Three-way attribution of a file's lines: original, AI versions, final text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.similarity import similarity
from ..functions.text import lines, strip_end
from ..schemas import AI, AI_MODIFIED, HUMAN, ORIGINAL, UNKNOWN

THRESHOLD = 0.6
#: Fixed values of the method.
CONTEXT_SIMILARITY, CONTEXT_CONFIDENCE, CONTEXT_ROUNDS = 0.5, 0.85, 5
BLOCK_LINES, BLOCK_CERTAIN = 8, 0.85
_FRAGMENT = re.compile(r"^(?:\.|,|\)|\]|\}|&&|\|\|)|(?:\(|\[|\{|,|=|&&|\|\|)$")


# --- set-based, in DataFrame operations ------------------------------------


def by_content(originals: DataFrame, edits: DataFrame, finals: DataFrame, by: list[str]) -> DataFrame:
    """Each final line is Original if the original has its content, else AI of the last
    edit that wrote it, else Unmatched (left to the similarity step).

    originals(by, text), edits(by, edit_no, edit_id, prompt_index, text), finals(by, text).
    """
    key = strip_end(F.col("line"))
    o = originals.select(*by, F.explode(lines(F.col("text"))).alias("line")).select(*by, key.alias("key")).distinct().withColumn("in_original", F.lit(True))
    e = edits.select(*by, "edit_no", "edit_id", "prompt_index", F.explode(lines(F.col("text"))).alias("line")).groupBy(*by, key.alias("key")).agg(F.max(F.struct("edit_no", "edit_id", "prompt_index")).alias("e"))
    f = finals.select(*by, F.posexplode(lines(F.col("text"))).alias("k", "line")).select(*by, (F.col("k") + 1).cast("long").alias("line_number"), F.col("line").alias("content"), key.alias("key"))
    out = f.join(o, [*by, "key"], "left").join(e, [*by, "key"], "left")
    original = F.col("in_original").isNotNull()
    kind = F.when(original, ORIGINAL).when(F.col("e").isNotNull(), AI).otherwise("Unmatched")
    return out.select(*by, "line_number", "content", kind.alias("source_type"), F.when(~original, F.col("e.edit_id")).alias("edit_id"), F.when(~original, F.col("e.prompt_index")).alias("prompt_index"))


# --- line alignment --------------------------------------------------------


def split_lines(text: str) -> list[str]:
    """\\n and \\r\\n close a line."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
        ended = len(parts)
    else:
        ended = len(parts) - 1
    return [p[:-1] if k < ended and p.endswith("\r") else p for k, p in enumerate(parts)]


def line_tokens(text: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+\Z", text)


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal elements on a shortest edit script (Myers, linear space). Where no
    element is repeated and the common ones stand in one order, there is one such script."""
    place = {t: k for k, t in enumerate(a)}
    if len(place) == len(a) and len(set(b)) == len(b):
        same = [(place[t], j) for j, t in enumerate(b) if t in place]
        if all(p[0] < q[0] for p, q in zip(same, same[1:])):
            return same
    ids: dict[str, int] = {}
    x = [ids.setdefault(t, len(ids)) for t in a]
    y = [ids.setdefault(t, len(ids)) for t in b]
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        m = _middle(x, y, a0, a1, b0, b1)
        if m is not None:
            todo += [(m[0], a1, m[1], b1), (a0, m[0], b0, m[1])]
    return sorted(out)


def _middle(x, y, a0, a1, b0, b1):
    """A point on a shortest path of the box that is none of its two corners."""
    n, m = a1 - a0, b1 - b0
    delta, limit = n - m, (n + m + 1) // 2
    fwd, bwd = {1: 0}, {1: 0}
    for d in range(limit + 1):
        for k in range(-d, d + 1, 2):
            i = fwd[k + 1] if k == -d or (k != d and fwd.get(k - 1, -1) < fwd.get(k + 1, -1)) else fwd[k - 1] + 1
            j, i0 = i - k, i
            while i < n and 0 <= j < m and x[a0 + i] == y[b0 + j]:
                i, j = i + 1, j + 1
            fwd[k] = i
            back = bwd.get(delta - k)
            if delta % 2 and back is not None and abs(delta - k) <= d - 1 and i + back >= n and 0 <= i0 <= n:
                p = (a0 + min(i, n), b0 + min(max(i - k, 0), m))
                return p if p not in ((a0, b0), (a1, b1)) else None
        for k in range(-d, d + 1, 2):
            i = bwd[k + 1] if k == -d or (k != d and bwd.get(k - 1, -1) < bwd.get(k + 1, -1)) else bwd[k - 1] + 1
            j = i - k
            while i < n and 0 <= j < m and x[a1 - 1 - i] == y[b1 - 1 - j]:
                i, j = i + 1, j + 1
            bwd[k] = i
            ahead = fwd.get(delta - k)
            if delta % 2 == 0 and ahead is not None and abs(delta - k) <= d and i + ahead >= n:
                p = (a0 + max(n - i, 0), b0 + min(max(m - (i - k), 0), m))
                return p if p not in ((a0, b0), (a1, b1)) else None
    return None


def map_lines(source: str, target: str) -> list[tuple[int, int]]:
    return align(line_tokens(source), line_tokens(target))


# --- position-aware attribution of one file --------------------------------


def block_form(s: str) -> str:
    out = " ".join(s.split())
    for p, q in ((" .", "."), (" ,", ","), (" ;", ";"), (" )", ")"), ("( ", "(")):
        out = out.replace(p, q)
    return out


class Options:
    """Texts with owners, asked for the most similar one. Lengths, and then the signs
    that two texts can have in common at all, bound a similarity from above, so that
    few pairs are compared."""

    def __init__(self, items: list[tuple[str, tuple]]):
        self.items = items
        self.chars = np.array([len(s) for s, _ in items], np.int64)
        self.bytes = np.array([len(s.encode()) for s, _ in items], np.int64)
        self.bags: dict[int, np.ndarray] = {}
        self.first: dict[str, int] = {}
        for k, (s, _) in enumerate(items):
            self.first.setdefault(s, k)

    @staticmethod
    def _bag(s: str) -> np.ndarray:
        return np.bincount(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64)

    def best(self, text: str, threshold: float):
        """(similarity, owner) of the most similar text at or above a threshold; the
        first of equals. Nones if there is none."""
        if text in self.first:
            return 1.0, self.items[self.first[text]][1]
        m, n = len(text), self.chars
        longest = np.maximum(len(text.encode()), self.bytes)
        near = np.flatnonzero((longest > 0) & (2 * np.minimum(m, n) >= np.maximum(m, n)) & (np.minimum(m, n) >= threshold * longest - 1e-9))
        if not len(near):
            return None, None
        for k in near:
            if k not in self.bags:
                self.bags[k] = self._bag(self.items[k][0])
        common = np.minimum(np.array([self.bags[k] for k in near]), self._bag(text)).sum(axis=1)
        most = common / longest[near]
        best, at = None, None
        for k in np.argsort(-most, kind="stable"):
            if most[k] < threshold - 1e-9 or (best is not None and most[k] < best - 1e-9):
                break
            s = similarity(text, self.items[near[k]][0])
            if s >= threshold and (best is None or s > best or (s == best and near[k] < at)):
                best, at = s, near[k]
        return (None, None) if at is None else (best, self.items[at][1])


def attribute(original: str, edits: list[tuple[str, int, str]], final: str, threshold: float = THRESHOLD) -> list[dict]:
    """edits: (edit_id, prompt_index, text after), oldest first. A dict per final line."""
    rows = split_lines(final)
    in_original = {s.rstrip() for s in split_lines(original)}
    if not edits:
        return [{"content": s, "type": ORIGINAL if s.rstrip() in in_original else HUMAN, "edit": None, "prompt": None, "similarity": None, "confidence": 1.0} for s in rows]
    latest = edits[-1][2]
    owner: dict[str, tuple[str, int]] = {}
    order: dict[str, tuple[int, int]] = {}
    for e, (edit_id, prompt, after) in enumerate(edits):
        for k, s in enumerate(split_lines(after)):
            owner[s.rstrip()] = (edit_id, prompt)
            order[s.rstrip()] = (-e, k)
    found: list[tuple | None] = [None] * len(rows)
    for _, k in map_lines(original, final):
        if k < len(found):
            found[k] = (ORIGINAL, None, None)
    ai_lines = split_lines(latest)
    for k, j in map_lines(latest, final):
        if j < len(found) and found[j] is None:
            who = owner.get(ai_lines[k].rstrip() if k < len(ai_lines) else "")
            if who:
                found[j] = (AI, who, None)
    # ties of similarity go to the latest edit, then to the earliest line
    options = Options([(s.strip(), owner[s]) for s in sorted(owner, key=order.__getitem__) if s.strip()])
    for j, s in enumerate(rows):
        if found[j] is None:
            key = s.rstrip()
            if key in in_original:
                found[j] = (ORIGINAL, None, None)
            elif key in owner:
                found[j] = (AI, owner[key], None)
            else:
                near, who = options.best(s.strip(), threshold) if s.strip() else (None, None)
                found[j] = (HUMAN, None, None) if near is None else (AI_MODIFIED, who, near)
    sure = {ORIGINAL: 1.0, AI: 1.0, HUMAN: 0.9, UNKNOWN: 0.5}
    out = [{"content": s, "type": t, "edit": who and who[0], "prompt": who and who[1], "similarity": near, "confidence": near if t == AI_MODIFIED else sure[t]} for s, (t, who, near) in zip(rows, found)]
    if len(out) >= 2:
        _between(out)
        _blocks(out, edits)
        _context(out)
    return out


def _between(out: list[dict]) -> None:
    for k in range(1, len(out) - 1):
        before = out[k - 1]
        if out[k]["type"] == UNKNOWN and before["edit"] is not None and before["edit"] == out[k + 1]["edit"]:
            out[k] |= {"type": AI_MODIFIED, "edit": before["edit"], "prompt": before["prompt"], "similarity": CONTEXT_SIMILARITY, "confidence": CONTEXT_SIMILARITY}


def _blocks(out: list[dict], edits: list[tuple[str, int, str]]) -> None:
    """Short runs of unmatched lines against AI lines and windows of 2 to 8 of them."""
    open_ = lambda r: r["type"] in (HUMAN, UNKNOWN) or (r["type"] == AI_MODIFIED and r["similarity"] < BLOCK_CERTAIN)
    if not any(map(open_, out)):
        return
    formed = [([block_form(s) for s in split_lines(after)], (edit_id, prompt)) for edit_id, prompt, after in edits]
    options = [(s, who) for ls, who in formed for s in ls if s]
    for ls, who in formed:
        for size in range(2, min(BLOCK_LINES, len(ls)) + 1):
            options += [(t, who) for k in range(len(ls) - size + 1) if (t := " ".join(ls[k : k + size]))]
    options = Options(options)
    k = 0
    while k < len(out):
        if not open_(out[k]):
            k += 1
            continue
        end = k
        while end < len(out) and open_(out[end]):
            end += 1
        n = end - k
        if n <= BLOCK_LINES:
            least = {1: 0.75, 2: 0.70, 3: 0.65, 4: 0.65}.get(n, 0.60)
            near, who = options.best(" ".join(block_form(r["content"]) for r in out[k:end]), least)
            if near is not None:
                for r in out[k:end]:
                    r |= {"type": AI, "edit": who[0], "prompt": who[1], "similarity": None, "confidence": near}
        k = end


def _context(out: list[dict]) -> None:
    """Fragments between lines of one edit become that edit's, to a fixed point."""
    kinds = (AI, AI_MODIFIED)
    for _ in range(CONTEXT_ROUNDS):
        changed = False
        for k in range(1, len(out) - 1):
            a, r, b = out[k - 1], out[k], out[k + 1]
            if r["type"] not in (HUMAN, AI_MODIFIED) or a["type"] not in kinds or b["type"] not in kinds or a["edit"] is None or a["edit"] != b["edit"]:
                continue
            s = r["content"].strip()
            if s and _FRAGMENT.search(s):
                r |= {"type": AI, "edit": a["edit"], "prompt": a["prompt"], "similarity": None, "confidence": CONTEXT_CONFIDENCE}
                changed = True
        if not changed:
            return


def three_way(files: DataFrame, by: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """files(by, path, original, edits array<struct<edit_id, prompt_index, after>>, final):
    a row per final line. Files are independent: no shuffle, one batch of files at a
    time in memory."""
    from pyspark.sql.types import StructType

    keys = files.select(*by, "path").schema
    found = [("line_number", "bigint", pa.int64()), ("content", "string", pa.string()), ("source_type", "string", pa.string()), ("edit_id", "string", pa.string()), ("prompt_index", "bigint", pa.int64()), ("similarity", "double", pa.float64()), ("confidence", "double", pa.float64())]
    schema = StructType([*keys.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t, _ in found)).fields])
    n_keys = len(keys.names)

    def run(batches):
        for b in batches:
            rows = {n: [] for n, _, _ in found}
            sizes = []
            for original, edits, final in zip(*(b.column(n_keys + k).to_pylist() for k in range(3))):
                edits = [(e["edit_id"], e["prompt_index"], e["after"] or "") for e in edits or []]
                got = attribute(original or "", edits, final or "", threshold)
                sizes.append(len(got))
                rows["line_number"] += range(1, len(got) + 1)
                for name, k in (("content", "content"), ("source_type", "type"), ("edit_id", "edit"), ("prompt_index", "prompt"), ("similarity", "similarity"), ("confidence", "confidence")):
                    rows[name] += [r[k] for r in got]
            at = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(n_keys)), *(pa.array(rows[n], t) for n, _, t in found)], names=schema.names)

    return files.select(*by, "path", "original", "edits", "final").mapInArrow(run, schema)


def hunks(old: str, new: str) -> tuple[list[tuple[int, int, list[str]]], int, int]:
    """Inserted runs (start, count, lines) of the new text, lines added and removed.
    Deletions inside a run do not split it, equal lines do."""
    a, b = line_tokens(old), line_tokens(new)
    same = align(a, b)
    kept = {j for _, j in same}
    out: list[tuple[int, int, list[str]]] = []
    for j, t in enumerate(b):
        if j in kept:
            continue
        if out and out[-1][0] - 1 + out[-1][1] == j:
            s, n, ls = out[-1]
            out[-1] = (s, n + 1, [*ls, t.rstrip("\n")])
        else:
            out.append((j + 1, 1, [t.rstrip("\n")]))
    return out, len(b) - len(kept), len(a) - len(same)


_DIFF = "struct<hunks:array<struct<new_start:bigint,new_count:bigint,content:array<string>>>,lines_added:bigint,lines_removed:bigint>"


def _diffs(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(old, new):
        h, added, removed = hunks(a or "", b or "")
        rows.append(([{"new_start": s, "new_count": n, "content": ls} for s, n, ls in h], added, removed))
    return pd.DataFrame(rows, columns=["hunks", "lines_added", "lines_removed"])


def line_diff(old: str, new: str):
    """Column of inserted hunks and counts between two text columns."""
    return F.pandas_udf(_diffs, _DIFF)(old, new)

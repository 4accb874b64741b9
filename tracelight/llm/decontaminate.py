"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of consecutive item words are the patterns. A text is normalised once
(A-Z lowered, runs of other ASCII signs to one blank), scanned once, and every
occurrence is mapped back to word numbers and to code points of the original.

The automaton reads two symbols a word, the digits of its number among the words of the items,
from two alphabets, so that it is never out of step; words of no item are one symbol of no
pattern. It has at most NODES nodes, of some 45 bytes each: items that would make more go in
blocks, and long items in parts that overlap by a window.

Nulls and empty texts have no words, hits or items. Items without words give no
window. Repeated rows are treated row by row; equal windows of several items
count for each of them. Extra columns are ignored. An empty benchmark leaves
every document clean.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import runtime as R

WINDOW = 10
#: Nodes of one automaton at most; 2 million take about 100 MB.
NODES = 2_000_000
_SYMBOLS = 2
_UNKNOWN = "\0" * _SYMBOLS
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(R.WORD_BYTES).split()


def _spelling(words: set[bytes]) -> dict[bytes, str]:
    """Two signs for every word: digits of its number, each place with signs of its own."""
    base = max(2, math.isqrt(len(words)) + 1)
    return {w: chr(1 + k // base) + chr(1 + base + k % base) for k, w in enumerate(sorted(words))}


class _Windows:
    """The automaton of some items and the spelling of their words."""

    def __init__(self, items):
        import ahocorasick

        listed = [(item, words_of(text)) for item, text in items]
        self.spelling = _spelling({w for _, words in listed for w in words})
        owners: dict[str, set] = {}
        for item, words in listed:
            spelled = [self.spelling[w] for w in words]
            for k in range(max(1, len(words) - WINDOW + 1) if words else 0):
                owners.setdefault("".join(spelled[k : k + WINDOW]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        same: dict[tuple, tuple] = {}
        for w, ids in owners.items():
            value = (len(w) // _SYMBOLS, tuple(sorted(ids)))
            self.automaton.add_word(w, same.setdefault(value, value))
        if owners:
            self.automaton.make_automaton()
        else:
            self.automaton = None


@functools.lru_cache(maxsize=1)
def _automaton(key: str, items: tuple) -> _Windows:
    return _Windows(items)


def scan(windows: _Windows, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged runs of hit words (first, end) and the items that occur."""
    if windows.automaton is None or not words:
        return [], set()
    get = windows.spelling.get
    found, items = [], set()
    for last, (n, ids) in windows.automaton.iter("".join([get(w, _UNKNOWN) for w in words])):
        found.append(((last + 1) // _SYMBOLS - n, (last + 1) // _SYMBOLS))
        items.update(ids)
    spans: list[list[int]] = []
    for first, end in sorted(found):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([first, end])
    return [(a, b) for a, b in spans], items


def original_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code-point offsets of the text they come from."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(R.WORD_BYTES))]
    out, byte, char = [], 0, 0
    for first, end in spans:
        pair = []
        for b in (at[first][0], at[end - 1][1]):
            char += len(text[byte:b].decode())
            byte = b
            pair.append(char)
        out.append(tuple(pair))
    return out


SCHEMA = "doc_id long, n_words long, hit_words array<struct<first:int,end:int>>, hit_chars array<struct<start:int,end:int>>, item_ids array<string>"


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The distinct items, long ones in parts, and the number of blocks that they make."""
    part = NODES // (WINDOW * _SYMBOLS) // 4  # windows of a part
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("words", F.regexp_extract_all(F.translate("text", R.UPPER, R.LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).where(F.size("words") > 0)
    windows = F.greatest(F.size("words") - WINDOW + 1, F.lit(1))
    rows = rows.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.floor((windows - 1) / part).cast("int"))).alias("k"))
    rows = rows.select("item_id", F.slice("words", F.col("k") * part + 1, part + WINDOW - 1).alias("words"))
    n = F.greatest(F.size("words") - WINDOW + 1, F.lit(1)) * F.least(F.size("words"), F.lit(WINDOW)) * _SYMBOLS
    total = rows.select(F.sum(n.cast("long"))).first()[0] or 0
    # blocks are dealt by hash: half full on average, so that none is over
    return rows.select("item_id", F.array_join("words", " ").alias("text")), 1 if total <= NODES else 2 * total // NODES + 1


def _blocks(rows: DataFrame, n: int):
    """The items in n blocks of bounded size, fetched one at a time; whoever takes them
    lets go of one before the next."""
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((r.item_id or "", r.text.encode()) for r in part.collect())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: word count, hit runs as words and as code points, items."""
    spark = docs.sparkSession
    R.prepare(spark)
    rows, n = _items(benchmark)
    docs = R.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    if n > 1:  # rows get a number that all scans agree on
        docs = R.stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    more = ["_row"] if n > 1 else []

    def scanned(items):
        sent = spark.sparkContext.broadcast(tuple(items))
        key = hashlib.sha256(repr(items).encode()).hexdigest()

        def run(batches):
            a = _automaton(key, sent.value)
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), R.utf8(b.column(1))):
                    words = words_of(text)
                    spans, ids = scan(a, words)
                    chars = original_spans(text, spans)
                    rows.append((doc, len(words), [{"first": x, "end": y} for x, y in spans], [{"start": x, "end": y} for x, y in chars], sorted(ids)))
                out = list(zip(*rows)) if rows else [[]] * 5
                pair = lambda x, y: pa.list_(pa.struct([(x, pa.int32()), (y, pa.int32())]))
                kinds = [pa.int64(), pa.int64(), pair("first", "end"), pair("start", "end"), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds)), *b.columns[2:]], names=["doc_id", "n_words", "hit_words", "hit_chars", "item_ids", *more])

        out = docs.mapInArrow(run, SCHEMA + (", _row long" if more else ""))
        if n > 1:  # what a block finds is written, so that one block is held at a time
            out = R.stored(out, "hits")
            sent.destroy()
        return out

    found = [scanned(items) for items in _blocks(rows, n)]
    if len(found) == 1:
        return found[0]
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  one list per block
    return out.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), union("hit_words").alias("hit_words"), union("hit_chars").alias("hit_chars"), union("item_ids").alias("item_ids")).drop("_row")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no window occurs, all columns kept. Rows are tested where
    they lie; every block of a large benchmark is one more pass over what is left."""
    spark = docs.sparkSession
    R.prepare(spark)
    at = docs.columns.index("text")

    def without(df, items):
        sent = spark.sparkContext.broadcast(tuple(items))
        key = hashlib.sha256(repr(items).encode()).hexdigest()

        def run(batches):
            a = _automaton(key, sent.value)
            for b in batches:
                keep = [k for k, t in enumerate(R.utf8(b.column(at))) if not scan(a, words_of(t))[1]]
                yield b.take(pa.array(keep, pa.int64()))

        return df.mapInArrow(run, df.schema)

    for items in _blocks(*_items(benchmark)):
        docs = without(docs, items)
    return docs


def hit_count(spans):
    """Words in the union of sorted runs; runs of several blocks may overlap."""
    step = lambda acc, x: F.struct((acc.n + F.greatest(x.end - F.greatest(x.first, acc.end), F.lit(0))).cast("long").alias("n"), F.greatest(acc.end, x.end).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda acc: acc.n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(R.table(spark, sf_dir, "documents"), R.table(spark, sf_dir, "benchmark"))
    n_hit = hit_count(F.col("hit_words"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: Windows are joined as word lists; each step is set-based, so DuckDB spreads it over its threads.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[k:k + least(len(words), 10) - 1], ' ') AS win FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM i WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
o AS (SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS k, words FROM w, sizes WHERE len(words) >= n),
h AS (SELECT o.doc_id, o.k, o.n, p.item_id FROM (SELECT doc_id, k, n, array_to_string(words[k:k + n - 1], ' ') AS win FROM o) o JOIN p ON p.n = o.n AND p.win = o.win),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

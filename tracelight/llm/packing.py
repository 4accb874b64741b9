"""Best-fit packing of token pieces into sequences of fixed capacity.

Pieces above a third of the capacity can share a sequence with one other such
piece at most. They are matched greedily, the largest first, each with the
largest that still fits, which pairs as many as can be paired. Smaller pieces
then go, largest first, into the tightest remaining gap.

Only lengths matter for the plan, so it is made from the histogram, which has as
many rows as the capacity at most. Pieces find their places by their rank among
those of equal length; ranks are counted per bucket of a length, so that a length
shared by a third of all pieces is not ranked in one task.

Null text is empty; an empty document has its end id alone. Repeated rows are
packed as often as they occur. An empty table gives no piece.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import runtime as R
from .tokens import END, encoder, tokenizer_path

CAPACITY = 4096


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """counts: length to number of pieces. Runs (length, first rank, number, per
    sequence, first sequence, first offset): the k-th piece of a run goes to
    sequence first + k // per, at offset + k % per * length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is outside of 1 to capacity")
    groups: dict[int, list] = {}  # gap: [(bins, [(length, per bin), ...])]
    gaps: list[int] = []

    def add(bins, gap, items):
        if bins:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((bins, items))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k < 0:
            add(left.pop(a), capacity - a, [(a, 1)])
            large.pop()
            continue
        b = large[k]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n == 0:  # a == b, and one is left: the next smaller partner
            b = large[k - 1] if k else 0
            n = min(left[a], left[b]) if b else 0
            if not n:
                add(left.pop(a), capacity - a, [(a, 1)])
                large.pop()
                continue
        add(n, capacity - a - b, [(a, 2)] if a == b else [(a, 1), (b, 1)])
        for x, used in ((a, 2 * n),) if a == b else ((a, n), (b, n)):
            left[x] -= used
            if not left[x]:
                del left[x]
                large.remove(x)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                per = min(c, capacity // n)
                add(c // per, capacity - per * n, [(n, per)])
                c %= per
                continue
            gap = gaps[k]
            bins, items = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(k)
            per = min(c, gap // n)
            used = min(bins, c // per)
            add(bins - used, gap, items)
            add(used, gap - per * n, [*items, (n, per)])
            c -= used * per
    runs, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for gap in gaps:
        for bins, items in groups[gap]:
            at = 0
            for n, per in items:
                runs.append((n, rank[n], bins * per, per, sequence, at))
                rank[n] += bins * per
                at += n * per
            sequence += bins
    return runs


def cut(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    R.prepare(docs.sparkSession)
    path = tokenizer or tokenizer_path()

    def run(batches):
        enc, end = encoder(path), struct.pack("<I", END)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(R.forgetting(lambda: encoder(path).forget(), run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    pieces = R.stored(cut(R.spread(docs.select("doc_id", "text")), capacity, tokenizer), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total = sum(histogram.values())
    buckets = max(16, total // 500_000)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    runs = np.array(sorted(plan(histogram, capacity)) or np.empty((0, 6)), np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(runs)
    key = [F.col("length"), F.col("bucket")]
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    # one row per length and bucket: bounded by capacity x buckets
    sizes = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    below = sizes.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("below"))
    ranked = placed.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32")) - 1).join(below, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("below") + F.col("k")).alias("rank"))

    def run(batches):
        r = sent.value
        starts = (r[:, 0] << 45) + r[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(starts, (length << 45) + rank, side="right") - 1
            n = rank - r[k, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(r[k, 4] + n // r[k, 3]), pa.array(r[k, 5] + n % r[k, 3] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(R.table(spark, sf_dir, "documents"))

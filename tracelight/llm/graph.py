"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import runtime as R

#: Rows of (node, minimum) that are broadcast at most: about 4 MB.
FEW = 250_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b), any orderable key type: (node, root) for every node that an
    edge names; root is the smallest node of its component.

    Alternating large-star and small-star steps: no group is collected, minima are
    combined before they are moved, and the number of edges does not grow. Each step is
    written out, so lineage stays short. Minima of a checked number are broadcast; more
    of them are a table, and as both sides of the join then come from a shuffle, Spark
    can split a hub's edges over tasks. The result is a stored table. Raises if it has not settled after `rounds`.
    """
    def written(df, n):
        """Small tables of a checked size go to few files."""
        return R.stored(df.coalesce(1 + n // 50_000) if n <= FEW else df, "edges")

    def result(df):
        out = df.select(F.col("a").alias("node"), F.col("b").alias("root"))
        out._tracelight_path = df._tracelight_path
        return out

    now = R.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def sign(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def minima(df, n):
        least = df.groupBy("a").agg(F.min("b").alias("m"))
        return F.broadcast(least) if n <= FEW else R.stored(least, "minima")

    before = sign(now)
    if not before[0]:
        return result(now)
    for _ in range(rounds):
        # large star: a node's larger neighbours join the smallest of its neighbourhood
        least = minima(now, before[0])
        moved = now.join(least.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = written(moved.distinct(), before[0])
        R.discard(least)
        R.discard(now)
        # small star: a node and its smaller neighbours join the smallest of them
        least = minima(large, before[0])
        moved = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).where("e.a <> e.b")
        now = written(moved.select("e.a", "e.b").distinct(), before[0])
        R.discard(least)
        R.discard(large)
        after = sign(now)
        if after == before:
            return result(now)
        before = after
    raise RuntimeError("components did not settle")

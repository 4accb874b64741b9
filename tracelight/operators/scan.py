"""Ordered scans of keys of any size.

A window holds all rows of a key in one task. Here rows are ranged over tasks by key and
place and cut into segments of so many rows, each segment is scanned alone, and one row a segment carries what the next one
begins with: its last value, its sum, its last known value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .tables import Scratch


#: Rows of a segment at most; a divisor of what sets the ids of two tasks apart.
SEGMENT = 1 << 16


class Scan:
    """Values along the order of a key's rows. Rows of the same place come in no set order."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str], segments: int | None = None, ranged: bool = False):
        """ranged: df is result(keep=True) of a scan in the same order, whose segments hold on."""
        if ranged:
            self.rows = df
        else:
            spark = df.sparkSession
            n = segments or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
            # written: the borders of a range are sampled, and must be the same for all that reads them
            ranged = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
            self.rows = Scratch(spark, "scan").write(ranged.withColumn("_seg", F.expr(f"monotonically_increasing_id() div {SEGMENT}")))
        self.by, self.order, self.columns = by, order, [c for c in df.columns if c != "_seg"]
        self.within: list[tuple[str, str, Column]] = []

    def lag(self, name: str, value: Column) -> "Scan":
        """The value of the row before."""
        self.within.append((name, "lag", value))
        return self

    def total(self, name: str, value: Column) -> "Scan":
        """The sum up to and with this row."""
        self.within.append((name, "sum", value))
        return self

    def known(self, name: str, value: Column) -> "Scan":
        """The last value that is not null, this row's included."""
        self.within.append((name, "last", value))
        return self

    def result(self, keep: bool = False) -> DataFrame:
        """keep: with the segments, for a scan of what this one found."""
        part = [*self.by, "_seg"]
        w = W.partitionBy(*part).orderBy(*self.order)
        so_far = w.rowsBetween(W.unboundedPreceding, 0)
        rows, ends, at = self.rows, [], F.struct(*self.order)
        for k, (_, kind, value) in enumerate(self.within):
            here = {"lag": F.lag(value).over(w), "sum": F.sum(value).over(so_far), "last": F.last(value, ignorenulls=True).over(so_far)}[kind]
            rows = rows.withColumn(f"_v{k}", here)
            # a struct, as a null may be the last value
            ends.append({"lag": F.max_by(F.struct(value.alias("v")), at), "sum": F.struct(F.sum(value).alias("v")), "last": F.max_by(F.when(value.isNotNull(), F.struct(value.alias("v"))), F.when(value.isNotNull(), at))}[kind].alias(f"_e{k}"))
        rows = rows.withColumn("_first", F.row_number().over(w) == 1)
        before = W.partitionBy(*self.by).orderBy("_seg") if self.by else W.orderBy("_seg")  # a row a segment
        earlier = before.rowsBetween(W.unboundedPreceding, -1)
        carry = self.rows.groupBy(*part).agg(*ends)
        for k, (_, kind, _) in enumerate(self.within):
            carry = carry.withColumn(f"_c{k}", F.lag(f"_e{k}").over(before)["v"] if kind == "lag" else F.sum(F.col(f"_e{k}.v")).over(earlier) if kind == "sum" else F.last(f"_e{k}", ignorenulls=True).over(earlier)["v"])
        carry = carry.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)], *[f"_c{k}" for k in range(len(self.within))])
        if not self.by:  # a row a segment: the rows stay where they are
            carry = F.broadcast(carry)
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(part)]
        out = rows.join(carry, [x for x in same] if len(same) > 1 else same[0], "left")
        values = []
        for k, (name, kind, _) in enumerate(self.within):
            own, carried = F.col(f"_v{k}"), F.col(f"_c{k}")
            value = F.when(F.col("_first"), carried).otherwise(own) if kind == "lag" else F.when(own.isNull(), carried).when(carried.isNull(), own).otherwise(own + carried) if kind == "sum" else F.coalesce(own, carried)
            values.append(value.alias(name))
        return out.select(*self.columns, *(["_seg"] if keep else []), *values)

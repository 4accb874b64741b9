"""Notes kept by commit: a table in buckets of the commit id.

A change rewrites the buckets of the commits that it names and no others; a lookup
reads one. Every bucket that was written holds a row without commit, so that one whose last
note goes is rewritten as well. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import finalize as FI


class NoteStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, commit_id: Column) -> Column:
        return F.pmod(F.xxhash64(commit_id), F.lit(self.buckets)).cast("int")

    def _raw(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], "commit_id string, note string, bucket int")
        return self.spark.read.schema("commit_id string, note string, bucket int").parquet(self.path)

    def read(self) -> DataFrame:
        """commit_id, note of all notes."""
        return self._raw().where("commit_id is not null").select("commit_id", "note")

    def lookup(self, *commit_ids: str) -> DataFrame:
        """The notes of some commits, out of their buckets alone; commits without one have no row."""
        at = self.spark.createDataFrame([(c,) for c in commit_ids], "c string").select(self._bucket(F.col("c"))).distinct().collect()
        return self._raw().where(F.col("bucket").isin(*[r[0] for r in at]) & F.col("commit_id").isin(*commit_ids)).select("commit_id", "note")

    def _rewrite(self, ids: DataFrame, new: DataFrame | None) -> None:
        """ids(commit_id) lose their notes, new(commit_id, note) come in."""
        touched = [r[0] for r in ids.select(self._bucket(F.col("commit_id"))).distinct().collect()]  # as many as there are buckets
        if not touched:
            return
        old = self._raw().where(F.col("bucket").isin(*touched)).where("commit_id is not null")
        rows = old.join(ids.select("commit_id").distinct(), "commit_id", "left_anti").select("commit_id", "note")
        if new is not None:
            rows = rows.unionByName(new.select("commit_id", "note"))
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(F.lit(None).cast("string").alias("commit_id"), F.lit(None).cast("string").alias("note"), "bucket")
        rows = rows.withColumn("bucket", self._bucket(F.col("commit_id"))).unionByName(marks)
        rows.repartition(min(len(touched), self.buckets), "bucket").sortWithinPartitions("bucket", "commit_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def upsert(self, new: DataFrame) -> DataFrame:
        """new(commit_id, note) replaces notes of the same commits; too large ones are
        refused and change nothing. Of several for a commit the largest text counts. Returns what
        was refused: commit_id, bytes."""
        one = new.groupBy("commit_id").agg(F.max("note").alias("note")).where("commit_id is not null")
        checked = FI.size_check(one)
        good = checked.where("status <> 'refused'").select("commit_id", "note")
        self._rewrite(good.select("commit_id"), good)
        return checked.where("status = 'refused'").select("commit_id", "bytes")

    def remove(self, ids: DataFrame) -> None:
        self._rewrite(ids.select("commit_id").where("commit_id is not null"), None)

    def copy(self, pairs: DataFrame, dry_run: bool = False) -> DataFrame:
        """pairs(source, target): source, target, outcome of each copy. A target that has a
        note keeps it, and a source without one is no error. The outcomes are those before the copy."""
        notes = self._raw().where("commit_id is not null").select("commit_id", "note")
        said = FI.copies(notes, pairs).select("source", "target", "outcome").collect() if dry_run else None
        if dry_run:
            return self.spark.createDataFrame(said, "source string, target string, outcome string")
        done = FI.copies(notes, pairs).where("outcome = 'copied'").groupBy("target").agg(F.min(F.struct("source", "note")).alias("m")).select(F.col("target").alias("commit_id"), F.col("m.note").alias("note"))
        out = FI.copies(notes, pairs).groupBy("outcome").agg(F.count("*").alias("n")).collect()  # three outcomes
        self._rewrite(done.select("commit_id"), done)
        return self.spark.createDataFrame(out, "outcome string, n long")

"""Tables between the steps of one operator."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_FOLDERS: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    """Folders that results still read go with the driver; those of a session that is over
    are left to whoever clears the shared one."""
    for spark, folder in _FOLDERS:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                p = spark._jvm.org.apache.hadoop.fs.Path(folder)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_clear)


class Scratch:
    """A folder of its own under spark.checkpoint.dir, which driver and executors share;
    only a local session without that setting gets a temporary one. Written tables cut
    the lineage, and survive lost executors; what no later step reads is dropped, the rest
    goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tracelight-")
        self.spark, self.folder, self.n = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", 0
        _FOLDERS.append((spark, self.folder))

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

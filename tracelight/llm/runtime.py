"""Shared folders, intermediate tables and Arrow helpers of the operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
#: Stored tables that are not discarded, and their sessions.
_KEPT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session that leaves the setting empty gets a temporary folder; on a
    cluster every executor would write to its own disk.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(sc.applicationId)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tracelight-")
    return f"{base.rstrip('/')}/tracelight/{name}-{uuid.uuid4().hex[:12]}"


def prepare(spark: SparkSession) -> None:
    """Ship this package to the workers and bound the Arrow batches by bytes. The
    settings must hold until the result is read, so they stay; where the session has
    values of its own, those are left."""
    sc = spark.sparkContext
    for name, default, value in (("maxBytesPerBatch", ("67108864b", "64MB"), "4m"), ("maxRecordsPerBatch", ("10000",), "2048")):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) in default:
            spark.conf.set(name, value)
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tracelight-"), "tracelight_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Within, a plan's shuffle files go when it has run. Only for plans whose result
    is in a file by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Bytes of stored tables up to which what is made of them goes to few files.
SMALL = 64 << 20


def _bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that stored() wrote."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tracelight_path)
    return int(p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def stored(df: DataFrame, name: str, codec: str = "zstd", of: tuple = ()) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a
    lost executor costs no recomputation. of: the stored tables that df is made of; if they
    are small together, df takes as many files as there are cores, not one a partition."""
    spark = df.sparkSession
    if of and sum(map(_bytes, of)) <= SMALL:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism))
    path = shared_dir(spark, name)
    with _shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracelight_path = path
    _KEPT[path] = spark
    return out


def _clear() -> None:
    """What results still read when the driver ends goes with it; a session that is
    over leaves its folders to whoever clears the shared one."""
    for path, spark in list(_KEPT.items()):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_clear)


def discard(df: DataFrame) -> None:
    """Remove a table that stored() wrote and that no later plan reads."""
    path = getattr(df, "_tracelight_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
        _KEPT.pop(path, None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(df: DataFrame, target_mb: int = 32) -> int:
    """Partitions for a shuffle of df: its estimated bytes over the target, and
    no fewer than the session's setting."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # estimates without statistics are as good as infinite: they get a bounded number
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min((size >> 20) // target_mb, 100_000) if size < 1 << 60 else 1, 1)


def _nodes(plan) -> set[str]:
    """Names of a plan's operators, as Spark's own nodes have them."""
    out, below = {plan.nodeName()}, plan.children()
    for k in range(below.size()):
        out |= _nodes(below.apply(k))
    return out


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a small or unsplittable input has fewer partitions than
    the cluster has cores; the shuffle then costs less than the idle cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if any("Exchange" in n or "Join" in n for n in _nodes(df._jdf.queryExecution().sparkPlan())):
        return df  # dealt out already; counting its partitions could run its stages
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def free(df: DataFrame, name: str) -> str:
    """The name, with signs after it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def forgetting(clear, run):
    """A worker's batch function that lets go of the tables it has filled when its task
    ends: workers are kept for later stages, and would hold those of all stages at once."""

    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            clear()

    return to_the_end


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def local_fs(path: str):
    """(pyarrow filesystem, path in it) of a shared folder, for workers that
    write or range-read files of a format of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def crc_mod(column, m: int):
    """crc32(id as text) mod m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % m


#: for translate() in columns
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: lower-cases A-Z and turns what is no word byte (ASCII but digits and letters) into blanks
WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
#: lower-cases A-Z only
LOWER_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) for c in range(256))

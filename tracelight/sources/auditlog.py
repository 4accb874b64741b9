"""An audit log that grows: JSON lines in the order in which they were appended.

The log is a folder with a folder per append, numbered, or any file or folder of JSON
lines. The place of an event is its line among all lines of the log's files, in the order of
their names, counted per block of a file, so that no task reads more than its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import schemas as S
from ..operators import audit as AU

_FOLDER = "append="


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, file, line, value): lines of text files with their place among all of them
    and in their file, both from 1. A block is read by one task, whose ids run on in it, and
    is left where it is; one row a block gives its first id and what stands before it."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_row"))
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("_row").alias("_start"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "_start", before(W.orderBy("file", "block")).alias("above"), before(W.partitionBy("file").orderBy("block")).alias("above_in_file"))
    k = F.col("_row") - F.col("_start") + 1
    return raw.join(F.broadcast(blocks), ["file", "block"]).select((F.col("above") + k).cast("long").alias("seq"), "file", (F.col("above_in_file") + k).cast("long").alias("line"), "value")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events with their place as seq. Blank lines are skipped and keep their number;
    a line that is no event fails the read, with its number; a log that is not there is empty."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], S.AUDIT + ", seq bigint")
    rows = placed_lines(spark, path).where(F.trim("value") != "")
    parsed = rows.select("seq", "file", "line", F.from_json("value", S.AUDIT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    wrong = F.col("e").isNull() | F.col("e._bad").isNotNull() | F.col("e.event").isNull() | F.col("e.timestamp").isNull()
    refuse = F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"), F.lit(" is no audit event")))
    checked = parsed.withColumn("event", F.when(wrong, refuse).otherwise(F.col("e.event")))
    return checked.select(*["event" if c == "event" else f"e.{c}" for c in S.AUDIT_FIELDS], "seq")


def _appends(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders of finished appends, in order."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory() and f.getPath().getName().startswith(_FOLDER)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(n for n in names if done(n))


def append(events: DataFrame, path: str, chain: bool = False) -> None:
    """Appends events in the order of seq; details that are null are left out. An append
    is a folder of its own that must be new, so of two writers at a time one fails. chain: events
    carry on the hash of the last one in the log; hashes depend on each other, so one task
    streams them, in packs that many tasks have sorted; else they are ranged over tasks."""
    spark = events.sparkSession
    done = _appends(spark, path)
    target = f"{path.rstrip('/')}/{_FOLDER}{int(done[-1].removeprefix(_FOLDER)) + 1 if done else 0:012d}"
    if chain:
        last = read(spark, f"{path.rstrip('/')}/{done[-1]}").orderBy(F.desc("seq")).select("event_hash").first() if done else None
        rows = AU.chained(events.withColumn("_log", F.lit("log")), "_log", {"log": last.event_hash} if last else None, wide=True)
    else:
        rows = events.repartitionByRange("seq").sortWithinPartitions("seq")
    rows.select(*[c for c in S.AUDIT_FIELDS if c in rows.columns]).write.mode("errorifexists").json(target)

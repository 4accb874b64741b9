"""The audit log: filters and the hash chain."""

from __future__ import annotations

import hashlib
import json
import zlib

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schemas import AUDIT, AUDIT_EVENTS, AUDIT_FIELDS
from .scan import Scan

#: The keys of an event in the order in which they are hashed.
HASHED = ("commit", "commit_count", "event", "field", "format", "pattern_name", "prev_hash", "reason", "redaction_count", "timestamp", "user")


def audit(log: DataFrame, since: str | None = None, event: str | None = None, limit: int | None = 50) -> DataFrame:
    """Newest first by timestamp text, then in log order; unreadable times fail `since`."""
    if event is not None:
        if event not in AUDIT_EVENTS:
            raise ValueError(f"{event!r} is none of {', '.join(AUDIT_EVENTS)}")
        log = log.where(F.col("event") == event)
    if since is not None:
        log = log.where(F.try_to_timestamp("timestamp") >= F.lit(since).cast("timestamp"))
    if limit is None:
        return log
    return log.orderBy(F.desc("timestamp"), "seq").limit(limit)


def event_hash(df: DataFrame) -> Column:
    """First 32 hex digits of SHA-256 over compact JSON, keys sorted, nulls left out."""
    present = [F.col(c) for c in HASHED if c in df.columns]
    return F.substring(F.sha2(F.to_json(F.struct(*present)), 256), 1, 32)


def verify_chain(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per log (or group of `by`): whether the chain holds, and the first bad seq.
    The first event has no prev_hash; every later one names its predecessor's; a
    stored hash must equal the recomputed one, and rows without one skip that test."""
    if by:
        w = W.partitionBy(*by).orderBy("seq")
        rows = log.withColumn("_own", event_hash(log)).withColumn("_before", F.lag("event_hash").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    else:  # one log of any length: its parts are scanned side by side
        by = []
        rows = Scan(log.withColumn("_own", event_hash(log)), [], ["seq"]).lag("_before", F.col("event_hash")).lag("_there", F.lit(True)).result().withColumn("_first", F.col("_there").isNull())
    linked = F.when(F.col("_first"), F.col("prev_hash").isNull()).otherwise(F.col("prev_hash").eqNullSafe(F.col("_before")))
    good = linked & (F.col("event_hash").isNull() | (F.col("event_hash") == F.col("_own")))
    return rows.groupBy(*by).agg(F.coalesce(F.bool_and(good), F.lit(True)).alias("valid"), F.min(F.when(~good, F.col("seq"))).alias("first_bad"), F.count("*").alias("events"))


def _hashed(batch, by: int, last: dict, log, before):
    """A batch of events in order with prev_hash and event_hash, and the log and hash that end it."""
    import pyarrow as pa

    names = batch.schema.names
    used = {k: batch.column(names.index(k)).to_pylist() for k in HASHED if k in names}
    prev, own = [], []
    for i, of in enumerate(batch.column(by).to_pylist()):
        if of != log:
            log, before = of, last.get(of)
        body = {k: (int(v) if isinstance(v, float) and v == int(v) else v) for k, c in used.items() if (v := c[i]) is not None and v == v}
        if before is not None:
            body["prev_hash"] = before
        prev.append(before)
        before = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:32]
        own.append(before)
    hashes = [pa.array(prev, pa.string()), pa.array(own, pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *hashes], names=[*names, "prev_hash", "event_hash"]), log, before


def chained(events: DataFrame, by: str = "stream", last: dict | None = None, wide: bool = False) -> DataFrame:
    """Adds prev_hash and event_hash to new events of each log, in seq order. A hash
    depends on the one before, so each log is folded by one task; logs run side by
    side and rows are streamed. last: hash that ends a log so far. wide: a log may be of any
    length; it is sorted by many tasks, and comes packed to the one that folds it, which
    orders packs of thousands of events and opens them one by one."""
    last = last or {}
    names = [c for c in events.columns if c not in ("prev_hash", "event_hash")]
    events, at = events.select(*names), names.index(by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", prev_hash string, event_hash string"

    def fold(batches):
        log, before = None, None
        for b in batches:
            out, log, before = _hashed(b, at, last, log, before)
            yield out

    if not wide:
        return events.repartition(by).sortWithinPartitions(by, "seq").mapInArrow(fold, schema)
    seq = names.index("seq")

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            logs = b.column(at).to_pylist()
            cuts = [0, *(i for i in range(1, len(logs)) if logs[i] != logs[i - 1]), len(logs)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema) as w:
                        w.write_batch(b.slice(i, j - i))
                    ends = [b.column(seq).slice(k, 1) for k in (i, j - 1)]
                    packed = pa.array([zlib.compress(sink.getvalue().to_pybytes(), 1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(at).slice(i, 1), *ends, packed], names=[by, "_first", "_last", "_packed"])

    def fold_packed(batches):
        import pyarrow as pa

        # one pack at a time
        yield from fold(b for p in batches for k in range(p.num_rows) for b in pa.ipc.open_stream(zlib.decompress(p.column(3)[k].as_py())))

    kind = lambda c: events.schema[c].dataType.simpleString()
    packs = events.repartitionByRange(by, "seq").sortWithinPartitions(by, "seq").mapInArrow(pack, f"`{by}` {kind(by)}, _first {kind('seq')}, _last {kind('seq')}, _packed binary")
    return packs.repartition(by).sortWithinPartitions(by, "_first", "_last").mapInArrow(fold_packed, schema)


def event(spark, kind: str, timestamp: str, **details) -> DataFrame:
    """One event as a row of the log's schema; unknown details are refused."""
    if kind not in AUDIT_EVENTS:
        raise ValueError(kind)
    unknown = set(details) - set(AUDIT_FIELDS)
    if unknown:
        raise ValueError(f"unknown details: {sorted(unknown)}")
    return spark.createDataFrame([tuple({"timestamp": timestamp, "event": kind, **details}.get(n) for n in AUDIT_FIELDS)], AUDIT)


def deleted(spark, timestamp: str, commit: str, reason: str, user: str | None = None) -> DataFrame:
    return event(spark, "delete", timestamp, commit=commit, reason=reason, user=user)


def exported(spark, timestamp: str, format: str, commit_count: int, user: str | None = None) -> DataFrame:
    return event(spark, "export", timestamp, format=format, commit_count=commit_count, user=user)


def retention_applied(spark, timestamp: str, commit_count: int, reason: str, user: str | None = None) -> DataFrame:
    return event(spark, "retention_apply", timestamp, commit_count=commit_count, reason=reason, user=user)


def config_changed(spark, timestamp: str, field: str, reason: str, user: str | None = None) -> DataFrame:
    return event(spark, "config_change", timestamp, field=field, reason=reason, user=user)


def redactions(counts: DataFrame, timestamp: str) -> DataFrame:
    """counts(pattern_name, n): an event per pattern, of no user."""
    none = lambda c: F.lit(None).cast("bigint" if c.endswith("count") else "string").alias(c)
    known = {"timestamp": F.lit(timestamp), "event": F.lit("redaction"), "pattern_name": F.col("pattern_name"), "redaction_count": F.col("n")}
    return counts.select(*[known[c].alias(c) if c in known else none(c) for c in AUDIT_FIELDS])

"""Queries over tables that grow: the audit log and the note store, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as AU
from ..operators.tables import Scratch
from ..sources import auditlog, projection as P
from ..sources.notes import NoteStore
from . import sql as Q
from .registry import op


@op("K8_append_and_read", f"WITH {Q.AUDIT} SELECT row_number() OVER (ORDER BY seq % 3, seq) AS seq, timestamp, event, user FROM audit")
def _(spark, d):
    """Three appends, read back in the order in which they came."""
    folder, log = Scratch(spark, "audit").folder, P.audit_log(spark, d)
    for k in range(3):
        auditlog.append(log.where(F.col("seq") % 3 == k), folder)
    return auditlog.read(spark, folder).select("seq", "timestamp", "event", "user")


@op("W12_one_log", f"WITH {Q.AUDIT} SELECT k AS log, k = 0 AS valid, CASE WHEN k = 1 THEN 701 END AS first_bad, count(*) AS events FROM audit, (SELECT unnest([0, 1]) AS k) GROUP BY k")
def _(spark, d):
    """One chain of all events, appended in two parts; in its copy the 701st names no predecessor."""
    folder, log = Scratch(spark, "audit").folder, P.audit_log(spark, d)
    auditlog.append(log.where("seq < 500"), folder, chain=True)
    auditlog.append(log.where("seq >= 500"), folder, chain=True)
    rows = auditlog.read(spark, folder).select("seq", "timestamp", "event", "user", "prev_hash", "event_hash")
    torn = rows.withColumn("prev_hash", F.when(F.col("seq") != 701, F.col("prev_hash")))
    of = lambda k, df: AU.verify_chain(df).select(F.lit(k).alias("log"), "valid", "first_bad", "events")
    return of(0, rows).unionByName(of(1, torn))


_STORE = """n AS (SELECT CAST(o_orderkey AS VARCHAR) AS commit_id, 'note ' || o_custkey AS note, o_orderkey AS k, o_custkey AS c FROM orders)"""


def _store(spark, d) -> NoteStore:
    """All orders' notes; then those of some customers are written anew, others removed."""
    s = NoteStore(spark, Scratch(spark, "notes").folder, 16)
    n = P.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("commit_id"), F.concat(F.lit("note "), F.col("o_custkey").cast("string")).alias("note"), F.col("o_custkey").alias("c"))
    s.upsert(n.where("c % 3 > 0"))
    s.upsert(n.where("c % 3 < 2").withColumn("note", F.concat("note", F.lit(" again"))))
    s.remove(n.where("c % 5 = 0"))
    return s


@op("K1_note_store", f"WITH {_STORE} SELECT commit_id, note || CASE WHEN c % 3 < 2 THEN ' again' ELSE '' END AS note FROM n WHERE c % 5 <> 0")
def _(spark, d):
    return _store(spark, d).read()


@op("S1_note_lookup", f"WITH {_STORE}, p AS (SELECT o_orderkey FROM orders WHERE o_custkey % 5 <> 0 ORDER BY o_orderkey LIMIT 3) SELECT commit_id, note || CASE WHEN c % 3 < 2 THEN ' again' ELSE '' END AS note FROM n WHERE k IN (FROM p)")
def _(spark, d):
    first = P.table(spark, d, "orders").where("o_custkey % 5 <> 0").orderBy("o_orderkey").limit(3).collect()  # the commits asked for
    return _store(spark, d).lookup(*[str(r.o_orderkey) for r in first], "no such commit")

"""The audit log, the note store, ordered scans and the sink of commits."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tests.test_capture import commit, edit, plain
from tracelight.operators import annotations as AN, attribution as AT, audit as AU, retention as RE
from tracelight.operators.scan import Scan
from tracelight.sources import auditlog, readers
from tracelight.sources.notes import NoteStore
from tracelight.streaming import capture, commits as CO


@pytest.mark.parametrize("segments", [1, 7])
def test_scan(spark, segments):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, 1, 2, 3])) for k in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "k string, at long, x long")
    got = Scan(df, ["k"], ["at"], segments).lag("lag", F.col("x")).total("sum", F.col("x")).known("last", F.col("x")).result().collect()
    want = []
    for key in ("a", "b", None):
        before, total, last = None, None, None
        for _, at, x in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            total, last = total if x is None else (total or 0) + x, last if x is None else x
            want.append((key, at, x, before, total, last))
            before = x
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert Scan(df.limit(0), [], ["at"]).lag("lag", F.col("x")).result().collect() == []


def log_rows(spark, first, n):
    return spark.createDataFrame([(k, f"2024-01-01T00:00:{k % 60:02d}Z", "export", "json", k) for k in range(first, first + n)], "seq long, timestamp string, event string, format string, commit_count long").repartition(5)


def test_log_of_many_appends(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert auditlog.read(spark, path).collect() == []
    for first, n in ((0, 500), (500, 2), (502, 40)):
        readers.auditlog.append(log_rows(spark, first, n), path)
    got = auditlog.read(spark, path).orderBy("seq").collect()
    assert [r.commit_count for r in got] == list(range(542)) and [r.seq for r in got] == list(range(1, 543))
    assert AU.audit(auditlog.read(spark, path), limit=2).first().commit_count == 59


def test_chain_over_appends(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for first, n in ((0, 30), (30, 1), (31, 400)):
        auditlog.append(log_rows(spark, first, n), path, chain=True)
    log = auditlog.read(spark, path)
    assert AU.verify_chain(log).first().asDict() == {"valid": True, "first_bad": None, "events": 431}
    assert AU.verify_chain(log.where("seq <> 200")).first().first_bad == 201
    assert AU.verify_chain(log.withColumn("reason", F.when(F.col("seq") == 77, "x"))).first().first_bad == 77


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"timestamp":"t","event":"delete"}\n\n{"timestamp":"t","event":\n')
    with pytest.raises(Exception, match="line 3 of file:.*a.jsonl"):
        auditlog.read(spark, f"file://{tmp_path}").collect()
    (tmp_path / "a.jsonl").write_text('{"timestamp":"t","event":"delete"}\n{"event":"delete"}\n')
    with pytest.raises(Exception, match="line 2 of file:.*a.jsonl"):
        auditlog.read(spark, f"file://{tmp_path}").collect()


def test_places_over_blocks(spark, tmp_path):
    """Files of several blocks each, of which the larger ones are read first."""
    want = []
    for f, n in (("a", 30), ("b", 4000), ("c", 1200)):
        lines = [f"{f}{k} " + "x" * (k % 40) for k in range(n)]
        (tmp_path / f"{f}.txt").write_text("\n".join(lines) + "\n")
        want += [(f"{f}.txt", k + 1, x) for k, x in enumerate(lines)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = auditlog.placed_lines(spark, f"file://{tmp_path}").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(os.path.basename(r.file), r.line, r.value) for r in got] == want and [r.seq for r in got] == list(range(1, len(want) + 1))


def test_typed_events(spark):
    e = AU.deleted(spark, "t", "c1", "old", "me").unionByName(AU.exported(spark, "t", "csv", 3)).unionByName(AU.retention_applied(spark, "t", 2, "r")).unionByName(AU.config_changed(spark, "t", "f", "r"))
    e = e.unionByName(AU.redactions(spark.createDataFrame([("EMAIL", 2)], "pattern_name string, n long"), "t"))
    assert [(r.event, r.commit, r.reason, r.format, r.commit_count, r.pattern_name, r.redaction_count, r.user, r.field) for r in e.collect()] == [
        ("delete", "c1", "old", None, None, None, None, "me", None), ("export", None, None, "csv", 3, None, None, None, None), ("retention_apply", None, "r", None, 2, None, None, None, None),
        ("config_change", None, "r", None, None, None, None, None, "f"), ("redaction", None, None, None, None, "EMAIL", 2, None, None),
    ]


# --- notes


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_note_store(spark, tmp_path):
    path = str(tmp_path / "notes")
    s = NoteStore(spark, f"file://{path}", 32)
    assert s.read().collect() == [] and s.lookup("c1").collect() == []
    notes = lambda rows: spark.createDataFrame(rows, "commit_id string, note string")
    assert s.upsert(notes([(f"c{k}", f"n{k}") for k in range(300)])).collect() == []
    before = files_of(path)
    refused = s.upsert(notes([("c7", "new"), ("c7", "newer"), ("big", "x" * (5 << 20)), (None, "lost")])).collect()
    assert [(r.commit_id, r.bytes) for r in refused] == [("big", 5 << 20)]
    # one bucket's file is another one now
    assert len(before - files_of(path)) == 1 and len(files_of(path) - before) == 1
    assert s.lookup("c7", "c8", "big", "none").orderBy("commit_id").collect() == [("c7", "newer"), ("c8", "n8")] and s.read().count() == 300
    plan = s.lookup("c7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    before = files_of(path)
    s.remove(notes([("c7", None), ("c8", None)]))
    assert s.read().count() == 298 and 1 <= len(before - files_of(path)) <= 2
    pairs = spark.createDataFrame([("c1", "d1"), ("c2", "c3"), ("gone", "d2")], "source string, target string")
    assert {(r.source, r.outcome) for r in s.copy(pairs, dry_run=True).collect()} == {("c1", "copied"), ("c2", "exists"), ("gone", "missing")} and s.read().count() == 298
    assert {r.outcome: r.n for r in s.copy(pairs).collect()} == {"copied": 1, "exists": 1, "missing": 1}
    assert s.lookup("d1").first().note == "n1" and s.lookup("c3").first().note == "n3"
    # a bucket whose last note goes
    t = NoteStore(spark, f"file://{path}2", 4)
    t.upsert(notes([("a", "1")]))
    t.remove(notes([("a", None)]))
    assert t.read().collect() == []


def test_commit_sink(spark, tmp_path):
    """A stream's commits become notes, once; a batch that comes again changes nothing."""
    events = [
        edit("r", 1, "f", "p", None, "a\nb\n"), edit("r", 2, "f", "q", None, "a\nb\nc\n", plan=True), edit("r", 3, "g", "q", "old\n", "old\nnew\n", depth=1), edit("r", 4, "dead", "q", None, "x"), commit("r", 5, ["f", "dead", "g2"], {"g": "g2"}),
        edit("r", 6, "f", "s", "a\nb\nc\n", "z\n"), commit("r", 7, ["f"]),
    ]
    versions = spark.createDataFrame([("c5", "f", "a\nB here\nc\nhuman\n"), ("c5", "g2", "old\nnew\n"), ("c5", "dead", None), ("c7", "f", "z\n")], "commit_id string, path string, content string")
    store = NoteStore(spark, f"file://{tmp_path}/notes", 4)
    seen = []
    inner = CO.commit_sink(store, lambda: versions)

    def sink(batch, batch_id):
        rows = batch.collect()
        seen.append((spark.createDataFrame(rows, batch.schema), batch_id))
        inner(batch, batch_id)

    spark.createDataFrame(events, capture.EVENT).coalesce(1).write.json(f"file://{tmp_path}/in")
    q = capture.capture_stream(spark.readStream.schema(capture.EVENT).json(f"file://{tmp_path}/in")).writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    notes = {r.commit_id: json.loads(r.note) for r in store.read().collect()}
    assert set(notes) == {"c5", "c7"} and [f["path"] for f in notes["c5"]["files"]] == ["f", "g2"]
    head = notes["c5"]["session"]
    assert (notes["c5"]["version"], head["used_plan_mode"], head["subagent_count"], head["prompt_count"]) == (3, True, 1, 2)
    assert [(p["index"], p["text"], p["affected_files"]) for p in notes["c5"]["prompts"]] == [(0, "p", ["f"]), (1, "q", ["f", "g"])]
    # the lines are those of the operator on the same edits
    taken = [r for r in plain(events)[0] if r[1] == "c5" and r[3] == "f"]
    files = spark.createDataFrame([("c5", "f", taken[0][8], [(str(k), r[6], r[9]) for k, r in enumerate(taken)], "a\nB here\nc\nhuman\n")], "commit_id string, path string, original string, edits array<struct<edit_id:string,prompt_index:long,after:string>>, final string")
    want = [(r.line_number, r.content, r.source_type, r.prompt_index) for r in AT.three_way(files, ["commit_id"]).orderBy("line_number").collect()]
    assert [(x["line_number"], x["content"], x["source"]["type"], x["prompt_index"]) for x in notes["c5"]["files"][0]["lines"]] == want
    # as the readers see them
    parsed = readers.notes(store.read())
    assert readers.note_files(parsed).count() == 3 and readers.note_lines(parsed).count() == 7 and readers.note_prompts(parsed).count() == 3
    before = sorted(map(tuple, store.read().collect()))
    for batch, batch_id in seen:
        inner(batch, batch_id)
    assert sorted(map(tuple, store.read().collect())) == before
    # retention after a commit, and again
    commits = spark.sql("select 1L commit_key, 'c5' commit_id, timestamp_ntz'2020-01-01 00:00:00' committed_at union all select 2L, 'c7', timestamp_ntz'2024-01-01 00:00:00'")
    parents = spark.createDataFrame([(2, 1)], "commit_key long, parent_key long")
    refs = spark.createDataFrame([], "ref_name string, commit_key long")
    gone = []
    purge = CO.purge_by(RE.Policy(max_age_days=30, min_commits=1), lambda: commits, lambda: parents, lambda: refs, lambda: "2024-01-10 00:00:00")
    purging = CO.commit_sink(store, lambda: versions, purge, lambda ids, _: gone.append([r.commit_id for r in ids.collect()]))
    for _ in range(2):
        purging(seen[0][0].limit(0), 9)
    assert gone == [["c5"]] and [r.commit_id for r in store.read().collect()] == ["c7"]


def test_overlap_by_blocks(spark):
    rng = random.Random(9)
    span = lambda n: (lambda a: (a, a + rng.randrange(n)))(rng.randrange(3000))
    groups = [(rng.choice(["f", "g", None]), *span(700), k % 3) for k in range(150)] + [("f", 5, 4, 0)]
    ranges = [(rng.choice(["f", "f", None]), *span(5)) for _ in range(60)] + [("f", 100, 900)]
    g = spark.createDataFrame(groups + groups[:5], "path string, start_line long, end_line long, extra long")
    r = spark.createDataFrame(ranges, "path string, range_start long, range_end long")
    want = [x for x in groups + groups[:5] if x[1] <= x[2] and any(x[0] == p and x[1] <= e and x[2] >= s for p, s, e in ranges)]
    got = AN.in_ranges(g, r, ["path"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "_block" in plan

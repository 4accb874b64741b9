import random

import pytest
from pyspark.sql import functions as F

from tracelight.operators import annotations as AN, audit as AU, diffview as DV, export as EX, finalize as FI, graph as GR, history as HI, retention as RE
from tracelight.sources import readers
from tracelight.streaming import capture


def test_islands(spark):
    rows = [(1, "AI", None), (2, "AI", 5), (3, "AIModified", 5), (5, "AI", 1), (6, "Human", None), (7, "AIModified", 2)]
    df = spark.createDataFrame([("f", *r) for r in rows], "path string, line_number long, source_type string, prompt_index long")
    got = sorted((r.group_type, r.start_line, r.end_line, r.prompt_index) for r in AN.line_groups(df, ["path"]).collect())
    assert got == [("AI", 1, 2, 5), ("AI", 5, 5, 1), ("AIModified", 3, 3, 5), ("AIModified", 7, 7, 2)]
    got = sorted((r.start_line, r.end_line, r.ai_count, r.modified_count) for r in AN.line_groups(df, ["path"], group_types=True).collect())
    assert got == [(1, 3, 2, 1), (5, 5, 1, 0), (7, 7, 0, 1)]
    assert AN.line_groups(df, ["path"], ai_only=True, min_lines=2).count() == 1


def test_overlap(spark):
    g = spark.createDataFrame([("f", 12, 18), ("f", 5, 15), ("f", 18, 25), ("f", 22, 28), ("g", 12, 18)], "path string, start_line long, end_line long")
    r = spark.createDataFrame([("f", 10, 20)], "path string, range_start long, range_end long")
    assert sorted(x.start_line for x in AN.in_ranges(g, r, ["path"]).collect()) == [5, 12, 18]


def test_score(spark):
    df = spark.createDataFrame([(1.0, 120, True), (0.5, 10, False)], "coverage double, ai_total long, is_new_file boolean")
    assert [r.s for r in df.select(AN.score(F.lit(True)).alias("s")).collect()] == [100.0, 38.0]


def test_days(spark):
    assert str(EX.day("2024-02-29")) == "2024-02-29"
    for bad in ("2023-02-29", "2024-02-30", "2024/01/15", "2024-01"):
        with pytest.raises(ValueError):
            EX.day(bad)
    df = spark.sql("select timestamp_ntz'2024-01-15 23:59:59' t union all select timestamp_ntz'2024-01-16 00:00:00'")
    assert EX.in_days(df, "t", "2024-01-15", "2024-01-15").count() == 1
    with pytest.raises(ValueError):
        EX.in_days(df, "t", "2024-02-01", "2024-01-01")


def test_retention_keeps_newest(spark):
    df = spark.sql("select id commit_key, concat('c', id) commit_id, timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(id) committed_at, false is_retained, true is_old from range(3)")
    got = {r.commit_id: r.keep for r in RE.sets(df, 2).collect()}
    assert got == {"c0": False, "c1": True, "c2": True}


def test_retention_partition(spark):
    df = spark.sql("select id commit_key, lpad(hex(id), 8, '0') commit_id, timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) committed_at, id % 997 = 0 is_retained, id < 4000 is_old from range(5000)")
    got = RE.sets(df, 1500)
    keep = got.where("keep").count()
    assert keep >= 1500 and got.count() == 5000 and got.select("commit_id").distinct().count() == 5000


def test_ancestors(spark):
    edges = spark.createDataFrame([(k, k - 1) for k in range(1, 130)] + [(5, 200), (200, 3)], "commit_key long, parent_key long")
    head = spark.createDataFrame([(6,)], "commit_key long")
    assert sorted(r.commit_key for r in GR.ancestors(edges, head).collect()) == [0, 1, 2, 3, 4, 5, 6, 200]
    base = spark.createDataFrame([(4,)], "commit_key long")
    assert sorted(r.commit_key for r in GR.commit_range(edges, base, head).collect()) == [5, 6, 200]


def test_chain(spark):
    ev = spark.createDataFrame([("a", k, "delete", f"2024-01-0{k + 1}T00:00:00Z", "abc") for k in range(3)] + [("b", 0, "export", "2024-01-01T00:00:00Z", None)], "stream string, seq long, event string, timestamp string, commit string")
    done = AU.chained(ev)
    assert all(r.valid for r in AU.verify_chain(done, ["stream"]).collect())
    torn = done.withColumn("prev_hash", F.when(F.col("seq") == 1, "bad").otherwise(F.col("prev_hash")))
    assert {r.stream: (r.valid, r.first_bad) for r in AU.verify_chain(torn, ["stream"]).collect()} == {"a": (False, 1), "b": (True, None)}


def test_audit_log(spark, tmp_path):
    p = tmp_path / "audit.jsonl"
    assert readers.audit_log(spark, f"file://{p}").count() == 0
    p.write_text('{"timestamp":"2024-01-01T00:00:00Z","event":"delete","commit":"x"}\n\n{"timestamp":"2024-01-02T00:00:00Z","event":"export"}\n')
    log = readers.audit_log(spark, f"file://{p}")
    assert [r.event for r in AU.audit(log).collect()] == ["export", "delete"]
    assert AU.audit(log, since="2024-01-02T00:00:00Z").count() == 1 and AU.audit(log, event="delete").count() == 1
    p.write_text('{"timestamp": \n')
    with pytest.raises(Exception):
        readers.audit_log(spark, f"file://{p}").collect()


def test_resolve(spark):
    pending = spark.createDataFrame([("c", "old"), ("c", "same"), ("c", "other")], "commit_id string, path string")
    ch = spark.createDataFrame([("c", 0, "R", "old", "new"), ("c", 1, "R", "old", "later"), ("c", 0, "M", "same", "same")], "commit_id string, parent_idx int, status string, old_path string, new_path string")
    got = {r.path: r.resolved for r in FI.resolve(pending, ch).collect()}
    assert got == {"old": "new", "same": "same", "other": None}


def test_pending_validation(spark, tmp_path):
    ok = '{"version":3,"prompt_counter":0,"session":{"session_id":"123e4567-e89b-12d3-a456-426614174000","prompt_count":0,"prompts":[]},"file_histories":{}}'
    (tmp_path / "a.json").write_text(ok)
    (tmp_path / "b.json").write_text(ok.replace('"version":3', '"version":9'))
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.json").write_text(ok.replace('"prompt_count":0', '"prompt_count":2'))
    good, bad = readers.pending(spark, f"file://{tmp_path}")
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["malformed", "prompt count mismatch", "unsupported version"]


def test_diff(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n a\n---b\n+++c\n+d\n\\ No newline\n@@ -9 +20 @@\n+e"
    df = readers.diff_lines(spark.createDataFrame([(1, text)], "id int, text string"), ["id"])
    got = [(r.text, r.kind, r.line_no) for r in DV.parse(df, ["id"]).where("kind <> 'header'").orderBy("n").collect()]
    assert got == [(" a", "context", 1), ("---b", "removed", None), ("+++c", "added", 2), ("+d", "added", 3), ("\\ No newline", "marker", None), ("+e", "added", 20)]
    b = spark.createDataFrame([("x", 2, "AI", "abcdefghij", None), ("x", 20, "AIModified", "abcdefghij", 0.8)], "path string, line_no long, source_type string, edit_id string, similarity double")
    got = [r.text for r in DV.annotated(df, b, ["id"], verbose=True).orderBy("n").collect()]
    assert got[6] == "● +++c  # AI: abcdefgh" and got[7] == "+d" and got[10] == "◐ +e  # AI-mod(80%): abcdefgh"


def test_transcripts(spark):
    lines = [
        '{"type":"user","message":{"content":"first"}}', '{"type":"assistant","tool_name":"EnterPlanMode"}', '{"type":"user","message":{"content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}}',
        '{"type":"user","toolUseResult":{"x":1},"message":{"content":"tool"}}', '{"type":"user","isCompactSummary":true,"message":{"content":"summary"}}', '{"agentId":"z","tool_name":"Task"}',
    ]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(lines)], "id int, n int, value string")
    p = readers.transcript_lines(df, ["id"])
    assert readers.last_prompt(p, ["id"]).first().prompt == "a b"
    assert readers.context(p, ["id"]).first()[1:] == (True, True, 1)


def test_history(spark):
    rows = [("f", 1, None, "a\n", "p"), ("f", 2, "ignored", "a\nb\n", "p"), ("g", 3, "x", "y", "q"), ("f", 4, None, "c", "p")]
    df = spark.createDataFrame([("r", *x) for x in rows], "repo string, path string, seq long, old_content string, new_content string, prompt string")
    e = {r.seq: r for r in HI.file_edits(df, ["repo"]).collect()}
    assert e[2].before == "a\n" and e[2].was_new_file and e[3].original == "x" and e[4].before == "a\nb\n"
    n = HI.numbered_prompts(df, ["repo"])
    assert [r.prompt_index for r in n.orderBy("seq").collect()] == [0, 0, 1, 2]
    assert HI.pending_totals(HI.file_edits(df, ["repo"]), ["repo"]).first()[1:] == (4, 2, 2)


def test_paired_snapshots(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = lambda m: t0 + timedelta(minutes=m)
    pre = [(None, "f", at(0), "a"), (None, "f", at(1), "b"), ("call", "f", at(2), "x"), (None, "h", at(0), None), (None, "old", at(0), "z"), (None, "same", at(0), "s")]
    post = [(None, "f", at(3), "c"), (None, "f", at(4), "d"), ("call", "g", at(5), "y"), (None, "h", at(1), "new"), (None, "old", at(61), "zz"), (None, "same", at(1), "s")]
    # a later pre overwrites, a post uses up, the next has nothing; a file that was not there; a state past its time; no change
    want = {("f", at(1), "b", True, "c"), ("f", None, "", False, "d"), ("g", at(2), "x", True, "y"), ("h", None, "", False, "new"), ("old", None, "", False, "zz")}
    kind = "call_id string, path string, ts timestamp, {} string"
    pre, post = spark.createDataFrame(pre, kind.format("old_content")), spark.createDataFrame(post, kind.format("new_content"))
    row = lambda r: (r.path, r.pre_ts, r.old_content, r.old_present, r.new_content)
    assert {row(r) for r in capture.paired_snapshots(pre, post).collect()} == want
    for name, df in (("pre", pre), ("post", post)):
        df.coalesce(1).write.json(f"file://{tmp_path}/{name}")
    read = lambda name, df: spark.readStream.schema(df.schema).json(f"file://{tmp_path}/{name}")
    out = capture.paired_snapshots(read("pre", pre), read("post", post))
    q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {row(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == want


def test_ancestors_of_long_and_branched_histories(spark, monkeypatch):
    rng = random.Random(5)
    chain = [(k, k - 1) for k in range(1, 5001)]
    got = {r.commit_key for r in GR.ancestors(spark.createDataFrame(chain, "commit_key long, parent_key long"), spark.createDataFrame([(4321,)], "commit_key long")).collect()}
    assert got == set(range(4322))
    monkeypatch.setattr(GR, "GENERATIONS", 2)
    monkeypatch.setattr(GR, "NEAR", 1)
    for n in (60, 60, 60, 9):
        edges = [(k, p) for k in range(1, n) for p in set(rng.choices(range(max(0, k - 5), k), k=rng.choice((1, 1, 1, 2, 3)))) if rng.random() < 0.95]
        heads = rng.sample(range(n), 3)
        want, todo = set(heads), list(heads)
        while todo:
            k = todo.pop()
            for a, b in edges:
                if a == k and b not in want:
                    want.add(b)
                    todo.append(b)
        rows = edges + edges[:5]
        got = {r.commit_key for r in GR.ancestors(spark.createDataFrame(rows, "commit_key long, parent_key long"), spark.createDataFrame([(h,) for h in heads], "commit_key long")).collect()}
        assert got == want


def test_most_similar_option():
    from tracelight.functions.similarity import similarity
    from tracelight.operators.attribution import Options

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 14)))
    for _ in range(300):
        items = [(word(), (k, k)) for k in range(rng.randint(0, 12))]
        text, least = word(), rng.choice((0.6, 0.7, 0.75))
        best, owner = None, None
        for s, who in items:
            x = similarity(text, s)
            if x >= least and (best is None or x > best):
                best, owner = x, who
        assert Options(items).best(text, least) == (best, owner)


def test_line_diff_and_three_way_of_random_files():
    """The diff rebuilds the new text; every line of the final text is named once, and those
    that nobody else wrote are the human's."""
    from tracelight.operators.attribution import attribute, hunks

    rng = random.Random(7)
    pool = [f"line {k} of some text" for k in range(12)] + ["}", "{", ""]
    text = lambda n: "".join(rng.choice(pool) + "\n" for _ in range(n))
    for _ in range(150):
        old, new = text(rng.randint(0, 12)), text(rng.randint(0, 12))
        hs, added, removed = hunks(old, new)
        assert added == sum(n for _, n, _ in hs) and len(new.splitlines()) - len(old.splitlines()) == added - removed
        rows, inserted = new.splitlines(), set()
        for start, n, ls in hs:
            assert rows[start - 1 : start - 1 + n] == ls
            inserted |= set(range(start - 1, start - 1 + n))
        rest, at = [s for k, s in enumerate(rows) if k not in inserted], 0
        for s in old.splitlines():  # what was kept stands in the old text in the same order
            at += at < len(rest) and rest[at] == s
        assert at == len(rest)
        final = new + "zz99 qq88\n"
        got = attribute(old, [(f"e{k}", k, text(rng.randint(1, 9))) for k in range(rng.randint(0, 3))], final)
        assert [r["content"] for r in got] == final.splitlines() and got[-1]["type"] == "Human"


def test_in_diff_bonus(spark):
    stats = spark.createDataFrame([("in.rs", 10, 10, 0, 0, 0, 0, 1, 10, 1.0, True), ("out.rs", 10, 10, 0, 0, 0, 0, 1, 10, 1.0, True), ("part.rs", 100, 10, 0, 50, 40, 0, 1, 10, 0.1, False)], "path string, total_lines long, ai_lines long, ai_modified_lines long, human_lines long, original_lines long, unknown_lines long, n_prompts long, ai_total long, coverage double, is_new_file boolean")
    groups = spark.createDataFrame([("part.rs", "AI", 1, 5, 5, 0, 0), ("part.rs", "AI", 50, 54, 5, 0, 1)], "path string, group_type string, start_line long, end_line long, ai_count long, modified_count long, prompt_index long")
    ranges = spark.createDataFrame([("in.rs", 1, 1), ("part.rs", 4, 9)], "path string, range_start long, range_end long")
    got = {(r.path, r.kind, r.start_line): r.score for r in AN.candidates(stats, groups, ["path"], ranges=ranges).collect()}
    assert set(got) == {("in.rs", "file", 1), ("part.rs", "lines", 1)} and got["in.rs", "file", 1] == 73.0
    free = {(r.path, r.start_line): r.score for r in AN.candidates(stats, groups, ["path"]).collect()}
    assert free["out.rs", 1] == free["in.rs", 1] == 73.0 and len(free) == 4
    out = {(r.path, r.start_line): r for r in AN.candidates(stats, groups, ["path"], mode="lines", ranges=ranges.where("path = 'in.rs'")).collect()}
    assert set(out) == {("part.rs", 1), ("part.rs", 50)} and out["part.rs", 1].score == 0.1 * 40 + 3

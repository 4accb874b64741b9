"""What keeps queries in proportion to their input."""

import random

from pyspark.sql import functions as F

from tracelight.functions import trailers as TR
from tracelight.operators import attribution as A, audit as AU, blame as BL, diffview, graph as GR, provenance as PR, scan
from tracelight.plans import catalog, package
from tracelight.sources import auditlog, projection as P

from .test_versions import blamed

SMALL = "/root/testdata/sf0.001"


def test_trailers_are_read_once(spark):
    """However many fields are asked for, the message is cut into lines once."""
    df = spark.createDataFrame([("m\n\nAI-Model: x\nAI-Lines: 3\n",)], "message string").select(TR.parse(F.col("message")).alias("p")).select("p.*")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert df.first().asDict() == {"session": None, "model": "x", "ai_lines": 3, "ai_modified_lines": None, "human_lines": None}
    rows = ["AI-Lines: 1\nplain\nAI-Lines: 2\n\nAI-Lines: 3", "AI-Lines: 1\nAI-Lines:", None, "", "\n\n", "AI-Lines: +7 \nx: AI-Lines: 9"]
    got = spark.createDataFrame([(k, m) for k, m in enumerate(rows)], "k int, m string").select("k", TR.parse(F.col("m"))["ai_lines"].alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [2, None, None, None, None, 7]


def test_one_diff_is_written_once(spark, monkeypatch):
    written = []
    write = scan.Scratch.write
    monkeypatch.setattr(scan.Scratch, "write", lambda self, df: written.append(df.columns) or write(self, df))
    text = ["diff --git a/f b/f", "--- a/f", "+++ b/f", "@@ -1 +5,2 @@", " a", "+b", "+++ b/g", "-c", " d", "diff --git a/h b/h", "+++ b/h", "@@ -1 +1 @@", "+e"]
    df = spark.createDataFrame(list(enumerate(text)), "n int, text string")
    wide = sorted(diffview.parse(df, [], wide=True).collect())
    assert len(written) == 1
    assert wide == sorted(diffview.parse(df.withColumn("k", F.lit(0)), ["k"]).drop("k").collect())


def test_lines_of_a_commit_are_moved_once(spark):
    for name in ("A10_file_stats", "W1_line_groups", "P24_prompt_target"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(l_orderkey" in plan, name


def test_batches_are_bounded(spark):
    package.ship(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_lines_without_repeats_are_aligned_at_once(monkeypatch):
    r = random.Random(5)
    pairs = []
    for _ in range(300):
        a = [str(r.randint(0, 30)) for _ in range(r.randint(0, 9))]
        b = [x for x in a if r.random() < 0.7]
        for _ in range(r.randint(0, 3)):
            b.insert(r.randint(0, len(b)), str(r.randint(0, 30)))
        pairs.append((a, b, A.align(a, b)))
    asked = []
    middle = A._middle
    monkeypatch.setattr(A, "_middle", lambda *args: asked.append(1) or middle(*args))
    for a, b, found in pairs:
        asked.clear()
        assert A.align(a, b) == found and all(a[i] == b[j] for i, j in found)
        same = [a.index(x) for x in b if x in a]
        if len(set(a)) == len(a) and len(set(b)) == len(b) and same == sorted(same):
            assert not asked and len(found) == len(same)


def test_versions_are_moved_once(spark):
    """A text is moved to its block only, and a long history is put together from its blocks."""
    rng = random.Random(11)
    files = {}
    for name, n in (("f", 2 * PR.BLOCK + 1), ("g", 5 * PR.BLOCK + 7), ("h", PR.BLOCK)):
        text, versions = [f"{name}{k}\n" for k in range(12)], []
        for seq in range(n):
            k = rng.randrange(len(text) + 1)
            text = text[:k] + [f"{name} {seq}\n"] * (seq % 3) + text[k + seq % 4 // 2 :]
            versions.append("".join(text[:30]))
            text = text[:30]
        files[name] = versions
    rows = [(p, k, 100 * k, t) for p, ts in files.items() for k, t in enumerate(ts)]
    v = spark.createDataFrame(rows, "path string, seq long, commit_key long, content string")
    plan = PR.line_maps(v, ["path"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    found = PR.hunks(v, ["path"]).collect()
    got = {(r.path, r.seq, r.final_start + k): (r.commit_key // 100, r.orig_start + k - 1) for r in found for k in range(r.n_lines)}
    want = {(p, seq, k + 1): x for p, ts in files.items() for seq, here in enumerate(blamed(ts, None)) for k, x in enumerate(here)}
    assert got == want and len(found) < len(got)
    assert any(seq - x[0] > 2 * PR.BLOCK for (_, seq, _), x in want.items())
    # no two hunks of a version go on in one another
    ends = {(r.path, r.seq, r.final_start + r.n_lines, r.commit_key, r.orig_start + r.n_lines) for r in found}
    assert not ends & {(r.path, r.seq, r.final_start, r.commit_key, r.orig_start) for r in found}
    plan = P.histories(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(path") == 1


def test_lines_of_commits_are_contracted(spark, monkeypatch, tmp_path):
    """Rounds leave a share of the links each, and what is reached stays the same."""
    rng = random.Random(4)
    edges = [(k, k - 1) for k in range(1, 3000) if k % 500] + [(k, k - 1000) for k in range(1200, 3000, 700)] + [(1499, 700), (1499, 710), (5000, 4000), (5000, 4000)]
    edges += [(10_000 + k, 10_000 + rng.randrange(k)) for k in range(1, 60)]
    name = {k: rng.randrange(1 << 40) for k in {x for e in edges for x in e}}
    want, todo, up = set(), [2777, 1499, 10_050], {}
    for a, b in edges:
        up.setdefault(a, []).append(b)
    heads = spark.createDataFrame([(name[k],) for k in todo], "commit_key long")
    while todo:
        k = todo.pop()
        if k not in want:
            want.add(k)
            todo += up.get(k, [])
    parents = spark.createDataFrame([(name[a], name[b]) for a, b in edges], "commit_key long, parent_key long")
    monkeypatch.setattr(GR, "LINKS", 100)
    left, tables = GR.contracted(parents.distinct(), heads, f"file://{tmp_path}/alone")
    assert len(tables) >= 3 and left.count() < 500
    seen = []
    chains = GR.chains
    monkeypatch.setattr(GR, "chains", lambda p, folder: seen.append(p.count()) or chains(p, folder))
    got = [r.commit_key for r in GR.ancestors(parents, heads).collect()]
    assert sorted(got) == sorted(name[k] for k in want) and seen[0] < 500


def test_a_long_log_comes_packed(spark, tmp_path):
    """The task that folds a log sorts packs of events, not events; hashes are the same."""
    kinds = ("delete", "export", "redaction")
    n = 25_000
    rows = [(f"log{k % 2}" if k > 20_000 else "log1", k, kinds[k % 3], f"t{k % 7}", None if k % 5 else f"ü{k}", None if k % 2 else k) for k in range(n)]
    random.Random(2).shuffle(rows)
    ev = spark.createDataFrame(rows, "stream string, seq long, event string, timestamp string, commit string, commit_count long").repartition(5)
    plain, wide = AU.chained(ev, last={"log0": "f" * 32}), AU.chained(ev, last={"log0": "f" * 32}, wide=True)
    assert wide.columns == plain.columns
    got = sorted(wide.collect(), key=lambda r: r.seq)
    assert got == sorted(plain.collect(), key=lambda r: r.seq) and len(got) == n and got[-1].event_hash
    assert sum(r.prev_hash is None for r in got) == 1
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    last = plan[: plan.index("RepartitionByExpression")]
    assert "Sort [stream" in last and "_first" in last and "seq" not in last.partition("Sort")[2].partition("\n")[0]


def test_segments_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(scan, "SEGMENT", 64)
    rows = [(k % 3, k, k % 17 if k % 5 else None) for k in range(5000)]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    for by in ([], ["g"]):
        s = scan.Scan(df, by, ["k"]).lag("before", F.col("v")).total("sum", F.col("v")).known("known", F.col("v"))
        assert s.rows.groupBy("_seg").count().agg(F.max("count")).first()[0] <= 64
        state = {}
        want = []
        for g, k, v in rows:
            before, total, known = state.get(g if by else 0, (None, None, None))
            now = (v, total if v is None else v + (total or 0), known if v is None else v)
            state[g if by else 0] = now
            want.append((g, k, v, before, *now[1:]))
        assert sorted(map(tuple, s.result().collect()), key=lambda r: r[1]) == want


def test_lines_of_a_log_stay_in_their_blocks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}").write_text("".join(f"{k} {i}\n" for i in range(400)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = auditlog.placed_lines(spark, f"file://{tmp_path}")
        assert "hashpartitioning(value" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan and plan.count("Window") <= 4
        got = sorted((r.seq, r.line, r.value) for r in found.collect())
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [(400 * k + i + 1, i + 1, f"{k} {i}") for k in range(3) for i in range(400)]


def test_blamed_lines_are_not_moved(spark):
    """Hunks, notes and prompts are dealt once each; what blame finds is what its joins find."""
    for name in ("J2_prompt_preview", "K12_blame_json"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x]
        assert len(dealt) == (3 if name == "J2_prompt_preview" else 6), plan
        assert all("(path" not in x and "prompt_index" not in x.partition("hashpartitioning(")[2].partition(")")[0] for x in dealt), plan
    rng = random.Random(9)
    some = lambda *xs: rng.choice([*xs, None])
    hunks = [(some(1, 2, 3), some("a", "b"), 10 * k, some(1, 2, 3, 4), rng.randrange(4)) for k in range(200)]
    notes = [(c, p, n, some("AI", "Human"), some(0, 1, 2)) for c in (1, 2, None) for p in ("a", "b", None) for n in (1, 3, 4, None)]
    prompts = [(c, i, some("x", " long " * 30)) for c in (1, 2, None) for i in (0, 1, None)]
    h = spark.createDataFrame(hunks, "commit_key long, path string, final_start long, orig_start long, n_lines long")
    n = spark.createDataFrame(notes, "commit_key long, path string, line_number long, source_type string, prompt_index long")
    p = spark.createDataFrame(prompts, "commit_key long, prompt_index long, text string")
    names = ["commit_key", "path", "line_number", "orig_line", "source_type", "prompt_index", "prompt_preview"]
    dealt = [df.repartition(7, "commit_key") for df in (h, n, p)]
    key = lambda r: str(tuple(r))
    got, want = BL.blame(*dealt, together=True).select(*names), BL.blame(h, n, p).select(*names)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.where("prompt_preview is not null").count() > 0

"""Capture in tables and streams against a plain version, with restarts, status and backups."""

import random

from pyspark.sql import functions as F

from tracelight.streaming import capture



def edit(repo, seq, path, prompt, old=None, new="n\n", session="s1", explicit=False, present=False, plan=False, depth=0):
    return (repo, seq, "edit", session, explicit, path, prompt, old, present, new, f"2024-01-01T00:00:{seq % 60:02d}Z", plan, depth, None, None, None)


def commit(repo, seq, changed, renames=None):
    return (repo, seq, "commit", None, None, None, None, None, None, None, None, None, None, f"c{seq}", changed, renames)


def clear(repo, seq):
    return (repo, seq, "clear", *[None] * 13)


def plain(events):
    """Lists and loops; prompts hold no secrets here."""
    out, states = [], {}
    for repo, seq, kind, session, explicit, path, prompt, old, present, new, _, plan, depth, commit_id, changed, renames in sorted(events, key=lambda e: (e[0], e[1])):
        st = states.get(repo)

        def emit(p, to, commit_id, st):
            before, was_new = st["files"][p][0]["old"] or "", st["files"][p][0]["old"] is None
            for k, e in enumerate(st["files"].pop(p)):
                out.append((repo, commit_id, st["session"], p, to, k + 1, e["index"], dict(st["prompts"])[e["index"]], before, e["new"], was_new, e["plan"], e["depth"], commit_id is None))
                before = e["new"]

        if kind == "clear":
            states.pop(repo, None)
        elif kind == "commit":
            if st is None:
                continue
            for p in sorted(st["files"]):
                to = (renames or {}).get(p)
                if to is not None and (to in changed or p in changed):
                    emit(p, to, commit_id, st)
                elif p in changed:
                    emit(p, p, commit_id, st)
            used = {e["index"] for es in st["files"].values() for e in es}
            st["prompts"] = [x for x in st["prompts"] if x[0] in used]
            st["next"] = max(used, default=-1) + 1
            if not st["files"]:
                del states[repo]
        else:
            if st is not None and explicit and st["session"] != session:
                for p in sorted(st["files"]):
                    emit(p, None, None, st)
                st = None
            if st is None:
                st = states[repo] = {"session": session, "files": {}, "prompts": [], "next": 0}
            if not st["prompts"] or st["prompts"][-1][1] != prompt:
                st["prompts"].append((st["next"], prompt))
                st["next"] += 1
            start = (old or "") if present else old
            st["files"].setdefault(path, []).append({"index": st["prompts"][-1][0], "old": start, "new": new or "", "plan": plan, "depth": depth})
    return sorted(out, key=str), states


def random_events(rng, n, repos="rq"):
    out = []
    for seq in range(n):
        repo, turn = rng.choice(repos), rng.random()
        if turn < 0.75:
            out.append(edit(repo, seq, rng.choice("fghk"), rng.choice(["p", "q", "r"]), rng.choice([None, "", "old\n"]), rng.choice(["a\n", "a\nb\n", ""]), rng.choice(["s1", "s1", "s2"]), rng.random() < 0.1, rng.random() < 0.3, rng.random() < 0.2, rng.randrange(2)))
        elif turn < 0.98:
            out.append(commit(repo, seq, rng.sample("fghkz", rng.randrange(4)), {"f": "z"} if rng.random() < 0.4 else None))
        else:
            out.append(clear(repo, seq))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.drop("edit_id").collect()), key=str)


def test_capture_of_tables(spark):
    events = random_events(random.Random(5), 900)
    df = spark.createDataFrame(events, capture.EVENT).repartition(5)
    got = capture.capture_batch(df)
    assert rows(got) == plain(events)[0]
    ids = [r.edit_id for r in got.collect()]
    assert len(set(ids)) == len(ids) and all(len(i) == 36 for i in ids)
    assert capture.capture_batch(df.limit(0)).collect() == []


def test_numbers_and_renames(spark):
    """Numbers restart when nothing is left, else after the largest that is left."""
    events = [edit("r", 1, "f", "a"), edit("r", 2, "g", "b"), commit("r", 3, ["f"]), edit("r", 4, "f", "c"), edit("r", 5, "h", "b"), commit("r", 6, ["new", "f", "g"], {"h": "new"}), edit("r", 7, "f", "a"), commit("r", 8, ["f"])]
    got = capture.capture_batch(spark.createDataFrame(events, capture.EVENT)).orderBy("commit_id", "path").collect()
    assert [(r.commit_id, r.path, r.committed_path, r.prompt_index, r.prompt) for r in got] == [("c3", "f", "f", 0, "a"), ("c6", "f", "f", 2, "c"), ("c6", "g", "g", 1, "b"), ("c6", "h", "new", 3, "b"), ("c8", "f", "f", 0, "a")]


def test_head_and_redaction(spark):
    events = [edit("r", 1, "f", "use password=hunter2222 please"), edit("r", 2, "g", "p"), commit("r", 3, ["f", "g"])]
    head = spark.createDataFrame([("r", "g", "committed\n")], "repo string, path string, content string")
    got = {r.path: r for r in capture.capture_batch(spark.createDataFrame(events, capture.EVENT), head=head).collect()}
    assert "hunter2222" not in got["f"].prompt and "[REDACTED]" in got["f"].prompt
    assert (got["g"].before, got["g"].was_new_file, got["f"].was_new_file) == ("committed\n", False, True)


def test_stream_with_restarts(spark, tmp_path):
    events = random_events(random.Random(6), 160) + [edit("s", 1, "f", "token = abcdef123456789 and password=hunter2222", new="x\ny\n")]
    src, out, point = (f"file://{tmp_path}/{n}" for n in ("in", "out", "cp"))
    for k in range(0, 160, 80):
        part = [e for e in events if k <= e[1] < k + 80]
        spark.createDataFrame(part, capture.EVENT).coalesce(1).write.mode("append").json(src)
        capture.run_once(spark, src, out, point)
    want, left = plain(events[:-1])
    got = spark.read.parquet(out)
    assert rows(got.where("repo <> 's'")) == want
    # what is pending, read beside the stream
    status = {r.repo: r for r in capture.status(spark, point, F.lit("2024-01-01 05:00:00").cast("timestamp")).collect()}
    assert set(status) == {*left, "s"} and (status["s"].file_count, status["s"].line_count, status["s"].edit_count, status["s"].prompt_count, status["s"].is_stale) == (1, 2, 1, 1, False)
    for repo, st in left.items():
        assert status[repo].edit_count == sum(map(len, st["files"].values())) and status[repo].prompt_count == len(st["prompts"])
    kept = capture.backup(spark, point)
    assert "hunter2222" not in str(kept.collect()) and kept.where("part = 'prompts'").count() >= 1
    # a backup begins a new stream, which goes on as the old one would have
    kept.write.parquet(f"file://{tmp_path}/backup")
    more = [commit(r, 1000, ["f", "g", "h", "k"]) for r in status]
    spark.createDataFrame(more, capture.EVENT).coalesce(1).write.json(f"file://{tmp_path}/in2")
    capture.run_once(spark, f"file://{tmp_path}/in2", f"file://{tmp_path}/out2", f"file://{tmp_path}/cp2", restore=spark.read.parquet(f"file://{tmp_path}/backup"))
    after = spark.read.parquet(f"file://{tmp_path}/out2")
    whole = [r for r in plain(events[:-1] + more)[0] if r[1] == "c1000"]
    assert rows(after.where("repo <> 's'")) == whole
    assert after.where("repo = 's'").first().prompt.count("[REDACTED]") >= 1


def test_large_micro_batch(spark, tmp_path):
    """Events of several Arrow batches, out of order, go through the state store."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        events = random_events(random.Random(7), 150, "r")
        random.Random(1).shuffle(events)
        src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
        spark.createDataFrame(events, capture.EVENT).coalesce(1).write.json(src)
        capture.run_once(spark, src, out, f"file://{tmp_path}/cp")
        assert rows(spark.read.parquet(out)) == plain(events)[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

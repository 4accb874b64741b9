"""The engine's methods over a small repository of four commits, documents included."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from tracelight.functions.redaction import redact
from tracelight.operators import audit as AU, retention as RE
from tracelight.plans.engine import Engine, Tables
from tracelight.sources import auditlog, texts as TX
from tracelight.sources.notes import NoteStore

COMMITS = [(k, f"{k}abcdef{k}" + "0" * 32, f"Ann {k}" if k < 4 else None, f"change {k}\nbody", "m1" if k < 3 else "m2", f"2024-01-0{k}T10:00:00Z", f"2024-01-0{k} 12:00:00", f"s{k}") for k in (1, 2, 3, 4)]
F_TXT = ["a\nb\nc\n", "a\nb\nc\nai one\nai two\n", "new top\na\nb\nc\nai one\nai two changed\n"]


@pytest.fixture(scope="module")
def engine(spark):
    commits = spark.createDataFrame(COMMITS, "commit_key long, commit_id string, author string, message string, model string, started_at string, committed_at string, session_id string").withColumn("committed_at", F.col("committed_at").cast("timestamp_ntz"))
    parents = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 1, 0), (4, 3, 1)], "commit_key long, parent_key long, parent_idx long")
    refs = spark.createDataFrame([("HEAD", 3), ("refs/heads/main", 3), ("refs/heads/side", 4), ("refs/tags/v1", 1)], "ref_name string, commit_key long")
    versions = spark.createDataFrame([("f.txt", 0, 1, F_TXT[0]), ("f.txt", 1, 2, F_TXT[1]), ("f.txt", 2, 3, F_TXT[2]), ("g.txt", 0, 2, "x\ny\nz\n"), ("gone.txt", 0, 1, "1\n2\n3\n4\n"), ("gone.txt", 1, 3, None)], "path string, seq long, commit_key long, content string")
    line = lambda c, p, n, kind, sim=None, i=None: (c, p, n, kind, sim, f"e{c}" if kind.startswith("AI") else None, i)
    notes = [line(1, "f.txt", k, "Original") for k in (1, 2, 3)] + [line(1, "gone.txt", k, "AI", i=0) for k in (1, 2, 3, 4)]
    notes += [line(2, "f.txt", k, "Original") for k in (1, 2, 3)] + [line(2, "f.txt", 4, "AI", i=0), line(2, "f.txt", 5, "AI", i=1)] + [line(2, "g.txt", k, "AI", i=1) for k in (1, 2, 3)]
    notes += [line(3, "f.txt", 1, "Human"), *(line(3, "f.txt", k, "Original") for k in (2, 3, 4)), line(3, "f.txt", 5, "AI", i=0), line(3, "f.txt", 6, "AIModified", 0.7, 2)]
    lines = spark.createDataFrame(notes, "commit_key long, path string, line_number long, source_type string, similarity double, edit_id string, prompt_index long")
    prompts = spark.createDataFrame([(1, 0, "first words", ["gone.txt"]), (2, 0, "add a line", ["f.txt"]), (2, 1, 'second "prompt" ' + "long " * 30, ["f.txt", "g.txt"]), (3, 2, "change it", ["f.txt"])], "commit_key long, prompt_index long, text string, affected_files array<string>")
    return Engine(spark, Tables(commits, lines, parents, refs, None, prompts, versions=versions))


@pytest.fixture(scope="module")
def quick(engine, spark):
    """The same with the hunks of HEAD as a table."""
    t = engine.t
    paths = spark.createDataFrame([("f.txt",), ("g.txt",), ("gone.txt",)], "path string")
    found = engine.hunks(paths, "HEAD")
    hunks = spark.createDataFrame(found.collect(), found.schema)
    return Engine(spark, Tables(t.commits, t.note_lines, t.parents, t.refs, None, t.prompts, hunks, versions=t.versions))


def text(df):
    return [r.line for r in df.collect()]


def placed(df):
    by = "place" if "place" in df.columns else "n"
    return "".join(r.line for r in df.orderBy(by).collect())


def test_revisions(engine):
    key = lambda r: engine.resolve(r).first().commit_key
    assert [key(r) for r in ("HEAD", "heads/side", "v1", "2abc", 4, "main~2", "side~", "HEAD~1^")] == [3, 4, 1, 2, 4, 1, 1, 1]
    for bad in ("nothing", "HEAD~9", "v1^"):
        with pytest.raises(ValueError):
            key(bad)
    assert sorted(r.commit_key for r in engine.range("v1", "HEAD").collect()) == [2, 3]


def test_blame_from_versions(engine, quick):
    rows = engine.blame("f.txt").orderBy("line_number").collect()
    assert [(r.line_number, r.commit_key, r.source_type, r.content, r.author) for r in rows] == [
        (1, 3, "Human", "new top", "Ann 3"), (2, 1, "Original", "a", "Ann 1"), (3, 1, "Original", "b", "Ann 1"), (4, 1, "Original", "c", "Ann 1"), (5, 2, "AI", "ai one", "Ann 2"), (6, 3, "AIModified", "ai two changed", "Ann 3"),
    ]
    old = engine.blame("f.txt", revision="HEAD~1").orderBy("line_number").collect()
    assert [(r.commit_key, r.content) for r in old] == [(1, "a"), (1, "b"), (1, "c"), (2, "ai one"), (2, "ai two")]
    doc = json.loads(placed(quick.blame("f.txt", format="json")))
    assert doc["revision"] == "HEAD" and [x["source"] for x in doc["lines"]][4:] == ["ai", "ai_modified"] and doc["summary"]["ai_lines"] == 1 and doc["lines"][4]["prompt"] == {"index": 0, "preview": "add a line"}
    got = text(quick.blame("f.txt", ai_only=True, format="text"))
    assert got == ["", " LINE    │ COMMIT  │ AUTHOR      │ SRC │ CODE", "─" * 85, "    5 │ 2abcdef │ Ann 2      │  ● │ ai one", "    6 │ 3abcdef │ Ann 3      │  ◐ │ ai two changed", "─" * 85, "Legend: ● AI (2) ◐ AI-modified (1) + Human (0) ─ Original (0)", "AI involvement: 100% (3 of 2 lines)", 'First AI prompt: "add a line"']
    assert engine.blame("gone.txt").collect() == [] and engine.blame("gone.txt", revision="v1").count() == 4


def test_prompt(quick):
    engine = quick
    assert engine.prompt("f.txt").first().line_number == 5 and engine.prompt("f.txt:6").first().prompt_index == 2
    for bad in ("f.txt:1", "f.txt:99", "none.txt"):
        with pytest.raises(ValueError):
            engine.prompt(bad)
    doc = json.loads(engine.prompt("f.txt:6", format="json").first().json)
    assert doc["prompt"]["text"] == "change it" and doc["commit"]["short"] == "3abcdef" and doc["session"]["id"] == "s3" and doc["line"]["content"] == "ai two changed"
    got = text(engine.prompt("g.txt:2", format="text"))
    assert got[0] == "╔" + "═" * 68 + "╗" and got[1] == "║  PROMPT #1 in session s2  " and got[4].startswith('║  second "prompt" long') and all(len(x) == 70 for x in got[4:7]) and got[-3:] == ["File: g.txt:2", "Commit: 2abcdef", "Source: AI"]
    assert got[got.index("Files affected by this prompt:") + 1 :][:2] == ["  - f.txt", "  - g.txt"]
    lost = text(engine.prompt("f.txt:5", format="text"))
    assert "Line 5 is AI-generated but prompt details are not available." not in lost


def test_show(engine):
    doc = json.loads(engine.show("HEAD~1", format="json").first().json)
    assert doc["has_attribution"] and [f["path"] for f in doc["files"]] == ["f.txt", "g.txt"] and doc["summary"]["total_ai_lines"] == 5
    assert json.loads(engine.show("side", format="json").first().json)["has_attribution"] is False
    got = text(engine.show("HEAD", format="text"))
    assert got == ["Commit: 3abcdef", "Session: s3", "Model: m2", "Started: 2024-01-03T10:00:00Z", "", "Prompts used:", '  #2: "change it"', "", "Files with AI changes:", "  f.txt (1 AI, 1 modified, 1 human, 3 original) - 6 total lines", "", "Summary:", "  1 AI-generated lines", "  1 AI lines modified by human", "  1 human-added lines", "  3 original/unchanged lines"]
    assert text(engine.show("side", format="text")) == ["No AI attribution found for commit 4abcdef", "This commit was not made with tracked AI assistance."]


def test_summary(engine):
    total, files = engine.summary()
    assert (total.first().commits_analyzed, total.first().commits_with_ai, total.first().additions) == (3, 3, 12) and files.count() == 3
    doc = json.loads(placed(engine.summary(format="json")))
    assert doc["additions"] == {"total": 12, "ai": 10, "ai_modified": 1, "human": 1} and [f["path"] for f in doc["files"]] == ["f.txt", "g.txt", "gone.txt"] and doc["models"] == ["m1", "m2"] and doc["files"][1]["is_new_file"] is True
    got = text(engine.summary("HEAD~1", format="text"))
    assert got[5] == "Commits analyzed: 1 (1 with AI attribution)" and "  +1 AI-generated (33.3%)" in got and "  f.txt +3 (67% AI)" in got and got[-2:] == ["", "═" * 60] and "  - m2" in got
    none = text(engine.summary("HEAD", "HEAD", "text"))
    assert none[-1] == "No AI attribution data found in the specified commit range."
    assert any("AI Attribution Summary" in x for x in text(engine.summary(format="markdown")))


def test_annotations(quick):
    engine = quick
    doc = json.loads(engine.annotations(format="json", min_ai_lines=2).first().json)
    # gone.txt cannot be blamed, but was analysed
    assert doc["schema"] == "annotations.v1" and doc["summary"] == {"files_analyzed": 3, "models": ["m1", "m2"], "session_range": "2024-01-01 to 2024-01-03"}
    by = {}
    for a in doc["annotations"]:
        by.setdefault(a["path"], []).append((a["start_line"], a["end_line"], a["title"]))
    assert by == {"g.txt": [(1, 3, "New file (3 lines) generated by AI")], "f.txt": [(5, 5, "AI Generated (1 line)"), (6, 6, "AI Modified (1 line)")]}
    whole = json.loads(engine.annotations(format="checks", min_ai_lines=2, shallow=True).first().json)
    assert "schema" not in whole and {(a["path"], a["start_line"]) for a in whole["annotations"]} == {("f.txt", 1), ("g.txt", 1)}
    # shares are of all lines of the note's file
    assert {r.path for r in engine.annotations(min_ai_lines=1, min_ai_percent=60.0, consolidate="file").collect()} == {"g.txt"}
    changed = engine.annotations("HEAD~1", "HEAD", min_ai_lines=2, diff_only=True, consolidate="lines").collect()
    assert {(r.path, r.start_line) for r in changed} == {("f.txt", 5), ("f.txt", 6)}
    assert engine.annotations(None, "HEAD", min_ai_lines=2, diff_only=True).count() == 3
    assert {(r.path, r.range_start, r.range_end) for r in engine.ranges("HEAD~1", "HEAD").collect()} == {("f.txt", 1, 6), ("gone.txt", 0, 0)}


def test_export_files(engine, tmp_path):
    read = lambda p: "".join(open(f).read() for f in sorted(glob.glob(f"{p}/part-*")))
    assert engine.export_to(f"file://{tmp_path}/csv", "csv") == 3
    rows = list(csv.DictReader(read(tmp_path / "csv").splitlines()))
    assert [r["commit_short"] for r in rows] == ["3abcdef", "2abcdef", "1abcdef"] and rows[0]["ai_modified_lines"] == "1" and rows[1]["message"] == "change 2"
    assert engine.export_to(f"file://{tmp_path}/json", "json", "2024-02-01T00:00:00+00:00", since="2024-01-02") == 2
    doc = json.loads(read(tmp_path / "json"))
    assert [c["commit_short"] for c in doc["commits"]] == ["3abcdef", "2abcdef"] and doc["summary"]["total_commits"] == 2 and doc["date_range"]["since"] == "2024-01-02"


def test_retention(engine, spark, tmp_path):
    store = NoteStore(spark, f"file://{tmp_path}/notes", 4)
    store.upsert(spark.createDataFrame([(c[1], f"note {c[0]}") for c in COMMITS[:3]], "commit_id string, note string"))
    policy = RE.Policy(max_age_days=30, retain_refs=("refs/tags/v1", "refs/none"), min_commits=1)
    shown = engine.retention_preview(policy, "2024-06-01 00:00:00", 1).collect()
    assert [(r.commit_id[:2], r.hidden) for r in shown] == [("2a", 1)] and engine.retention_sets(policy, "2024-06-01 00:00:00")[1] == ["refs/none"]
    log = f"file://{tmp_path}/log"
    assert [engine.retention_apply(policy, "2024-06-01 00:00:00", store, log=log) for _ in range(1)] == [2]
    assert [r.note for r in store.read().collect()] == ["note 1"]
    events = auditlog.read(spark, log)
    assert [(r.event, r.commit_count) for r in events.collect()] == [("retention_apply", 2)] and AU.verify_chain(events).first().valid


def test_redaction_texts(spark):
    df = redact(spark.createDataFrame([("mail a@b.example please",), ("nothing",), (None,)], "text string"))
    got = {r.text: r for r in TX.redaction_texts(df).collect()}
    hit = got["mail a@b.example please"]
    assert hit.basic == ["Redacted output:", "mail [REDACTED] please"] and hit.matches == ["Sensitive data 1 found:", "", "  EMAIL            a@b.example"]
    assert hit.audit == ["Audit Trail: 1 redactions made:", "", "  Pattern: EMAIL  Range: (5, 16)  Preview: a@b.exampl...", "", "Redacted output:", "mail [REDACTED] please"]
    assert got["nothing"].basic == got["nothing"].matches == got["nothing"].audit == [TX.NOTHING]


def test_annotated_diff(quick, spark):
    engine = quick
    diff = "diff --git a/f.txt b/f.txt\n--- a/f.txt\n+++ b/f.txt\n@@ -1,5 +1,6 @@\n+new top\n a\n b\n c\n ai one\n-ai two\n+ai two changed"
    rows = spark.createDataFrame(list(enumerate(diff.split("\n"))), "n long, text string")
    got = [r.text for r in engine.annotate_diff(rows, []).orderBy("n").collect()]
    assert got[4] == "+new top" and got[-1] == "◐ +ai two changed  # AI-mod" and got[-2] == "-ai two"

"""Similar lines in blocks against all pairs."""

import random

import pytest

from tracelight.functions.similarity import similarity
from tracelight.operators import similar as SI
from tracelight.plans import catalog

WORDS = ["alpha", "beta(", "x = 1", "return", "été", "  ", "}", "longer words here", "longer word here"]


def some_line(rng):
    s = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(4)))
    return s if rng.random() < 0.7 else s.replace("e", "", 1) + " "


@pytest.mark.parametrize("chunk, block", [(1000, 10_000), (3, 4)])
def test_set_analysis(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(SI, "CHUNK", chunk)
    monkeypatch.setattr(SI, "BLOCK", block)
    rng = random.Random(21)
    text = lambda n: "\n".join(some_line(rng) for _ in range(rng.randrange(n)))
    files = {f"f{k}": (text(6), [text(14) for _ in range(rng.randrange(4))], text(14)) for k in range(25)}
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    originals = t([(p, o) for p, (o, _, _) in files.items()], "path string, text string")
    edits = t([(p, k, f"{p}-{k}", k, x) for p, (_, es, _) in files.items() for k, x in enumerate(es)], "path string, edit_no int, edit_id string, prompt_index long, text string")
    finals = t([(p, f) for p, (_, _, f) in files.items()], "path string, text string")
    got = {(r.path, r.line_number): (r.source_type, r.edit_id, r.prompt_index, r.similarity, r.confidence) for r in SI.set_analysis(originals, edits, finals, ["path"]).collect()}
    want = {}
    split = lambda s: s.removesuffix("\n").split("\n") if s else []
    for p, (o, es, f) in files.items():
        seen = {x.rstrip() for x in split(o)}
        owner = {}
        for e, text_ in enumerate(es):
            for k, x in enumerate(split(text_)):
                owner[x.rstrip()] = (e, k)
        for j, x in enumerate(split(f), 1):
            key = x.rstrip()
            if key in seen:
                row = ("Original", None, None, None, 1.0)
            elif key in owner:
                row = ("AI", f"{p}-{owner[key][0]}", owner[key][0], None, 1.0)
            else:
                near = [(-similarity(x.strip(), y.strip()), -e, k) for y, (e, k) in owner.items() if y.strip() and x.strip() and similarity(x.strip(), y.strip()) >= SI.THRESHOLD]
                s, e, _ = min(near, default=(None, None, None))
                row = ("Human", None, None, None, 0.9) if s is None else ("AIModified", f"{p}-{-e}", -e, -s, -s)
            want[p, j] = row
    assert got == want and {r[0] for r in want.values()} == {"Original", "AI", "AIModified", "Human"}
    assert SI.set_analysis(originals.limit(0), edits.limit(0), finals.limit(0), ["path"]).collect() == []


@pytest.mark.parametrize("chunk, block", [(1000, 10_000), (3, 4)])
def test_files_analysis(spark, monkeypatch, chunk, block):
    """Files analysed where they stand, long ones, repeated and null names among them, as tables are."""
    monkeypatch.setattr(SI, "CHUNK", chunk)
    monkeypatch.setattr(SI, "BLOCK", block)
    rng = random.Random(22)
    ends = ["\n", "\n", "\r\n", "\x1c\n", " \n", " \x85\n", "\r\r\n"]
    text = lambda n: "".join(some_line(rng) + rng.choice(ends) for _ in range(rng.randrange(n))) + rng.choice(["", "x", "\r"])
    rows = [(None if k == 30 else f"f{k % 25}", text(6), [(e + k, f"{k}-{e}", e, text(14)) for e in range(rng.randrange(4))], text(14)) for k in range(31)]
    rows += [("none", None, None, text(9)), ("nulls", "a", [(0, "e", 0, None)], "b\n\nb"), ("empty", "", [], "")]
    files = spark.createDataFrame(rows, "path string, original string, edits array<struct<edit_no int, edit_id string, prompt_index long, text string>>, final string")
    edits = files.selectExpr("path", "inline(edits)")
    want = SI.set_analysis(files.selectExpr("path", "original as text"), edits, files.selectExpr("path", "final as text"), ["path"])
    got = SI.files_analysis(files, ["path"])
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    found = sorted(map(repr, want.collect()))
    assert sorted(map(repr, got.collect())) == found and len(found) > 150
    assert all(any(f"source_type='{t}'" in r for r in found) for t in ("Original", "AI", "AIModified", "Human"))


def test_files_of_one_name(spark):
    """Lines of the same number are told apart."""
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    edits = t([("f", 0, "e", 0, "abcdefghij\nklmnopqrst")], "path string, edit_no int, edit_id string, prompt_index long, text string")
    finals = t([("f", "abcdefghiX"), ("f", "klmnopqrXX"), ("f", "0")], "path string, text string")
    got = SI.set_analysis(t([], "path string, text string"), edits, finals, ["path"])
    assert sorted((r.content, r.source_type, r.similarity) for r in got.collect()) == [("0", "Human", None), ("abcdefghiX", "AIModified", 0.9), ("klmnopqrXX", "AIModified", 0.8)]


def test_texts_stay_where_they_are(spark):
    """Of documents with names of their own nothing is joined or moved by line."""
    plan = catalog.QUERIES["X1_set_analysis"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "hashpartitioning" not in plan

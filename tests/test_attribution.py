import random

import pytest

from tracelight.operators.attribution import align, attribute, hunks, split_lines, three_way


def kinds(original, versions, final):
    got = attribute(original, [(f"e{k}", k, v) for k, v in enumerate(versions)], final)
    return [r["type"] for r in got], got


def test_no_edits():
    k, rows = kinds("line1\nline2\n", [], "line1\nline2\nline3\n")
    assert k == ["Original", "Original", "Human"] and {r["confidence"] for r in rows} == {1.0}


def test_line_shift():
    k, _ = kinds("line1\nline2\n", ["line1\nline2\nAI added\n"], "new first line\nline1\nline2\nAI added\n")
    assert k == ["Human", "Original", "Original", "AI"]


def test_later_edit_owns_untouched_lines():
    _, rows = kinds("original\n", ["original\nfirst AI\n", "original\nfirst AI\nsecond AI\n"], "original\nfirst AI\nsecond AI\n")
    assert [r["prompt"] for r in rows] == [None, 1, 1]


def test_whitespace_and_blanks():
    k, _ = kinds("", ["a  \nb\t\nc \n"], "a\nb\nc\n")
    assert k == ["AI"] * 3
    k, _ = kinds("", ["a\n\nb\n\nc\n"], "a\n\nb\n\nc\n")
    assert k == ["AI"] * 5


def test_duplicate_braces():
    o = "fn a() {\n    x();\n}\n"
    v = o + "\nfn b() {\n    y();\n}\n"
    k, _ = kinds(o, [v], v)
    assert k == ["Original"] * 3 + ["AI"] * 4


def test_rewritten_body():
    k, _ = kinds("fn a() {\n    old();\n}\n", ["fn a() {\n    new1();\n    new2();\n}\n"], "fn a() {\n    new1();\n    new2();\n}\n")
    assert k == ["Original", "AI", "AI", "Original"]


@pytest.mark.parametrize(
    "line, final, least",
    [
        ("    let x = foo.bar().baz().qux();\n", "    let x = foo\n        .bar()\n        .baz()\n        .qux();\n", 4),
        ("let value = compute_the_thing(first, second);\n", "let value =\n    compute_the_thing(first, second);\n", 2),
        ("assert!(condition_holds, \"a message for {}\", name);\n", "assert!(\n    condition_holds,\n    \"a message for {}\",\n    name\n);\n", 5),
    ],
)
def test_reformatted(line, final, least):
    k, _ = kinds("", [line], final)
    assert "Human" not in k and k.count("AI") >= least


def test_modified():
    k, rows = kinds("", ["the quick brown fox jumps\nsecond line here\n"], "the quick brown cat jumps over it\nsecond line here\n")
    assert k[1] == "AI" and k[0] in ("AI", "AIModified")


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(5)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        got = align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert len(got) == lcs_length(a, b), (a, b, got)


def test_hunks():
    h, added, removed = hunks("a\nb\nc\nd\ne\n", "a\nX\nb\nc\nY\nd\ne\n")
    assert [(s, n) for s, n, _ in h] == [(2, 1), (5, 1)] and (added, removed) == (2, 0)
    h, added, removed = hunks("a\nb\n", "a\nc\nd\n")
    assert [(s, n) for s, n, _ in h] == [(2, 2)] and (added, removed) == (2, 1)


def test_split_lines():
    assert [split_lines(s) for s in ("", "\n", "a\r\nb", "a\rb\n")] == [[], [""], ["a", "b"], ["a\rb"]]


def test_counts_cover_every_line(spark):
    rows = [("f1", "a\nb\n", [("e0", 0, "a\nb\nc\n")], "a\nb\nc\nd\n"), ("f2", "", [], "x\n"), ("f3", None, None, None)]
    df = spark.createDataFrame(rows, "path string, original string, edits array<struct<edit_id:string,prompt_index:bigint,after:string>>, final string")
    got = three_way(df, []).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in got} == {"f1": 4, "f2": 1}

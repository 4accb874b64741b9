"""Provenance, tree diffs and renames against plain versions."""

import random

import pytest

from tracelight.operators import finalize as FI, provenance as PR, trees as TR
from tracelight.operators.attribution import align, line_tokens

LINES = ["a\n", "b\n", "{\n", "}\n", "\n", "long line with many letters one\n", "long line with many letters two\n", "é\n"]


def edited(rng, lines):
    out = list(lines)
    for _ in range(rng.randrange(5)):
        k = rng.randrange(len(out) + 1)
        turn = rng.random()
        if turn < 0.4:
            out[k:k] = [rng.choice(LINES) for _ in range(rng.randrange(1, 4))]
        elif turn < 0.7:
            del out[k : k + rng.randrange(1, 4)]
        elif out:
            j = rng.randrange(len(out))
            block = out[j : j + 2]
            del out[j : j + 2]
            k = rng.randrange(len(out) + 1)
            out[k:k] = block
    return out


def blamed(versions, signs):
    """Version after version: (version, line) in which every line first stood."""
    out, old = [], None
    for seq, text in enumerate(versions):
        b = line_tokens(text)
        here = [(seq, k) for k in range(len(b))]
        if old is not None:
            a = line_tokens(versions[seq - 1])
            pairs = align(a, b)
            if signs is not None:
                pairs = pairs + PR.moved(a, b, pairs, signs)
            for x, y in pairs:
                here[y] = old[x]
        out.append(here)
        old = here
    return out


@pytest.mark.parametrize("signs", [None, 20])
def test_provenance(spark, signs):
    rng = random.Random(3)
    files = {}
    for f in range(25):
        lines, versions = [rng.choice(LINES) for _ in range(rng.randrange(12))], []
        for _ in range(rng.choice([1, 2, 7, 24])):
            versions.append("".join(lines) + rng.choice(["", "", "end"]))
            lines = edited(rng, lines)
        files[f"f{f}"] = versions
    rows = [(p, k, 100 * k, t) for p, ts in files.items() for k, t in enumerate(ts)]
    v = spark.createDataFrame(rows, "path string, seq long, commit_key long, content string")
    got = {}
    for r in PR.hunks(v, ["path"], signs).collect():
        lines = got.setdefault((r.path, r.seq), {})
        for k in range(r.n_lines):
            assert r.final_start + k not in lines
            lines[r.final_start + k] = (r.commit_key // 100, r.orig_start + k - 1)
    for p, ts in files.items():
        for seq, lines in enumerate(blamed(ts, signs)):
            assert [got.get((p, seq), {}).get(k + 1) for k in range(len(lines))] == lines
    newest = PR.at_revision(PR.hunks(v, ["path"], signs), v, ["path"])
    assert sum(r.n_lines for r in newest.collect()) == sum(len(line_tokens(ts[-1])) for ts in files.values())


def test_provenance_of_odd_versions(spark):
    v = spark.createDataFrame([("f", 0, 1, "a\n"), ("f", 1, 2, None), ("f", 2, 3, "a\n"), ("g", 0, 1, "")], "path string, seq long, commit_key long, content string")
    assert sorted((r.path, r.seq, r.commit_key) for r in PR.hunks(v, ["path"]).collect()) == [("f", 0, 1), ("f", 2, 3)]
    assert PR.hunks(v.limit(0), ["path"]).collect() == []


def test_moved_lines():
    a, b = ["x\n", "one long line to be moved down\n", "y\n", "z\n"], ["x\n", "y\n", "z\n", "one long line to be moved down\n"]
    assert PR.moved(a, b, [(0, 0), (2, 1), (3, 2)], 20) == [(1, 3)] and PR.moved(a, b, [(0, 0), (2, 1), (3, 2)], 60) == []


# --- trees


@pytest.mark.parametrize(
    "old, new, want",
    [
        ("1\n2\n3\n4\n5\n6\n7\n8\n9\n", "1\n2\n3\n4\nX\n6\n7\n8\n9\n", [(2, 7)]),
        ("".join(f"{k}\n" for k in range(20)), "".join(f"{k}\n" for k in range(20) if k not in (2, 17)), [(1, 5), (14, 5)]),
        ("".join(f"{k}\n" for k in range(20)), "".join(f"{k}\n" for k in range(20) if k not in (2, 9)), [(1, 11)]),
        (None, "a\nb\n", [(1, 2)]),
        ("a\nb\n", None, [(0, 0)]),
        ("a\n", "a\n", []),
    ],
)
def test_diff_hunks(old, new, want):
    assert TR.diff_hunks(old, new) == want


def test_diff_ranges(spark):
    old = spark.createDataFrame([(1, "a", "x\n"), (1, "b", "1\n2\n"), (1, "c", "same"), (1, "n", None)], "k long, path string, content string")
    new = spark.createDataFrame([(1, "b", "1\n3\n"), (1, "c", "same"), (1, "d", "new\n"), (2, "c", "other\n"), (1, "n", "")], "k long, path string, content string")
    got = sorted(tuple(r) for r in TR.diff_ranges(old, new, ["k"]).collect())
    assert got == [(1, "a", 0, 0), (1, "b", 1, 2), (1, "d", 1, 1), (2, "c", 1, 1)]
    status = {(r.k, r.path): r.status for r in TR.tree_diff(old, new, ["k"]).collect()}
    assert status == {(1, "a"): "D", (1, "b"): "M", (1, "d"): "A", (2, "c"): "A", (1, "n"): "A"}


def plain_renames(old, new, percent=50, rewrite=50):
    """All pairs, best first, of one commit's files."""
    bag = lambda t: {x: t.removesuffix("\n").split("\n").count(x) for x in t.removesuffix("\n").split("\n")}
    size = lambda b: sum(n * (len(x.encode()) + 1) for x, n in b.items())
    common = lambda a, b: sum(min(n, b.get(x, 0)) * (len(x.encode()) + 1) for x, n in a.items())
    src = {p: t for p, t in old.items() if t and p not in new}
    src |= {p: t for p, t in old.items() if t and p in new and new[p] != t and 100 * common(bag(t), bag(new[p] or "")) < rewrite * max(size(bag(t)), size(bag(new[p] or "")) if new[p] else 0)}
    dst = {p: t for p, t in new.items() if t and p not in old}
    out = {}
    for text in set(src.values()):
        for a, b in zip(sorted(p for p, t in src.items() if t == text), sorted(p for p, t in dst.items() if t == text)):
            out[a] = (b, 1.0)
    pairs = []
    for a in src.keys() - out.keys():
        for b in dst.keys() - {x for x, _ in out.values()}:
            x, y = bag(src[a]), bag(dst[b])
            c, m = common(x, y), max(size(x), size(y))
            if 100 * c >= percent * m:
                pairs.append((-c / m, a, b))
    used = {b for b, _ in out.values()}
    for s, a, b in sorted(pairs):
        if a not in out and b not in used:
            out[a] = (b, -s)
            used.add(b)
    return {(a, b, s) for a, (b, s) in out.items()}


def test_renames(spark):
    rng = random.Random(8)
    old_rows, new_rows, want = [], [], set()
    for k in range(12):
        old = {f"p{i}": rng.choice(["", "{\n", "".join(rng.choice(LINES) for _ in range(rng.randrange(1, 9)))]) for i in range(9)}
        new = {}
        for p, t in old.items():
            turn = rng.random()
            if turn < 0.2:
                new[p] = t
            elif turn < 0.35:
                new[p] = "".join(edited(rng, line_tokens(t))) or "z"
            elif turn < 0.8:
                new[f"q{rng.randrange(12)}"] = rng.choice([t, "".join(edited(rng, line_tokens(t)))])
        old_rows += [(k, p, t) for p, t in old.items()]
        new_rows += [(k, p, t) for p, t in new.items()]
        want |= {(k, *r) for r in plain_renames(old, new)}
    schema = "commit_key long, path string, content string"
    old, new = spark.createDataFrame(old_rows, schema), spark.createDataFrame(new_rows, schema)
    got = {tuple(r) for r in TR.renames(old, new, ["commit_key"]).collect()}
    assert got == want and len(got) > 10
    # the commit's changes lead pending files to their new paths
    ch = TR.changes(old, new, ["commit_key"])
    moved = {(r.commit_key, r.old_path, r.new_path) for r in ch.where("status = 'R'").collect()}
    assert moved == {r[:3] for r in want}
    ch = ch.selectExpr("cast(commit_key as string) commit_id", "0 parent_idx", "status", "old_path", "new_path")
    resolved = FI.resolve(ch.where("status = 'R'").selectExpr("commit_id", "old_path path"), ch)
    assert {(int(r.commit_id), r.path, r.resolved) for r in resolved.collect()} == moved
    assert TR.renames(old.limit(0), new, ["commit_key"]).collect() == []

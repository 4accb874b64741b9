"""Periodic runs, the Merkle manifest and URL filters against plain versions, on rows with
nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tests.llm.test_llm_operators import docs, prose
from tracelight.llm import manifest as MF, runs as RU, urlfilter as U

# --- periodic runs


def plain_runs(w, times=4, least=6):
    """Every period tried at every place."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def odd_words(rng):
    letters = "abcd"[: rng.choice([1, 2, 2, 3, 4])]
    w = [rng.choice(letters) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(5)):
        p = [rng.choice(letters) for _ in range(rng.randrange(1, 7))]
        at = rng.randrange(len(w) + 1)
        w[at:at] = (p * 9)[: rng.randrange(1, 45)]
    return w * rng.randrange(1, 5) if rng.random() < 0.3 else w


def test_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(2500):
        w, times, least = odd_words(rng), *rng.choice([(4, 6), (4, 6), (2, 2), (3, 5), (4, 1)])
        assert RU.whole_runs([ord(c) for c in w], times, least) == plain_runs(w, times, least), w
        assert RU.runs_of(w, times, least) == plain_runs(w, times, least), w


def test_factors_begin_earlier():
    rng = random.Random(12)
    for _ in range(300):
        w = [ord(c) for c in odd_words(rng)]
        at = 0
        for start, k, source in RU.factors(w):
            assert start == at and (source < 0) == (w[start] not in w[:start])
            if source >= 0:
                assert source < start and w[source : source + k] == w[start : start + k]
                longer = w[start : start + k + 1]
                assert len(longer) == k or all(w[j : j + k + 1] != longer for j in range(start))
            at += k
        assert at == len(w)


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, orig, n = h // 10, list(w), len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [orig[i] if i < a else orig[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None,) * 3
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_runs(spark):
    rng = random.Random(13)
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "x  b\tb\nb b b b  ", "é é é é é é é", prose(rng, 40), "la li lu " * 400]
    texts += [" ".join(odd_words(rng)) for _ in range(120)] + [prose(rng, 4000)]
    d = docs(spark, texts)
    got = sorted(tuple(r) for r in RU.scan(d, plant=True).collect())
    assert got == [plain_row(i, t) for i, t in enumerate(texts)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 5
    assert RU.scan(d.limit(0)).collect() == []
    # a null doc_id keeps its words, and rows may repeat
    rows = spark.createDataFrame([(None, "b b b b b b"), (None, "b b b b b b")], "doc_id long, text string")
    assert [(r.doc_id, r.n_runs, r.length) for r in RU.scan(rows, plant=True).collect()] == [(None, 1, 6)] * 2


def test_collapse(spark):
    d = docs(spark, [None, "a  b", "x y y y y y y z", "la li la li la li la li lu"]).withColumnRenamed("row", "runs")
    got = {r.doc_id: r for r in RU.collapse(d).collect()}
    assert [got[k].text for k in range(4)] == [None, "a  b", "x y z", "la li lu"]
    assert got[0].runs == got[1].runs == [] and got[2].runs[0].asDict() == {"start": 1, "length": 6, "period": 1}
    assert got[3].lang == "en" and RU.collapse(d).columns == [c for c in d.columns if c != "runs"] + ["runs"]


# --- manifest


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def committed(row, low=False):
    out = ""
    for c in MF.COMMITTED:
        x = row[c]
        if x is not None and c == "text" and low:
            x = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in x)
        out += "-" if x is None else f"{len(str(x).encode())}:{x}"
    return H([out])


def proof(nodes, i):
    """(root, siblings level by level) of node i."""
    path = []
    while len(nodes) > 1:
        a = i - i % 8
        path.append((nodes[a:i], nodes[i + 1 : a + 8]))
        nodes, i = [H(nodes[k : k + 8]) for k in range(0, len(nodes), 8)], i // 8
    return nodes[0], path


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tops = {}
    for lang in order:
        by[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, committed(r)))
        tops[lang] = proof([committed(r) for r in by[lang]], 0)[0]
    out = []
    for lang in order:
        leaves = [committed(r) for r in by[lang]]
        root, above = proof([tops[x] for x in order], order.index(lang))
        for i, r in enumerate(by[lang]):
            path = proof(leaves, i)[1] + above
            third = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 0
            got = committed(r, low=third)
            for a, b in path:
                got = H([*a, got, *b])
            out.append((r["doc_id"], leaves[i], tops[lang], root, H(x for a, b in path for x in (*a, *b)), got, got == root))
    return sorted(out, key=str)


FIELDS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string"


def manifest_rows(rng, n):
    langs = ["en", "en", "en", "de", "", None, "fr", "éé", "fr-CA"]
    rows = []
    for k in range(n):
        t = rng.choice([None, "", "abc", "ABC Def", prose(rng, 5).title(), prose(rng, 3)])
        i = rng.choice([k, k, k, -k, k * 10**13, None if rng.random() < 0.2 else k, 7])
        rows.append((i, t, "en" if k < n // 3 else rng.choice(langs), rng.choice(["web", None, "b:1"]), None if t is None else len(t), "x", "y"))
    return rows + rows[:9]


def check_manifest(spark, rows):
    named = [dict(zip([f.split()[0] for f in FIELDS.split(", ")], r)) for r in rows]
    got = MF.manifest(spark.createDataFrame(rows, FIELDS), changed=MF.tampered()).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(named)


def test_manifest(spark):
    check_manifest(spark, manifest_rows(random.Random(1), 1600))


def test_small_manifests(spark):
    for n in (0, 1, 9):
        rows = [(k, "T", "en", None, 1, "x", "y") for k in range(n)]
        check_manifest(spark, rows) if n else [MF.manifest(spark.createDataFrame([], FIELDS)).collect()] == [[]]
    assert MF.manifest(spark.createDataFrame([], FIELDS)).collect() == []


def test_manifest_of_a_shared_id(spark, monkeypatch):
    """One id in many rows is told apart by digests, equal rows are counted."""
    monkeypatch.setattr(MF, "MOST", 16)
    monkeypatch.setattr(MF, "SHARE", 4)
    monkeypatch.setattr(MF, "STEP", 3)
    rng = random.Random(2)
    rows = [(None, f"t{k}", "en", "s", 2, "x", "y") for k in range(300)] + [(5, "same", "en", "s", 4, "x", "y")] * 700 + [(k, "u", "de", "s", 1, "x", "y") for k in range(200)]
    rng.shuffle(rows)
    check_manifest(spark, rows)


def test_manifest_sql(spark):
    rows = manifest_rows(random.Random(3), 300)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    named = [dict(zip([f.split()[0] for f in FIELDS.split(", ")], r)) for r in rows]
    assert sorted(con.execute(MF.ORACLE).fetchall(), key=str) == plain_manifest(named)


# --- URL filters


def canonical(u):
    return f'<html><head><link href="{u}" rel=canonical></head>'


PAGES = [
    (1, "http://a.org/x", canonical("http://b.net/y")), (2, "http://b.net/y", ""), (3, "https://c.org/z#f", canonical("http://a.org/x")), (4, "http://c.org/fr/z", canonical("http://a.org/x")),
    (5, None, canonical("http://b.net/")), (6, "nourl", None), (7, "http://d.org/r?url=http%3A%2F%2Fexample.com%2Fde%2Fk&x=1", ""),
    (8, "http://e.org/k?utm_source=1", "<META content=\"0; URL='http://q.net/'\" http-equiv=\"Refresh\">"), (9, "http://e.org/k", f"<!-- {canonical('http://z.org/fr/')} -->"),
    (10, "http://g.org/k?a=1&utm_x=2&b=3#t", None), (11, "http://Net/", "x"), (12, "http://www.Example.net/en/1", canonical("http://h.org/w")), (13, "http://h.org/w", ""),
    (14, "http://h.org/v", canonical("http://v.net/1")), (15, "http://h.org/v?utm_a=1", canonical("http://h.org/w")), (16, "http://i.net", ""), (17, "http://xnet/", ""), (18, "http://e.org/k", "twice"), (None, "ftp://u@B.net:1/", ""),
]
SCHEMA = "page_id long, url string, html string"


def run_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    return sorted(con.execute(U.ORACLE).fetchall(), key=str)


def test_url_filters(spark):
    got = {r.page_id: r for r in U.judge(spark.createDataFrame([(*p, "n", "b") for p in PAGES], SCHEMA + ", node string, by string")).collect()}
    verdicts = {k: (r.verdict, r.by, r.rule) for k, r in got.items()}
    assert verdicts[2] == ("block", "rule", "net/") and verdicts[12] == ("allow", "rule", "example.net/en/") and verdicts[4] == ("allow", "rule", "org/fr/")
    # an allowed alias goes before a blocked one
    assert verdicts[1] == verdicts[3] == verdicts[13] == verdicts[14] == verdicts[15] == ("allow", "default", None)
    # through a redirecting address, through a refresh, and without tracking parameters
    assert verdicts[7] == verdicts[8] == verdicts[9] == verdicts[18] == ("block", "class", None)
    assert verdicts[5] == verdicts[6] == verdicts[10] == verdicts[17] == ("allow", "default", None) and (got[5].host, got[5].path) == ("", "")
    assert verdicts[11] == ("block", "rule", "net/") and verdicts[16] == ("allow", "default", None) and got[16].path == ""
    assert sorted((tuple(r) for r in got.values()), key=str) == run_sql(PAGES)
    assert U.judge(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("link, address", [("/y", "b.net/y"), ("y?q", "b.net/p/y?q"), ("?q", "b.net/p/x?q"), ("//c.org", "c.org/"), ("#f", None), ("", None), ("mailto:a@b", None), ("HTTPS://C.org/a#b", "c.org/a")])
def test_links_against_their_page(spark, link, address):
    row = U.read_pages(spark.createDataFrame([(1, "http://b.net/p/x", f'<link rel="Canonical" href="{link}">')], SCHEMA)).first()
    assert row.aliases == ([] if address is None else [address])


@pytest.mark.parametrize("few", [0, 1000])
def test_hub_and_chain(spark, monkeypatch, few):
    """A blocked target of very many pages, a chain of redirects, and a table of redirects."""
    monkeypatch.setattr(U, "FEW", few)
    rows = [(k, f"http://s{k}.org/", canonical("http://hub.net/")) for k in range(300)] + [(1000 + k, f"http://t.org/{k}", canonical(f"/{k + 1}")) for k in range(40)]
    moved = spark.createDataFrame([("http://t.org/40", "http://end.net/"), (None, "http://x.net/"), ("http://free.org/", None)], "source_url string, target_url string")
    got = U.judge(spark.createDataFrame(rows, SCHEMA), redirects=moved).groupBy("verdict", "by").count().collect()
    assert [tuple(r) for r in got] == [("block", "class", 340)]

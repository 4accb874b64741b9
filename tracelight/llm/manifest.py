"""Merkle manifest of a table: a digest a row, a tree a group, and proofs of rows.

Rows are ranked within their group by doc_id without a global sort: ids are counted by
leading binary digits, the counts of all levels of the digits are summed from the top
down, and only rows that share all counted digits are sorted, together. A rank in base FAN,
digit by digit, is the key of a row in a trie whose nodes are rank prefixes; nodes with the
longest prefixes are reduced first, DIGITS digits at a time: one row a block of FAN**DIGITS
nodes, whatever the group. On the way back, blocks pass their siblings down to their members.

Order: doc_id (null first), then digest. Rows equal in all committed columns are equal
leaves side by side, and are counted before they are moved. Ids that very many different rows
share (null, for one) are told apart by digits of their digests. Group null comes first, the
others are in the order of their UTF-8 bytes. An empty table gives no row. Columns that are
not committed are ignored. A null doc_id counts as empty text for crc32.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import runtime as R

#: Nodes under one, and digits of base FAN that a block of the trie spans.
FAN, DIGITS = 8, 3
BLOCK = FAN**DIGITS
_BITS = BLOCK.bit_length() - 1
#: Rows that share all counted digits: as many as are wished for, and at most if digits are left.
SHARE, MOST = 256, 4096
#: Binary digits that one level of the counts spans, and those of a digest that are counted at most.
STEP, LEAF_BITS = 10, 52
#: Rows up to which small tables are broadcast: of numbers, and of paths (2 kB each).
FEW, FEW_PATHS = 100_000, 4_000
COMMITTED = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def written(value: Column) -> Column:
    """A value as it is committed: its UTF-8 bytes counted, then itself."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(written, values)).cast("binary"), 256))


def levels(total: int) -> int:
    """Steps from so many nodes to one."""
    k = 0
    while total > 1:
        total, k = -(-total // FAN), k + 1
    return k


def climbed(nodes: list[str], total: int) -> list[list[str]]:
    """A block's nodes, then those of the levels above, as far as the block or the tree
    of `total` nodes on the block's level goes."""
    out = [nodes]
    for _ in range(min(DIGITS, levels(total))):
        low = out[-1]
        out.append([digest("".join(low[i : i + FAN])) for i in range(0, len(low), FAN)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Level by level, what stands before and after node i in its run."""
    out = []
    for row in tree[:-1]:
        a = i - i % FAN
        out.append(("".join(row[a:i]), "".join(row[i + 1 : a + FAN])))
        i //= FAN
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


# A path is kept as text: a line "before,after" a level.
def _text(path: list[tuple[str, str]]) -> str:
    return "".join(f"{a},{b}\n" for a, b in path)


def _path(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split(",")) for line in text.splitlines()]


def _small(df: DataFrame, rows: int, most: int = FEW) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _groups(base: DataFrame) -> tuple[DataFrame, int, int]:
    """(group, g, total) with g the group's place, the number of groups and the largest total.
    Groups are ranked by counts of their first two bytes, then among those that share them."""
    named = base.groupBy("group").agg(F.count("*").alias("total")).withColumn("head", F.hex(F.substring(F.coalesce(F.col("group"), F.lit("")).cast("binary"), 1, 2)))
    named = R.stored(named.coalesce(1), "groups")
    heads = named.groupBy("head").agg(F.count("*").alias("n"))  # 65,793 rows at most
    heads = heads.select("head", F.coalesce(F.sum("n").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    within = F.row_number().over(W.partitionBy("head").orderBy(F.asc_nulls_first("group")))
    out = R.stored(named.withColumn("k", within).join(heads, "head").select("group", (F.col("below") + F.col("k") - 1).alias("g"), "total").coalesce(1), "groups")
    R.discard(named)
    n, most = out.agg(F.count("*"), F.max("total")).first()
    return out, n, most or 0


def _below(counts: DataFrame, digits: list[Column]) -> DataFrame:
    """counts(g, bucket, part, n): adds `below`, the rows of the group in smaller buckets.
    digits: the levels, coarse to fine; each refines the one before it, into 2**STEP at most."""
    names = [f"d{k}" for k in range(len(digits))]
    t = counts.select("*", *[d.alias(n) for d, n in zip(digits, names)])
    up = None
    for k in range(len(names)):
        keys = ["g", *names[:k]]
        here = t.groupBy(*keys, names[k]).agg(F.sum("n").alias("n"))
        smaller = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(names[k]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        if up is None:
            up = here.select(*keys, names[k], smaller.alias("below"))
        else:
            up = here.select(*keys, names[k], smaller.alias("more")).join(up, keys).select(*keys, names[k], (F.col("below") + F.col("more")).alias("below"))
    return t.join(up, ["g", *names]).select("g", "bucket", "part", "below")


def placed(rows: DataFrame, low: int, high: int, total: int) -> DataFrame:
    """rows(g, doc_id, leaf, n): adds start, the place of the first of a row's n copies in
    its group. low, high: the ids' range; total: rows in all."""
    shift = max(0, ((high - low + 1) * SHARE // max(total, 1)).bit_length() - 1)
    part = F.lit(0).cast("long")
    while True:
        # null ids go before all others
        bucket = F.coalesce(F.shiftright("doc_id", shift), F.lit((low >> shift) - 1)).cast("long")
        counts = R.stored(rows.groupBy("g", bucket.alias("bucket"), part.alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "counts")
        buckets, most = counts.agg(F.count("*"), F.max("rows")).first()
        most = most or 0
        if most <= MOST or shift == 0:
            break
        shift = max(0, shift - STEP)
        R.discard(counts)
    bits = 0
    if most > MOST:  # one id each: digits of the digest go on
        bits = min(LEAF_BITS, (most // SHARE).bit_length())
        heavy = R.stored(counts.where(F.col("rows") > MOST).select("g", "bucket", F.lit(True).alias("heavy")).coalesce(1), "heavy")
        rows = rows.withColumn("bucket", bucket).join(_small(heavy, heavy.count()), ["g", "bucket"], "left")
        head = F.shiftright(F.conv(F.hex(F.substring("leaf", 1, LEAF_BITS // 4 // 2 + 1)), 16, 10).cast("long"), 8 * (LEAF_BITS // 8 + 1) - bits)
        part = F.when(F.col("heavy"), head).otherwise(F.lit(0)).cast("long")
        rows = rows.withColumn("part", part).drop("heavy")
        counts = R.stored(rows.groupBy("g", "bucket", "part").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "counts")
        buckets = counts.count()
    else:
        rows = rows.withColumns({"bucket": bucket, "part": part})
    span, ups = (high >> shift) - (low >> shift) + 2, 0
    while span >> (STEP * (ups + 1)):
        ups += 1
    digits = [F.shiftright("bucket", STEP * k) for k in range(ups, -1, -1)]
    digits += [F.shiftright("part", max(0, bits - STEP * (k + 1))) for k in range(-(-bits // STEP))]
    below = R.stored(_below(counts, digits), "below", of=(counts,))
    held = W.partitionBy("g", "bucket", "part").orderBy(F.asc_nulls_first("doc_id"), "leaf").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(_small(below, buckets), ["g", "bucket", "part"]).withColumn("start", F.col("below") + F.coalesce(F.sum("n").over(held), F.lit(0))).drop("below", "bucket", "part")


def _up(blocks: DataFrame) -> DataFrame:
    """blocks(g, block, total, members): their nodes as (g, pos, total, node)."""
    def run(batches):
        for b in batches:
            g, block, total, members = (b.column(k).to_pylist() for k in range(4))
            nodes = [climbed(_nodes(m), t)[-1][0] for m, t in zip(members, total)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([-(-t // BLOCK) for t in total], pa.int64()), pa.array(nodes, pa.string())], names=["g", "pos", "total", "node"])

    return blocks.select("g", "block", "total", "members").mapInArrow(run, "g long, pos long, total long, node string")


def _nodes(members: list[dict]) -> list[str]:
    """A block's nodes in order; copies take a place each."""
    out = []
    for m in sorted(members, key=lambda m: m["pos"]):
        out += [m["node"].hex() if isinstance(m["node"], bytes) else m["node"]] * (m.get("n") or 1)
    return out


def _gathered(nodes: DataFrame) -> DataFrame:
    block = F.shiftright("pos", _BITS).alias("block")
    return nodes.groupBy("g", block).agg(F.max("total").alias("total"), F.collect_list(F.struct("pos", "node")).alias("members"))


def _tree(blocks: DataFrame, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """The nodes (g, node) that remain of each group, and the stored blocks of all rounds,
    lowest first. total: nodes of the largest group."""
    rounds = [blocks]
    while True:
        up = _up(rounds[-1])
        total = -(-total // BLOCK)
        if total <= 1:
            return up.select("g", "node"), rounds
        rounds.append(R.stored(_gathered(up), "blocks"))


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """paths(g, pos, path, subroot, root) of blocks, joined to them."""
    n = blocks.count()
    return blocks.join(_small(paths.withColumnRenamed("pos", "block"), n, FEW_PATHS), ["g", "block"]).select("g", "block", "total", "members", "path", "subroot", "root")


def _down(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of the blocks' members."""
    def run(batches):
        for b in batches:
            rows = []
            for g, block, total, members, path, subroot, root in zip(*(c.to_pylist() for c in b.columns)):
                tree = climbed(_nodes(members), total)
                rows += [(g, block * BLOCK + i, _text(siblings(tree, i)) + path, subroot, root) for i in range(len(tree[0]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.string()] * 3)], names=["g", "pos", "path", "subroot", "root"])

    return _with_paths(blocks, paths).mapInArrow(run, "g long, pos long, path string, subroot string, root string")


def _proofs(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """A row per leaf, with its proof and the root that its changed digest (or else its own) gives."""
    def run(batches):
        for b in batches:
            rows = []
            for _, block, total, members, path, subroot, root in zip(*(c.to_pylist() for c in b.columns)):
                tree, above, i = climbed(_nodes(members), total), _path(path), 0
                for m in sorted(members, key=lambda m: m["pos"]):
                    for _ in range(m["n"]):
                        way = siblings(tree, i) + above
                        got = folded((m["changed"] or m["node"]).hex(), way)
                        rows.append((m["doc_id"], tree[0][i], subroot, root, digest("".join(map("".join, way))), got, got == root))
                        i += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] + [pa.string()] * 5 + [pa.bool_()])], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _with_paths(blocks, paths).mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, committed: list[str] = COMMITTED, changed: Column | None = None, group: str = "lang") -> DataFrame:
    """Per row doc_id, leaf, subroot (of its group), root, proof_sha256 (of its siblings,
    level by level), folded_root and verified. committed: the columns of a leaf, in order.
    changed: the digest to verify where it is not null, as binary; else a row's own."""
    R.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(group).cast("string").alias("group"), leaf([F.col(c) for c in committed]).alias("leaf"), (F.lit(None).cast("binary") if changed is None else changed).alias("changed"))
    base = R.stored(R.spread(rows), "leaves")
    groups, n_groups, most = _groups(base)
    low, high, total = base.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    # null groups meet as well
    named = base.join(_small(groups.select(F.col("group").alias("_group"), "g"), n_groups), F.col("group").eqNullSafe(F.col("_group")))
    counted = named.groupBy("g", "doc_id", "leaf").agg(F.count("*").alias("n"), F.first("changed", ignorenulls=True).alias("changed"))
    # which of equal rows has which place is open, but they are equal; the tree is made of what is stored
    totals = _small(groups.select("g", "total"), n_groups)
    first, last = F.shiftright("start", _BITS), F.shiftright(F.col("start") + F.col("n") - 1, _BITS)
    pieces = placed(counted, low or 0, high or 0, total).select("*", F.explode(F.sequence(first, last)).alias("block"))
    pos = F.greatest(F.col("start"), F.col("block") * BLOCK)
    end = F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * BLOCK)
    member = F.struct(pos.alias("pos"), (end - pos).alias("n"), "doc_id", F.col("leaf").alias("node"), "changed")
    blocks = R.stored(pieces.groupBy("g", "block").agg(F.collect_list(member).alias("members")).join(totals, "g").select("g", "block", "total", "members"), "blocks")
    R.discard(base)
    top, rounds = _tree(blocks, most)
    subroots = R.stored(top.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(n_groups).cast("long").alias("total"), "node"), "subroots")
    root, heads = _tree(R.stored(_gathered(subroots), "blocks"), n_groups)
    paths = root.select("g", F.lit(0).cast("long").alias("pos"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    paths = reduce(lambda p, b: R.stored(_down(b, p), "paths"), reversed(heads), paths)
    # a group's path from here on is that of its only top block
    paths = paths.drop("subroot").join(subroots.select("pos", F.col("node").alias("subroot")), "pos").select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    paths = reduce(lambda p, b: R.stored(_down(b, p), "paths"), reversed(rounds[1:]), paths)
    return _proofs(rounds[0], paths)


def tampered(committed: list[str] = COMMITTED) -> Column:
    """The digest of a row whose text is lower-cased, for a third of the ids."""
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(R.crc_mod(F.col("doc_id"), 3) == 0, leaf([low if c == "text" else F.col(c) for c in committed]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(R.table(spark, sf_dir, "documents"), changed=tampered())


#: Levels of each group's tree that the SQL goes up; 8**10 rows a group.
_ORACLE_LEVELS = 10
#: The table of the standard CRC-32 by half bytes.
_CRC = (0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C)


def _oracle() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    commit = lambda cs: "sha256(" + " || ".join(map(field, cs)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    half = lambda c, x: f"xor({c} >> 4, list_extract(t, CAST(xor({c}, {x}) & 15 AS BIGINT) + 1))"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: x <> ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {half(half('c', 'b'), '(b >> 4)')})"
    ctes = [
        f"crc AS (SELECT doc_id AS id, xor({crc}, 4294967295::BIGINT) AS h FROM documents, (SELECT [{', '.join(map(str, _CRC))}]::BIGINT[] AS t))",
        f"l0 AS (SELECT d.doc_id, lang, {commit(COMMITTED)} AS leaf, CASE WHEN h % 3 = 0 THEN {commit([low if c == 'text' else c for c in COMMITTED])} ELSE {commit(COMMITTED)} END AS changed FROM documents d JOIN (SELECT DISTINCT id, h FROM crc) c ON c.id IS NOT DISTINCT FROM d.doc_id)",
        "t0 AS (SELECT *, coalesce(lang, '') || CASE WHEN lang IS NULL THEN '-' ELSE '+' END AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i0 FROM l0)",
        "n0 AS (SELECT g, i0 AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM t0)",
        "p0 AS (SELECT g, i0, i0 AS i, changed AS f, '' AS proof FROM t0)",
    ]
    for k in range(_ORACLE_LEVELS):
        ctes += [
            f"s{k} AS (SELECT g, i, n, h, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM n{k})",
            f"n{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (max(n) + 7) // 8 AS n FROM n{k} GROUP BY g, i // 8)",
            f"p{k + 1} AS (SELECT p.g, i0, p.i // 8 AS i, CASE WHEN n = 1 THEN f ELSE sha256(a || f || b) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || a || b END AS proof FROM p{k} p JOIN s{k} s ON s.g = p.g AND s.i = p.i)",
        ]
    top = _ORACLE_LEVELS
    ctes += [
        f"m0 AS (SELECT g, row_number() OVER (ORDER BY g <> '-', g) - 1 AS i, h, count(*) OVER () AS n FROM n{top})",
        "w0 AS (SELECT g, h AS subroot, i AS j FROM m0)",
        f"q0 AS (SELECT p.g, i0, j, f, proof, subroot FROM p{top} p JOIN w0 w ON w.g = p.g)",
    ]
    for k in range(3):
        ctes += [
            f"o{k} AS (SELECT i, n, h, coalesce(string_agg(h, '') OVER (PARTITION BY i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM m{k})",
            f"m{k + 1} AS (SELECT i // 8 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (max(n) + 7) // 8 AS n FROM m{k} GROUP BY i // 8)",
            f"q{k + 1} AS (SELECT q.g, i0, j // 8 AS j, CASE WHEN n = 1 THEN f ELSE sha256(a || f || b) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || a || b END AS proof, subroot FROM q{k} q JOIN o{k} o ON o.i = q.j)",
        ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT t.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM q3 q JOIN t0 t ON t.g = q.g AND t.i0 = q.i0, (SELECT h AS root FROM m3)"


ORACLE = _oracle()

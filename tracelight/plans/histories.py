"""Queries over versions of files: provenance, tree diffs and renames, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.text import lines
from ..operators import blame as BL, graph as GR, provenance as PR, trees as TR
from ..operators.tables import Scratch
from ..sources import projection as P
from .registry import op

#: vl: every line of every version, with its number.
_LINES = """v AS (SELECT o_orderkey AS commit_key, 'src/h' || o_custkey % 200 AS path, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) - 1 AS seq FROM orders),
li AS (SELECT DISTINCT l_orderkey, l_linenumber AS ln FROM lineitem),
vl AS (SELECT path, s AS seq, oseq, ln, row_number() OVER (PARTITION BY path, s ORDER BY oseq, ln) AS line FROM (SELECT path, seq AS oseq, seq + age AS s, ln, age FROM v JOIN li ON l_orderkey = commit_key, (SELECT unnest(range(0, 5)) AS age)) x
 WHERE (age = 0 OR (ln + 2 * oseq + age) % 4 <> 0) AND EXISTS (FROM v WHERE v.path = x.path AND v.seq = x.s))"""

#: born: every line with the version and place where it first stood without a break.
_BORN = f"""{_LINES}, isl AS (SELECT *, seq - row_number() OVER (PARTITION BY path, oseq, ln ORDER BY seq) AS g FROM vl),
born AS (SELECT path, seq, line, ln, oseq, first_value(seq) OVER w AS born_seq, first_value(line) OVER w AS orig FROM isl WINDOW w AS (PARTITION BY path, oseq, ln, g ORDER BY seq))"""


@op("S6_provenance", f"""WITH {_BORN}, cut AS (SELECT *, CASE WHEN lag(born_seq) OVER w = born_seq AND lag(orig) OVER w + 1 = orig THEN 0 ELSE 1 END AS fresh FROM born WINDOW w AS (PARTITION BY path, seq ORDER BY line)),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY path, seq ORDER BY line) AS h FROM cut)
SELECT h.path, h.seq, commit_key, min(line) AS final_start, min(orig) AS orig_start, count(*) AS n_lines FROM h JOIN v ON v.path = h.path AND v.seq = born_seq GROUP BY h.path, h.seq, h, commit_key""")
def _(spark, d):
    return PR.hunks(P.histories(spark, d), ["path"])


@op("J1_blame_from_versions", f"""WITH {_BORN} SELECT path, seq, commit_key, line AS line_number, orig AS orig_line, CASE WHEN born_seq = oseq THEN ['AI', 'AIModified', 'Human'][ln % 3 + 1] ELSE 'Unknown' END AS source_type FROM born JOIN v USING (path) WHERE v.seq = born_seq AND born.seq = (SELECT max(seq) FROM v w WHERE w.path = born.path)"""
    .replace("SELECT path, seq, commit_key", "SELECT path, born.seq, v.commit_key"))
def _(spark, d):
    """The newest version of every file, on hunks derived from its versions; notes are those
    of the commits that the hunks name."""
    v, numbered = P.histories(spark, d), P.versions(spark, d)
    newest = Scratch(spark, "newest").write(PR.at_revision(PR.hunks(v, ["path"]), numbered, ["path"]))
    at = v.join(newest.select("commit_key", "path").distinct(), ["commit_key", "path"], "left_semi").select("commit_key", "path", "seq", F.posexplode(lines(F.col("content"))).alias("k", "text"))
    own = at.where(F.col("text").startswith(F.concat(F.lit("line "), F.col("seq").cast("string"), F.lit(":"))))
    kind = F.element_at(F.array(F.lit("AI"), F.lit("AIModified"), F.lit("Human")), (F.substring_index("text", ":", -1).cast("int") % 3 + 1))
    notes = own.select("commit_key", "path", (F.col("k") + 1).cast("long").alias("line_number"), kind.alias("source_type"))
    last = numbered.groupBy("path").agg(F.max("seq").alias("seq"))
    return BL.blame(newest, notes).join(last, "path").select("path", "seq", "commit_key", "line_number", "orig_line", "source_type")


@op("S7_tree_diff", f"""WITH {_LINES}, f AS (SELECT path, seq, count(line) AS n, string_agg(oseq || ':' || ln, ',' ORDER BY line) AS t FROM v LEFT JOIN vl USING (path, seq) GROUP BY path, seq),
pair AS (SELECT path, coalesce(a.seq, b.seq) AS seq, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, a.path IS NULL AS fresh, b.path IS NULL AS gone FROM (SELECT path, seq + 2 AS seq, n, t FROM f) a FULL JOIN f b USING (path, seq) WHERE a.t IS DISTINCT FROM b.t OR a.path IS NULL OR b.path IS NULL),
kept AS (SELECT p.path, p.seq, a.line AS la, b.line AS lb FROM pair p JOIN vl a ON a.path = p.path AND a.seq = p.seq - 2 JOIN vl b ON b.path = p.path AND b.seq = p.seq AND b.oseq = a.oseq AND b.ln = a.ln
 UNION ALL SELECT path, seq, 0, 0 FROM pair UNION ALL SELECT path, seq, na + 1, nb + 1 FROM pair),
step AS (SELECT *, lead(la) OVER w AS ja, lead(lb) OVER w AS jb FROM kept WINDOW w AS (PARTITION BY path, seq ORDER BY la)),
ch AS (SELECT *, lag(jb) OVER (PARTITION BY path, seq ORDER BY lb, la) AS before FROM step WHERE ja - la > 1 OR jb - lb > 1),
grp AS (SELECT *, sum(CASE WHEN lb + 1 - before <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY path, seq ORDER BY lb, la) AS g FROM ch),
h AS (SELECT path, seq, g, greatest(min(lb) + 1 - 3, 1) AS s, least(max(jb) - 1 + 3, any_value(nb)) AS e FROM grp JOIN pair USING (path, seq) GROUP BY path, seq, g)
SELECT path, seq, CASE WHEN e >= s THEN s ELSE s - 1 END AS range_start, CASE WHEN e >= s THEN e ELSE s - 1 END AS range_end FROM h""")
def _(spark, d):
    """Every version of a file against the one two before it."""
    v = P.histories(spark, d).select("seq", "path", "content")
    return TR.diff_ranges(v.withColumn("seq", F.col("seq") + 2), v, ["seq"])


_TREES = """t AS (SELECT doc_id // 40 AS c, doc_id, text, doc_id % 5 = 0 AS stays, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS l FROM documents),
fo AS (SELECT c, CASE WHEN stays THEN 'doc/' ELSE 'old/' END || doc_id AS path, CASE WHEN doc_id % 35 = 0 THEN 'written anew ' || doc_id WHEN doc_id % 7 = 0 THEN text ELSE array_to_string([x FOR x, i IN l IF (i - 1) % 3 <> 1], chr(10)) END AS content FROM t),
fn AS (SELECT c, CASE WHEN stays THEN 'doc/' ELSE 'new/' END || doc_id AS path, text AS content FROM t),
st AS (SELECT c, path, CASE WHEN a.content IS NULL THEN 'A' WHEN b.content IS NULL THEN 'D' ELSE 'M' END AS status FROM (FROM fo WHERE content IS NOT NULL) a FULL JOIN (FROM fn WHERE content IS NOT NULL) b USING (c, path) WHERE a.content IS DISTINCT FROM b.content)"""

_RENAMES = f"""{_TREES},
bag AS (SELECT side, c, path, line, count(*) AS n, max(strlen(line) + 1) AS w FROM (SELECT side, c, path, unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS line FROM (SELECT 0 AS side, * FROM fo UNION ALL SELECT 1, * FROM fn) WHERE content <> '') GROUP BY ALL),
size AS (SELECT side, c, path, sum(n * w) AS size FROM bag GROUP BY ALL),
self AS (SELECT c, path FROM st LEFT JOIN (SELECT a.c, a.path, sum(least(a.n, b.n) * a.w) AS common FROM bag a JOIN bag b ON a.side = 0 AND b.side = 1 AND a.c = b.c AND a.path = b.path AND a.line = b.line GROUP BY ALL) USING (c, path) JOIN (SELECT c, path, max(size) AS larger FROM size GROUP BY ALL) USING (c, path) WHERE status = 'M' AND coalesce(common, 0) * 100 < larger * 50),
src AS (SELECT c, path, content FROM fo JOIN (SELECT c, path FROM st WHERE status = 'D' UNION ALL FROM self) USING (c, path) WHERE content <> ''),
dst AS (SELECT c, path, content FROM fn JOIN st USING (c, path) WHERE status = 'A' AND content <> ''),
rs AS (SELECT *, row_number() OVER (PARTITION BY c, content ORDER BY path) AS k FROM src), rd AS (SELECT *, row_number() OVER (PARTITION BY c, content ORDER BY path) AS k FROM dst),
ex AS (SELECT c, rs.path AS old_path, rd.path AS new_path, 1.0::DOUBLE AS score FROM rs JOIN rd USING (c, content, k)),
pr AS (SELECT a.c, a.path AS old_path, b.path AS new_path, sum(least(a.n, b.n) * a.w) AS common FROM bag a JOIN bag b ON a.side = 0 AND b.side = 1 AND a.c = b.c AND a.line = b.line
 WHERE (a.c, a.path) IN (SELECT (c, path) FROM src) AND (a.c, a.path) NOT IN (SELECT (c, old_path) FROM ex) AND (b.c, b.path) IN (SELECT (c, path) FROM dst) AND (b.c, b.path) NOT IN (SELECT (c, new_path) FROM ex) GROUP BY ALL),
sc AS (SELECT pr.*, CAST(common AS DOUBLE) / greatest(x.size, y.size) AS score FROM pr JOIN size x ON x.side = 0 AND x.c = pr.c AND x.path = old_path JOIN size y ON y.side = 1 AND y.c = pr.c AND y.path = new_path WHERE common * 100 >= greatest(x.size, y.size) * 50),
rk AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, old_path, new_path) AS r FROM sc),
greedy AS (SELECT c, 0 AS r, [''] AS used FROM (SELECT DISTINCT c FROM rk) UNION ALL SELECT g.c, g.r + 1, CASE WHEN list_contains(used, '<' || old_path) OR list_contains(used, '>' || new_path) THEN used ELSE list_concat(used, ['<' || old_path, '>' || new_path, old_path || '>' || new_path]) END FROM greedy g JOIN rk ON rk.c = g.c AND rk.r = g.r + 1),
best AS (SELECT c, used FROM greedy QUALIFY row_number() OVER (PARTITION BY c ORDER BY r DESC) = 1),
rn AS (FROM ex UNION ALL SELECT rk.c, old_path, new_path, score FROM rk JOIN best ON best.c = rk.c AND list_contains(used, old_path || '>' || new_path))"""


@op("S9_renames", f"WITH RECURSIVE {_RENAMES} SELECT c AS commit_key, old_path, new_path, score FROM rn")
def _(spark, d):
    old, new = P.moved_files(spark, d)
    return TR.renames(old, new, ["commit_key"])


@op("S8_changes_from_trees", f"""WITH RECURSIVE {_RENAMES} SELECT c AS commit_key, status, CASE WHEN status <> 'A' THEN path END AS old_path, CASE WHEN status <> 'D' THEN path END AS new_path FROM st
WHERE NOT (status = 'A' AND (c, path) IN (SELECT (c, new_path) FROM rn)) AND NOT (status = 'D' AND (c, path) IN (SELECT (c, old_path) FROM rn)) UNION ALL SELECT c, 'R', old_path, new_path FROM rn""")
def _(spark, d):
    old, new = P.moved_files(spark, d)
    return TR.changes(old, new, ["commit_key"])


@op("G1_ancestors_of_chains", f"""WITH RECURSIVE {_LINES.partition(', li AS')[0].partition(',\nli AS')[0]}, p AS (SELECT a.commit_key, b.commit_key AS parent_key FROM v a JOIN v b ON a.path = b.path AND a.seq = b.seq + 1), h AS (SELECT path, max(seq) - 3 AS seq FROM v GROUP BY path),
r AS (SELECT commit_key FROM v JOIN h USING (path, seq) UNION SELECT parent_key FROM r JOIN p USING (commit_key)) SELECT commit_key FROM r""")
def _(spark, d):
    """The history of every file as a line of commits, from the third before its last."""
    v, w = P.versions(spark, d), W.partitionBy("path").orderBy("seq")
    parents = v.where("path is not null").select("commit_key", F.lag("commit_key").over(w).alias("parent_key")).where("parent_key is not null")
    heads = v.join(v.groupBy("path").agg((F.max("seq") - 3).alias("seq")), ["path", "seq"]).select("commit_key")
    return GR.ancestors(parents, heads)

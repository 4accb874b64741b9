"""Queries over inputs as they come, and over answers of the engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..operators import export as EX
from ..operators.tables import Scratch
from ..sources import projection as P, readers
from ..sources.notes import NoteStore
from . import sql as Q
from .engine import Engine, Tables
from .registry import op


@op("S2_attributed_commits", "SELECT CAST(o_orderkey AS VARCHAR) AS commit_id FROM orders WHERE o_custkey % 3 > 0")
def _(spark, d):
    """Commits with a note, out of the store."""
    store = NoteStore(spark, Scratch(spark, "notes").folder, 16)
    store.upsert(P.table(spark, d, "orders").where("o_custkey % 3 > 0").select(F.col("o_orderkey").cast("string").alias("commit_id"), F.lit("{}").alias("note")))
    return store.read().select("commit_id")


@op("S14_diff_lines", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) END AS l FROM documents WHERE text IS NOT NULL))")
def _(spark, d):
    return readers.diff_lines(P.table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


@op("S20_notes_without_commit", f"WITH {Q.NOTE_LINES}, {Q.COMMITS} SELECT DISTINCT commit_key FROM note_lines WHERE commit_key NOT IN (SELECT commit_key FROM commits WHERE commit_key % 7 > 0)")
def _(spark, d):
    """What makes an export fail; retention passes over it."""
    return EX.missing(P.commits(spark, d).where("commit_key % 7 > 0"), P.note_lines(spark, d).select("commit_key").distinct()).select("commit_key")


@op("P28_bash_prompts", """WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN 'null' END AS d, CASE WHEN conv_id % 3 > 0 THEN repeat(text, 3) END AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN coalesce(d, '') NOT IN ('', 'null') THEN '[Bash] ' || d WHEN coalesce(c, '') <> '' THEN '[Bash] ' || substr(c, 1, 200) || CASE WHEN length(c) > 200 THEN '...' ELSE '' END ELSE '[Bash] AI-executed shell command' END AS prompt FROM c""")
def _(spark, d):
    c = P.table(spark, d, "conversations")
    turn = F.col("turn") % 4
    rows = c.select("conv_id", "turn", F.when(turn == 0, F.col("text")).when(turn == 1, "").when(turn == 2, "null").alias("description"), F.when(F.col("conv_id") % 3 > 0, F.repeat("text", F.lit(3))).alias("command"))
    return rows.select("conv_id", "turn", readers.bash_prompt().alias("prompt"))


@op("F7_hex_digest", "SELECT doc_id, substr(sha256(text), 1, 24) AS digest FROM documents")
def _(spark, d):
    return P.table(spark, d, "documents").select("doc_id", X.hex_digest(F.col("text"), 24).alias("digest"))


_REASONS = ("malformed", "unsupported version", "invalid session id", "prompt count mismatch", "file without edits")


@op("Z6_pending_states", "SELECT o_orderkey AS k, CASE o_orderkey % 7 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(_REASONS)) + " END AS reason FROM orders")
def _(spark, d):
    """A state per order, most of them with a fault."""
    k = F.col("o_orderkey") % 7
    uuid = F.concat(F.lpad(F.hex("o_orderkey"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    bad = lambda at, x, y: F.when(k == at, F.lit(x)).otherwise(F.lit(y))
    session = F.concat(F.lit('{"session_id":"'), F.when(k == 2, "s1").otherwise(uuid), F.lit('","prompt_count":'), bad(3, "2", "1"), F.lit(',"prompts":[{"index":0,"text":"p"}]}'))
    state = F.concat(F.lit('{"version":'), bad(1, "9", "3"), F.lit(',"session":'), session, F.lit(',"file_histories":{"f":{"path":"f","edits":['), bad(4, "", '{"edit_id":"e"}'), F.lit("]}}}"))
    text = F.when(k == 0, F.lit("{]")).otherwise(state)
    rows = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.from_json(text, S.PENDING).alias("p"))
    return readers.check_pending(rows).select("k", "reason")


def _engine(spark, d) -> Engine:
    refs = spark.createDataFrame([("HEAD", 1400), ("refs/heads/old", 21)], "ref_name string, commit_key long")
    hunks = P.blame_hunks(spark, d).where("path not like '%3'")
    return Engine(spark, Tables(P.commits(spark, d), P.note_lines(spark, d), P.commit_parents(spark, d), refs, None, P.prompts(spark, d), hunks))


_WALK = """r AS (SELECT CAST(1400 AS BIGINT) AS commit_key UNION SELECT p.parent_key FROM r JOIN parents p ON p.commit_key = r.commit_key),
b AS (SELECT CAST(21 AS BIGINT) AS commit_key UNION SELECT p.parent_key FROM b JOIN parents p ON p.commit_key = b.commit_key)"""


@op("J21_files_analyzed", f"""WITH RECURSIVE {Q.PARENTS}, {Q.NOTE_LINES}, {Q.NOTE_FILES}, {_WALK}, k AS (SELECT DISTINCT path FROM note_files WHERE commit_key IN (FROM r) AND ai_lines + ai_modified_lines >= 1 AND (ai_lines + ai_modified_lines) * 100.0 / total_lines >= 5)
SELECT (SELECT count(*) FROM k) AS files_analyzed, (SELECT count(*) FROM k WHERE path NOT LIKE '%3') AS files_annotated""")
def _(spark, d):
    """Of the check document: files that cannot be blamed count, and have no annotation."""
    doc = _engine(spark, d).annotations(format="checks", min_ai_lines=1, consolidate="file", max_annotations=1000)
    parsed = doc.select(F.from_json("json", "struct<annotations:array<struct<path:string>>,summary:struct<files_analyzed:bigint>>").alias("j"))
    return parsed.select("j.summary.files_analyzed", F.size(F.array_distinct("j.annotations.path")).cast("long").alias("files_annotated"))


@op("K13_summary_document", f"""WITH RECURSIVE {Q.PARENTS}, {Q.NOTE_LINES}, {Q.NOTE_FILES}, {_WALK}, c AS (SELECT commit_key FROM orders JOIN (SELECT commit_key FROM r EXCEPT SELECT commit_key FROM b) ON o_orderkey = commit_key), f AS (SELECT * FROM note_files WHERE commit_key IN (FROM c))
SELECT (SELECT count(*) FROM c) AS commits_analyzed, (SELECT count(DISTINCT commit_key) FROM f) AS commits_with_ai, CAST(sum(ai_lines + ai_modified_lines + human_lines) AS BIGINT) AS additions, CAST(sum(ai_lines) AS BIGINT) AS ai, count(DISTINCT path) AS files FROM f""")
def _(spark, d):
    """Numbers out of the JSON document of old..HEAD."""
    lines = _engine(spark, d).summary("old", "HEAD", "json")
    doc = lines.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("ls")).select(F.concat_ws("", F.transform("ls", lambda x: x["line"])).alias("t"))
    j = F.from_json("t", "struct<commits_analyzed:bigint,commits_with_ai:bigint,additions:struct<total:bigint,ai:bigint>,files:array<struct<path:string>>>")
    return doc.select(j.alias("j")).select("j.commits_analyzed", "j.commits_with_ai", F.col("j.additions.total").alias("additions"), F.col("j.additions.ai").alias("ai"), F.size("j.files").cast("long").alias("files"))

"""Readers of the engine's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions.text import lines
from . import auditlog


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit events in the order in which they were appended; see `auditlog`."""
    return auditlog.read(spark, path)


def notes(raw: DataFrame, strict: bool = True) -> DataFrame:
    """raw(commit_id, note text): parsed notes. strict fails on bad JSON, else they are
    dropped. version_ok is a warning, not a filter."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    out = raw.select("commit_id", F.from_json("note", S.NOTE, {"mode": mode}).alias("n"))
    if not strict:
        out = out.where("n is not null and n.session is not null")
    return out.withColumn("version_ok", F.col("n.version") == S.NOTE_VERSION)


def note_files(parsed: DataFrame) -> DataFrame:
    f = parsed.select("commit_id", F.explode("n.files").alias("f"))
    return f.select("commit_id", "f.path", "f.summary.*")


def note_lines(parsed: DataFrame) -> DataFrame:
    f = parsed.select("commit_id", F.explode("n.files").alias("f")).select("commit_id", "f.path", F.explode("f.lines").alias("l"))
    return f.select("commit_id", "path", "l.line_number", "l.content", F.col("l.source.type").alias("source_type"), F.col("l.source.similarity").alias("similarity"), "l.edit_id", "l.prompt_index", "l.confidence")


def note_prompts(parsed: DataFrame) -> DataFrame:
    p = parsed.select("commit_id", F.explode("n.prompts").alias("p"))
    return p.select("commit_id", F.col("p.index").alias("prompt_index"), "p.text", "p.timestamp", "p.affected_files")


def pending(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good states, quarantine): a whole file is one state. A state is good if it
    parses and passes check_pending; the others keep their text and the reason."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    checked = check_pending(raw.select("file", "raw", F.from_json("raw", S.PENDING).alias("p")))
    return checked.where("reason is null").select("file", "p"), checked.where("reason is not null").select("file", "raw", "reason")


def check_pending(states: DataFrame) -> DataFrame:
    """Adds reason: null for a valid state p."""
    uuid = r"^(?i)(\{|urn:uuid:)?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"
    empty = F.exists(F.map_values("p.file_histories"), lambda h: h["edits"].isNull() | (F.size(h["edits"]) == 0))
    reason = (
        F.when(F.col("p").isNull() | F.col("p.session").isNull(), "malformed")
        .when(~F.coalesce(F.col("p.version").isin(*S.PENDING_VERSIONS), F.lit(False)), "unsupported version")
        .when(~F.coalesce(F.col("p.session.session_id").rlike(uuid), F.lit(False)), "invalid session id")
        .when(F.coalesce("p.session.prompt_count", F.lit(0)) != F.coalesce(F.size("p.session.prompts"), F.lit(0)), "prompt count mismatch")
        .when(F.coalesce(empty, F.lit(False)), "file without edits")
    )
    return states.withColumn("reason", reason)


def hook_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(S.HOOK).json(path)


def diff_lines(texts: DataFrame, by: list[str], column: str = "text") -> DataFrame:
    """A row per line of a diff, with its place."""
    return texts.select(*by, F.posexplode(lines(F.col(column))).alias("n", "text"))


TRANSCRIPT = "type string, toolUseResult string, isCompactSummary boolean, planMode boolean, tool_name string, agentId string, message struct<content:string>"


def transcript_lines(raw: DataFrame, by: list[str]) -> DataFrame:
    """raw(by, n, value): parsed transcript lines."""
    return raw.select(*by, "n", F.from_json("value", TRANSCRIPT).alias("t")).select(*by, "n", "t.*")


def last_prompt(parsed: DataFrame, by: list[str], limit: int = 2000) -> DataFrame:
    """The last real user turn of each transcript: its string, or its text parts joined
    by blanks, cut to `limit` bytes; empty if it has neither."""
    user = (F.col("type") == "user") & F.col("toolUseResult").isNull() & ~F.coalesce("isCompactSummary", F.lit(False))
    content = F.max_by(F.struct("message.content"), "n").getField("content")
    got = parsed.where(user).groupBy(*by).agg(content.alias("content"))
    parts = F.from_json("content", "array<struct<type:string,text:string>>")
    text = F.when(F.col("content").startswith("["), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), " ")).otherwise(F.coalesce("content", F.lit("")))
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), 1, limit), "UTF-8")
    return got.select(*by, F.when(F.octet_length(text) <= limit, text).otherwise(cut).alias("prompt"))


def context(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Plan mode, subagent and depth of each transcript, in one aggregate."""
    entered = F.max_by(F.when(F.col("tool_name").isin("EnterPlanMode", "ExitPlanMode"), F.col("tool_name")), F.when(F.col("tool_name").isin("EnterPlanMode", "ExitPlanMode"), F.col("n")))
    plan = F.max_by("planMode", F.when(F.col("planMode").isNotNull(), F.col("n")))
    tasks, agents = F.count_if(F.col("tool_name") == "Task"), F.count_if(F.col("agentId").isNotNull())
    out = parsed.groupBy(*by).agg(plan.alias("p"), entered.alias("e"), tasks.alias("t"), agents.alias("a"))
    # a plan mode that is set to false lets the tools decide, as an absent one does
    mode = F.when(F.coalesce("p", F.lit(False)), True).otherwise(F.coalesce(F.col("e") == "EnterPlanMode", F.lit(False)))
    return out.select(*by, mode.alias("plan_mode"), ((F.col("t") > 0) | (F.col("a") > 0)).alias("is_subagent"), F.when(F.col("t") > 0, 1).otherwise(0).alias("agent_depth"))


def bash_prompt(description: str = "description", command: str = "command") -> F.Column:
    d, c = F.col(description), F.col(command)
    return F.when(F.coalesce(d, F.lit("")).isin("", "null"), F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("[Bash] "), F.left(c, F.lit(200)), F.when(F.length(c) > 200, "...").otherwise(""))).otherwise("[Bash] AI-executed shell command")).otherwise(F.concat(F.lit("[Bash] "), d))


def dirty_files(*listings: DataFrame) -> DataFrame:
    """Union of listings(seq, path): blanks removed, first place kept."""
    out = listings[0]
    for x in listings[1:]:
        out = out.unionByName(x)
    return out.where("path is not null and path <> ''").groupBy("path").agg(F.min("seq").alias("seq"))


def snapshot_changes(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """manifest(path, old_content) against now(path, new_content): files changed since,
    and files created since."""
    both = manifest.join(now, "path", "left").where(~F.col("old_content").eqNullSafe(F.coalesce("new_content", F.lit(""))))
    made = now.join(manifest, "path", "left_anti").select("path", F.lit(None).cast("string").alias("old_content"), "new_content")
    return both.select("path", "old_content", F.coalesce("new_content", F.lit("")).alias("new_content"), F.lit("changed").alias("change")).unionByName(made.withColumn("change", F.lit("created")))


def relative_path(path: F.Column, root: str) -> F.Column:
    """The path under root, or null if it is empty, outside, or climbs with '..'."""
    root = root.rstrip("/") + "/"
    p = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)
    p = F.regexp_replace(p, r"^(\./)+", "")
    return F.when((p != "") & ~p.startswith("/") & ~p.rlike(r"(^|/)\.\.(/|$)"), p)


def redaction_input(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """(text): a given text, or a file as one; exactly one of them."""
    if (text is None) == (path is None):
        raise ValueError("give a text or a file, and not both")
    return spark.createDataFrame([(text,)], "text string") if path is None else spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")

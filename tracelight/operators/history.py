"""Batch form of capture: ordered edits per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import content_hash, lines
from .scan import Scan


def edit_id(*parts: Column) -> Column:
    """A stable id of the form of a UUID: the same edit has it in every run."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12))


def file_edits(events: DataFrame, by: list[str]) -> DataFrame:
    """events(by, path, seq, old_content, new_content): adds before, original,
    was_new_file and hashes. What an edit starts from is what the edit before left; the
    old content counts for a file's first edit only."""
    w = W.partitionBy(*by, "path").orderBy("seq")
    first = F.first_value("old_content").over(w)
    e = events.withColumn("before", F.coalesce(F.lag("new_content").over(w), F.col("old_content"), F.lit("")))
    return e.withColumns({
        "original": F.coalesce(first, F.lit("")), "was_new_file": first.isNull(), "edit_no": F.row_number().over(w).cast("long"),
        "after_hash": content_hash(F.col("new_content")), "before_hash": content_hash(F.col("before")), "after_lines": F.size(lines(F.col("new_content"))).cast("long"),
    })


def numbered_prompts(events: DataFrame, by: list[str], base: int = 0, wide: bool = False) -> DataFrame:
    """Adds prompt_index: neighbouring events with the same text share one prompt. wide: a
    session may be of any length; its parts are numbered side by side."""
    if wide:
        rows = Scan(events, by, ["seq"]).lag("_before", F.col("prompt")).lag("_there", F.lit(True)).result()
        rows = rows.withColumn("_new", F.when(F.col("_there").isNull() | ~F.col("prompt").eqNullSafe(F.col("_before")), 1).otherwise(0).cast("long")).drop("_before", "_there")
        return Scan(rows, by, ["seq"]).total("_n", F.col("_new")).result().withColumn("prompt_index", F.col("_n") - 1 + base).drop("_new", "_n")
    w = W.partitionBy(*by).orderBy("seq")
    new = F.coalesce((~F.col("prompt").eqNullSafe(F.lag("prompt").over(w))) | (F.row_number().over(w) == 1), F.lit(True))
    return events.withColumn("_new", new.cast("long")).withColumn("prompt_index", F.sum("_new").over(w) - 1 + base).drop("_new")


def prompt_table(numbered: DataFrame, by: list[str]) -> DataFrame:
    """A row per prompt: text, first time and the files it touched, in order."""
    first = numbered.groupBy(*by, "prompt_index", "path").agg(F.min("seq").alias("s"), F.first("prompt").alias("text"))
    return first.groupBy(*by, "prompt_index").agg(F.first("text").alias("text"), F.min("s").alias("first_seq"), F.transform(F.array_sort(F.collect_list(F.struct("s", "path"))), lambda x: x["path"]).alias("affected_files"))


def pending_totals(edits: DataFrame, by: list[str]) -> DataFrame:
    """Edits, files and lines gained of a pending state."""
    gain = F.greatest(F.size(lines(F.col("new_content"))) - F.size(lines(F.col("before"))), F.lit(0))
    return edits.groupBy(*by).agg(F.count("*").alias("total_edits"), F.count_distinct("path").alias("file_count"), F.sum(gain.cast("long")).alias("total_lines"))


def pending_status(edits: DataFrame, sessions: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """sessions(session_id, started_at, prompt_count): one row each with what
    edits(session_id, path, before, new_content) hold; sessions without edits have zeros."""
    t = pending_totals(edits, ["session_id"])
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    return sessions.join(t, "session_id", "left").select(
        "session_id", (F.coalesce("total_edits", F.lit(0)) > 0).alias("has_pending"), zero("file_count", "file_count"), zero("total_lines", "line_count"), zero("total_edits", "edit_count"), "prompt_count",
        is_stale(F.col("started_at"), as_of, hours).alias("is_stale"), age_text(F.col("started_at"), as_of).alias("age"), F.lit(hours).alias("max_pending_age_hours"),
    )


def is_default_context(context: Column) -> Column:
    """No plan, no subagent: a context that notes leave out; a missing one is such."""
    none = ~F.coalesce(context["plan_mode"], F.lit(False)) & context["subagent_id"].isNull() & (F.coalesce(context["agent_depth"], F.lit(0)) == 0) & context["plan_step"].isNull()
    return context.isNull() | none


def matching_edit(contents: DataFrame, edits: DataFrame, by: list[str]) -> DataFrame:
    """contents(by, content): the first edit (by seq) that left exactly this content."""
    first = edits.groupBy(*by, content_hash(F.col("new_content")).alias("hash")).agg(F.min("seq").alias("seq"))
    return contents.withColumn("hash", content_hash(F.col("content"))).join(first, [*by, "hash"], "left").select(*by, "content", "seq")


def age_text(started_at: Column, as_of: Column) -> Column:
    """'3 hours ago', '5 minutes ago', 'just now' or 'unknown'."""
    minutes = F.floor((F.unix_seconds(as_of) - F.unix_seconds(F.try_to_timestamp(started_at))) / 60)
    hours = F.floor(minutes / 60)
    return F.when(minutes.isNull(), "unknown").when(hours > 0, F.concat(hours.cast("string"), F.lit(" hours ago"))).when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" minutes ago"))).otherwise("just now")


def is_stale(started_at: Column, as_of: Column, hours: int = 24) -> Column:
    """Older than so many hours; a start that cannot be read is stale."""
    age = F.unix_seconds(as_of) - F.unix_seconds(F.try_to_timestamp(started_at))
    return F.coalesce(age > hours * 3600, F.lit(True))

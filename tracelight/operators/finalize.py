"""From pending edits to notes when commits arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import NOTE_MAX_BYTES, NOTE_WARN_BYTES


def changed_paths(changes: DataFrame) -> DataFrame:
    """Paths named on either side of any parent's diff."""
    return changes.select("commit_id", F.explode(F.array("old_path", "new_path")).alias("path")).where("path is not null").distinct()


def renames(changes: DataFrame) -> DataFrame:
    """Old path to new path; the first parent that renames it decides."""
    r = changes.where("status = 'R' and old_path is not null and new_path is not null")
    return r.groupBy("commit_id", "old_path").agg(F.min(F.struct("parent_idx", "new_path")).alias("m")).select("commit_id", "old_path", F.col("m.new_path").alias("new_path"))


def resolve(pending: DataFrame, changes: DataFrame) -> DataFrame:
    """pending(commit_id, path): adds resolved, the path under which the commit has the
    file, or null if it does not touch it and the file stays pending. A rename counts
    if either of its names changed."""
    ch = changed_paths(changes)
    p = pending.join(renames(changes).withColumnRenamed("old_path", "path"), ["commit_id", "path"], "left")
    mark = lambda name, col: ch.select("commit_id", F.col("path").alias(name), F.lit(True).alias(col))
    p = p.join(mark("path", "same"), ["commit_id", "path"], "left").join(mark("new_path", "moved"), ["commit_id", "new_path"], "left")
    moved = F.col("new_path").isNotNull() & (F.col("moved").isNotNull() | F.col("same").isNotNull())
    return p.withColumn("resolved", F.when(moved, F.col("new_path")).when(F.col("same").isNotNull(), F.col("path"))).drop("same", "moved", "new_path")


def with_content(resolved: DataFrame, versions: DataFrame) -> DataFrame:
    """Resolved files with their committed text; those that the commit deleted are
    used up without a result."""
    v = versions.where("content is not null").select("commit_id", F.col("path").alias("resolved"), F.col("content").alias("final"))
    return resolved.where("resolved is not null").join(v, ["commit_id", "resolved"])


def remaining(resolved: DataFrame) -> DataFrame:
    return resolved.where("resolved is null").drop("resolved")


def used_prompts(prompts: DataFrame, edits: DataFrame, by: list[str]) -> DataFrame:
    return prompts.join(edits.select(*by, "prompt_index").distinct(), [*by, "prompt_index"], "left_semi")


def remaining_prompts(prompts: DataFrame, processed: DataFrame, pending: DataFrame, by: list[str]) -> DataFrame:
    """prompts with marks: processed (an edit that a commit took has it), remaining (one
    that is still pending). A prompt may be both, or neither."""
    mark = lambda edits, name: edits.select(*by, "prompt_index").distinct().withColumn(name, F.lit(True))
    out = prompts.join(mark(processed, "processed"), [*by, "prompt_index"], "left").join(mark(pending, "remaining"), [*by, "prompt_index"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("processed", "remaining")})


def next_prompt(prompts: DataFrame, by: list[str], of: DataFrame | None = None) -> DataFrame:
    """The number after the largest. of(by): all that are asked for; 0 where nothing remains."""
    out = prompts.groupBy(*by).agg((F.max("prompt_index") + 1).alias("next_prompt"))
    return out if of is None else of.select(*by).distinct().join(out, by, "left").withColumn("next_prompt", F.coalesce("next_prompt", F.lit(0)))


def edit_flags(edits: DataFrame, by: list[str]) -> DataFrame:
    """Whether any edit was planned, and how many came from subagents."""
    return edits.groupBy(*by).agg(F.coalesce(F.bool_or("plan_mode"), F.lit(False)).alias("used_plan_mode"), F.count_if(F.col("agent_depth") > 0).alias("subagent_count"))


def attribution_totals(files: DataFrame) -> DataFrame:
    """What is reported when a note is attached: lines by AI and by humans, and files."""
    return files.groupBy("commit_key").agg(F.sum(F.col("ai_lines") + F.col("ai_modified_lines")).alias("total_ai"), F.sum("human_lines").alias("total_human"), F.count("*").alias("files"))


def total_redactions(prompts: DataFrame, by: list[str], events: str = "redaction_events") -> DataFrame:
    """Redactions of the prompts that stay pending."""
    return prompts.groupBy(*by).agg(F.sum(F.coalesce(F.size(events), F.lit(0))).cast("long").alias("total_redactions"))


def has_note(commits: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds has_attribution."""
    n = notes.select("commit_id").distinct().withColumn("_n", F.lit(True))
    return commits.join(n, "commit_id", "left").withColumn("has_attribution", F.col("_n").isNotNull()).drop("_n")


def size_check(notes: DataFrame, note: str = "note") -> DataFrame:
    """Adds bytes and status: ok, large or refused."""
    n = F.octet_length(note)
    return notes.withColumn("bytes", n).withColumn("status", F.when(n > NOTE_MAX_BYTES, "refused").when(n > NOTE_WARN_BYTES, "large").otherwise("ok"))


def upsert(notes: DataFrame, new: DataFrame) -> DataFrame:
    """new replaces notes of the same commit; refused ones change nothing."""
    good = size_check(new).where("status <> 'refused'").select(*notes.columns)
    return notes.join(good, "commit_id", "left_anti").unionByName(good)


def remove(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return notes.join(ids, "commit_id", "left_anti")


def copies(notes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(source, target): what each copy would do. A target that has a note keeps
    it; a source without one is a no-op."""
    s = notes.select(F.col("commit_id").alias("source"), "note")
    t = notes.select(F.col("commit_id").alias("target"), F.lit(True).alias("has"))
    out = pairs.join(s, "source", "left").join(t, "target", "left")
    return out.select("source", "target", F.when(F.col("note").isNull(), "missing").when(F.col("has").isNotNull(), "exists").otherwise("copied").alias("outcome"), "note")


def copied(notes: DataFrame, pairs: DataFrame) -> DataFrame:
    new = copies(notes, pairs).where("outcome = 'copied'").groupBy("target").agg(F.min(F.struct("source", "note")).alias("m")).select(F.col("target").alias("commit_id"), F.col("m.note").alias("note"))
    return notes.unionByName(new)


def orphans(notes: DataFrame, commits: DataFrame) -> DataFrame:
    return notes.join(commits, "commit_id", "left_anti")

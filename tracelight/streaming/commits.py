"""What a stream of captured edits does when commits arrive: notes, then retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import attribution as AT, attribution_counts as AC, retention as RE
from ..operators.tables import Scratch
from ..sources.notes import NoteStore


def notes_of(taken: DataFrame, versions: DataFrame, session: DataFrame | None = None, model: str = "unknown") -> DataFrame:
    """taken: committed edits as capture emits them. versions(commit_id, path, content):
    files as the commits have them. (commit_id, note) with every commit's note as JSON; files
    that a commit deleted are used up without lines, and a commit without any has no note."""
    e = F.struct("edit_no", "edit_id", "prompt_index", "after")
    by = ["commit_id", "committed_path", "path"]
    files = taken.groupBy(*by).agg(F.array_sort(F.collect_list(e)).alias("edits"), F.min_by("before", "edit_no").alias("original"))
    now = versions.where("content is not null").select("commit_id", F.col("path").alias("committed_path"), F.col("content").alias("final"))
    here = files.join(now, ["commit_id", "committed_path"]).select("commit_id", F.col("committed_path").alias("path"), "original", F.transform("edits", lambda x: F.struct(x["edit_id"].alias("edit_id"), x["prompt_index"].alias("prompt_index"), x["after"].alias("after"))).alias("edits"), "final")
    lines = AT.three_way(here, ["commit_id"])
    kind = F.col("source_type")
    source = F.struct(kind.alias("type"), F.when(kind.isin("AI", "AIModified"), F.col("edit_id")).alias("edit_id"), F.when(kind == "AIModified", F.col("similarity")).alias("similarity"))
    line = F.struct("line_number", "content", source.alias("source"), "edit_id", "prompt_index", "confidence")
    per_file = lines.groupBy("commit_id", "path").agg(F.array_sort(F.collect_list(line), lambda a, b: (a["line_number"] - b["line_number"]).cast("int")).alias("lines"), *AC.counters())
    summary = F.struct("total_lines", "ai_lines", "ai_modified_lines", "human_lines", "original_lines", "unknown_lines")
    listed = per_file.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("path", "lines", summary.alias("summary"))), lambda a, b: F.when(a["path"] < b["path"], -1).otherwise(1)).alias("files"))
    kept = taken.join(now.select("commit_id", "committed_path"), ["commit_id", "committed_path"], "left_semi")
    prompt = kept.groupBy("commit_id", "prompt_index").agg(F.first("prompt").alias("text"), F.array_sort(F.collect_set("path")).alias("affected_files"))
    prompts = prompt.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct(F.col("prompt_index").alias("index"), "text", F.lit(None).cast("string").alias("timestamp"), "affected_files"))).alias("prompts"))
    flags = kept.groupBy("commit_id").agg(F.min("session_id").alias("session_id"), F.bool_or("plan_mode").alias("used_plan_mode"), F.count_if(F.col("agent_depth") > 0).alias("subagent_count"))
    out = listed.join(prompts, "commit_id").join(flags, "commit_id")
    if session is not None:
        out = out.join(session.select("session_id", "started_at"), "session_id", "left")
    started = F.col("started_at") if session is not None else F.lit(None).cast("string")
    head = F.struct("session_id", F.struct(F.lit(model).alias("id"), F.lit("anthropic").alias("provider")).alias("model"), started.alias("started_at"), F.size("prompts").cast("long").alias("prompt_count"), "used_plan_mode", "subagent_count")
    note = F.struct(F.lit(3).cast("short").alias("version"), head.alias("session"), "prompts", "files")
    return out.select("commit_id", F.to_json(note, {"ignoreNullFields": "false"}).alias("note"))


def commit_sink(store: NoteStore, versions: Callable[[], DataFrame], purge: Callable[[DataFrame], DataFrame] | None = None, log: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: notes of the batch's commits go into the store, then what
    purge(notes) names (commit_id) goes out of it, and log(removed, batch_id) hears of it.

    Every step is keyed by commit, so a batch that comes twice after a failure leaves the
    store as it was. versions and purge are called in every batch, as their tables grow."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        taken = batch.where("not discarded").persist()
        try:
            if taken.head(1):
                store.upsert(notes_of(taken, versions()))
            if purge is not None:
                # a table of its own: what the plan would find after the removal is nothing
                gone = Scratch(batch.sparkSession, "purge").write(purge(store.read().select("commit_id")).select("commit_id"))
                if gone.head(1):
                    store.remove(gone)
                    if log is not None:
                        log(gone, batch_id)
        finally:
            taken.unpersist()

    return sink


def purge_by(policy: RE.Policy, commits: Callable[[], DataFrame], parents: Callable[[], DataFrame], refs: Callable[[], DataFrame], as_of: Callable[[], str]) -> Callable[[DataFrame], DataFrame]:
    """The notes that a retention policy deletes as of now: a purge for commit_sink."""

    def purge(noted: DataFrame) -> DataFrame:
        c = commits()
        retained, _ = RE.reachable(parents(), refs(), policy.retain_refs)
        flagged = RE.entries(noted.join(c, "commit_id").select("commit_key"), c, retained, as_of(), policy.max_age_days)
        return RE.sets(flagged, policy.min_commits).where("not keep").select("commit_id")

    return purge

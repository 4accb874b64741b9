"""Retention: which notes a policy keeps and deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .graph import ancestors


@dataclass(frozen=True)
class Policy:
    max_age_days: int | None = None
    retain_refs: tuple[str, ...] = ("refs/heads/main",)
    min_commits: int = 100


def reachable(parents: DataFrame, refs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Commits reachable from any named ref, and the names that resolve to nothing
    (they protect nothing, so callers should show them)."""
    found = refs.where(F.col("ref_name").isin(*names))
    missing = sorted(set(names) - {r.ref_name for r in found.select("ref_name").distinct().collect()})  # as many as the policy names
    return ancestors(parents, found.select("commit_key")), missing


def entries(attributed: DataFrame, commits: DataFrame, retained: DataFrame, as_of: str, max_age_days: int | None) -> DataFrame:
    """Attributed commits that exist, with flags; those missing are in neither set."""
    age = F.lit(False) if max_age_days is None else F.coalesce(F.col("committed_at") < F.expr(f"timestamp_ntz'{as_of}' - interval {int(max_age_days)} days"), F.lit(False))
    c = attributed.select("commit_key").distinct().join(commits.select("commit_key", "commit_id", "committed_at"), "commit_key")
    mark = retained.select("commit_key").distinct().withColumn("_r", F.lit(True))
    return c.join(mark, "commit_key", "left").select("commit_key", "commit_id", "committed_at", F.coalesce("_r", F.lit(False)).alias("is_retained"), age.alias("is_old"))


def sets(flagged: DataFrame, min_commits: int) -> DataFrame:
    """commit_id, keep. Retained and young commits stay; while they are fewer than
    min_commits, the newest of the others stay too. At most min_commits rows are
    ranked for that, so no window covers the whole table."""
    safe = F.col("is_retained") | ~F.col("is_old")
    kept = flagged.where(safe)
    n_kept = kept.limit(min_commits).count()
    others = flagged.where(~safe)
    if n_kept < min_commits:
        topped = others.orderBy(F.desc("committed_at"), "commit_id").limit(min_commits - n_kept).select("commit_id", F.lit(True).alias("_top"))
        return flagged.join(topped, "commit_id", "left").select("commit_id", (safe | F.coalesce("_top", F.lit(False))).alias("keep"))
    return flagged.select("commit_id", safe.alias("keep"))


def apply(notes: DataFrame, decided: DataFrame) -> DataFrame:
    """The notes that remain."""
    return notes.join(decided.where(~F.col("keep")), "commit_id", "left_anti")


def preview(decided: DataFrame, show: int = 25) -> DataFrame:
    """The first `show` notes to go, by commit_id, and how many more there are."""
    gone = decided.where(~F.col("keep")).select("commit_id")
    return gone.orderBy("commit_id").limit(show).crossJoin(F.broadcast(gone.agg(F.greatest(F.count("*") - show, F.lit(0)).alias("hidden"))))

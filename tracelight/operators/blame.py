"""Line-level blame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import preview
from ..schemas import UNKNOWN


def expand(hunks: DataFrame) -> DataFrame:
    """A row per line of a hunk, with its number now and in its commit."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_lines") - 1)).alias("k")
    return hunks.where("n_lines > 0").select("*", k).select("commit_key", "path", (F.col("final_start") + F.col("k")).alias("line_number"), (F.col("orig_start") + F.col("k")).alias("orig_line"))


def blame(hunks: DataFrame, notes: DataFrame, prompts: DataFrame | None = None, together: bool = False) -> DataFrame:
    """Every line with its source; what no note names is Unknown. notes has one row
    per (commit_key, path, line_number), prompts one per (commit_key, prompt_index). Notes are
    joined by commit and path as queried, renames are not followed. together: the three tables
    are dealt by commit into as many parts each; lines then are not moved, and stay with
    their commit for what is joined next."""
    n = notes.withColumnRenamed("line_number", "orig_line")
    p = None if prompts is None else prompts.select("commit_key", "prompt_index", preview(F.col("text")).alias("prompt_preview"))
    if together and p is not None:
        return _beside(expand(hunks), n, p)
    out = expand(hunks).join(n, ["commit_key", "path", "orig_line"], "left")
    out = out.withColumn("source_type", F.coalesce("source_type", F.lit(UNKNOWN)))
    return out if p is None else out.join(p, ["commit_key", "prompt_index"], "left")


def _beside(lines: DataFrame, notes: DataFrame, prompts: DataFrame) -> DataFrame:
    """Lines with their note and prompt, which stand before them in windows within a commit:
    unlike joins by more than the commit, these take the tables as they are dealt."""
    told = [c for c in notes.columns if c not in ("commit_key", "path", "orig_line")]
    kind, is_line = F.col("_kind"), (F.col("_kind") == 0).cast("int")
    rows = lines.withColumn("_kind", F.lit(0)).unionByName(notes.withColumn("_kind", F.lit(1)), True).unionByName(prompts.withColumn("_kind", F.lit(2)), True)
    before = lambda *keys: W.partitionBy("commit_key", *keys).orderBy(is_line).rowsBetween(W.unboundedPreceding, W.currentRow)
    known = lambda *keys: F.concat(*[F.col(c).cast("string") for c in ("commit_key", *keys)]).isNotNull()
    note = F.first(F.when((kind == 1) & known("path", "orig_line"), F.struct(*told)), ignorenulls=True).over(before("path", "orig_line"))
    rows = rows.withColumn("_note", note).where(kind != 1).withColumns({c: F.when(kind == 2, F.col(c)).otherwise(F.col(f"_note.{c}")) for c in told}).drop("_note")
    asked = F.first(F.when((kind == 2) & known("prompt_index"), F.struct("prompt_preview")), ignorenulls=True).over(before("prompt_index"))
    rows = rows.withColumn("_prompt", F.when(known("prompt_index"), asked)).where(kind == 0)
    return rows.withColumns({"source_type": F.coalesce("source_type", F.lit(UNKNOWN)), "prompt_preview": F.col("_prompt.prompt_preview")}).drop("_prompt", "_kind")


def prompt_target(lines: DataFrame, by: list[str], line: int | None = None, also: list[str] | None = None) -> DataFrame:
    """Per file the asked line, or else its first line by AI; also: more of its columns."""
    names = ["line_number", "prompt_index", "edit_id", *(also or [])]
    ai = lines.where(F.col("source_type").isin("AI", "AIModified"))
    if line is not None:
        ai = ai.where(F.col("line_number") == line)
    return ai.groupBy(*by).agg(F.min(F.struct(*names)).alias("f")).select(*by, *(f"f.{c}" for c in names))

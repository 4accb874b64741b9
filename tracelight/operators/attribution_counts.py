"""Counters over attributed lines: per file, per commit, for blame and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import percent
from ..schemas import AI, AI_KINDS, AI_MODIFIED, HUMAN, HUMAN_KINDS, ORIGINAL, UNKNOWN


def is_ai(kind: Column) -> Column:
    return kind.isin(*AI_KINDS)


def is_human(kind: Column) -> Column:
    return kind.isin(*HUMAN_KINDS)


def counters(kind: str = "source_type") -> list[Column]:
    """The six counters of a file, one map-side pass."""
    n = lambda t: F.count_if(F.col(kind) == t)
    return [
        F.count("*").alias("total_lines"), n(AI).alias("ai_lines"), n(AI_MODIFIED).alias("ai_modified_lines"),
        n(HUMAN).alias("human_lines"), n(ORIGINAL).alias("original_lines"), n(UNKNOWN).alias("unknown_lines"),
    ]


def note_files(lines: DataFrame) -> DataFrame:
    return lines.groupBy("commit_key", "path").agg(*counters())


def commit_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("commit_key").agg(*(F.sum(c).alias(f"total_{c}") for c in ("ai_lines", "ai_modified_lines", "human_lines", "original_lines")))


def blame_totals(lines: DataFrame, by: list[str], ai_only: bool = False, human_only: bool = False) -> DataFrame:
    """Totals per group; filters apply first, so percentages are of what is shown."""
    if ai_only:
        lines = lines.where(is_ai(F.col("source_type")))
    elif human_only:
        lines = lines.where(is_human(F.col("source_type")))
    c = lines.groupBy(*by).agg(*counters())
    ai = F.col("ai_lines") + F.col("ai_modified_lines")
    return c.select(*by, "total_lines", ai.alias("ai_total"), F.col("ai_lines").alias("pure_ai"), F.col("ai_modified_lines").alias("modified"), F.col("human_lines").alias("human"), F.col("original_lines").alias("original"), percent(ai, F.col("total_lines")).alias("ai_percent"))

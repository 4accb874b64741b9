"""Unified diffs with the source of added lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scan import Scan

#: Header lines of the unified format, and marks of added lines.
FILE = r"^\+\+\+ b/(.+)$"
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"

AI_MARK, MOD_MARK = "  # AI", "  # AI-mod"


def parse(diff: DataFrame, by: list[str], wide: bool = False) -> DataFrame:
    """diff(by, n, text): adds path, kind and line_no, the line's number in the new file.

    Inside a hunk the first sign alone tells what a line is. Two running values over
    the order of lines, the current file and the current hunk's start, give the rest. wide: a
    diff may be of any length; its parts are scanned side by side.
    """
    t = F.col("text")
    start = F.regexp_extract(t, HUNK, 1)
    # what the scans ask of a line, so that they need not move its text; a new file closes the hunk before, 0 stands for none
    rows = diff.withColumn("_opens", t.startswith("diff --git ")).withColumn("_hunk", F.when(F.col("_opens"), 0).when(start != "", start.cast("long")).cast("long"))
    rows = rows.withColumn("_file", F.when(t.rlike(FILE), F.regexp_extract(t, FILE, 1))).withColumn("_sign", F.left(t, F.lit(1)))
    name = F.when(F.col("_opens"), F.lit("")).when(F.col("_start") == 0, F.col("_file"))
    sign = F.col("_sign")
    body = (F.col("_start") > 0) & F.col("_hunk").isNull()
    kind = F.when(~body, "header").when(sign == "+", "added").when(sign == "-", "removed").when(sign == "\\", "marker").otherwise("context")
    moves = F.when(kind.isin("added", "context"), 1).otherwise(0)
    if wide:
        rows = Scan(rows, by, ["n"]).known("_start", F.col("_hunk")).result(keep=True).withColumn("_start", F.coalesce("_start", F.lit(0)))
        rows = Scan(rows, by, ["n"], ranged=True).known("path", name).total("_moves", moves).result(keep=True)
        rows = Scan(rows, by, ["n"], ranged=True).known("_above", F.when(F.col("_hunk").isNotNull(), F.col("_moves"))).result()
        seen = F.col("_moves") - F.coalesce("_above", F.lit(0))
    else:
        w = W.partitionBy(*by).orderBy("n")
        rows = rows.withColumn("_start", F.coalesce(F.last("_hunk", ignorenulls=True).over(w), F.lit(0))).withColumn("_h", F.count("_hunk").over(w))
        rows = rows.withColumn("path", F.last(name, ignorenulls=True).over(w))
        seen = F.sum(moves).over(W.partitionBy(*by, "_h").orderBy("n"))
    rows = rows.withColumn("kind", kind)
    return rows.select(*by, "n", "text", F.nullif("path", F.lit("")).alias("path"), "kind", F.when(F.col("kind").isin("added", "context"), F.col("_start") + seen - 1).alias("line_no"))


def annotated(diff: DataFrame, blame: DataFrame, by: list[str], verbose: bool = False) -> DataFrame:
    """Added lines are joined with blame(path, line_no, source_type, edit_id, similarity)
    and marked; other lines stay as they are."""
    rows = parse(diff, by)
    b = blame.select("path", "line_no", "source_type", "edit_id", "similarity", F.lit("added").alias("kind"))
    out = rows.join(b, ["path", "line_no", "kind"], "left")
    return out.select(*by, "n", mark(F.col("text"), F.col("source_type"), F.col("edit_id"), F.col("similarity"), verbose).alias("text"))


def mark(text: Column, kind: Column, edit_id: Column, similarity: Column, verbose: bool = False) -> Column:
    ai, mod = F.lit(AI_MARK), F.lit(MOD_MARK)
    if verbose:
        name = F.coalesce(F.concat(F.lit(": "), F.left(edit_id, F.lit(8))), F.lit(""))
        ai = F.concat(ai, name)
        mod = F.when(similarity.isNull(), mod).otherwise(F.concat(mod, F.lit("("), F.round(similarity * 100).cast("int").cast("string"), F.lit("%)"), name))
    return F.when(kind == "AI", F.concat(F.lit("● "), text, ai)).when(kind == "AIModified", F.concat(F.lit("◐ "), text, mod)).otherwise(text)

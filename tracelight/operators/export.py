"""Exports of attributed commits."""

from __future__ import annotations

import json
import re
from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..functions.text import csv_field, export_cut, short_commit


def day(text: str | None) -> date | None:
    """A strict yyyy-mm-dd date."""
    if text is None:
        return None
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"{text!r} is no date of the form YYYY-MM-DD")
    return date.fromisoformat(text)


def in_days(df: DataFrame, column: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows from the first second of `since` to the last of `until`."""
    a, b = day(since), day(until)
    if a and b and a > b:
        raise ValueError("since is after until")
    if a:
        df = df.where(F.col(column) >= F.lit(f"{a} 00:00:00").cast(df.schema[column].dataType))
    if b:
        df = df.where(F.col(column) < F.date_add(F.lit(str(b)).cast("date"), 1).cast(df.schema[column].dataType))
    return df


PROMPTS = "array<struct<index:bigint,text:string,affected_files:array<string>>>"


def export(commits: DataFrame, totals: DataFrame, prompts: DataFrame, since: str | None = None, until: str | None = None, full_prompts: bool = False, prompt_len: int = 100, files: DataFrame | None = None) -> DataFrame:
    """A row per attributed commit of the days asked for. The date test stands before
    the joins and reaches the scan. files(commit_key, path) names the files of a commit;
    commits and prompts may hold session_id and affected_files. A note whose commit is
    missing fails the export: see missing()."""
    c = in_days(commits, "committed_at", since, until)
    if "session_id" not in c.columns:
        c = c.withColumn("session_id", F.lit(None).cast("string"))
    touched = F.col("affected_files") if "affected_files" in prompts.columns else F.array().cast("array<string>")
    text = F.col("text") if full_prompts else export_cut(F.col("text"), prompt_len)
    p = prompts.groupBy("commit_key").agg(F.array_sort(F.collect_list(F.struct(F.col("prompt_index").alias("index"), text.alias("text"), touched.alias("affected_files")))).alias("prompts"))
    out = c.join(totals, "commit_key").join(p, "commit_key", "left")
    if files is None:
        out = out.withColumn("files", F.array().cast("array<string>"))
    else:
        out = out.join(files.groupBy("commit_key").agg(F.array_sort(F.collect_set("path")).alias("files")), "commit_key", "left")
    return out.select(
        "commit_id", short_commit(F.col("commit_id")).alias("commit_short"), F.coalesce(F.split_part(F.col("message"), F.lit("\n"), F.lit(1)), F.lit("(no message)")).alias("message"), F.coalesce("author", F.lit("Unknown")).alias("author"),
        "committed_at", "session_id", "model", F.col("total_ai_lines").alias("ai_lines"), F.col("total_ai_modified_lines").alias("ai_modified_lines"), F.col("total_human_lines").alias("human_lines"), F.col("total_original_lines").alias("original_lines"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.coalesce("prompts", F.array().cast(PROMPTS)).alias("prompts"),
    )


def missing(commits: DataFrame, noted: DataFrame) -> DataFrame:
    """Notes whose commit does not exist."""
    return noted.join(commits, "commit_key", "left_anti")


def ordered(exported: DataFrame) -> DataFrame:
    return exported.orderBy(F.desc("committed_at"), "commit_id")


def export_summary(exported: DataFrame) -> DataFrame:
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return exported.agg(F.count("*").alias("commits"), F.count_if(F.col("ai_lines") > 0).alias("commits_with_ai"), total("ai_lines", "ai_lines"), total("ai_modified_lines", "ai_modified_lines"), total("human_lines", "human_lines"), total("original_lines", "original_lines"), total(F.size("prompts").cast("long"), "prompts"))


#: The columns of a CSV export, in their order.
CSV_COLUMNS = ("commit_id", "commit_short", "message", "author", "committed_at", "session_id", "model", "ai_lines", "ai_modified_lines", "human_lines", "original_lines", "files_count", "prompts_count")
CSV_HEADER = ",".join(CSV_COLUMNS)
_TIME = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"


def csv_lines(exported: DataFrame) -> DataFrame:
    """One text column: strings quoted and flattened to one line, numbers bare. The header
    is CSV_HEADER; with_header() puts it first."""
    row = exported.withColumns({"files_count": F.size("files").cast("long"), "prompts_count": F.size("prompts").cast("long"), "committed_at": F.date_format("committed_at", _TIME)})
    kinds = dict(row.dtypes)
    cell = lambda c: F.concat(F.lit('"'), csv_field(F.coalesce(c, F.lit(""))), F.lit('"')) if kinds[c] == "string" else F.col(c).cast("string")
    return row.select("commit_id", F.concat_ws(",", *map(cell, CSV_COLUMNS)).alias("line"))


def with_header(exported: DataFrame) -> DataFrame:
    """(place, line): header, then commits newest first; places order the file."""
    rows = csv_lines(exported).join(exported.select("commit_id", "committed_at"), "commit_id")
    place = F.struct(F.lit(1).alias("part"), (-F.unix_micros(F.col("committed_at").cast("timestamp"))).alias("t"), F.col("commit_id").alias("id"))
    head = exported.sparkSession.range(1).select(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("t"), F.lit("").alias("id")).alias("place"), F.lit(CSV_HEADER).alias("line"))
    return head.unionByName(rows.select(place.alias("place"), "line"))


def json_lines(exported: DataFrame, exported_at: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """(place, line): the lines of one JSON document, a line per commit; ordered by place
    they are the file. No task holds more than its own commits."""
    spark = exported.sparkSession
    walk = lambda part: F.struct(F.lit(part).alias("part"), (-F.unix_micros(F.col("committed_at").cast("timestamp"))).alias("t"), F.col("commit_id").alias("id"))
    bare = lambda part: F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("t"), F.lit("").alias("id")).alias("place")
    span = None if since is None and until is None else {"since": since, "until": until}
    opening = json.dumps({"export_version": 1, "exported_at": exported_at, "date_range": span}, separators=(",", ":"))[:-1] + ',"commits":['
    last = F.broadcast(exported.agg(F.max(walk(1)).alias("last")))  # one row
    fields = [F.date_format("committed_at", _TIME).alias("committed_at") if c == "committed_at" else F.col(c) for c in exported.columns]
    body = exported.select(walk(1).alias("place"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line")).crossJoin(last)
    body = body.select("place", F.concat("line", F.when(F.col("place") == F.col("last"), "").otherwise(",")).alias("line"))
    s = export_summary(exported)
    names = {"commits": "total_commits", "ai_lines": "total_ai_lines", "ai_modified_lines": "total_ai_modified_lines", "human_lines": "total_human_lines", "original_lines": "total_original_lines", "prompts": "total_prompts"}
    tail = s.select(bare(2), F.concat(F.lit('],"summary":'), F.to_json(F.struct(*(F.col(c).alias(names.get(c, c)) for c in s.columns))), F.lit("}")).alias("line"))
    return spark.range(1).select(bare(0), F.lit(opening).alias("line")).unionByName(body).unionByName(tail)

"""Writers: audit lines, exports and JSON envelopes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from . import auditlog


def append_audit(events: DataFrame, path: str, chain: bool = False) -> None:
    """Appends events in the order of seq; see `auditlog`."""
    auditlog.append(events, path, chain)


def write_lines(rows: DataFrame, path: str) -> None:
    """rows(place, line): a folder of text files which one after the other are the lines in
    the order of their places. Ranged over tasks, so no task sorts all of them."""
    rows.repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


def source_json(kind: F.Column) -> F.Column:
    """Names of sources as machine output spells them."""
    return F.when(kind == "AI", "ai").when(kind == "AIModified", "ai_modified").otherwise(F.lower(kind))


def blame_json(lines: DataFrame, by: list[str]) -> DataFrame:
    """One JSON object per blamed line; nulls are written. Columns that a table lacks
    (commit_id, author, prompt_preview, content) are null."""
    col = lambda c: F.col(c) if c in lines.columns else F.lit(None).cast("string")
    kind = F.col("source_type")
    body = F.struct(
        "line_number", F.col("line_number").alias("line"), F.struct(col("commit_id").alias("id"), F.substring(col("commit_id"), 1, 7).alias("short"), col("author").alias("author")).alias("commit"),
        source_json(kind).alias("source"), F.struct(kind.isin("AI", "AIModified").alias("is_ai"), kind.isin("Human", "Original").alias("is_human")).alias("flags"),
        F.struct(F.col("prompt_index").alias("index"), col("prompt_preview").alias("preview")).alias("prompt"), col("content").alias("content"),
    )
    return lines.select(*by, "line_number", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def blame_document(lines: DataFrame, path: str, revision: str) -> DataFrame:
    """(n, line): the lines of one JSON document for a file, in order of n."""
    spark = lines.sparkSession
    rows = blame_json(lines, [])
    c = lambda k: F.count_if(F.col("source_type") == k)
    total = lines.agg(F.count("*").alias("total_lines"), c("AI").alias("ai_lines"), c("AIModified").alias("ai_modified_lines"), c("Human").alias("human_lines"), c("Original").alias("original_lines"), F.max("line_number").alias("last"))
    ai = F.col("ai_lines") + F.col("ai_modified_lines")
    total = total.withColumn("ai_percentage", F.coalesce(F.try_divide(ai.cast("double"), F.col("total_lines").cast("double")), F.lit(0.0)) * 100.0)
    head = json.dumps({"schema_version": 1, "schema": "blame.v1", "file": path, "revision": revision}, separators=(",", ":"), ensure_ascii=False)[:-1] + ',"lines":['
    body = rows.crossJoin(F.broadcast(total.select("last"))).select(F.col("line_number").cast("long").alias("n"), F.concat("json", F.when(F.col("line_number") == F.col("last"), "").otherwise(",")).alias("line"))
    tail = total.select((F.coalesce("last", F.lit(0)) + 1).cast("long").alias("n"), F.concat(F.lit('],"summary":'), F.to_json(F.struct(*[x for x in total.columns if x != "last"])), F.lit("}")).alias("line"))
    return spark.range(1).select(F.lit(-1).cast("long").alias("n"), F.lit(head).alias("line")).unionByName(body).unionByName(tail)


def show_json(totals: DataFrame, prompts: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """totals(commit_key, commit_id, total_*, and session_id, model, started_at if
    known): one document per commit; commits without a note say so. prompts(commit_key,
    prompt_index, text), files(commit_key, path, counters)."""
    out = totals
    if prompts is not None:
        out = out.join(prompts.groupBy("commit_key").agg(F.array_sort(F.collect_list(F.struct(F.col("prompt_index").alias("index"), "text"))).alias("prompts")), "commit_key", "left")
    if files is not None:
        counted = [c for c in files.columns if c not in ("commit_key", "path")]
        out = out.join(files.groupBy("commit_key").agg(F.array_sort(F.collect_list(F.struct("path", F.struct(*counted).alias("summary")))).alias("files")), "commit_key", "left")
    has = F.col("total_ai_lines").isNotNull()
    none = F.array().cast
    head = [F.lit(1).alias("schema_version"), F.lit("show.v1").alias("schema")]
    commit = [F.col("commit_id").alias("commit"), F.substring("commit_id", 1, 7).alias("commit_short")]
    session = F.struct(*(F.col(c).alias(n) for c, n in (("session_id", "session_id"), ("model", "model"), ("started_at", "started_at")) if c in out.columns))
    listed = [F.coalesce(F.col(c), none(out.schema[c].dataType)).alias(c) for c in ("prompts", "files") if c in out.columns]
    summary = F.struct(*(c for c in ("total_ai_lines", "total_ai_modified_lines", "total_human_lines", "total_original_lines")))
    full = F.to_json(F.struct(*head, F.lit(True).alias("has_attribution"), *commit, session.alias("session"), *listed, summary.alias("summary")))
    bare = F.to_json(F.struct(*head, F.lit(False).alias("has_attribution"), *commit))
    return out.select("commit_key", F.when(has, full).otherwise(bare).alias("json"))


def prompt_json(answers: DataFrame, reference: str, revision: str = "HEAD", by: list[str] | None = None) -> DataFrame:
    """answers(path, line_number, content, source_type, prompt_index, commit_id, author,
    text, timestamp, affected_files, session_id, model, started_at; missing ones are null): one document per line asked for."""
    col = lambda c, kind="string": F.col(c) if c in answers.columns else F.lit(None).cast(kind)
    prompt = F.when(col("text").isNotNull(), F.struct(F.col("prompt_index").alias("index"), col("text").alias("text"), col("timestamp").alias("timestamp"), col("affected_files", "array<string>").alias("affected_files")))
    body = F.struct(
        F.lit(1).alias("schema_version"), F.lit("prompt.v1").alias("schema"), F.struct(F.lit(reference).alias("reference"), F.col("path").alias("file"), "line_number", F.lit(revision).alias("revision")).alias("query"),
        F.struct("line_number", col("content").alias("content"), source_json(F.col("source_type")).alias("source"), "prompt_index").alias("line"),
        F.struct(col("commit_id").alias("id"), F.substring(col("commit_id"), 1, 7).alias("short"), col("author").alias("author")).alias("commit"), prompt.alias("prompt"),
        F.struct(col("session_id").alias("id"), col("model").alias("model"), col("started_at").alias("started_at")).alias("session"),
    )
    return answers.select("path", "line_number", *(by or []), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def note_json(columns: F.Column) -> F.Column:
    """A note as compact JSON with explicit nulls."""
    return F.to_json(columns, {"ignoreNullFields": "false"})


def summary_document(summary: DataFrame, files: DataFrame, models: DataFrame) -> DataFrame:
    """(place, line): the lines of one JSON document over range_summary, summary_by_file and
    models_first_seen; files and models stand in the order of their names."""
    place = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("name")).alias("place")
    s = lambda *cols: F.to_json(F.struct(*cols))
    head = s(F.lit(1).alias("schema_version"), F.lit("summary.v1").alias("schema"), "commits_analyzed", "commits_with_ai", F.struct(F.col("additions").alias("total"), F.col("ai_lines").alias("ai"), F.col("ai_modified_lines").alias("ai_modified"), F.col("human_lines").alias("human")).alias("additions"), F.col("ai_percent").alias("ai_percentage"))
    out = summary.select(place(0, F.lit("")), F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"files":[')).alias("line"))
    listed = lambda df, part, name, body: df.crossJoin(F.broadcast(df.agg(F.max(name).alias("_last")))).select(place(part, F.col(name)), F.concat(body, F.when(F.col(name) == F.col("_last"), "").otherwise(",")).alias("line"))
    file = s("path", "additions", (F.col("ai_lines") + F.col("ai_modified_lines")).alias("ai_additions"), "ai_lines", "ai_modified_lines", "human_lines", "ai_percent", "is_new_file")
    model = F.substring(F.to_json(F.array("model")), 2, 1 << 30)
    out = out.unionByName(listed(files, 1, "path", file)).unionByName(summary.select(place(2, F.lit("")), F.lit('],"models":[').alias("line")))
    return out.unionByName(listed(models, 3, "model", F.regexp_replace(model, r"\]$", ""))).unionByName(summary.select(place(4, F.lit("")), F.lit("]}").alias("line")))

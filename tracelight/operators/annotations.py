"""Review annotations: file statistics, runs of lines, scores and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import ratio, truncate
from ..schemas import AI, AI_MODIFIED
from .attribution_counts import counters


def significant(files: DataFrame, min_ai_lines: int = 3, min_ai_percent: float = 5.0) -> DataFrame:
    """Files with so many lines by AI, and such a share of all their lines."""
    ai = F.col("ai_lines") + F.col("ai_modified_lines")
    return files.where((ai >= min_ai_lines) & (ratio(ai, F.col("total_lines")) * 100.0 >= min_ai_percent))


def first_seen(files: DataFrame, commits: DataFrame, **limits) -> DataFrame:
    """Per path the counters of the first significant commit in walk order."""
    kept = significant(files, **limits).join(commits.select("commit_key", "commit_id", "committed_at"), "commit_key")
    walk = F.struct((-F.unix_micros(F.col("committed_at").cast("timestamp"))).alias("t"), F.col("commit_id").alias("commit_id"), "ai_lines", "ai_modified_lines", "human_lines", "original_lines", "total_lines")
    return kept.groupBy("path").agg(F.min(walk).alias("f")).select("path", "f.commit_id", "f.ai_lines", "f.ai_modified_lines", "f.human_lines", "f.original_lines", "f.total_lines")


def file_stats(lines: DataFrame, by: list[str]) -> DataFrame:
    """Counters and derived shares per file."""
    out = lines.groupBy(*by).agg(*counters(), F.count_distinct(F.when(F.col("source_type").isin(AI, AI_MODIFIED), F.col("prompt_index"))).alias("n_prompts"))
    ai = F.col("ai_lines") + F.col("ai_modified_lines")
    return out.withColumns({
        "ai_total": ai, "coverage": ratio(ai, F.col("total_lines")),
        "is_new_file": (F.col("original_lines") == 0) & (ai + F.col("human_lines") > 0),
    })


def prompt_counts(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines per prompt of a file, ranked by count, then index."""
    n = lines.where(F.col("source_type").isin(AI, AI_MODIFIED) & F.col("prompt_index").isNotNull()).groupBy(*by, "prompt_index").agg(F.count("*").alias("line_count"))
    return n.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("line_count"), "prompt_index")).cast("long"))


def score(in_diff: Column) -> Column:
    return F.col("coverage") * 40.0 + F.least(F.col("ai_total"), F.lit(100)) * 0.3 + F.when(F.col("is_new_file"), 15.0).otherwise(0.0) + F.when(in_diff, 15.0).otherwise(0.0)


def consolidates(threshold: float = 0.7, prompt_limit: int = 3) -> Column:
    return F.col("is_new_file") | ((F.col("coverage") >= threshold) & (F.col("n_prompts") <= prompt_limit))


def line_groups(lines: DataFrame, by: list[str], ai_only: bool = False, group_types: bool = False, min_lines: int = 1) -> DataFrame:
    """Maximal runs of neighbouring lines of one kind. A run's rows share the
    difference of line number and rank, so one window and one aggregate find it."""
    kinds = [AI] if ai_only else [AI, AI_MODIFIED]
    eligible = lines.where(F.col("source_type").isin(*kinds))
    kind = F.lit("AIRelated") if group_types else F.col("source_type")
    eligible = eligible.withColumn("group_type", kind)
    island = F.col("line_number") - F.row_number().over(W.partitionBy(*by, "group_type").orderBy("line_number"))
    named = F.when(F.col("prompt_index").isNotNull(), F.struct("line_number", "prompt_index"))
    runs = eligible.withColumn("island", island).groupBy(*by, "group_type", "island").agg(
        F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line"),
        F.count_if(F.col("source_type") == AI).alias("ai_count"), F.count_if(F.col("source_type") == AI_MODIFIED).alias("modified_count"), F.min(named).alias("p"),
    )
    return runs.where(F.col("end_line") - F.col("start_line") + 1 >= min_lines).select(*by, "group_type", "start_line", "end_line", "ai_count", "modified_count", F.col("p.prompt_index").alias("prompt_index"))


#: Lines of a block that overlaps are looked for in.
BLOCK = 256


def _blocks(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for every block of lines that an interval stands in."""
    return df.where(F.col(start) <= F.col(end)).withColumn("_block", F.explode(F.sequence(F.floor(F.col(start) / BLOCK), F.floor(F.col(end) / BLOCK))))


def in_ranges(groups: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Runs that overlap a changed range of their file. Runs and ranges meet in the blocks of
    lines that they stand in, so a file of very many of both is spread, and few are compared;
    a null key is equal to another."""
    spans = ["start_line", "end_line"]
    g, r = _blocks(groups.select(*by, *spans).distinct(), *spans).alias("g"), _blocks(ranges.select(*by, "range_start", "range_end").distinct(), "range_start", "range_end").alias("r")
    test = (F.col("g._block") == F.col("r._block")) & (F.col("g.start_line") <= F.col("r.range_end")) & (F.col("g.end_line") >= F.col("r.range_start"))
    for c in by:
        test = test & F.col(f"g.{c}").eqNullSafe(F.col(f"r.{c}"))
    hit = g.join(r, test, "left_semi").select(*by, *spans).distinct().alias("h")
    same = F.lit(True)
    for c in [*by, *spans]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"h.{c}"))
    return groups.alias("a").join(hit, same, "left_semi")


def in_diff(groups: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Runs that a diff leaves: those that overlap a changed range of their file, and all
    runs of files that the diff does not name."""
    named = ranges.select(*by).distinct()
    return in_ranges(groups, ranges, by).unionByName(groups.join(named, by, "left_anti"))


def diff_ranges(hunks: DataFrame) -> DataFrame:
    """hunks(path, new_start, new_lines) to (path, range_start, range_end), ends
    inclusive; a hunk that only removes covers its start."""
    return hunks.select("path", F.col("new_start").alias("range_start"), (F.col("new_start") + F.greatest(F.col("new_lines") - 1, F.lit(0))).alias("range_end"))


#: Orders of files of the same score.
SORTS = {"coverage": lambda: [F.desc("coverage")], "lines": lambda: [F.desc("ai_total")], "alpha": lambda: []}


def chosen(stats: DataFrame, groups: DataFrame, by: list[str], mode: str = "auto", threshold: float = 0.7, prompt_limit: int = 3, limit: int | None = 50, ranges: DataFrame | None = None, sort_by: str = "coverage") -> DataFrame:
    """File annotations where files consolidate, else one per run, with the files'
    counters; best scores first. With ranges (a diff), files in it score higher, and
    others have no annotation of the whole file."""
    whole = {"auto": consolidates(threshold, prompt_limit), "file": F.lit(True), "lines": F.lit(False)}[mode]
    order = SORTS[sort_by]()
    stats = stats.where("ai_total > 0")
    if ranges is None:
        stats = stats.withColumn("in_diff", F.lit(True))
    else:
        stats = stats.join(ranges.select(*by).distinct().withColumn("_named", F.lit(True)), by, "left").withColumn("in_diff", F.col("_named").isNotNull()).drop("_named")
        groups = in_diff(groups, ranges, by)
    stats = stats.withColumn("score", score(F.col("in_diff"))).withColumn("whole", whole)
    own = [c for c in stats.columns if c not in (*by, "whole", "in_diff")]
    files = stats.where("whole and in_diff").select(*by, *own, F.lit("file").alias("kind"), F.lit(1).cast("long").alias("start_line"), F.col("total_lines").alias("end_line"))
    runs = groups.join(stats.where(~F.col("whole")).select(*by, *own), by).withColumn("kind", F.lit("lines"))
    out = files.unionByName(runs, allowMissingColumns=True)
    if limit is not None:
        out = out.orderBy(F.desc("score"), *order, *by, "start_line", "end_line").limit(limit)
    return out


def candidates(stats: DataFrame, groups: DataFrame, by: list[str], *args, **options) -> DataFrame:
    """The places and scores alone of what chosen() picks."""
    return chosen(stats, groups, by, *args, **options).select(*by, "kind", "start_line", "end_line", "score", "coverage")


def _plural(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" line"), F.when(n > 1, "s").otherwise(""))


def described(picked: DataFrame, prompts: DataFrame, by: list[str], models: list[str], session_range: str | None = None) -> DataFrame:
    """picked as of chosen(): path, lines, level, title, message and raw details of each
    annotation. prompts(by, prompt_index, preview, line_count, place): the prompts of a
    file, most lines first."""
    p = prompts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "prompt_index", F.coalesce("preview", F.lit("")).alias("preview"), "line_count"))).alias("ps"))
    df = picked.join(p, by, "left").withColumn("ps", F.when(F.col("kind") == "file", F.coalesce("ps", F.array().cast("array<struct<place:bigint,prompt_index:bigint,preview:string,line_count:bigint>>"))))
    own = prompts.select(*by, F.col("prompt_index"), F.col("preview").alias("run_prompt"))
    df = df.join(own, [*by, "prompt_index"], "left") if "prompt_index" in df.columns else df.withColumn("run_prompt", F.lit(None).cast("string"))
    n_run = F.col("end_line") - F.col("start_line") + 1
    share = F.round(F.col("coverage") * 100).cast("int").cast("string")
    text = lambda c: F.col(c).cast("string")
    # fixed values: the wording of titles and messages
    file_title = F.when(F.col("is_new_file"), F.concat(F.lit("New file ("), text("total_lines"), F.lit(" lines) generated by AI"))).otherwise(F.concat(share, F.lit("% AI-generated ("), text("ai_total"), F.lit(" of "), text("total_lines"), F.lit(" lines)")))
    made = F.concat(F.lit("AI Generated ("), _plural(n_run), F.lit(")"))
    mixed = F.concat(F.lit("AI Related ("), n_run.cast("string"), F.lit(" lines: "), text("ai_count"), F.lit(" AI, "), text("modified_count"), F.lit(" AI-modified)"))
    run_title = F.when(F.col("group_type") == AI, made).when(F.col("group_type") == AI_MODIFIED, F.concat(F.lit("AI Modified ("), _plural(n_run), F.lit(")"))).otherwise(F.when(F.col("modified_count") > 0, mixed).otherwise(made))
    meta = " | ".join(([f"Model{'s' * (len(models) > 1)}: {', '.join(models)}"] if models else []) + ([f"Session: {session_range}"] if session_range else []))
    line = lambda *xs: F.concat(F.lit("\n"), *xs)
    breakdown = F.concat(F.lit("**Breakdown:** "), text("ai_lines"), F.lit(" AI, "), text("ai_modified_lines"), F.lit(" AI-modified, "), text("human_lines"), F.lit(" human, "), text("original_lines"), F.lit(" original"))
    first = F.transform(F.slice("ps", 1, 3), lambda x, i: line((i + 1).cast("string"), F.lit(". "), truncate(x["preview"], 100), F.lit(" ("), x["line_count"].cast("string"), F.lit(" lines)")))
    more = F.when(F.size("ps") > 3, line(F.lit("   ...and "), (F.size("ps") - 3).cast("string"), F.lit(" more"))).otherwise("")
    several = F.concat(F.lit("\n"), line(F.lit("**Prompts:** "), F.size("ps").cast("string"), F.lit(" prompts used")), F.array_join(first, ""), more)
    one = F.concat(F.lit("\n\n**Prompt:** "), truncate(F.try_element_at("ps", F.lit(1))["preview"], 200))
    asked = F.when(F.size("ps") == 1, one).when(F.size("ps") > 1, several).otherwise("")
    # the head is a line of its own only if there is one; the breakdown follows an empty line either way
    file_text = F.concat(F.lit(meta + "\n\n" if meta else "\n"), breakdown, asked)
    alone = F.when(F.col("group_type") == AI, "These lines were generated by AI and committed unchanged.").when(F.col("group_type") == AI_MODIFIED, "These lines were generated by AI and then modified by a human.").otherwise("These lines were generated or modified by AI.")
    quoted = F.concat(F.lit("\n**Prompt:** "), truncate(F.col("run_prompt"), 200))
    run_text = F.when(F.col("run_prompt").isNotNull(), F.concat(F.lit(meta + "\n" if meta else ""), quoted)).otherwise(F.lit(meta) if meta else alone)
    listed = F.array_join(F.transform("ps", lambda x, i: F.concat(F.lit("Prompt "), (i + 1).cast("string"), F.lit(": "), x["preview"])), "\n\n")
    details = F.when(F.size("ps") == 1, F.try_element_at("ps", F.lit(1))["preview"]).when(F.size("ps") > 1, listed)
    whole = F.col("kind") == "file"
    return df.select(
        *by, "start_line", "end_line", F.lit("notice").alias("annotation_level"), F.when(whole, file_title).otherwise(run_title).alias("title"),
        F.when(whole, file_text).otherwise(run_text).alias("message"), F.when(whole, details).otherwise(F.col("run_prompt")).alias("raw_details"), "score",
    )


def checks_json(rows: DataFrame, files_analyzed: int, models: list[str], session_range: str | None = None, envelope: bool = False) -> DataFrame:
    """One document of described() rows, best score first; they are as many as the limit
    of annotations. envelope adds the schema of the stable machine output."""
    fields = [c for c in ("path", "start_line", "end_line", "annotation_level", "title", "message", "raw_details") if c in rows.columns]
    listed = rows.agg(F.collect_list(F.struct((-F.col("score")).alias("s"), *fields)).alias("a"))
    found = F.transform(F.array_sort("a"), lambda x: F.struct(*(x[c].alias(c) for c in fields)))
    summary = [F.lit(files_analyzed).alias("files_analyzed"), F.array(*map(F.lit, models)).cast("array<string>").alias("models")] + ([F.lit(session_range).alias("session_range")] if session_range else [])
    head = [F.lit(1).alias("schema_version"), F.lit("annotations.v1").alias("schema")] if envelope else []
    return listed.select(F.to_json(F.struct(*head, found.alias("annotations"), F.struct(*summary).alias("summary"))).alias("json"))

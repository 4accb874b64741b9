"""Summaries over a range of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import percent


def range_summary(commits: DataFrame, files: DataFrame) -> DataFrame:
    """One row: commits, commits that have a note, line totals and shares.
    files is summed per commit before the join: one row per commit is moved."""
    sums = files.groupBy("commit_key").agg(*(F.sum(c).alias(c) for c in ("ai_lines", "ai_modified_lines", "human_lines", "original_lines")), F.lit(1).alias("noted"))
    j = commits.select("commit_key").join(sums, "commit_key", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = j.agg(F.count("*").alias("commits_analyzed"), F.count("noted").alias("commits_with_ai"), *(total(c) for c in ("ai_lines", "ai_modified_lines", "human_lines", "original_lines")))
    ai = F.col("ai_lines") + F.col("ai_modified_lines")
    added = ai + F.col("human_lines")
    return out.withColumns({"additions": added, "ai_additions": ai, "ai_percent": percent(ai, added)})


def summary_by_file(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Counters per path over all commits; newness is that of the first commit in walk
    order (newest first, then commit_id)."""
    walk = F.struct((-F.unix_micros(F.col("committed_at").cast("timestamp"))).alias("t"), F.col("commit_id").alias("id"))
    new = (F.col("original_lines") == 0) & (F.col("ai_lines") + F.col("ai_modified_lines") + F.col("human_lines") > 0)
    j = files.join(commits.select("commit_key", "commit_id", "committed_at"), "commit_key")
    # one minimum over a struct keeps the aggregate on the hash path
    out = j.groupBy("path").agg(F.min(F.struct(walk.alias("w"), new.alias("new"))).alias("first"), *(F.sum(c).alias(c) for c in ("ai_lines", "ai_modified_lines", "human_lines", "original_lines", "total_lines")), F.count("*").alias("commits"))
    ai = F.col("ai_lines") + F.col("ai_modified_lines")
    return out.select("path", F.col("first.new").alias("is_new_file"), "ai_lines", "ai_modified_lines", "human_lines", "original_lines", "total_lines", "commits", (ai + F.col("human_lines")).alias("additions"), percent(ai, ai + F.col("human_lines")).alias("ai_percent"))


def models_first_seen(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct models of noted commits with the place at which the walk meets them."""
    noted = commits.join(files.select("commit_key").distinct(), "commit_key", "left_semi")
    first = noted.groupBy("model").agg(F.max("committed_at").alias("first_seen"), F.count("*").alias("commits"))
    return first


def session_range(commits: DataFrame) -> DataFrame:
    """First and last start of a session, as text: one date or 'a to b'."""
    m = commits.agg(F.min("started_at").alias("a"), F.max("started_at").alias("b"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    a, b = F.split_part(F.col("a"), F.lit("T"), F.lit(1)), F.split_part(F.col("b"), F.lit("T"), F.lit(1))
    return m.select(F.when(a == b, a).otherwise(F.concat(a, F.lit(" to "), b)).alias("session_range"), "models")


def markdown_tier(p) -> F.Column:
    return F.when(p >= 80, "🤖🤖🤖").when(p >= 50, "🤖🤖").when(p >= 20, "🤖").otherwise("👤")


def markdown(summary: DataFrame, files: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """The summary as Markdown lines, ordered by part and name: heading, breakdown of the
    additions, a row per file, a row per model."""
    p = F.col("ai_percent")
    n = lambda c: F.col(c).cast("string")
    share = lambda c: F.format_string("%.1f", percent(F.col(c), F.col("additions")))
    row = lambda name, c: F.concat(F.lit(f"| {name} | +"), n(c), F.lit(" | "), share(c), F.lit("% |"))
    head = summary.crossJoin(F.broadcast(files.agg(F.count("*").alias("n_files"))))  # two rows of one
    # fixed values: the wording of the summary, line by line
    text = [
        F.concat(F.lit("## "), markdown_tier(p), F.lit(" AI Attribution Summary")), "",
        F.concat(F.lit("This PR adds **+"), n("additions"), F.lit("** lines with AI attribution across **"), n("n_files"), F.lit("** files.")), "", "### Additions Breakdown", "",
        "| Metric | Lines | % of Additions |", "|--------|------:|--------------:|", row("🟢 AI-generated", "ai_lines"), row("🟡 AI-modified by human", "ai_modified_lines"), row("🔵 Human-written", "human_lines"),
        F.concat(F.lit("| **Total additions** | **+"), n("additions"), F.lit("** | **100%** |")), "", F.concat(F.lit("**AI involvement: "), F.format_string("%.1f", p), F.lit("%** of additions are AI-generated")), "",
        *[F.when(F.col("n_files") > 0, x) for x in ("### Files Changed", "", "| File | +Added | AI | Human | AI % | Status |", "|------|-------:|---:|------:|-----:|--------|")],
    ]
    text = [F.lit(x) if isinstance(x, str) else x for x in text]
    out = head.select(F.posexplode(F.array(*text)).alias("k", "line")).where("line is not null").select((F.col("k") + 1).alias("part"), F.lit("").alias("name"), "line")
    k = len(text) + 1
    ai = F.col("ai_lines") + F.col("ai_modified_lines")
    listed = F.concat(F.lit("| `"), F.col("path"), F.lit("` | +"), n("additions"), F.lit(" | "), ai.cast("string"), F.lit(" | "), n("human_lines"), F.lit(" | "), F.format_string("%.0f", percent(ai, F.col("additions"))), F.lit("% | "), F.when(F.col("is_new_file"), "New").otherwise("Modified"), F.lit(" |"))
    out = out.unionByName(files.select(F.lit(k).alias("part"), F.col("path").alias("name"), listed.alias("line")))
    if models is not None:
        some = models.agg(F.count("*").alias("n")).where("n > 0")
        titles = some.select(F.posexplode(F.array(*map(F.lit, ("", "### Models Used", "")))).alias("k", "line")).select((F.col("k") + k + 1).alias("part"), F.lit("").alias("name"), "line")
        out = out.unionByName(titles).unionByName(models.select(F.lit(k + 4).alias("part"), F.col("model").alias("name"), F.concat(F.lit("- "), F.col("model")).alias("line")))
    return out.orderBy("part", "name")

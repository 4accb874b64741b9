"""Answers as lines of text, for people: tables (part, k, line), in that order the text.

Long parts are rows with places of their own, so no task holds a whole answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fit, pad, percent, short_commit, truncate, wrap
from ..operators.attribution_counts import counters

#: The marks of sources, the wording and the rules of the texts.
MARKS = {"AI": "●", "AIModified": "◐", "Human": "+", "Original": "─"}
NOTHING = "No sensitive data detected."


def _part(df: DataFrame, part: int, lines: list, k: Column | None = None) -> DataFrame:
    """Lines (null: none) of each row of df as one part of a text."""
    listed = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    at = F.struct((F.lit(0).cast("long") if k is None else k.cast("long")).alias("a"), F.col("_i").cast("long").alias("b"))
    return df.select("*", F.posexplode(listed).alias("_i", "line")).where("line is not null").select(F.lit(part).alias("part"), at.alias("k"), "line")


def _joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("part", "k")


def _n(c: str) -> Column:
    return F.col(c).cast("string")


def blame_text(lines: DataFrame) -> DataFrame:
    """lines(line_number, commit_id, author, source_type, content, prompt_preview; others
    than the first and the source may be missing) of one file."""
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in lines.columns else F.lit("")
    mark = F.lit("?")
    for kind, sign in MARKS.items():
        mark = F.when(F.col("source_type") == kind, sign).otherwise(mark)
    body = F.concat(F.when(F.length(_n("line_number")) > 5, _n("line_number")).otherwise(F.lpad(_n("line_number"), 5, " ")), F.lit(" │ "), short_commit(col("commit_id")), F.lit(" │ "), fit(col("author"), 10), F.lit(" │  "), mark, F.lit(" │ "), truncate(col("content"), 50))
    shown = F.when(F.col("prompt_preview").isNotNull(), F.struct("line_number", "prompt_preview")) if "prompt_preview" in lines.columns else F.lit(None).cast("struct<line_number:bigint,prompt_preview:string>")
    c = lines.agg(*counters(), F.min(shown).alias("shown"))
    both = F.col("ai_lines") + F.col("ai_modified_lines")
    legend = F.concat(F.lit("Legend: ● AI ("), both.cast("string"), F.lit(") ◐ AI-modified ("), _n("ai_modified_lines"), F.lit(") + Human ("), _n("human_lines"), F.lit(") ─ Original ("), _n("original_lines"), F.lit(")"))
    # fixed: modified lines count twice here
    share = F.concat(F.lit("AI involvement: "), F.format_string("%.0f", percent(both, F.col("total_lines"))), F.lit("% ("), (both + F.col("ai_modified_lines")).cast("string"), F.lit(" of "), _n("total_lines"), F.lit(" lines)"))
    first = F.concat(F.lit('First AI prompt: "'), F.col("shown.prompt_preview"), F.lit('"'))
    rule = "─" * 85
    head = lines.sparkSession.range(1)
    return _joined([_part(head, 0, ["", " LINE    │ COMMIT  │ AUTHOR      │ SRC │ CODE", rule]), _part(lines, 1, [body], F.col("line_number")), _part(c, 2, [rule, legend, share, first])])


def summary_text(summary: DataFrame, files: DataFrame, models: DataFrame) -> DataFrame:
    """What range_summary, summary_by_file and models_first_seen found. Files and models
    stand in the order of their names."""
    rule = "═" * 60
    share = lambda c: F.format_string("%.1f", percent(F.col(c), F.col("additions")))
    row = lambda c, name: F.concat(F.lit("  +"), _n(c), F.lit(f" {name} ("), share(c), F.lit("%)"))
    some = lambda x: F.when(F.col("commits_with_ai") > 0, x)
    top = ["", rule, "  AI Attribution Summary", rule, "", F.concat(F.lit("Commits analyzed: "), _n("commits_analyzed"), F.lit(" ("), _n("commits_with_ai"), F.lit(" with AI attribution)")), ""]
    top += [F.when(F.col("commits_with_ai") == 0, "No AI attribution data found in the specified commit range.")]
    top += [some(x) for x in ("Lines Added:", row("ai_lines", "AI-generated"), row("ai_modified_lines", "AI-modified by human"), row("human_lines", "Human-written"), F.concat(F.lit("  +"), _n("additions"), F.lit(" Total additions")), "")]
    top += [some(F.concat(F.lit("AI involvement: "), F.format_string("%.1f", F.col("ai_percent")), F.lit("% of additions are AI-generated"))), some(""), some("Files Changed:")]
    listed = F.concat(F.lit("  "), F.col("path"), F.lit(" +"), _n("additions"), F.lit(" ("), F.format_string("%.0f", F.col("ai_percent")), F.lit("% AI)"), F.when(F.col("is_new_file"), " (new)").otherwise(""))
    noted = F.broadcast(summary.where("commits_with_ai > 0").select(F.lit(True).alias("_noted")))  # a row or none
    by_name = lambda df, part, line, name: df.crossJoin(noted).select(F.lit(part).alias("part"), F.col(name).alias("name"), line.alias("line"))
    flat = lambda df: df.select("part", F.lit("").alias("name"), F.col("k.b").alias("b"), "line")
    named = lambda df: df.select("part", "name", F.lit(0).cast("long").alias("b"), "line")
    any_model = models.agg(F.count("*").alias("n")).crossJoin(noted)
    out = flat(_part(summary, 0, top)).unionByName(named(by_name(files, 1, listed, "path")))
    out = out.unionByName(flat(_part(any_model, 2, ["", F.when(F.col("n") > 0, "Models used:")]))).unionByName(named(by_name(models, 3, F.concat(F.lit("  - "), F.col("model")), "model")))
    out = out.unionByName(flat(_part(summary.where("commits_with_ai > 0"), 4, ["", rule])))
    return out.orderBy("part", "name", "b").select("part", F.struct("name", "b").alias("k"), "line")


def show_text(found: DataFrame, files: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """found: the one commit (commit_id, session_id, model, started_at, total_*; totals are
    null without a note), its files with counters and its prompts."""
    named = lambda c: F.coalesce(F.col(c), F.lit("")) if c in found.columns else F.lit("")
    short = short_commit(F.col("commit_id"))
    has = F.col("total_ai_lines").isNotNull()
    head = [F.when(has, F.concat(F.lit(f"{title}: "), x)) for title, x in (("Commit", short), ("Session", named("session_id")), ("Model", named("model")), ("Started", named("started_at")))]
    head += [F.when(has, ""), F.when(~has, F.concat(F.lit("No AI attribution found for commit "), short)), F.when(~has, "This commit was not made with tracked AI assistance.")]
    parts = [_part(found, 0, head)]
    if prompts is not None:
        parts += [_part(prompts.limit(1), 1, ["Prompts used:"]), _part(prompts, 2, [F.concat(F.lit("  #"), _n("prompt_index"), F.lit(': "'), truncate(F.col("text"), 60), F.lit('"'))], F.col("prompt_index")), _part(prompts.limit(1), 3, [""])]
    more = lambda c, name: F.when(F.col(c) > 0, F.concat(F.lit(", "), _n(c), F.lit(f" {name}"))).otherwise("")
    line = F.concat(F.lit("  "), F.col("path"), F.lit(" ("), _n("ai_lines"), F.lit(" AI"), more("ai_modified_lines", "modified"), more("human_lines", "human"), more("original_lines", "original"), F.lit(") - "), _n("total_lines"), F.lit(" total lines"))
    ranked = files.select("path", line.alias("text"))
    rows = ranked.select(F.lit(5).alias("part"), F.col("path").alias("name"), F.lit(0).cast("long").alias("b"), F.col("text").alias("line"))
    total = lambda c, name: F.when(F.col(c) > 0, F.concat(F.lit("  "), _n(c), F.lit(f" {name}")))
    tail = ["", "Summary:", F.concat(F.lit("  "), _n("total_ai_lines"), F.lit(" AI-generated lines")), total("total_ai_modified_lines", "AI lines modified by human"), total("total_human_lines", "human-added lines"), total("total_original_lines", "original/unchanged lines")]
    parts += [_part(found.where(has), 4, ["Files with AI changes:"]), _part(found.where(has), 6, tail)]
    out = rows
    for p in parts:
        out = out.unionByName(p.select("part", F.lit("").alias("name"), (F.col("k.a") * 1000 + F.col("k.b")).alias("b"), "line"))
    return out.orderBy("part", "name", "b").select("part", F.struct("name", "b").alias("k"), "line")


def prompt_text(answer: DataFrame) -> DataFrame:
    """answer: the one line that was asked for (path, line_number, commit_id, source_type,
    prompt_index, text, affected_files, session_id, model, started_at; the prompt may be null)."""
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in answer.columns else F.lit("")
    known = F.col("text").isNotNull()
    when = lambda x: F.when(known, F.lit(x) if isinstance(x, str) else x)
    bar = "═" * 68
    top = [when(f"╔{bar}╗"), when(F.concat(F.lit("║  PROMPT #"), _n("prompt_index"), F.lit(" in session "), truncate(col("session_id"), 20), F.lit("  "))), when(F.concat(F.lit("║  Model: "), col("model"), F.lit(" | "), col("started_at"), F.lit("  "))), when(f"╠{bar}╣")]
    wrapped = F.transform(wrap(F.coalesce("text", F.lit("")), 64), lambda x: F.concat(F.lit("║  "), pad(x, 64), F.lit("  ║")))
    box = answer.where(known).select(F.posexplode(wrapped).alias("_w", "line")).select(F.lit(1).alias("part"), F.struct(F.col("_w").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("k"), "line")
    parts = [_part(answer, 0, top), box, _part(answer, 2, [when(f"╚{bar}╝"), when("")])]
    if "affected_files" in answer.columns:
        listed = answer.where(known & (F.size("affected_files") > 0))
        parts += [_part(listed, 3, ["Files affected by this prompt:"]), listed.select(F.posexplode("affected_files").alias("_w", "f")).select(F.lit(4).alias("part"), F.struct(F.col("_w").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("k"), F.concat(F.lit("  - "), F.col("f")).alias("line")), _part(listed, 5, [""])]
    lost = F.when(~known, F.concat(F.lit("Line "), _n("line_number"), F.lit(" is AI-generated but prompt details are not available.")))
    tail = [lost, F.concat(F.lit("File: "), F.col("path"), F.lit(":"), _n("line_number")), F.concat(F.lit("Commit: "), short_commit(col("commit_id"))), F.concat(F.lit("Source: "), F.col("source_type"))]
    return _joined([*parts, _part(answer, 6, tail)])


def redaction_texts(redacted: DataFrame, column: str = "text") -> DataFrame:
    """redact()'s rows with what a redaction test prints of each text: basic, matches, audit
    (arrays of lines)."""
    events = F.coalesce("events", F.array().cast("array<struct<start:int,end:int,ordinal:int,name:string,hit:string>>"))
    by = lambda a, b: F.when(a["ordinal"] != b["ordinal"], a["ordinal"] - b["ordinal"]).otherwise(a["start"] - b["start"])
    none, n = F.array(F.lit(NOTHING)), F.size(events)
    cut = lambda x, limit: F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(limit)), F.lit("..."))).otherwise(x)
    match = F.transform(F.array_sort(events, by), lambda e: F.concat(F.lit("  "), F.when(F.length(e["name"]) >= 16, e["name"]).otherwise(F.rpad(e["name"], 16, " ")), F.lit(" "), cut(e["hit"], 40)))
    audit = F.transform(events, lambda e: F.concat(F.lit("  Pattern: "), e["name"], F.lit("  Range: ("), e["start"].cast("string"), F.lit(", "), e["end"].cast("string"), F.lit(")  Preview: "), F.left(e["hit"], F.lit(10)), F.lit("...")))
    shown = F.array(F.lit("Redacted output:"), F.col("redacted"))
    return redacted.withColumns({
        "basic": F.when(F.col("redacted") == F.col(column), none).otherwise(shown),
        "matches": F.when(n == 0, none).otherwise(F.concat(F.array(F.concat(F.lit("Sensitive data "), n.cast("string"), F.lit(" found:")), F.lit("")), match)),
        "audit": F.when(n == 0, none).otherwise(F.concat(F.array(F.concat(F.lit("Audit Trail: "), n.cast("string"), F.lit(" redactions made:")), F.lit("")), audit, F.array(F.lit("")), shown)),
    })

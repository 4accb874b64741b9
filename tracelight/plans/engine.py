"""The engine's methods, one per command, over canonical tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.redaction import Redactor, matches, redact
from ..functions.text import file_line, lines
from ..operators import annotations as AN, attribution as AT, attribution_counts as AC, audit as AU, blame as BL, diffview as DV, export as EX, finalize as FI, graph as GR, history as HI, provenance as PR, retention as RE, summary as SU, trees as TR
from ..operators.tables import Scratch
from ..sources import auditlog, sinks as SI, texts as TX
from ..sources.notes import NoteStore
from .package import ship


@dataclass
class Tables:
    """commits(commit_key, commit_id, author, message, model, started_at, committed_at),
    parents(commit_key, parent_key, and parent_idx if it is known), refs(ref_name,
    commit_key), note_lines(commit_key, path, line_number, source_type, similarity, edit_id,
    prompt_index), prompts(commit_key, prompt_index, text), versions(path, seq, commit_key,
    content), blame_hunks(revision?, commit_key, path, final_start, orig_start, n_lines),
    diff_ranges(path, range_start, range_end), audit(seq, timestamp, event, ...). Hunks and
    ranges that are not given come from the versions. Note files are kept apart from note lines, so
    that summaries never read lines."""

    commits: DataFrame
    note_lines: DataFrame
    parents: DataFrame | None = None
    refs: DataFrame | None = None
    note_files: DataFrame | None = None
    prompts: DataFrame | None = None
    blame_hunks: DataFrame | None = None
    diff_ranges: DataFrame | None = None
    audit: DataFrame | None = None
    versions: DataFrame | None = None


class Engine:
    def __init__(self, spark: SparkSession, tables: Tables):
        ship(spark)
        self.spark, self.t = spark, tables

    @property
    def files(self) -> DataFrame:
        return self.t.note_files if self.t.note_files is not None else AC.note_files(self.t.note_lines)

    def resolve(self, revision) -> DataFrame:
        """A commit key, a commit_id prefix or a ref name (whole, or of a branch or tag),
        as commit_key rows; ~n and ^ after it go to first parents."""
        if isinstance(revision, int):
            return self.spark.createDataFrame([(revision,)], "commit_key long")
        name, steps = revision, 0
        while m := re.fullmatch(r"(.+?)(?:~(\d*)|\^)", name):
            name, steps = m[1], steps + (int(m[2] or 1) if m[2] is not None else 1)
        rows = []
        if self.t.refs is not None:
            named = [name, f"refs/{name}", f"refs/tags/{name}", f"refs/heads/{name}", f"refs/remotes/{name}"]
            found = {r.ref_name: r for r in self.t.refs.where(F.col("ref_name").isin(*named)).limit(2 * len(named)).collect()}
            rows = [found[n] for n in named if n in found][:1]  # a ref goes before a commit_id
        if not rows:
            rows = self.t.commits.where(F.col("commit_id").startswith(name)).select("commit_key").distinct().limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{revision!r} names {'no commit' if not rows else 'more than one commit'}")
        key = rows[0].commit_key
        for _ in range(steps):
            up = self.t.parents.where(F.col("commit_key") == key)
            got = up.agg(F.min_by("parent_key", "parent_idx" if "parent_idx" in up.columns else "parent_key")).first()[0]
            if got is None:
                raise ValueError(f"{revision!r} goes beyond the first commit")
            key = got
        return self.spark.createDataFrame([(key,)], "commit_key long")

    def range(self, base=None, head="HEAD") -> DataFrame:
        keys = GR.commit_range(self.t.parents, None if base is None else self.resolve(base), self.resolve(head))
        return self.t.commits.join(keys, "commit_key", "left_semi")

    # -- versions of files

    def history(self, paths: DataFrame | None = None, revision=None) -> DataFrame:
        """The versions of files (all, or paths(path)) up to a revision, numbered without gaps."""
        v = self.t.versions if paths is None else self.t.versions.join(paths, "path", "left_semi")
        if revision is not None:
            v = v.join(self.range(None, revision), "commit_key", "left_semi")
        return v.withColumn("seq", (F.row_number().over(W.partitionBy("path").orderBy("seq")) - 1).cast("long"))

    def hunks(self, paths: DataFrame, revision=None) -> DataFrame:
        """Blame hunks of files as a revision has them (path, commit_key, final_start, orig_start, n_lines)."""
        given = self.t.blame_hunks
        if given is None:
            v = self.history(paths, revision)
            return PR.at_revision(PR.hunks(v, ["path"]), v, ["path"])
        if "revision" in given.columns:
            given = given.where(F.col("revision") == ("HEAD" if revision is None else str(revision)))
        return given.join(paths, "path", "left_semi")

    def content(self, path: str, revision=None) -> DataFrame:
        """(line_number, content) of a file; none if the revision does not have it."""
        v = self.history(self._path(path), revision)
        last = v.agg(F.max_by(F.struct("content"), "seq").alias("c")).where("c.content is not null")
        return last.select(F.posexplode(lines(F.col("c.content"))).alias("k", "content")).select((F.col("k") + 1).cast("long").alias("line_number"), "content")

    def _path(self, path: str) -> DataFrame:
        return self.spark.createDataFrame([(path,)], "path string")

    # -- answers

    def blame(self, path: str, ai_only: bool = False, human_only: bool = False, revision=None, format: str = "rows") -> DataFrame:
        """rows: every line with its source, commit and prompt; json: (n, line) of a document;
        text: (part, k, line). Filters come before totals."""
        out = BL.blame(self.hunks(self._path(path), revision), self.t.note_lines, self.t.prompts)
        if ai_only:
            out = out.where(AC.is_ai(F.col("source_type")))
        elif human_only:
            out = out.where(AC.is_human(F.col("source_type")))
        out = out.join(self.t.commits.select("commit_key", "commit_id", F.coalesce("author", F.lit("Unknown")).alias("author")), "commit_key", "left")
        if self.t.versions is not None:
            out = out.drop("content").join(self.content(path, revision), "line_number", "left")
        if format == "rows":
            return out
        return SI.blame_document(out, path, "HEAD" if revision is None else str(revision)) if format == "json" else TX.blame_text(out)

    def prompt(self, reference: str, revision=None, format: str = "rows") -> DataFrame:
        """The line that a file:line reference names, or the file's first line by AI, with
        its prompt. json: one document; text: (part, k, line)."""
        path, line = self.spark.range(1).select(*file_line(F.lit(reference))).first()
        blamed = self.blame(path, revision=revision)
        if line is not None:
            got = blamed.where(F.col("line_number") == line)
            if not got.head(1):
                raise ValueError(f"{path} has no line {line}")
        target = BL.prompt_target(blamed, ["path"], line)
        if not target.head(1):
            raise ValueError(f"{reference} was not written by AI")
        own = [c for c in ("commit_key", "prompt_preview", "commit_id", "author", "source_type", "content") if c in blamed.columns]
        out = target.join(blamed.select("path", "line_number", *own), ["path", "line_number"])
        if format == "rows":
            return out
        session = [c for c in ("session_id", "model", "started_at") if c in self.t.commits.columns]
        out = out.join(self.t.commits.select("commit_key", *session), "commit_key", "left")
        if self.t.prompts is not None:
            out = out.join(self.t.prompts, ["commit_key", "prompt_index"], "left")
        return SI.prompt_json(out, reference, "HEAD" if revision is None else str(revision)) if format == "json" else TX.prompt_text(out)

    def show(self, revision, format: str = "rows") -> DataFrame:
        """A commit's totals; json: one document; text: (part, k, line)."""
        key = self.resolve(revision)
        found = key.join(AC.commit_totals(self.files), "commit_key", "left").join(self.t.commits, "commit_key", "left")
        if format == "rows":
            return found.select("commit_key", *[c for c in found.columns if c.startswith("total_")])
        files = self.files.join(key, "commit_key", "left_semi")
        prompts = None if self.t.prompts is None else self.t.prompts.join(key, "commit_key", "left_semi")
        return SI.show_json(found, prompts, files) if format == "json" else TX.show_text(found, files, prompts)

    def summary(self, base=None, head="HEAD", format: str = "rows") -> tuple[DataFrame, DataFrame] | DataFrame:
        """(totals, by file); markdown, text: lines in order; json: (place, line) of a document."""
        c = self.range(base, head)
        total, files = SU.range_summary(c, self.files), SU.summary_by_file(c, self.files)
        if format == "rows":
            return total, files
        models = SU.models_first_seen(c, self.files)
        return {"markdown": SU.markdown, "text": TX.summary_text, "json": SI.summary_document}[format](total, files, models)

    def ranges(self, base, head="HEAD") -> DataFrame:
        """Changed lines from base to head (path, range_start, range_end)."""
        if self.t.diff_ranges is not None:
            return self.t.diff_ranges
        at = lambda r: self.history(None, r).groupBy("path").agg(F.max_by(F.struct("content"), "seq").alias("c")).select("path", "c.content")
        return TR.diff_ranges(at(base), at(head), [])

    def annotations(self, base=None, head="HEAD", consolidate: str = "auto", consolidate_threshold: float = 0.7, min_lines: int = 1, max_annotations: int = 50, ai_only: bool = False, min_ai_lines: int = 3, min_ai_percent: float = 5.0, diff_only: bool = False, group_ai_types: bool = False, consolidate_prompt_limit: int = 3, sort_by: str = "coverage", shallow: bool = False, format: str = "rows") -> DataFrame:
        """rows: places and scores; checks, json: one document (json with its schema). Files
        that cannot be blamed have no annotation, but count as analysed. diff_only without base has
        no effect; of a shallow history, files are annotated as a whole."""
        walk = self.range(base, head)
        kept = AN.significant(self.files.join(walk, "commit_key", "left_semi"), min_ai_lines, min_ai_percent).select("path").distinct()
        blamed = BL.blame(self.hunks(kept, None if self.t.blame_hunks is not None and head == "HEAD" else head), self.t.note_lines, self.t.prompts)
        groups = AN.line_groups(blamed, ["path"], ai_only, group_ai_types, min_lines)
        ranges = self.ranges(base, head) if diff_only and base is not None else None
        options = ("file" if shallow else consolidate, consolidate_threshold, consolidate_prompt_limit, max_annotations, ranges, sort_by)
        if format == "rows":
            return AN.candidates(AN.file_stats(blamed, ["path"]), groups, ["path"], *options)
        picked = AN.chosen(AN.file_stats(blamed, ["path"]), groups, ["path"], *options)
        noted = walk.join(self.files.select("commit_key").distinct(), "commit_key", "left_semi")
        span, models = SU.session_range(noted).select("session_range", "models").first()  # one row
        models = [m for m in (models or "").split(",") if m]
        prompts = AN.prompt_counts(blamed, ["path"])
        if self.t.prompts is not None:
            first = blamed.where("prompt_preview is not null").groupBy("path", "prompt_index").agg(F.min_by("prompt_preview", "line_number").alias("preview"))
            prompts = prompts.join(first, ["path", "prompt_index"], "left")
        else:
            prompts = prompts.withColumn("preview", F.lit(None).cast("string"))
        return AN.checks_json(AN.described(picked, prompts, ["path"], models, span), kept.count(), models, span, format == "json")

    def annotate_diff(self, diff: DataFrame, by: list[str], verbose: bool = False) -> DataFrame:
        named = DV.parse(diff, by).select("path").where("path is not null").distinct()
        b = BL.blame(self.hunks(named), self.t.note_lines).withColumnRenamed("line_number", "line_no")
        return DV.annotated(diff, b, by, verbose)

    def export(self, since: str | None = None, until: str | None = None, full_prompts: bool = False, prompt_max_len: int = 100) -> DataFrame:
        """Fails if a note's commit is missing."""
        lost = EX.missing(self.t.commits, self.files.select("commit_key").distinct()).head(1)
        if lost:
            raise ValueError(f"commit {lost[0].commit_key} has a note but does not exist")
        return EX.export(self.t.commits, AC.commit_totals(self.files), self.t.prompts, since, until, full_prompts, prompt_max_len, self.files)

    def export_to(self, path: str, format: str = "json", exported_at: str | None = None, since: str | None = None, until: str | None = None, full_prompts: bool = False, prompt_max_len: int = 100) -> int:
        """Writes an export as a folder of text files, in order; returns its commits."""
        rows = self.export(since, until, full_prompts, prompt_max_len)
        at = exported_at or datetime.now(timezone.utc).isoformat(timespec="seconds")
        SI.write_lines(EX.with_header(rows) if format == "csv" else EX.json_lines(rows, at, since, until), path)
        return rows.count()

    def retention_sets(self, policy: RE.Policy, as_of: str) -> tuple[DataFrame, list[str]]:
        """Decisions per commit, and the policy's refs that resolve to nothing."""
        found, missing = RE.reachable(self.t.parents, self.t.refs, policy.retain_refs)
        e = RE.entries(self.files.select("commit_key"), self.t.commits, found, as_of, policy.max_age_days)
        return RE.sets(e, policy.min_commits), missing

    def retention_preview(self, policy: RE.Policy, as_of: str, show: int = 25) -> DataFrame:
        """The first notes that would go, and how many more there are."""
        return RE.preview(self.retention_sets(policy, as_of)[0], show)

    def retention_apply(self, policy: RE.Policy, as_of: str, store: NoteStore, reason: str = "retention policy", log: str | None = None) -> int:
        """Removes the notes that a policy does not keep from the store, and appends to the
        audit log (a folder) that it did; returns how many."""
        decided, _ = self.retention_sets(policy, as_of)
        gone = Scratch(self.spark, "retention").write(decided.where("not keep").select("commit_id"))
        n = gone.count()
        if n:
            store.remove(gone)
            if log is not None:
                auditlog.append(AU.retention_applied(self.spark, as_of, n, reason).withColumn("seq", F.lit(0)), log, chain=True)
        return n

    def audit(self, since: str | None = None, event_type: str | None = None, limit: int | None = 50) -> DataFrame:
        return AU.audit(self.t.audit, since, event_type, limit)

    def redact(self, df: DataFrame, column: str = "text", redactor: Redactor | None = None) -> DataFrame:
        return redact(df, column, redactor or Redactor())

    def find_sensitive(self, df: DataFrame, column: str = "text", redactor: Redactor | None = None) -> DataFrame:
        """A row per match, in pattern order."""
        return matches(df, column, redactor or Redactor())

    def pending_status(self, edits: DataFrame, sessions: DataFrame, as_of, hours: int = 24) -> DataFrame:
        return HI.pending_status(edits, sessions, as_of, hours)

    def orphans(self, notes: DataFrame) -> DataFrame:
        return FI.orphans(notes, self.t.commits)

    def finalize(self, pending: DataFrame, changes: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """pending(commit_id, path, original, edits): attributed lines of the files that
        commits touch, and what stays pending."""
        resolved = FI.resolve(pending, changes)
        done = FI.with_content(resolved, versions)
        lines = AT.three_way(done.select("commit_id", F.col("resolved").alias("path"), "original", "edits", "final"), ["commit_id"])
        return lines, FI.remaining(resolved)

    def copy_notes(self, notes: DataFrame, pairs: DataFrame, dry_run: bool = False) -> DataFrame:
        return FI.copies(notes, pairs) if dry_run else FI.copied(notes, pairs)

"""What differs between two snapshots of a tree: changed files, hunks and renames.

A snapshot has a row per file (by, path, content); by names the pair that is compared,
commit and number of its parent for instance. Null content is a file that is not there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .attribution import align, line_tokens
from .tables import Scratch

#: Unchanged lines around a change that belong to its hunk.
CONTEXT = 3
#: Least similarity, in percent, of a renamed file, and from which on a changed file stays itself.
RENAME, REWRITE = 50, 50


def tree_diff(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Files that differ: (by, path, status A, D or M). Paths and digests meet, not texts."""
    side = lambda df, name: df.where("content is not null").select(*by, "path", F.sha2("content", 256).alias(name))
    both = side(old, "a").join(side(new, "b"), [*by, "path"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*by, "path", F.when(F.col("a").isNull(), "A").when(F.col("b").isNull(), "D").otherwise("M").alias("status"))


def diff_hunks(old: str | None, new: str | None, context: int = CONTEXT) -> list[tuple[int, int]]:
    """Hunks of a diff on the new side as (first line, lines), from 1; a hunk that leaves
    no line on that side begins at the line before it."""
    a, b = line_tokens(old or ""), line_tokens(new or "")
    kept = [(-1, -1), *align(a, b), (len(a), len(b))]
    changes = [(p[1] + 1, q[1]) for p, q in zip(kept, kept[1:]) if q[0] - p[0] > 1 or q[1] - p[1] > 1]
    out: list[list[int]] = []
    for first, end in changes:
        if out and first - out[-1][1] <= 2 * context:
            out[-1][1] = end
        else:
            out.append([first, end])
    spans = [(max(first - context, 0), min(end + context, len(b))) for first, end in out]
    return [(s + 1 if e > s else s, e - s) for s, e in spans]


def diff_ranges(old: DataFrame, new: DataFrame, by: list[str], context: int = CONTEXT) -> DataFrame:
    """(by, path, range_start, range_end) of every hunk on the new side, as the diff of the two
    snapshots has them. Only texts of files that differ are moved; each pair is aligned alone."""
    ch = tree_diff(old, new, by)
    side = lambda df, name: df.select(*by, "path", F.col("content").alias(name))
    rows = ch.join(side(old, "a"), [*by, "path"], "left").join(side(new, "b"), [*by, "path"], "left")
    keys = len(by) + 1

    def run(batches):
        for batch in batches:
            at, starts, ends = [], [], []
            for k, (a, b) in enumerate(zip(batch.column(keys).to_pylist(), batch.column(keys + 1).to_pylist())):
                for first, n in diff_hunks(a, b, context):
                    at.append(k)
                    starts.append(first)
                    ends.append(first + max(n - 1, 0))
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(keys)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[*by, "path", "range_start", "range_end"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, "path"])
    return rows.select(*by, "path", "a", "b").mapInArrow(run, f"{fields}, range_start long, range_end long")


# --- renames -----------------------------------------------------------------


def _bags(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, line, n, weight): every text line of a file once, as a digest, with how
    often it stands there and its bytes."""
    line = F.explode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("text")
    rows = files.where("content <> ''").select(*by, "path", line)
    return rows.groupBy(*by, "path", F.md5("text").alias("line")).agg(F.count("*").alias("n"), F.max(F.octet_length("text") + 1).alias("weight"))


def _prefixes(bags: DataFrame, by: list[str], percent: int) -> DataFrame:
    """The rarest lines of each file, up to where the others cannot make up `percent` of its
    bytes: two similar files have one of these in common."""
    held = bags.groupBy(*by, "line").agg(F.count("*").alias("files"))
    w = W.partitionBy(*by, "path", "side").orderBy(F.desc("files"), F.desc("line"))
    rows = bags.join(held, [*by, "line"]).withColumn("rest", F.sum(F.col("n") * F.col("weight")).over(w))
    total = F.sum(F.col("n") * F.col("weight")).over(W.partitionBy(*by, "path", "side"))
    return rows.withColumn("total", total).where(F.col("rest") * 100 >= F.col("total") * percent)


def similar_files(old: DataFrame, new: DataFrame, by: list[str], percent: int = RENAME) -> DataFrame:
    """(by, old_path, new_path, common, larger): all pairs of files that have at least
    `percent` of the larger one's bytes in common lines. A pair is looked at if both have
    one of their rarest lines in common and their sizes are near enough."""
    bags = _bags(old, by).withColumn("side", F.lit(0)).unionByName(_bags(new, by).withColumn("side", F.lit(1)))
    first = _prefixes(bags, by, percent)
    side = lambda df, k, name: df.where(F.col("side") == k).drop("side").withColumnsRenamed({"path": name, "total": f"{name}_bytes", "n": f"{name}_n"})
    keys = [*by, "line"]
    pairs = side(first.drop("n", "weight", "files", "rest"), 0, "old_path").join(side(first.drop("n", "weight", "files", "rest"), 1, "new_path"), keys)
    larger = F.greatest("old_path_bytes", "new_path_bytes")
    pairs = pairs.where(F.least("old_path_bytes", "new_path_bytes") * 100 >= larger * percent).select(*by, "old_path", "new_path", larger.alias("larger")).distinct()
    mine = pairs.join(side(bags, 0, "old_path"), [*by, "old_path"])
    both = mine.join(side(bags.drop("weight"), 1, "new_path"), [*keys, "new_path"])
    found = both.groupBy(*by, "old_path", "new_path").agg(F.sum(F.least("old_path_n", "new_path_n") * F.col("weight")).alias("common"), F.max("larger").alias("larger"))
    return found.where(F.col("common") * 100 >= F.col("larger") * percent)


def _score() -> Column:
    return F.col("common") / F.col("larger")


def assigned(pairs: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """One to one, best pair first (ties: old path, then new path): in every round all pairs
    go that are the best of both their files, and with them what else these files were in."""
    left, taken = scratch.write(pairs.withColumn("score", _score())), None
    order = [F.desc("score"), "old_path", "new_path"]
    while left.head(1):
        best = left.withColumn("a", F.row_number().over(W.partitionBy(*by, "old_path").orderBy(*order))).withColumn("b", F.row_number().over(W.partitionBy(*by, "new_path").orderBy(*order)))
        now = scratch.write(best.where("a = 1 and b = 1").select(*by, "old_path", "new_path", "score"))
        taken = now if taken is None else taken.unionByName(now)
        rest = left.join(now.select(*by, "old_path"), [*by, "old_path"], "left_anti").join(now.select(*by, "new_path"), [*by, "new_path"], "left_anti")
        then = scratch.write(rest)
        scratch.drop(left)
        left = then
    return left.select(*by, "old_path", "new_path", "score") if taken is None else taken


def renames(old: DataFrame, new: DataFrame, by: list[str], percent: int = RENAME, rewrite: int | None = REWRITE) -> DataFrame:
    """(by, old_path, new_path, score) of files that went from one path to another.

    Files that are gone are matched with files that are new: first those of equal
    content, in the order of their paths, then by similarity of their lines, each file once and
    the most similar first. A changed file that keeps less than `rewrite` percent of itself is
    a source as well. Empty files are never renamed."""
    t = Scratch(old.sparkSession, "renames")
    ch = tree_diff(old, new, by)
    full = lambda df: df.where("content <> ''").select(*by, "path", "content")
    gone = full(old).join(ch.where("status = 'D'").select(*by, "path"), [*by, "path"], "left_semi")
    fresh = full(new).join(ch.where("status = 'A'").select(*by, "path"), [*by, "path"], "left_semi")
    if rewrite is not None:
        kept = similar_self(old, new, ch.where("status = 'M'").select(*by, "path"), by)
        gone = gone.unionByName(full(old).join(kept.where(F.col("common") * 100 < F.col("larger") * rewrite).select(*by, "path"), [*by, "path"], "left_semi"))
    gone, fresh = t.write(gone), t.write(fresh)
    place = lambda df, name: df.select(*by, F.sha2("content", 256).alias("hash"), F.col("path").alias(name)).withColumn("k", F.row_number().over(W.partitionBy(*by, "hash").orderBy(name)))
    exact = t.write(place(gone, "old_path").join(place(fresh, "new_path"), [*by, "hash", "k"]).select(*by, "old_path", "new_path", F.lit(1.0).alias("score")))
    rest = lambda df, name: df.join(exact.select(*by, F.col(name).alias("path")), [*by, "path"], "left_anti")
    return exact.unionByName(assigned(similar_files(rest(gone, "old_path"), rest(fresh, "new_path"), by, percent), by, t))


def similar_self(old: DataFrame, new: DataFrame, paths: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, common, larger): bytes that a changed file keeps, and those of its larger version."""
    keys = [*by, "path", "line"]
    a, b = (_bags(df.join(paths, [*by, "path"], "left_semi"), by) for df in (old, new))
    both = a.withColumnRenamed("n", "a").join(b.select(*keys, F.col("n").alias("b"), F.col("weight").alias("w")), keys, "full")
    weight = F.coalesce("weight", "w")
    size = lambda n: F.sum(F.coalesce(n, F.lit(0)) * weight)
    return both.groupBy(*by, "path").agg(F.coalesce(F.sum(F.least("a", "b") * F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), weight)), F.lit(0)).alias("common"), F.greatest(size("a"), size("b")).alias("larger"))


def changes(old: DataFrame, new: DataFrame, by: list[str], percent: int = RENAME) -> DataFrame:
    """(by, status, old_path, new_path) of a commit against its parent: A, D, M, and R for
    files that were renamed, which are no longer A and D."""
    r = renames(old, new, by, percent)
    ch = tree_diff(old, new, by)
    left = ch.join(r.select(*by, F.col("new_path").alias("path"), F.lit("A").alias("status")), [*by, "path", "status"], "left_anti").join(r.select(*by, F.col("old_path").alias("path"), F.lit("D").alias("status")), [*by, "path", "status"], "left_anti")
    plain = left.select(*by, "status", F.when(F.col("status") != "A", F.col("path")).alias("old_path"), F.when(F.col("status") != "D", F.col("path")).alias("new_path"))
    return plain.unionByName(r.select(*by, F.lit("R").alias("status"), "old_path", "new_path"))

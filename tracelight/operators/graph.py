"""Reachability over the commit graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracelight-")
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex[:12]}"


#: Generations per job, jobs before chains are looked for, and steps of a chain that one round multiplies by.
GENERATIONS, NEAR, STRIDE = 8, 2, 4
#: Links that chains() follows to their ends, and steps along a line per round before that.
LINKS, STEPS = 1 << 18, 6


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chains(parents: DataFrame, folder: str) -> DataFrame:
    """(commit_key, last, steps) for commits above the end of a chain. A chain is a
    line of commits of which each has one parent and is its only child; pointers to the end
    are followed STRIDE times a round, so a chain of n commits takes log(n) rounds."""
    one = parents.groupBy("commit_key").agg(F.count("*").alias("n"), F.min("parent_key").alias("last")).where("n = 1").select("commit_key", "last")
    only = parents.groupBy("parent_key").agg(F.count("*").alias("n")).where("n = 1").select(F.col("parent_key").alias("last"))
    now = _written(one.join(only, "last", "left_semi").select("commit_key", "last", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")), f"{folder}/chains-0")
    k = 0
    while now.where("open").head(1):
        k += 1
        link = now.select(F.col("commit_key").alias("last"), F.col("last").alias("_next"), F.col("steps").alias("_more"))
        done, go = now.where("not open"), now.where("open")
        for _ in range(STRIDE - 1):
            go = go.join(link, "last", "left").select("commit_key", F.coalesce("_next", "last").alias("last"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), F.col("_next").isNotNull().alias("open"))
        now = _written(done.unionByName(go), f"{folder}/chains-{k}")
    return now.drop("open")


def contracted(parents: DataFrame, kept: DataFrame, folder: str) -> tuple[DataFrame, list[DataFrame]]:
    """parents(commit_key, parent_key), without repeats, less most commits that have one parent
    and one child and are not in kept(commit_key); and tables (top, by), the last first: who
    reaches top reaches the commits in by.

    One such commit in four, by hash, and all others stay. From each that stays the line is
    followed to the next, STEPS a job, and the commits between go. What is left is a share of
    the table, so all rounds together move a few times the table. Below LINKS of them, or
    where they get no fewer, chains() goes on."""
    now, tables, before = parents, [], None
    kind = parents.schema["parent_key"].dataType.simpleString()
    while True:
        k = len(tables)
        one = now.groupBy("commit_key").agg(F.count("*").alias("n"), F.min("parent_key").alias("next")).where("n = 1").select("commit_key", "next")
        only = now.groupBy("parent_key").agg(F.count("*").alias("n")).where("n = 1").select(F.col("parent_key").alias("commit_key"))
        inner = one.join(only, "commit_key", "left_semi").join(kept, "commit_key", "left_anti")
        links = _written(inner.where(F.pmod(F.xxhash64("commit_key", F.lit(k)), F.lit(4)) != 0), f"{folder}/links-{k}")
        n = links.count()
        if n < LINKS or before is not None and n > 0.9 * before:
            return now, tables[::-1]
        before = n
        at = links.select(F.col("commit_key").alias("at"), "next")
        step = now.join(links, "commit_key", "left_anti").select(F.col("commit_key").alias("top"), F.col("parent_key").alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("by"))
        for _ in range(STEPS):
            by = F.when(F.col("next").isNull(), F.col("by")).otherwise(F.array_append("by", F.col("at")))
            step = step.join(at, "at", "left").select("top", F.coalesce("next", "at").alias("at"), by.alias("by"))
        step = _written(step, f"{folder}/steps-{k}")
        passed = step.select(F.explode("by").alias("commit_key"))
        left = links.join(passed, "commit_key", "left_anti").select("commit_key", F.col("next").alias("parent_key"))
        now = _written(step.select(F.col("top").alias("commit_key"), F.col("at").alias("parent_key")).unionByName(left).distinct(), f"{folder}/parents-{k}")
        tables.append(step.where(F.size("by") > 0).select("top", "by"))


def _walk(edges: DataFrame, start: DataFrame, folder: str, jobs: int | None = None) -> tuple[DataFrame, bool]:
    """Nodes that start(node) reaches over edges(node, to), and whether that is all of
    them. Every job takes GENERATIONS steps from what the last one ended at, and is written:
    a node's generation is the first that meets it. The edges are dealt by node once a job, and
    every step leaves its nodes where the next one needs them."""
    spark, frontier, k = edges.sparkSession, start.select("node").distinct(), 0
    reached = None
    while True:
        step = frontier.select("node", F.lit(0).alias("g"))
        for _ in range(GENERATIONS):
            both = F.explode(F.array(F.struct("node", "g"), F.struct(F.col("to").alias("node"), (F.col("g") + 1).alias("g")))).alias("s")
            step = step.join(edges, "node", "left").select(both).select("s.node", "s.g").where("node is not null").groupBy("node").agg(F.min("g").alias("g"))
        if reached is not None:
            step = step.join(reached, "node", "left_anti")
        frontier = _written(step, f"{folder}/{k}").where(F.col("g") == GENERATIONS)
        k += 1
        reached = spark.read.schema("node " + start.schema["node"].dataType.simpleString()).parquet(*[f"{folder}/{i}" for i in range(k)])
        if not frontier.head(1):
            return reached, True
        if k == jobs:
            return reached, False


def ancestors(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """All commits reachable from heads(commit_key), heads included.

    parents(commit_key, parent_key). The nearest generations are walked, several a job.
    If that is not all, long tables are contracted to few commits of each line, chains of
    what stays are put into one step each, and what is left, merges and branches, is walked
    likewise; then the commits between those that stayed are met. Each table is written to the shared folder, so
    histories of any length keep a short lineage. (A recursive query is limited to 100
    levels by default.)
    """
    folder = _folder(parents.sparkSession)
    parents = parents.where("commit_key is not null and parent_key is not null").select("commit_key", "parent_key")
    heads = heads.where("commit_key is not null").select("commit_key")
    known, over = _walk(parents.toDF("node", "to"), heads.toDF("node"), f"{folder}/known", NEAR)
    known = known.toDF("commit_key")
    if over:
        return known
    parents = _written(parents.distinct(), f"{folder}/parents")
    parents, passed = contracted(parents, known, folder)
    line = chains(parents, folder)
    entry = line.select(F.col("commit_key").alias("parent_key"), "last")
    ends = parents.join(line, "commit_key", "left_anti").join(entry, "parent_key", "left").select(F.col("commit_key").alias("node"), F.coalesce("last", "parent_key").alias("to")).distinct()
    ends = _written(ends, f"{folder}/ends")
    start = known.join(line, "commit_key", "left")
    start = _written(start.select("commit_key", F.coalesce("last", "commit_key").alias("node"), F.coalesce("steps", F.lit(0)).alias("steps")), f"{folder}/start")
    met, _ = _walk(ends, start.select("node"), f"{folder}/met")
    whole = ends.join(met, "node", "left_semi").select(F.col("to").alias("node")).distinct()
    # chains entered at their top are reached whole, those that a known commit stands in from there on
    part = start.groupBy("node").agg(F.max("steps").alias("from"))
    out = line.join(part, line["last"] == part["node"]).where("steps <= from").select("commit_key").unionByName(start.select(F.col("node").alias("commit_key")))
    out = out.unionByName(line.join(whole, line["last"] == whole["node"], "left_semi").select("commit_key")).unionByName(whole.toDF("commit_key")).unionByName(met.toDF("commit_key"))
    out = out.distinct()
    for k, table in enumerate(passed):
        out = _written(out, f"{folder}/out-{k}")
        out = out.unionByName(table.join(out.withColumnRenamed("commit_key", "top"), "top", "left_semi").select(F.explode("by").alias("commit_key")))
    return out


def commit_range(parents: DataFrame, base: DataFrame | None, head: DataFrame) -> DataFrame:
    """Reachable from head and not from base."""
    found = ancestors(parents, head)
    return found if base is None else found.join(ancestors(parents, base), "commit_key", "left_anti")

"""The attribution tables, derived from general business tables.

A deterministic stand-in for a repository: orders are commits, line items are
attributed lines, conversations are prompts, events are an audit log, documents are
file versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, WindowSpec, functions as F

from ..functions.text import lines
from ..schemas import AI, AI_MODIFIED, HUMAN, ORIGINAL, UNKNOWN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_id(key) -> F.Column:
    return F.substring(F.sha2(key.cast("string"), 256), 1, 40)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_key, commit_id, author, message, model, started_at, committed_at, session_id."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("commit_key"), commit_id(F.col("o_orderkey")).alias("commit_id"), F.col("c_name").alias("author"),
        F.concat(F.lit("change "), F.col("o_orderstatus"), F.lit("\nbody")).alias("message"), F.lower(F.concat(F.lit("model-"), F.substring("o_orderpriority", 1, 1))).alias("model"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"), F.col("o_orderdate").alias("committed_at"), F.concat(F.lit("session-"), F.col("o_custkey").cast("string")).alias("session_id"),
    )


def commit_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey > 0")
    return o.select(F.col("o_orderkey").alias("commit_key"), F.expr("o_orderkey div 2").alias("parent_key"))


def _dealt(df: DataFrame, key: str, part: int = 4 << 20, like: DataFrame | None = None) -> DataFrame:
    """df by key in parts of about so many bytes of its files, or those of like, so that what a
    task holds does not grow with the table."""
    size = int((like or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // part), 100_000)), key)


def note_lines(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """One row per (commit_key, path, line_number): of repeated lines the smallest. together:
    a commit's lines are in one part, so what is counted per commit or file stays there."""
    kind = F.concat("l_returnflag", "l_linestatus")
    li = table(spark, sf_dir, "lineitem")
    li = _dealt(li, "l_orderkey") if together else li
    li = li.select(
        F.col("l_orderkey").alias("commit_key"), F.concat(F.lit("src/f"), (F.col("l_partkey") % 50).cast("string")).alias("path"), F.col("l_linenumber").cast("long").alias("line_number"),
        F.struct(
            "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
            F.when(kind.isin("AF", "RO"), AI).when(kind == "AO", AI_MODIFIED).when(kind == "NF", HUMAN).when(kind == "NO", ORIGINAL).otherwise(UNKNOWN).alias("type"),
        ).alias("row"),
    )
    best = li.groupBy("commit_key", "path", "line_number").agg(F.min("row").alias("row"))
    ai = F.col("row.type").isin(AI, AI_MODIFIED)
    return best.select(
        "commit_key", "path", "line_number", F.col("row.type").alias("source_type"), F.when(F.col("row.type") == AI_MODIFIED, 1 - F.col("row.l_discount")).alias("similarity"),
        F.when(ai, F.concat(F.lit("e"), F.col("row.l_suppkey").cast("string"))).alias("edit_id"), F.when(ai, F.col("row.l_suppkey") % 4).alias("prompt_index"),
    )


def prompts(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """commit_key, prompt_index, text: user turns, numbered within a conversation. together:
    dealt by commit as note_lines are."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    c = _dealt(c, "conv_id", like=table(spark, sf_dir, "lineitem")) if together else c
    from pyspark.sql import Window as W

    return c.select(F.col("conv_id").alias("commit_key"), (F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text")) - 1).cast("long").alias("prompt_index"), "text", F.array(F.concat(F.lit("src/f"), (F.col("conv_id") % 50).cast("string"))).alias("affected_files"))


def blame_hunks(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """commit_key, path, final_start, orig_start, n_lines: one hunk per line item. together:
    dealt by commit as note_lines are."""
    li = table(spark, sf_dir, "lineitem")
    li = _dealt(li, "l_orderkey") if together else li
    return li.select(
        F.col("l_orderkey").alias("commit_key"), F.concat(F.lit("src/f"), (F.col("l_partkey") % 50).cast("string")).alias("path"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10).cast("long").alias("final_start"), F.col("l_linenumber").cast("long").alias("orig_start"), (F.col("l_suppkey") % 3 + 1).cast("long").alias("n_lines"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in {"click": "delete", "view": "export", "purchase": "retention_apply", "signup": "config_change", "error": "redaction"}.items() for x in kv])
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.try_element_at(kinds, F.col("event_type")).alias("event"), F.col("user_id").cast("string").alias("user"))


def parts_to_deal(df: DataFrame) -> int | None:
    """Two parts a core for a table that is read in fewer, none for one that is read in as many."""
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    return parts if df.rdd.getNumPartitions() < parts else None


def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, original, ai, final: every 3rd line is new in ai; in final every 7th line
    is edited, every 11th replaced."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), lines(F.col("text")).alias("l"))
    keep = F.filter("l", lambda x, i: i % 3 != 1)
    final = F.transform("l", lambda x, i: F.when(i % 11 == 10, F.concat(F.lit("human "), i.cast("string"))).when(i % 7 == 6, F.concat(x, F.lit(" !"))).otherwise(x))
    return d.select("path", F.array_join(keep, "\n").alias("original"), F.array_join("l", "\n").alias("ai"), F.array_join(final, "\n").alias("final"))


def _of_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, WindowSpec]:
    """Orders as commits to 200 files, and the order of a file's commits."""
    from pyspark.sql import Window as W

    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_key"), F.concat(F.lit("src/h"), (F.col("o_custkey") % 200).cast("string")).alias("path"))
    return v, W.partitionBy("path").orderBy("commit_key")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, seq, commit_key: the versions of histories() without what stands in them."""
    v, w = _of_files(spark, sf_dir)
    return v.select("path", (F.row_number().over(w) - 1).cast("long").alias("seq"), "commit_key")


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, seq, commit_key, content: orders are versions of 200 files, and each brings a
    line per line item, which stands in the four versions after it as well but for a
    fourth of them, at random; some come back. A commit's own lines meet it once, and the
    window that numbers the versions looks back at those of the four before."""
    v, w = _of_files(spark, sf_dir)
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("commit_key")).agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("long"))).alias("own"))
    v = v.join(own, "commit_key", "left").select("path", (F.row_number().over(w) - 1).cast("long").alias("seq"), "commit_key", *[F.lag("own", k).over(w).alias(f"own{k}") for k in range(5)])

    def stands(k: int):
        at = F.col("seq") - k
        text = lambda ln: F.concat(F.lit("line "), at.cast("string"), F.lit(":"), ln.cast("string"), F.lit("\n"))
        there = F.filter(f"own{k}", lambda ln: (ln + 2 * at + k) % 4 != 0) if k else F.col("own0")
        return F.coalesce(F.array_join(F.transform(there, text), ""), F.lit(""))

    content = F.when(F.col("path").isNull(), "").otherwise(F.concat(*[stands(k) for k in (4, 3, 2, 1, 0)]))
    return v.select("path", "seq", "commit_key", content.alias("content"))


def moved_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots (commit_key, path, content) before and after commits of 40 documents: most
    files are moved, every fifth stays where it is, and of these every seventh is written anew."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 40).cast("long").alias("commit_key"), "doc_id", "text")
    kept = F.array_join(F.filter(lines(F.col("text")), lambda x, i: i % 3 != 1), "\n")
    path = lambda folder: F.concat(F.when(F.col("doc_id") % 5 == 0, "doc/").otherwise(folder), F.col("doc_id").cast("string"))
    old = F.when(F.col("doc_id") % 35 == 0, F.concat(F.lit("written anew "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(kept)
    return d.select("commit_key", path("old/").alias("path"), old.alias("content")), d.select("commit_key", path("new/").alias("path"), F.col("text").alias("content"))

"""The corpus pipeline: documents in, packed training sequences out.

Toxic documents go, one document of each near-duplicate group stays, documents that
hold benchmark passages go, secrets are blanked out, and what is left is packed.
Every stage works on all that its predecessor kept and returns the columns of
documents, the last one the pieces of the packing. Null texts are empty and clean;
they pass every filter. Rows that repeat doc_id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelight.llm import decontaminate, neardup, packing, runtime, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, and those without any word that the model
    weighs: their score is the labels' rate and no sign of toxicity. The model learns from
    at most toxicity.SAMPLE labelled rows that are not held out, whatever documents came in."""
    everything = runtime.table(spark, sf_dir, "documents")
    model = toxicity.learn(everything, runtime.table(spark, sf_dir, "labels"), toxicity.trained_on)
    score, known = runtime.free(docs, "_toxicity"), runtime.free(docs, "_known")
    found = toxicity.scored(runtime.spread(docs), model, score, known)
    return found.where((F.col(score) < toxicity.THRESHOLD) | (F.col(known) == 0)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group: five words a shingle, similarity 0.8 or more. Rows
    without doc_id or without words belong to no group and stay; a row is told from
    others of its doc_id by its text."""
    return neardup.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.clean(runtime.spread(docs), runtime.table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return secrets.redact(runtime.spread(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", blank_secrets),
    ("packing", pack_sequences),
]

#: Training a model and packing by tokenizer are beyond SQL; tests/llm hold each stage's operator
#: against a plain version, and the stages together against cases by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        now = runtime.stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        runtime.discard(docs)
        docs = now
    return STAGES[-1][1](spark, docs, sf_dir)

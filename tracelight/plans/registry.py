"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .package import ship

QUERIES: dict = {}
ORACLES: dict = {}


def op(name: str, oracle: str | None = None):
    def add(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add

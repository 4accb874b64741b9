"""Similarity of lines: longest common subsequence over the longer byte length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def lcs(a: str, b: str) -> int:
    """Bit-parallel: a row of the usual table is one integer."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b or 2 * min(len(a), len(b)) < max(len(a), len(b)):
        return 0.0
    return lcs(a, b) / max(len(a.encode()), len(b.encode()))


def at_most(a: str, b: str) -> float:
    """What similarity can be at most, from the lengths."""
    m, n = len(a), len(b)
    return 0.0 if 2 * min(m, n) < max(m, n) else min(m, n) / max(len(a.encode()), len(b.encode()))


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b)])


def similarity_column(a: Column, b: Column) -> Column:
    return F.pandas_udf(_similarities, "double")(a, b)

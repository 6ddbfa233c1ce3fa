"""Similarity ratios by longest common subsequence: 2 LCS / (m + n), for texts and for sets of texts."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits a character."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for c in b:
        met = row & where.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def set_ratio(a: list[str], b: list[str]) -> float:
    """The best pairing of two small sets: twice the common length over all lengths."""
    short, long = sorted((a, b), key=len)
    total = sum(map(len, a)) + sum(map(len, b))
    best = max((sum(common(x, y) for x, y in zip(short, some, strict=True)) for some in itertools.permutations(long, len(short))), default=0)
    return 2 * best / total if total else 1.0


def type_similarity(a: list[str], b: list[str]) -> float:
    """Likeness of two types' main forms, to two decimals."""
    options = []
    if len(a) == len(b):
        options.append(set_ratio(a, b))
    if len(a) > 1 and len(b) > 1:
        options.append(ratio(" ".join(a), " ".join(b)))
    return round(max(options, default=0.0), 2)


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def type_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([type_similarity(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def within(a: Column, b: Column, most: int) -> Column:
    """Classic edit distance of at most ``most`` and not zero (JVM-side, banded)."""
    d = F.levenshtein(a, b, most)
    return (d > 0) & (d <= most)

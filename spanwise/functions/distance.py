"""Distances between texts: character and token edit distance, longest common substring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def char_distance(a: Column, b: Column) -> Column:
    """Edit distance of characters over the longer length: 0 for equal texts, 1 where one is empty."""
    return F.when(a == b, F.lit(0.0)).when((a == "") | (b == ""), F.lit(1.0)).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def token_edits(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays, row by row in the JVM.

    Within a row the deletions are resolved by a running minimum of cost minus position, so no
    cell waits for its left neighbour.
    """
    places = F.sequence(F.lit(0), F.size(b))

    def row(prev: Column, token: Column) -> Column:
        up = F.transform(places, lambda j: F.when(j == 0, F.get(prev, F.lit(0)) + 1).otherwise(F.least(F.get(prev, j) + 1, F.get(prev, j - 1) + F.when(F.get(b, j - 1) == token, 0).otherwise(1))))
        less = F.transform(up, lambda x, j: x - j)
        return F.transform(less, lambda x, j: j + F.array_min(F.slice(less, F.lit(1), j + 1)))

    last = F.aggregate(a, places, row)
    return F.when(F.size(b) == 0, F.size(a)).otherwise(F.element_at(last, -1))


def _token_edits(a: list[str], b: list[str]) -> int:
    codes: dict[str, int] = {}
    x = [codes.setdefault(t, len(codes)) for t in a]
    y = np.array([codes.setdefault(t, len(codes)) for t in b], np.int64)
    at = np.arange(len(y) + 1)
    prev = at.copy()
    for k, t in enumerate(x):
        up = np.empty_like(prev)
        up[0] = k + 1
        np.minimum(prev[1:] + 1, prev[:-1] + (y != t), out=up[1:])
        prev = at + np.minimum.accumulate(up - at)
    return int(prev[-1])


@F.pandas_udf(DoubleType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of token arrays over the longer length: 0 for equal ones, 1 where one is empty. Arrow batches; for long texts."""
    return pd.Series([0.0 if list(x) == list(y) else 1.0 if not len(x) or not len(y) else _token_edits(list(x), list(y)) / max(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common substring, by rows over the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    prev = np.zeros(len(y) + 1, np.int32)
    best = 0
    for c in a:
        cur = np.zeros_like(prev)
        np.multiply(prev[:-1] + 1, y == ord(c), out=cur[1:])
        best = max(best, int(cur.max()))
        prev = cur
    return best


@F.pandas_udf(IntegerType())
def common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring of two texts. Arrow batches; nothing built in computes it."""
    return pd.Series([lcs_length(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")

"""String distances on columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levenshtein(a: Column | str, b: Column | str) -> Column:
    """Edit distance in code points."""
    return F.levenshtein(a, b)


def within(a: Column, b: Column, most: int) -> Column:
    """Whether the edit distance is at most ``most``."""
    if most < 0:
        return F.lit(False)
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b, most) >= 0)


def closest(candidates: DataFrame, target: str, column: str, most: int = 2, limit: int = 5) -> DataFrame:
    """(column, distance) of the nearest candidates, by distance and then by name."""
    word = F.col(column)
    near = candidates.where(within(word, F.lit(target), most)).select(word, F.levenshtein(word, F.lit(target)).alias("distance"))
    return near.orderBy("distance", column).limit(limit)


def aligned_distance(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, none touched twice."""
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        older, old = old, row
    return old[-1]


def damerau(a: Column | str, b: Column | str) -> Column:
    """Optimal string alignment distance; null if either is. Spark has no such function, so Arrow batches go to Python."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else aligned_distance(s, t) for s, t in zip(x, y)], dtype="Int32")

    return run(a, b)


def damerau_within(pairs: DataFrame, a: str, b: str, most: int, out: str = "distance") -> DataFrame:
    """The pairs at an alignment distance of at most ``most``; a swap is two edits, so that native distance rules most pairs out first."""
    near = pairs.where(F.levenshtein(a, b, 2 * most) >= 0)
    return near.withColumn(out, damerau(a, b)).where(F.col(out) <= most)

"""Joins in which null keys are equal to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left's rows with right's other columns, by keys that may be null."""
    named = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(named, same, how).drop(*[f"_of_{k}" for k in keys])

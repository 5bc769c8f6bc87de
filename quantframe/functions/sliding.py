"""Sliding aggregates in linear time, whatever the window's length.

Rows of a key are cut into blocks of the window's length. A window is the end of one block and the start of the next, so its
aggregate combines one running forward and one running backward, and no row is looked at again for each window it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions.windows import ordered

HOW = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def numbered(df: DataFrame, keys: list[str], by: list) -> DataFrame:
    """df with _at: the row's number within its key."""
    return df.withColumn("_at", F.row_number().over(ordered(keys, *by)))


def sliding(df: DataFrame, keys: list[str], column: str, n: int, how: str, out: str) -> DataFrame:
    """df (``numbered``) with out: sum, max or min of the last n rows; null where there are fewer, or any of them is null."""
    over, combine = HOW[how]
    block = F.floor((F.col("_at") - 1) / n)
    forward = Window.partitionBy(*keys, block).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*keys, block).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    ran = df.withColumn("_tail", over(column).over(backward)).withColumn("_tail_n", F.count(column).over(backward)).withColumn("_head", over(column).over(forward)).withColumn("_head_n", F.count(column).over(forward))
    w = ordered(keys, "_at")
    tail, tail_n = F.lag("_tail", n - 1).over(w), F.lag("_tail_n", n - 1).over(w)
    whole = (F.col("_at") % n == 0) if n > 1 else F.lit(True)  # the window is a block
    known = F.when(whole, F.col("_head_n")).otherwise(tail_n + F.col("_head_n")) >= n
    return ran.withColumn(out, F.when(known, F.when(whole, F.col("_head")).otherwise(combine(tail, F.col("_head"))))).drop("_tail", "_tail_n", "_head", "_head_n")


def rolling_drawdown(df: DataFrame, keys: list[str], by: list, n: int = 252, ret: str = "ret") -> DataFrame:
    """df with rolling_equity (compounded return of the last n rows, and one), rolling_peak (the largest of the last n of those) and rolling_max_drawdown (the deepest of the last n falls from that peak).

    Each needs its n rows, so the last starts 3 (n - 1) rows in. A null return, or one of -1 or less, leaves the windows it is in null."""
    rows = numbered(df, keys, by).withColumn("_log", F.when(F.col(ret) > -1, F.ln(1 + F.col(ret))))
    rows = sliding(rows, keys, "_log", n, "sum", "_sum").withColumn("rolling_equity", F.exp("_sum"))
    rows = sliding(rows, keys, "rolling_equity", n, "max", "rolling_peak").withColumn("_fall", F.col("rolling_equity") / F.col("rolling_peak") - 1)
    return sliding(rows, keys, "_fall", n, "min", "rolling_max_drawdown").drop("_at", "_log", "_sum", "_fall")

"""Two-level scans: ordered work on series of any length, without one task per series.

A series is cut into blocks along its order, each of a bounded number of rows, by one range exchange over key and order. Work
that runs along a series then has two levels: within a block an ordinary ordered window, and across blocks one row per
block that carries what the next blocks need. A series that holds most of the table is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions.joins import beside
from quantframe.sources.shared import materialise

BLOCK = "_block"


def in_blocks(df: DataFrame, keys: list[str], by: list[str], block_rows: int = 200_000) -> DataFrame:
    """df with _block, written once: numbers of stretches of about ``block_rows`` rows along keys and by. Rows equal in keys and by are in one block."""
    parts = max(1, -(-df.count() // block_rows))
    cut = df.repartitionByRange(parts, *[F.col(k).asc_nulls_first() for k in [*keys, *by]]) if parts > 1 else df.coalesce(1)
    return materialise(cut.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def inside(keys: list[str], *by) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(*by)


def carried(blocked: DataFrame, keys: list[str], aggregates: list[Column], before: list[Column]) -> DataFrame:
    """keys, _block and what comes before each block: aggregates make one row per key and block, ``before`` are window expressions over them
    (in terms of ``earlier(keys)``). A row per block meets in a key's window, not a row per row."""
    table = blocked.groupBy(*keys, BLOCK).agg(*aggregates)
    return table.select(*keys, BLOCK, *before)


def earlier(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def joined(blocked: DataFrame, carries: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its block's carries; the join is by key and block, so a long series is many small groups."""
    return beside(blocked, carries, [*keys, BLOCK])


def forward_fill(df: DataFrame, keys: list[str], by: list[str], columns: list[str], block_rows: int = 200_000) -> DataFrame:
    """df with each column's last value at or before the row."""
    blocked = in_blocks(df, keys, by, block_rows)
    order = F.struct(*by)
    # of a block the last value; of rows equal in order any may be last, as in one window
    last = [F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), order)).alias(f"_last_{c}") for c in columns]
    carries = carried(blocked, keys, last, [F.last(f"_last_{c}", ignorenulls=True).over(earlier(keys)).getField(c).alias(f"_before_{c}") for c in columns])
    w = inside(keys, *by).rowsBetween(Window.unboundedPreceding, 0)
    filled = joined(blocked, carries, keys).withColumns({f"_now_{c}": F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_before_{c}")) for c in columns})
    return filled.select(*[F.col(f"_now_{c}").alias(c) if c in columns else c for c in df.columns])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], prefix: str = "", block_rows: int = 200_000) -> DataFrame:
    """Each left row with the right row's columns at the latest time at or before its own, null before the first; right times are unique within a key."""
    marks = right.select(*keys, ts, F.struct(*columns).alias("_right"), F.lit(False).alias("_left"))
    both = left.withColumn("_left", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    filled = forward_fill(both, keys, [ts, "_left"], ["_right"], block_rows).filter("_left")  # false sorts first: a right row comes before left ones of its time
    return filled.select(*left.columns, *[F.col("_right").getField(c).alias(f"{prefix}{c}") for c in columns])


def drawdown(df: DataFrame, keys: list[str], by: list[str], ret: str = "ret", block_rows: int = 200_000) -> DataFrame:
    """df with equity (product of 1 + ret so far), peak and drawdown (equity / peak - 1, from the first row's equity on); returns are over -1, a null is none."""
    blocked = in_blocks(df.withColumn("_log", F.coalesce(F.ln(1 + F.col(ret)), F.lit(0.0))), keys, by, block_rows)
    w = inside(keys, *by).rowsBetween(Window.unboundedPreceding, 0)
    within = blocked.withColumn("_sum", F.sum("_log").over(w))
    totals = within.groupBy(*keys, BLOCK).agg(F.sum("_log").alias("_all"), F.max("_sum").alias("_top"))
    sums = totals.withColumn("_before", F.coalesce(F.sum("_all").over(earlier(keys)), F.lit(0.0)))
    peaks = sums.withColumn("_peak_before", F.max(F.col("_before") + F.col("_top")).over(earlier(keys))).select(*keys, BLOCK, "_before", "_peak_before")
    found = joined(within, peaks, keys).withColumn("_log_equity", F.col("_before") + F.col("_sum"))
    found = found.withColumn("_log_peak", F.greatest(F.max("_log_equity").over(w), F.col("_peak_before")))
    return found.select(*df.columns, F.exp("_log_equity").alias("equity"), F.exp("_log_peak").alias("peak"), (F.exp(F.col("_log_equity") - F.col("_log_peak")) - 1).alias("drawdown"))


def vwap(df: DataFrame, keys: list[str], by: list[str], price: str = "price", volume: str = "volume", block_rows: int = 200_000) -> DataFrame:
    """df with the running volume-weighted price of each series."""
    blocked = in_blocks(df, keys, by, block_rows)
    money, traded = F.col(price) * F.col(volume), F.col(volume)
    carries = carried(blocked, keys, [F.sum(money).alias("_m"), F.sum(traded).alias("_v")], [F.coalesce(F.sum(c).over(earlier(keys)), F.lit(0.0)).alias(f"_before{c}") for c in ("_m", "_v")])
    w = inside(keys, *by).rowsBetween(Window.unboundedPreceding, 0)
    found = joined(blocked, carries, keys)
    m, v = (F.col(f"_before{c}") + F.coalesce(F.sum(x).over(w), F.lit(0.0)) for c, x in (("_m", money), ("_v", traded)))
    return found.withColumn("_all", v).withColumn("vwap", F.when(F.col("_all") != 0, m / F.col("_all"))).select(*df.columns, "vwap")

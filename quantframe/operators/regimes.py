"""Market regimes per key: labels, statistics, transitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions.windows import ordered
from quantframe.operators.clean import quantiles

YEAR = 252


def volatility_regimes(df: DataFrame, keys: list[str], vol: str, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """regime 0 up to the low quantile (and without a value), 1 up to the high one, else 2."""
    regime = F.when(F.col(vol) > F.col("q")[1], 2).when(F.col(vol) > F.col("q")[0], 1).otherwise(0)
    return df.withColumn("q", quantiles(vol, low, high).over(Window.partitionBy(*keys))).withColumn("regime", regime).drop("q")


def trend_regimes(df: DataFrame, price: str, mean: str, band: float = 0.02) -> DataFrame:
    gap = F.col(price) / F.col(mean) - 1
    return df.withColumn("trend", F.when(gap > band, 1).when(gap < -band, -1).otherwise(0))


def regime_statistics(df: DataFrame, keys: list[str], by: list, ret: str = "ret") -> DataFrame:
    """Per key and regime: share of rows, annual return, volatility, Sharpe, and the mean length of its runs."""
    w = ordered(keys, *by)
    marked = df.withColumn("starts", ((F.row_number().over(w) == 1) | ~F.col("regime").eqNullSafe(F.lag("regime").over(w))).cast("long"))
    stats = marked.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("n"), (F.avg(ret) * YEAR).alias("annual_return"), (F.stddev_samp(ret) * math.sqrt(YEAR)).alias("volatility"), (F.count(F.lit(1)) / F.sum("starts")).alias("mean_run"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    sharpe = F.when(F.col("volatility") != 0, F.col("annual_return") / F.col("volatility"))
    return stats.select(*keys, "regime", "n", "annual_return", "volatility", share.alias("frequency"), sharpe.alias("sharpe"), "mean_run")


def transitions(df: DataFrame, keys: list[str], by: list) -> DataFrame:
    """Share of each next regime after each regime, over all keys."""
    pairs = df.withColumn("next", F.lead("regime").over(ordered(keys, *by))).filter("next IS NOT NULL")
    counts = pairs.groupBy("regime", "next").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("regime")))


def regime_counts(df: DataFrame, keys: list[str], regime: str = "regime") -> DataFrame:
    """Rows of each regime and their share of the key's rows."""
    table = df.groupBy(*keys, regime).agg(F.count(F.lit(1)).alias("n"))
    return table.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def accuracy_by_regime(df: DataFrame, keys: list[str], actual: str, predicted: str, regime: str = "regime") -> DataFrame:
    """Errors of predictions within each regime: root mean square, mean absolute, share with the right sign, correlation."""
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys, regime).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg((F.signum(actual) == F.signum(predicted)).cast("double")).alias("right_sign"), F.corr(actual, predicted).alias("corr"))


def rules_by_regime(df: DataFrame, keys: list[str], by: list, regime: str = "regime", ret: str = "ret", least: int = 50) -> DataFrame:
    """A rule for each regime with over ``least`` rows, fitted as the side of its mean return, and what it earns: keys, regime, side, n, mean, total of side times return."""
    fitted = df.groupBy(*keys, regime).agg(F.count(ret).alias("n"), F.signum(F.avg(ret)).alias("side")).filter(F.col("n") > least)
    held = df.join(fitted, [*keys, regime]).withColumn("gain", F.col("side") * F.col(ret))
    return held.groupBy(*keys, regime, "side", "n").agg(F.avg("gain").alias("mean"), F.sum("gain").alias("total"), F.stddev_samp("gain").alias("sd"))

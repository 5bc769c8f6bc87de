"""Indicators as expressions over ordered windows, per key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions.windows import compounded, full, ordered, returns, rolling

YEAR = 252


def sma(price: str, keys: list[str], by: list, n: int) -> Column:
    w = rolling(keys, by, n)
    return full(F.avg(price).over(w), w, n, F.col(price))


def rsi(df: DataFrame, keys: list[str], by: list, price: str = "close", n: int = 14) -> DataFrame:
    """Simple-mean RSI; without any loss it is 100."""
    step = df.withColumn("step", F.col(price) - F.lag(price).over(ordered(keys, *by)))
    w = rolling(keys, by, n)
    gain, loss = F.avg(F.greatest("step", F.lit(0.0))).over(w), F.avg(F.greatest(-F.col("step"), F.lit(0.0))).over(w)
    value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.when(loss != 0, loss)))
    return step.withColumn("rsi", full(value, w, n, F.col("step"))).drop("step")


def bollinger(df: DataFrame, keys: list[str], by: list, price: str = "close", n: int = 20, k: float = 2.0) -> DataFrame:
    w = rolling(keys, by, n)
    middle, width = full(F.avg(price).over(w), w, n, F.col(price)), k * full(F.stddev_pop(price).over(w), w, n, F.col(price))
    out = df.withColumn("bb_middle", middle).withColumn("bb_upper", middle + width).withColumn("bb_lower", middle - width)
    band = F.col("bb_upper") - F.col("bb_lower")
    return out.withColumn("bb_position", F.when(band != 0, (F.col(price) - F.col("bb_lower")) / band))


def realised_volatility(df: DataFrame, keys: list[str], by: list, ret: str = "ret", n: int = 20) -> Column:
    w = rolling(keys, by, n)
    return full(F.stddev_samp(ret).over(w) * math.sqrt(YEAR), w, n, F.col(ret))


def parkinson(keys: list[str], by: list, n: int = 20, high: str = "high", low: str = "low") -> Column:
    w = rolling(keys, by, n)
    square = F.ln(F.col(high) / F.col(low)) ** 2
    return full(F.sqrt(F.avg(square).over(w) * (YEAR / (4 * math.log(2)))), w, n, square)


def features(df: DataFrame, keys: list[str], by: list) -> DataFrame:
    """Returns, volatilities, trend and momentum of bars with close, high, low and volume; all over one partitioning."""
    w = ordered(keys, *by)
    out = df.withColumn("ret", returns("close", w)).withColumn("log_ret", returns("close", w, log=True))
    out = out.withColumn("vol_10", realised_volatility(out, keys, by, n=10)).withColumn("vol_20", realised_volatility(out, keys, by, n=20)).withColumn("parkinson", parkinson(keys, by))
    out = out.withColumn("sma_20", sma("close", keys, by, 20)).withColumn("sma_50", sma("close", keys, by, 50))
    out = out.withColumn("sma_distance", F.col("close") / F.col("sma_20") - 1).withColumn("crossover", F.signum(F.col("sma_20") - F.col("sma_50")))
    out = out.withColumn("momentum_10", returns("close", w, 10)).withColumn("momentum_20", returns("close", w, 20))
    volume = sma("volume", keys, by, 20)
    return out.withColumn("volume_ratio", F.col("volume") / F.when(volume != 0, volume))


def volatility_rank(df: DataFrame, keys: list[str], by: list, column: str, n: int = 252) -> DataFrame:
    """Percentile rank of the value in its last n (ties share their mean rank), for full windows."""
    held = df.withColumn("held", F.collect_list(column).over(rolling(keys, by, n)))
    less, equal = (F.size(F.filter("held", t)) for t in (lambda x: x < F.col(column), lambda x: x == F.col(column)))
    return held.withColumn("rank", F.when((F.size("held") == n) & F.col(column).isNotNull(), (less + (equal + 1) / 2) / n)).drop("held")


def drawdown(df: DataFrame, keys: list[str], by: list, ret: str = "ret") -> DataFrame:
    """equity after each return, its running peak, and the drawdown from it."""
    w = ordered(keys, *by)
    out = df.withColumn("equity", compounded(ret, w))
    out = out.withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def forward_returns(df: DataFrame, keys: list[str], by: list, price: str = "close", periods: tuple[int, ...] = (1, 5, 20), band: float = 0.02) -> DataFrame:
    """fwd_n for each n, and target -1 / 0 / 1 of the first by the band."""
    w = ordered(keys, *by)
    out = df
    for n in periods:
        out = out.withColumn(f"fwd_{n}", F.lead(price, n).over(w) / F.col(price) - 1)
    first = F.col(f"fwd_{periods[0]}")
    return out.withColumn("target", F.when(first > band, 1).when(first < -band, -1).when(first.isNotNull(), 0))


def crossover_backtest(df: DataFrame, keys: list[str], by: list, price: str = "close", fast: int = 10, slow: int = 30) -> DataFrame:
    """Per key: total, volatility and Sharpe of holding when the fast mean is above the slow one, a row later."""
    w = ordered(keys, *by)
    signal = F.when(sma(price, keys, by, fast) > sma(price, keys, by, slow), 1).otherwise(0)
    rows = df.withColumn("log_ret", returns(price, w, log=True)).withColumn("signal", signal)
    rows = rows.withColumn("gain", F.col("log_ret") * F.lag("signal").over(w)).filter("gain IS NOT NULL")
    deviation = F.stddev_samp("gain")
    return rows.groupBy(*keys).agg(F.sum("gain").alias("total"), (deviation * math.sqrt(YEAR)).alias("volatility"), F.when(deviation != 0, F.avg("gain") / deviation * math.sqrt(YEAR)).alias("sharpe"), F.count(F.lit(1)).alias("n"))

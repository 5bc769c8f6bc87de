"""Structured Streaming: live bars, look-back metrics, sessions, running drawdown and alerts with a cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantframe.operators.bars import ohlcv


def live_bars(ticks: DataFrame, keys: list[str], size: str, late: str, ts: str = "ts", tie: str = "id") -> DataFrame:
    """OHLCV of closed windows; ticks later than ``late`` are dropped. ts is a TIMESTAMP (watermarks need one)."""
    bars = ticks.withWatermark(ts, late).groupBy(*keys, F.window(ts, size).alias("w")).agg(*ohlcv("price", "volume", F.struct(ts, tie)), F.count(F.lit(1)).alias("n"))
    return bars.select(*keys, F.col("w.start").alias("bar"), "open", "high", "low", "close", "volume", "n")


def look_back(ticks: DataFrame, keys: list[str], size: str, step: str, late: str, ts: str = "ts") -> DataFrame:
    """Mean, sample deviation and range of the price over sliding windows."""
    table = ticks.withWatermark(ts, late).groupBy(*keys, F.window(ts, size, step).alias("w")).agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd"), (F.max("price") - F.min("price")).alias("range"), F.count(F.lit(1)).alias("n"))
    return table.select(*keys, F.col("w.end").alias("at"), "mean", "sd", "range", "n")


def activity_sessions(ticks: DataFrame, keys: list[str], gap: str, late: str, ts: str = "ts") -> DataFrame:
    table = ticks.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
    return table.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")


ALERTS = "symbol long, ts timestamp, id long, value double, peak double, drawdown double, alert boolean"
STATE = "peak double, alerted double"


def drawdown_alerts(values: DataFrame, threshold: float, cooldown: float) -> DataFrame:
    """Per symbol: running peak and drawdown of ``value``; alert when it is deeper than the threshold, at most once per cooldown (seconds).

    values: symbol, ts (TIMESTAMP), id, value. A group's rows of a micro-batch are taken in order of time; state is two numbers.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, alerted = state.get if state.exists else (float("-inf"), float("-inf"))
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for ts, i, value in zip(rows["ts"], rows["id"], rows["value"]):
            peak = max(peak, value)
            drawdown = value / peak - 1 if peak > 0 else 0.0
            fires = drawdown < -threshold and ts.timestamp() - alerted >= cooldown
            alerted = ts.timestamp() if fires else alerted
            out.append((key[0], ts, i, value, peak, drawdown, fires))
        state.update((peak, alerted))
        yield pd.DataFrame(out, columns=["symbol", "ts", "id", "value", "peak", "drawdown", "alert"])

    return values.groupBy("symbol").applyInPandasWithState(step, ALERTS, STATE, "append", GroupStateTimeout.NoTimeout)


def active_alerts(alerts: DataFrame) -> DataFrame:
    """The latest alert of each symbol, and how many it has had."""
    return alerts.filter("alert").groupBy("symbol").agg(F.max_by("value", F.struct("ts", "id")).alias("value"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))


def tick_sizes(ticks: DataFrame, capital: float, share: float, band: float) -> DataFrame:
    """Stateless sizing and decision of each tick by its distance from a reference price."""
    gap = F.col("price") / F.col("reference") - 1
    return ticks.withColumn("size", F.floor(F.lit(capital * share) / F.col("price"))).withColumn("decision", F.when(gap > band, "sell").when(gap < -band, "buy").otherwise("hold"))

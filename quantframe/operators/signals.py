"""Signals, strategy returns, rebalance days and simulations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantframe.functions.windows import compounded, full, ordered, returns, rolling
from quantframe.operators.clean import per_key


def premium_signals(df: DataFrame, keys: list[str], by: list, price: str = "close") -> DataFrame:
    """condor: -1 where 20-row volatility is over the key's 70 % quantile; strangle: over 60 %; calendar: 1 where 60-row volatility is over 10-row by 0.05."""
    moved = df.withColumn("ret", returns(price, ordered(keys, *by)))
    for n in (10, 20, 60):
        w = rolling(keys, by, n)
        moved = moved.withColumn(f"vol_{n}", full(F.stddev_samp("ret").over(w) * math.sqrt(252), w, n, F.col("ret")))
    cut = per_key(moved, keys, q=F.percentile("vol_20", F.array(F.lit(0.7), F.lit(0.6))))
    low = lambda k: F.when(F.col("vol_20") > F.col("q")[k], -1).otherwise(0)
    return cut.withColumn("condor", low(0)).withColumn("strangle", low(1)).withColumn("calendar", F.when(F.col("vol_60") - F.col("vol_10") > 0.05, 1).otherwise(0)).drop("q")


def strategy_returns(df: DataFrame, keys: list[str], by: list, signal: str, ret: str = "ret") -> Column:
    """A row's return times the signal of the row before."""
    return F.col(ret) * F.lag(signal).over(ordered(keys, *by))


def position_state(df: DataFrame, keys: list[str], by: list, entry: Column, leave: Column) -> DataFrame:
    """held: 1 from an entry to the next exit; trade: number of the entry that a held row belongs to."""
    w = ordered(keys, *by)
    flagged = df.withColumn("flag", F.when(entry, 1).when(leave, 0))
    held = flagged.withColumn("held", F.coalesce(F.last("flag", ignorenulls=True).over(w), F.lit(0)))
    opened = ((F.col("held") == 1) & (F.coalesce(F.lag("held").over(w), F.lit(0)) == 0)).cast("int")
    return held.withColumn("opened", opened).withColumn("trade", F.when(F.col("held") == 1, F.sum("opened").over(w))).drop("flag", "opened")


def rebalance_days(df: DataFrame, keys: list[str], day: str, frequency: str) -> DataFrame:
    """daily: all rows; weekly: Mondays; monthly: firsts of a month; else every 30th row of the key."""
    if frequency == "daily":
        return df
    if frequency == "weekly":
        return df.filter(F.weekday(day) == 0)
    if frequency == "monthly":
        return df.filter(F.dayofmonth(day) == 1)
    return df.withColumn("row", F.row_number().over(ordered(keys, day)) - 1).filter("row % 30 = 0").drop("row")


def monte_carlo(spark: SparkSession, mean: float, deviation: float, simulations: int, periods: int, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """One row: mean, deviation, bounds, value at risk and loss chances of the total return of normal paths."""
    paths = spark.range(simulations * periods).select((F.col("id") % simulations).alias("sim"), (F.lit(mean) + F.lit(deviation) * F.randn(seed)).alias("r"))
    totals = paths.groupBy("sim").agg((F.exp(F.sum(F.ln(1 + F.greatest("r", F.lit(-0.999999))))) - 1).alias("total"))
    side = (1 - confidence) / 2
    q = F.percentile("total", F.array(F.lit(side), F.lit(1 - side), F.lit(1 - confidence)))
    return totals.agg(F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"), q.alias("q"), F.avg((F.col("total") < 0).cast("double")).alias("loss"), F.avg((F.col("total") < -0.2).cast("double")).alias("large_loss")).select("mean", "sd", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.col("q")[2].alias("var"), "loss", "large_loss")


def scalp_signals(df: DataFrame, keys: list[str], by: list, price: str = "close", band: float = 0.005) -> DataFrame:
    """1 where the price moved by more than the band, else 0."""
    return df.withColumn("signal", F.coalesce((F.abs(returns(price, ordered(keys, *by))) > band).cast("int"), F.lit(0)))


def strategy_parameters(df: DataFrame, keys: list[str], by: list, ret: str = "ret", n: int = 20, bound: float = 0.25) -> DataFrame:
    """Annual volatility of each key, its mean rolling one, and the parameter set that this picks."""
    w = ordered(keys, *by).rowsBetween(1 - n, 0)
    rolled = df.withColumn("v", F.when(F.count(ret).over(w) >= n, F.stddev_samp(ret).over(w) * 252**0.5))
    table = rolled.groupBy(*keys).agg((F.stddev_samp(ret) * 252**0.5).alias("volatility"), F.avg("v").alias("mean_volatility"))
    return table.withColumn("parameters", F.when(F.col("mean_volatility") > bound, "wide").otherwise("narrow"))


def rank_strategies(results: DataFrame, strategy: str, score: str) -> DataFrame:
    """Per strategy over all its series: mean, median, deviation, share above zero, best, worst, and its place by mean."""
    s = F.col(score)
    table = results.groupBy(strategy).agg(F.avg(s).alias("mean"), F.percentile(s, F.lit(0.5)).alias("median"), F.stddev_samp(s).alias("sd"), F.avg((s > 0).cast("double")).alias("success"), F.max(s).alias("best"), F.min(s).alias("worst"), F.count(s).alias("n"))
    # strategies are few: their places are numbered in one task
    return table.withColumn("place", F.rank().over(Window.orderBy(F.desc("mean"))))


def class_matrix(results: DataFrame, dimension: DataFrame, key: str, group: str, strategy: str, score: str, strategies: list[str]) -> DataFrame:
    """Mean score by class of series, a column per strategy."""
    return results.join(dimension.select(key, group), key).groupBy(group).pivot(strategy, strategies).agg(F.avg(score))


def compare_runs(metrics: DataFrame, run: str, names: list[str], best: str) -> DataFrame:
    """A row per run with a column per metric, and whether it is the best run by ``best``. metrics: run, metric, value."""
    wide = metrics.groupBy(run).pivot("metric", names).agg(F.max("value"))
    top = wide.agg(F.max_by(run, F.struct(F.col(best), F.col(run))).alias("top"))
    return wide.join(F.broadcast(top), wide[run] == F.col("top"), "left").withColumn("is_best", F.col("top").isNotNull()).drop("top")


def long_flat(df: DataFrame, keys: list[str], by: list, price: str, entry: Column, leave: Column, capital: float = 100.0, fee: float = 0.001) -> DataFrame:
    """df with held, trade (``position_state``), fees (of the row) and equity: all capital is bought in at an entry and sold at an exit, at the row's price, less ``fee`` of the amount each time."""
    w = ordered(keys, *by)
    state = position_state(df, keys, by, entry, leave)
    was = F.coalesce(F.lag("held").over(w), F.lit(0))
    before = F.lag(price).over(w)
    grown = state.withColumn("_grown", F.when((was == 1) & (before != 0), F.col(price) / before).otherwise(1.0)).withColumn("_turns", F.col("held") != was)
    run = grown.withColumn("_r", F.col("_grown") * F.when(F.col("_turns"), 1 - fee).otherwise(1.0) - 1)
    out = run.withColumn("equity", compounded("_r", w) * capital)
    return out.withColumn("fees", F.when(F.col("_turns"), F.col("equity") / (1 - fee) * fee).otherwise(0.0)).drop("_grown", "_turns", "_r")


def long_flat_statistics(table: DataFrame, keys: list[str], by: str, capital: float = 100.0) -> DataFrame:
    """Of a table of ``long_flat``, per key: final equity, total return, fees, trades, share of rows held, deepest fall of equity."""
    w = ordered(keys, by)
    fallen = table.withColumn("_fall", F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    told = fallen.groupBy(*keys).agg(F.max_by("equity", by).alias("final"), F.sum("fees").alias("fees"), F.count_distinct("trade").alias("trades"), F.avg("held").alias("held_share"), F.min("_fall").alias("deepest"))
    return told.withColumn("total_return", F.col("final") / capital - 1)


def transformed(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """df after a user's named steps, one on the other: each a function from table to table, all one plan. An error in building a step names it."""
    for name, step in steps:
        try:
            df = step(df)
            if check:
                check(df)
        except Exception as e:
            e.add_note(f"in step {name}")
            raise
    return df

"""Performance of return series, per key, as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions.indicators import drawdown
from quantframe.functions.windows import ordered, rolling
from quantframe.operators.clean import per_key

YEAR = 252


def safe(x: Column, y: Column) -> Column:
    return F.when(y != 0, x / y)


def correlation(x: Column, y: Column) -> Column:
    """Of the rows with both; null where either doesn't vary (corr() fails there)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return safe(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def compounded_whole(ret: str) -> Column:
    """Aggregate product of 1 + ret, exact in sign where factors are zero or negative."""
    factor = 1 + F.col(ret)
    size = F.exp(F.coalesce(F.sum(F.when(factor != 0, F.ln(F.abs(factor)))), F.lit(0.0)))
    return F.when(F.max((factor == 0).cast("int")) == 1, 0.0).when(F.sum((factor < 0).cast("int")) % 2 == 1, -size).otherwise(size)


def basic(df: DataFrame, keys: list[str], ret: str = "ret", rate: float = 0.02) -> DataFrame:
    """Total and annual return, volatility, downside deviation, Sharpe and Sortino."""
    r, daily = F.col(ret), rate / YEAR
    table = df.groupBy(*keys).agg(
        F.count(ret).alias("n"), (compounded_whole(ret) - 1).alias("total"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"), F.stddev_samp(F.when(r < 0, r)).alias("below_zero"), F.stddev_samp(F.when(r < daily, r)).alias("below_rate"),
    )
    return table.select(
        *keys, "n", "total", (F.pow(1 + F.col("total"), YEAR / F.col("n")) - 1).alias("annual"), (F.col("sd") * math.sqrt(YEAR)).alias("volatility"), (F.col("below_zero") * math.sqrt(YEAR)).alias("downside"),
        (safe(F.col("mean") - daily, F.col("sd")) * math.sqrt(YEAR)).alias("sharpe"), (safe(F.col("mean") - daily, F.col("below_rate")) * math.sqrt(YEAR)).alias("sortino"),
    )


def drawdown_summary(df: DataFrame, keys: list[str], by: list, ret: str = "ret") -> DataFrame:
    """Deepest, mean (of rows below the peak), latest drawdown, and Burke's square root."""
    d = F.col("drawdown")
    return drawdown(df, keys, by, ret).groupBy(*keys).agg(F.min(d).alias("deepest"), F.avg(F.when(d < 0, d)).alias("mean"), F.max_by(d, F.struct(*by)).alias("current"), F.sqrt(F.sum(d * d)).alias("burke_root"))


def drawdown_periods(df: DataFrame, keys: list[str], by: str, ret: str = "ret") -> DataFrame:
    """A row per recovered stretch below the peak: its peak day (the row before), trough, recovery day, depth and rows."""
    w = ordered(keys, by)
    marked = drawdown(df, keys, [by], ret).withColumn("whole", (F.col("drawdown") >= 0).cast("int"))
    marked = marked.withColumn("before", F.lag(by).over(w)).withColumn("after", F.lead(by).over(w)).withColumn("period", F.sum("whole").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    below = marked.filter("whole = 0")
    return below.groupBy(*keys, "period").agg(F.min_by("before", by).alias("peak"), F.min_by(by, F.struct("drawdown", by)).alias("trough"), F.max_by("after", by).alias("recovery"), F.min("drawdown").alias("depth"), F.count(F.lit(1)).alias("n")).filter("recovery IS NOT NULL")


def distribution(df: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """Skew and excess kurtosis (population), value at risk and mean beyond it at 95 and 99 %, tail ratio."""
    q = F.percentile(ret, F.array(*[F.lit(x) for x in (0.05, 0.01, 0.95)]))
    held = per_key(df, keys, q=q)
    r = F.col(ret)
    return held.groupBy(*keys).agg(
        F.skewness(ret).alias("skew"), F.kurtosis(ret).alias("kurtosis"), F.first("q")[0].alias("var_95"), F.first("q")[1].alias("var_99"),
        F.avg(F.when(r <= F.col("q")[0], r)).alias("cvar_95"), F.avg(F.when(r <= F.col("q")[1], r)).alias("cvar_99"), F.abs(safe(F.first("q")[2], F.first("q")[0])).alias("tail_ratio"),
    )


def against_benchmark(df: DataFrame, bench: DataFrame, keys: list[str], by: str, ret: str = "ret", rate: float = 0.02) -> DataFrame:
    """beta (sample covariance by population variance), alpha, tracking error, information ratio, correlation, up and down capture."""
    both = df.join(bench.withColumnRenamed(ret, "b"), by)
    r, b, daily = F.col(ret), F.col("b"), rate / YEAR
    table = both.groupBy(*keys).agg(F.covar_samp(ret, "b").alias("cov"), F.var_pop("b").alias("var"), F.avg(ret).alias("mr"), F.avg("b").alias("mb"), F.stddev_samp(r - b).alias("te"), F.corr(ret, "b").alias("correlation"), safe(F.avg(F.when(b > 0, r)), F.avg(F.when(b > 0, b))).alias("up"), safe(F.avg(F.when(b < 0, r)), F.avg(F.when(b < 0, b))).alias("down"))
    beta = safe(F.col("cov"), F.col("var"))
    return table.select(*keys, beta.alias("beta"), ((F.col("mr") - daily - beta * (F.col("mb") - daily)) * YEAR).alias("alpha"), (F.col("te") * math.sqrt(YEAR)).alias("tracking_error"), (safe(F.col("mr") - F.col("mb"), F.col("te")) * math.sqrt(YEAR)).alias("information_ratio"), "correlation", F.col("up").alias("up_capture"), F.col("down").alias("down_capture"))


def trade_statistics(df: DataFrame, keys: list[str], pnl: str = "pnl") -> DataFrame:
    """Trades, win rate, mean win and loss, profit factor, expectancy, Kelly share."""
    p = F.col(pnl)
    table = df.groupBy(*keys).agg(F.count(pnl).alias("trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(F.when(p > 0, p)).alias("mean_win"), F.avg(F.when(p <= 0, p)).alias("mean_loss"), F.sum(F.when(p > 0, p)).alias("won"), F.sum(F.when(p <= 0, p)).alias("lost"), F.avg(pnl).alias("expectancy"))
    odds = F.abs(safe(F.col("mean_win"), F.col("mean_loss")))
    return table.withColumn("profit_factor", F.abs(safe(F.col("won"), F.col("lost")))).withColumn("kelly", F.col("win_rate") - safe(1 - F.col("win_rate"), odds)).drop("won", "lost")


def rolling_sharpe(df: DataFrame, keys: list[str], by: list, n: int = 52, ret: str = "ret") -> DataFrame:
    w = rolling(keys, by, n)
    sd = F.stddev_samp(ret).over(w)
    return df.withColumn("rolling_sharpe", F.when((F.count(ret).over(w) >= n) & (sd != 0), F.avg(ret).over(w) / sd * math.sqrt(YEAR)))


def monthly_pnl(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("month", ts).alias("month")).agg(F.sum("pnl").alias("pnl"), F.sum("commission").alias("commission"), F.count(F.lit(1)).alias("trades"))


def ratios(df: DataFrame, keys: list[str], by: list, ret: str = "ret", rate: float = 0.02) -> DataFrame:
    """Calmar (annual return by deepest drawdown), Sterling (by mean drawdown), Burke, gain-pain and Omega's sums."""
    r = F.col(ret)
    falls = drawdown_summary(df, keys, by, ret)
    sums = df.groupBy(*keys).agg(F.sum(r).alias("all"), F.sum(F.when(r < 0, -r)).alias("pain"))
    table = basic(df, keys, ret, rate).join(falls.withColumnRenamed("mean", "mean_fall"), keys).join(sums, keys).join(df.groupBy(*keys).agg(F.avg(r).alias("mean_ret")), keys)
    return table.select(*keys, safe(F.col("annual"), F.abs("deepest")).alias("calmar"), safe(F.col("annual"), F.abs("mean_fall")).alias("sterling"), safe((F.col("mean_ret") - rate / YEAR) * YEAR, F.col("burke_root")).alias("burke"), safe(F.col("all"), F.col("pain")).alias("gain_pain"))


def every_metric(df: DataFrame, keys: list[str], by: list, ret: str = "ret") -> DataFrame:
    """Basic, drawdown, ratio and distribution metrics of each key in one row."""
    tables = [basic(df, keys, ret), drawdown_summary(df, keys, by, ret).withColumnRenamed("mean", "mean_drawdown"), ratios(df, keys, by, ret), distribution(df, keys, ret)]
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, keys)
    return out


def winners(metrics: DataFrame, key: str, higher: list[str], lower: list[str] = ()) -> DataFrame:
    """metric, winner, value: the best key of each metric; of equal ones, the first by name."""
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), F.lit(sign).alias("sign")) for cs, sign in ((higher, 1.0), (lower, -1.0)) for c in cs])
    long = metrics.select(key, F.inline(rows)).filter("value IS NOT NULL")
    best = long.groupBy("metric").agg(F.max(F.col("value") * F.col("sign")).alias("top"))
    return long.join(best, "metric").filter(F.col("value") * F.col("sign") == F.col("top")).groupBy("metric").agg(F.min(key).alias("winner"), F.first("value").alias("value"))


def option_metrics(df: DataFrame, keys: list[str], day: str, n: int = 20, ret: str = "ret") -> DataFrame:
    """Share of days with a gain, mean rolling volatility less the whole one, and mean days from the first day below the peak to recovery."""
    days = df.groupBy(*keys, day).agg(F.sum(ret).alias("sum")).groupBy(*keys).agg(F.avg((F.col("sum") > 0).cast("double")).alias("positive_days"))
    w = rolling(keys, [day], n)
    rolled = df.withColumn("v", F.when(F.count(ret).over(w) >= n, F.stddev_samp(ret).over(w))).groupBy(*keys).agg(((F.avg("v") - F.stddev_samp(ret)) * math.sqrt(YEAR)).alias("volatility_premium"))
    spans = drawdown(df, keys, [day], ret).withColumn("whole", (F.col("drawdown") >= 0).cast("int")).withColumn("after", F.lead(day).over(ordered(keys, day)))
    spans = spans.withColumn("period", F.sum("whole").over(ordered(keys, day).rowsBetween(Window.unboundedPreceding, 0))).filter("whole = 0")
    spans = spans.groupBy(*keys, "period").agg(F.min(day).alias("first"), F.max_by("after", day).alias("back")).filter("back IS NOT NULL")
    recovery = spans.groupBy(*keys).agg(F.avg(F.datediff("back", "first")).alias("recovery_days"))
    return days.join(rolled, keys).join(recovery, keys, "left")


def equity_on_calendar(trades: DataFrame, keys: list[str], capital: float, ts: str = "ts", pnl: str = "pnl") -> DataFrame:
    """keys, day, equity: capital and all results up to each calendar day, from a key's first trade to its last."""
    daily = trades.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.sum(pnl).alias("sum"))
    span = daily.groupBy(*keys).agg(F.min("day").alias("low"), F.max("day").alias("high"))
    grid = span.select(*keys, F.explode(F.sequence("low", "high")).alias("day")).join(daily, [*keys, "day"], "left")
    return grid.select(*keys, "day", (F.sum(F.coalesce("sum", F.lit(0.0))).over(ordered(keys, "day").rowsBetween(Window.unboundedPreceding, 0)) + capital).alias("equity"))


def backtest_result(trades: DataFrame, keys: list[str], capital: float, ts: str = "ts", pnl: str = "pnl", rate: float = 0.02) -> DataFrame:
    """Per key: returns of the calendar-day equity, deepest and longest drawdown (days), and trade statistics."""
    w = ordered(keys, "day")
    before = F.lag("equity").over(w)
    curve = equity_on_calendar(trades, keys, capital, ts, pnl).withColumn("ret", safe(F.col("equity") - before, before))
    curve = curve.withColumn("fall", F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    curve = curve.withColumn("run", F.sum((F.col("fall") >= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    longest = curve.filter("fall < 0").groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest"))
    table = curve.groupBy(*keys).agg((F.max_by("equity", "day") / F.min_by("equity", "day") - 1).alias("total"), F.count("ret").alias("days"), F.stddev_samp("ret").alias("sd"), F.avg("ret").alias("m"), F.min("fall").alias("deepest"))
    table = table.join(longest, keys, "left").join(trade_statistics(trades, keys, pnl), keys)
    annual = F.when(F.col("total") >= -1, F.pow(1 + F.col("total"), YEAR / F.col("days"))) - 1  # none of a loss beyond the capital
    return table.select(*keys, "total", annual.alias("annual"), (F.col("sd") * math.sqrt(YEAR)).alias("volatility"), (safe(F.col("m") - rate / YEAR, F.col("sd")) * math.sqrt(YEAR)).alias("sharpe"), safe(annual, F.abs("deepest")).alias("calmar"), "deepest", F.coalesce("longest", F.lit(0)).alias("longest"), "trades", "win_rate", "profit_factor", "expectancy")

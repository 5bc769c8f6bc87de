"""Portfolio risk: returns, value at risk, correlation, exposure limits, sizing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.operators.clean import per_key
from quantframe.operators.performance import compounded_whole, drawdown_summary, safe

#: Standard normal quantiles at 95 and 99 %.
Z = {0.95: 1.6448536269514722, 0.99: 2.3263478740408408}


def portfolio_returns(panel: DataFrame, weights: DataFrame, ts: str = "day") -> DataFrame:
    """Weighted sum per day; weights are scaled to the strategies that are there. weights: strategy, weight (a row per strategy)."""
    total = weights.join(panel.select("strategy").distinct(), "strategy", "left_semi").agg(F.sum("weight").alias("all"))
    return panel.join(weights, "strategy").groupBy(ts).agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("sum")).crossJoin(F.broadcast(total)).select(ts, (F.col("sum") / F.col("all")).alias("ret"))


def value_at_risk(df: DataFrame, keys: list[str], by: str, level: float = 0.95, window: int = 252, ret: str = "ret") -> DataFrame:
    """Historical, parametric and Cornish-Fisher value at risk of the last ``window`` rows, and the shortfall beyond the first."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    last = df.withColumn("turn", latest).filter(F.col("turn") <= window)
    held = per_key(last, keys, q=F.percentile(ret, F.lit(1 - level)))
    stats = held.groupBy(*keys).agg(F.count(ret).alias("n"), F.first("q").alias("q"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s"), F.skewness(ret).alias("g"), F.kurtosis(ret).alias("k"), F.avg(F.when(F.col(ret) <= F.col("q"), F.col(ret))).alias("beyond"))
    n, z = F.col("n"), -Z[level]
    skew = F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6)
    bent = z + (z**2 - 1) * skew / 6 + (z**3 - 3 * z) * kurt / 24 - (2 * z**3 - 5 * z) * skew * skew / 36
    return stats.select(*keys, (-F.col("q")).alias("historical"), (-(F.col("m") + z * F.col("s"))).alias("parametric"), (-(F.col("m") + bent * F.col("s"))).alias("cornish_fisher"), (-F.col("q") * math.sqrt(5)).alias("weekly"), (-F.col("beyond")).alias("shortfall"))


def correlation_table(panel: DataFrame, series: str, ts: str, ret: str = "ret", least: int = 60) -> DataFrame:
    """a, b, corr, n for each pair of strategies with enough days in common (strategies are few)."""
    x, y = panel.select(F.col(series).alias("a"), ts, F.col(ret).alias("x")), panel.select(F.col(series).alias("b"), ts, F.col(ret).alias("y"))
    return x.join(y, ts).filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def position_breaches(positions: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """A row per portfolio and exceeded limit: exposure, concentration (largest position's share), positions."""
    total = positions.groupBy(*keys).agg(F.sum(F.abs("value")).alias("exposure"), (F.max(F.abs("value")) / F.sum(F.abs("value"))).alias("concentration"), F.count(F.lit(1)).cast("double").alias("positions"))
    tests = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), F.lit(float(v)).alias("most")) for k, v in limits.items()])
    return total.select(*keys, F.inline(F.filter(tests, lambda t: t["value"] > t["most"]))).withColumn("percent", F.col("value") / F.col("most") * 100)


def largest_positions(positions: DataFrame, keys: list[str], n: int = 3, cut: float = 0.2, tie: str = "position") -> DataFrame:
    """The n largest positions of each portfolio, and their values after the cut."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("value")), tie))
    return positions.withColumn("turn", turn).filter(F.col("turn") <= n).withColumn("reduced", F.col("value") * (1 - cut))


def kelly_sizes(stats: DataFrame, capital: float, fraction_cap: float = 0.25, risk_cap: float = 0.02) -> DataFrame:
    """Discrete Kelly share (clamped), and the position it gives under the risk cap by volatility; stats: win_rate, mean_win, mean_loss, volatility."""
    odds = F.abs(safe(F.col("mean_win"), F.col("mean_loss")))
    share = F.greatest(F.lit(0.0), F.least(F.lit(fraction_cap), safe(odds * F.col("win_rate") - (1 - F.col("win_rate")), odds)))
    return stats.withColumn("share", share).withColumn("position", F.least(F.col("share") * capital, safe(F.lit(risk_cap * capital), F.col("volatility"))))


def attribution(panel: DataFrame, weights: DataFrame, ret: str = "ret") -> DataFrame:
    """Per strategy: weight, total return, contribution, volatility, Sharpe."""
    table = panel.groupBy("strategy").agg((compounded_whole(ret) - 1).alias("total"), F.stddev_samp(ret).alias("sd"), F.avg(ret).alias("m"))
    return table.join(weights, "strategy").select("strategy", "weight", "total", (F.col("weight") * F.col("total")).alias("contribution"), (F.col("sd") * math.sqrt(252)).alias("volatility"), (safe(F.col("m"), F.col("sd")) * math.sqrt(252)).alias("sharpe"))


def rebalancing(allocations: DataFrame, threshold: float) -> DataFrame:
    """Strategies whose weight is off target by over the threshold, and the change to make."""
    return allocations.withColumn("change", F.col("target") - F.col("current")).filter(F.abs("change") > threshold)


def average_cost(trades: DataFrame, keys: list[str], by: list, quantity: str = "quantity", price: str = "price") -> DataFrame:
    """Running net quantity, and the mean price since the book was last flat."""
    w = Window.partitionBy(*keys).orderBy(*by)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    booked = trades.withColumn("net", F.sum(quantity).over(run))
    flat = F.coalesce(F.sum(F.when(F.col("net") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    since = Window.partitionBy(*keys, "book").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    booked = booked.withColumn("book", flat)
    amount = F.sum(F.col(quantity) * F.col(price)).over(since)
    return booked.withColumn("mean_price", F.when(F.col("net") != 0, amount / F.col("net")))


def fixed_fraction(df: DataFrame, capital: float, fraction: float, target_volatility: float, volatility: str = "volatility") -> DataFrame:
    """A fixed share of capital, scaled by target over own volatility within a half and two."""
    factor = F.greatest(F.lit(0.5), F.least(F.lit(2.0), safe(F.lit(target_volatility), F.col(volatility))))
    return df.withColumn("position", F.coalesce(factor, F.lit(1.0)) * (capital * fraction))


def validator_metrics(df: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """Hit ratio, profit factor, Kelly share within 0 and 1, and value at risk at 95 %."""
    r = F.col(ret)
    table = df.groupBy(*keys).agg(F.avg((r > 0).cast("double")).alias("hit_ratio"), F.sum(F.when(r > 0, r)).alias("won"), F.sum(F.when(r < 0, -r)).alias("lost"), F.avg(F.when(r > 0, r)).alias("win"), F.avg(F.when(r < 0, -r)).alias("loss"), F.percentile(ret, F.lit(0.05)).alias("var_95"))
    kelly = F.col("hit_ratio") - safe(1 - F.col("hit_ratio"), safe(F.col("win"), F.col("loss")))
    return table.select(*keys, "hit_ratio", safe(F.col("won"), F.col("lost")).alias("profit_factor"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), kelly)).alias("kelly"), "var_95")


def component_var(panel: DataFrame, weights: DataFrame, ts: str = "day", level: float = 0.95) -> DataFrame:
    """Per strategy: marginal (correlation with the portfolio, times its deviation by the portfolio's, times the portfolio's value at risk) and component (weight times marginal) value at risk, and the diversification ratio."""
    whole = portfolio_returns(panel, weights, ts).withColumnRenamed("ret", "all")
    at_risk = whole.agg((-F.percentile("all", F.lit(1 - level))).alias("var"), F.stddev_samp("all").alias("sp"))
    table = panel.join(whole, ts).groupBy("strategy").agg(F.corr("ret", "all").alias("corr"), F.stddev_samp("ret").alias("s")).join(weights, "strategy")
    # one row beside the few strategies
    table = table.crossJoin(F.broadcast(at_risk)).withColumn("marginal", safe(F.col("corr") * F.col("s"), F.col("sp")) * F.col("var"))
    ratio = table.agg((F.sum(F.col("weight") * F.col("s")) / F.sum("weight") / F.max("sp")).alias("diversification"))
    return table.crossJoin(F.broadcast(ratio)).select("strategy", "weight", "marginal", (F.col("weight") * F.col("marginal")).alias("component"), "diversification")


def portfolio_metrics(allocations: DataFrame, returns: DataFrame, capital: float, ts: str = "day") -> DataFrame:
    """One row: invested capital, cash and its share, active strategies, total return, volatility, Sharpe and deepest drawdown of the portfolio's returns."""
    held = allocations.agg((F.sum("current") * capital).alias("invested"), F.count_if(F.col("status") == "active").alias("active"))
    one = returns.withColumn("portfolio", F.lit(1))
    run = one.groupBy("portfolio").agg((compounded_whole("ret") - 1).alias("total"), (F.stddev_samp("ret") * math.sqrt(252)).alias("volatility"), F.avg("ret").alias("m"))
    falls = drawdown_summary(one, ["portfolio"], [ts]).select("portfolio", "deepest")
    return held.crossJoin(F.broadcast(run.join(falls, "portfolio"))).select("invested", (F.lit(capital) - F.col("invested")).alias("cash"), ((F.lit(capital) - F.col("invested")) / capital).alias("cash_share"), "active", "total", "volatility", safe(F.col("m") * 252, F.col("volatility")).alias("sharpe"), "deepest")


def portfolio_checks(metrics: DataFrame, correlations: DataFrame, least_cash: float, most_fall: float, most_corr: float) -> DataFrame:
    """check, value, bound of each exceeded limit: cash reserve, drawdown, largest correlation of two strategies."""
    top = correlations.agg(F.max("corr").alias("corr"))
    tests = F.array(*[F.struct(F.lit(n).alias("check"), v.alias("value"), F.lit(float(b)).alias("bound"), bad.alias("bad")) for n, v, b, bad in (("cash", F.col("cash_share"), least_cash, F.col("cash_share") < least_cash), ("drawdown", -F.col("deepest"), most_fall, -F.col("deepest") > most_fall), ("correlation", F.col("corr"), most_corr, F.col("corr") > most_corr))])
    return metrics.crossJoin(F.broadcast(top)).select(F.inline(F.filter(tests, lambda t: t["bad"]))).drop("bad")


def position_limits(positions: DataFrame, keys: list[str], capital: float, most_size: float, most_delta: float, least_days: int) -> DataFrame:
    """A row per position and exceeded limit: its size and its delta by capital, and days to expiry below the least. positions: value, delta, days."""
    size, delta = F.abs("value") / capital, F.abs(F.col("delta") * F.col("value")) / capital
    tests = F.array(F.struct(F.lit("size").alias("kind"), size.alias("value"), F.lit(most_size).alias("bound")), F.struct(F.lit("delta").alias("kind"), delta.alias("value"), F.lit(most_delta).alias("bound")), F.struct(F.lit("expiry").alias("kind"), F.col("days").cast("double").alias("value"), F.lit(float(least_days)).alias("bound")))
    return positions.select(*keys, F.inline(F.filter(tests, lambda t: F.when(t["kind"] == "expiry", t["value"] < t["bound"]).otherwise(t["value"] > t["bound"]))))


def volatility_adjusted(df: DataFrame, keys: list[str], by: str, capital: float, risk: float = 0.02, floor: float = 0.05, ret: str = "ret") -> DataFrame:
    """Risk capital by realised volatility (over 20 rows or more; not below the floor), and confidence: one less the deviation of the deviations over 21 rows, within 0.2 and 0.9."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(-20, 0)
    rolled = df.withColumn("v", F.when(F.count(ret).over(w) >= 21, F.stddev_samp(ret).over(w)))
    table = rolled.groupBy(*keys).agg(F.count(ret).alias("n"), (F.stddev_samp(ret) * math.sqrt(252)).alias("realised"), F.stddev_samp("v").alias("spread"))
    used = F.greatest(F.when(F.col("n") >= 20, F.col("realised")), F.lit(floor))
    return table.select(*keys, used.alias("volatility"), (F.lit(risk * capital) / used).alias("position"), F.least(F.lit(0.9), F.greatest(F.lit(0.2), 1 - F.coalesce("spread", F.lit(0.5)))).alias("confidence"))


def scale_down(sizes: DataFrame, correlations: DataFrame, capital: float, most: float) -> DataFrame:
    """Positions scaled so that sqrt(w'Cw) is at most ``most``. sizes: strategy, position; correlations: a, b, corr of pairs a < b."""
    w = sizes.select("strategy", "position", (F.col("position") / capital).alias("w"))
    pairs = correlations.join(w.select(F.col("strategy").alias("a"), F.col("w").alias("wa")), "a").join(w.select(F.col("strategy").alias("b"), F.col("w").alias("wb")), "b")
    terms = w.select((F.col("w") * F.col("w")).alias("x")).unionByName(pairs.select((2 * F.col("wa") * F.col("wb") * F.col("corr")).alias("x")))
    risk = terms.agg(F.sqrt(F.sum("x")).alias("risk"))
    return sizes.crossJoin(F.broadcast(risk)).withColumn("scaled", F.col("position") * F.when(F.col("risk") > most, most / F.col("risk")).otherwise(1.0))


def compare_methods(methods: dict[str, DataFrame], key: str) -> DataFrame:
    """Per key: the methods with the smallest, the largest and the most confident position. Each table: key, position, confidence."""
    rows = [df.select(key, F.lit(name).alias("method"), "position", "confidence") for name, df in methods.items()]
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    return table.groupBy(key).agg(F.min_by("method", F.struct("position", "method")).alias("smallest"), F.min("position").alias("least"), F.max_by("method", F.struct("position", "method")).alias("largest"), F.max("position").alias("most"), F.max_by("method", F.struct("confidence", "method")).alias("surest"))


def breach_state(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Breaches now, with whether they go on or are fresh, and those that ended. old, new: keys, kind, severity."""
    both = old.select(*keys, "kind", F.col("severity").alias("was")).join(new.select(*keys, "kind", F.col("severity").alias("now")), [*keys, "kind"], "full")
    return both.withColumn("state", F.when(F.col("now").isNull(), "ended").when(F.col("was").isNull(), "fresh").otherwise("going on"))


def halts(breaches: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: breaches by severity, and whether trading halts (any emergency, or two critical ones)."""
    n = {s: F.count_if(F.col("now") == s).alias(s) for s in ("warning", "critical", "emergency")}
    return breaches.filter("now IS NOT NULL").groupBy(*keys).agg(*n.values()).withColumn("halt", (F.col("emergency") > 0) | (F.col("critical") >= 2))

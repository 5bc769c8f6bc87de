"""Queries of alignment, combination, whole metrics, back-tests, margins and portfolio checks, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.functions import options
from quantframe.functions.windows import ordered, returns
from quantframe.jobs.queries import AT, CHAIN, DAILY, EQUITY, NUDGE, PANEL, POSITIONS, RET, TICKS, TRADES, TS, W, WEIGHTS, positions, r, settled, shown, weights
from quantframe.jobs.registry import query
from quantframe.operators import align, bars, clean, performance, regimes, risk, sentiment, signals, validation
from quantframe.sources import parsers, tables


def returned(spark, sf_dir) -> DataFrame:
    return tables.daily(spark, sf_dir).withColumn("ret", returns("close", ordered(["symbol"], "day")))


def macro(spark, sf_dir) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 10).alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value"), F.count(F.lit(1)).alias("volume"))


MACRO = "mc AS (SELECT o_custkey % 10 AS symbol, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value, count(*) AS volume FROM orders GROUP BY ALL)"
CAL = "cal AS (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM {0} GROUP BY symbol), bd AS (SELECT * FROM cal WHERE isodow(day) < 6)"


# --- bars, filters, alignment ---
@query(f"WITH {TICKS}, b AS (SELECT symbol, date_trunc('day', ts) AS bar, arg_max(price, row(ts, id)) AS close, sum(volume) AS volume, count(*) AS n FROM t GROUP BY symbol, date_trunc('day', ts)), g AS (SELECT symbol, unnest(generate_series(min(bar), max(bar), INTERVAL 1 DAY)) AS bar FROM b GROUP BY symbol) SELECT symbol, strftime(g.bar, {TS}) AS bar, round(close, 6) + 0.0 AS close, round(coalesce(volume, 0), 6) + 0.0 AS volume, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (symbol, bar)")
def bars_empty_bins(spark, sf_dir):
    b = bars.time_bars(tables.ticks(spark, sf_dir), ["symbol"], "day").select("symbol", "bar", "close", "volume", "n")
    return shown(bars.fill_empty_bins(b, ["symbol"], "1 day"))


@query(f"WITH {TICKS} SELECT symbol, hour(ts)::INT AS hour, round(avg(price), 6) + 0.0 AS mean, round(stddev_samp(price), 6) + 0.0 AS sd, round(min(price), 6) + 0.0 AS least, round(max(price), 6) + 0.0 AS greatest, count(price) AS n FROM t GROUP BY ALL")
def bars_hour_of_day(spark, sf_dir):
    return shown(bars.hour_profile(tables.ticks(spark, sf_dir), ["symbol"]))


@query(f"WITH {TICKS} SELECT symbol, strftime(date_trunc('day', ts), {TS}) AS bar, round(max(price) - min(price), 6) + 0.0 AS spread, round(sum(price * price) / count(*), 6) + 0.0 AS energy FROM t GROUP BY symbol, date_trunc('day', ts)")
def bars_user_aggregate(spark, sf_dir):
    spread, energy = F.max("price") - F.min("price"), F.sum(F.col("price") * F.col("price")) / F.count(F.lit(1))
    return shown(bars.aggregate_bars(tables.ticks(spark, sf_dir), ["symbol"], "day", spread.alias("spread"), energy.alias("energy")))


@query(f"WITH {MACRO}, x AS (SELECT symbol, date_trunc('month', day) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS bar, avg(value) AS value, sum(volume)::BIGINT AS volume FROM mc GROUP BY symbol, date_trunc('month', day)) SELECT symbol, strftime(bar, {AT}) AS bar, round(value, 4) + 0.0 AS value, volume FROM x")
def align_to_monthly(spark, sf_dir):
    return shown(align.to_frequency(macro(spark, sf_dir), ["symbol"], "month", "day"), 4)


@query(f"WITH {DAILY}, {MACRO}, x AS (SELECT symbol, date_trunc('week', day) AS bar, arg_max(close, day) AS close FROM d GROUP BY ALL), y AS (SELECT symbol, date_trunc('week', day) AS bar, arg_max(value, day) AS value FROM mc GROUP BY ALL) SELECT symbol, strftime(bar + INTERVAL 6 DAY, {AT}) AS bar, round(close, 6) + 0.0 AS px_close, round(value, 6) + 0.0 AS macro_value FROM x FULL JOIN y USING (symbol, bar)")
def align_many_weekly(spark, sf_dir):
    sources = {"px": tables.daily(spark, sf_dir).select("symbol", "day", "close"), "macro": macro(spark, sf_dir).select("symbol", "day", "value")}
    return shown(align.many_to_frequency(sources, ["symbol"], "week", "day"))


@query(f"WITH {DAILY}, {MACRO}, b AS (SELECT greatest((SELECT min(day) FROM d), (SELECT min(day) FROM mc)) AS lo, least((SELECT max(day) FROM d), (SELECT max(day) FROM mc)) AS hi) SELECT symbol, count(*) AS n, strftime(min(day), {AT}) AS low, strftime(max(day), {AT}) AS high FROM d, b WHERE day BETWEEN lo AND hi GROUP BY symbol")
def align_common_range(spark, sf_dir):
    ranged = align.common_range({"px": tables.daily(spark, sf_dir), "macro": macro(spark, sf_dir)}, "day")
    return shown(ranged["px"].groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("low"), F.max("day").alias("high")))


@query(f"WITH {DAILY}, {MACRO} SELECT symbol, strftime(day, {AT}) AS day, round(close, 6) + 0.0 AS close FROM d WHERE EXISTS (SELECT 1 FROM mc WHERE mc.symbol = d.symbol AND mc.day = d.day)")
def align_members(spark, sf_dir):
    return shown(align.members(tables.daily(spark, sf_dir), macro(spark, sf_dir), ["symbol", "day"]).select("symbol", "day", "close"))


@query(f"WITH {DAILY}, {CAL.format('d')}, j AS (SELECT symbol, day, close, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS 5 PRECEDING) AS filled FROM bd LEFT JOIN d USING (symbol, day)), a AS (SELECT symbol, count(*) AS rows_after, count(*) FILTER (filled IS NOT NULL AND close IS NULL)::BIGINT AS cells_filled, round(count(filled) / count(*), 6) + 0.0 AS coverage FROM j GROUP BY symbol) SELECT symbol, n AS rows_before, rows_after, cells_filled, coverage FROM a JOIN (SELECT symbol, count(*) AS n FROM d GROUP BY symbol) USING (symbol)")
def align_full_report(spark, sf_dir):
    return shown(align.align(tables.daily(spark, sf_dir), ["symbol"], "day", "volume", ["close"])[1])


@query(f"""WITH {DAILY}, {MACRO}, b AS (SELECT greatest((SELECT min(day) FROM d), (SELECT min(day) FROM mc)) AS lo, least((SELECT max(day) FROM d), (SELECT max(day) FROM mc)) AS hi),
x AS (SELECT symbol, day, close FROM d, b WHERE day BETWEEN lo AND hi), y AS (SELECT symbol, day, value FROM mc, b WHERE day BETWEEN lo AND hi),
u AS (SELECT symbol, day FROM x UNION ALL SELECT symbol, day FROM y), {CAL.format('u')},
m AS (SELECT symbol, day, NULL AS close, NULL AS value, 1 AS g FROM bd UNION ALL SELECT symbol, day, close, NULL, 0 FROM x),
n AS (SELECT symbol, day, NULL AS value, 1 AS g FROM bd UNION ALL SELECT symbol, day, value, 0 FROM y),
fx AS (SELECT symbol, day, g, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day, g ROWS 5 PRECEDING) AS c FROM m),
fy AS (SELECT symbol, day, g, last_value(value IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day, g ROWS 5 PRECEDING) AS v FROM n),
z AS (SELECT fx.symbol, fx.day, c, v FROM fx JOIN fy ON fx.symbol = fy.symbol AND fx.day = fy.day AND fx.g = 1 AND fy.g = 1),
k AS (SELECT avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM z),
qt AS (SELECT symbol, quantile_cont(c, 0.25) AS a, quantile_cont(c, 0.75) AS b FROM z GROUP BY symbol), pc AS (SELECT z.symbol, day, CASE WHEN c IS NOT NULL THEN greatest(least(c, b + (b - a) * 2), a - (b - a) * 2) END AS c FROM z JOIN qt USING (symbol))
SELECT symbol, strftime(day, {AT}) AS day, round((c - avg(c) OVER s) / CASE WHEN stddev_pop(c) OVER s = 0 THEN 1 ELSE stddev_pop(c) OVER s END, 4) + 0.0 AS px_close FROM pc WINDOW s AS (PARTITION BY symbol)""")
def align_combine_sources(spark, sf_dir):
    """Sources side by side, cleaned and scaled; the macro values stand for ten series only, so most rows have none and the column goes."""
    sources = {"px": tables.daily(spark, sf_dir).select("symbol", "day", "close"), "macro": macro(spark, sf_dir).select("symbol", "day", "value")}
    return shown(align.combine(sources, ["symbol"], "day").select("symbol", "day", "px_close"), 4)


# --- cleaning and selection ---
@query(f"WITH {DAILY}, u AS (SELECT * FROM d WHERE day <= DATE '1999-06-30' UNION SELECT * FROM d WHERE day >= DATE '1999-01-01'), q AS (SELECT symbol, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.75) AS b FROM u GROUP BY symbol) SELECT symbol, strftime(day, {AT}) AS day, round(greatest(least(close, b + (b - a) * 2), a - (b - a) * 2), 6) + 0.0 AS close FROM u JOIN q USING (symbol)")
def clean_load_parts(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    parts = [d.filter("day <= DATE '1999-06-30'"), d.filter("day >= DATE '1999-01-01'")]
    return shown(clean.load_parts(parts, ["symbol"], ["day"], ["close"]).select("symbol", "day", "close"))


@query(f"WITH {TICKS} SELECT id, round(volume, 6) + 0.0 AS volume FROM t WHERE volume IS NOT NULL")
def clean_drop_null_rows(spark, sf_dir):
    t = tables.ticks(spark, sf_dir).withColumn("empty", F.when(F.col("id") < 0, 1))
    return shown(clean.drop_null_rows(clean.drop_sparse_columns(t, ["empty", "volume"], 0.9), ["volume"]).select("id", "volume"))


@query(f"WITH {DAILY}, {RET}, s AS (SELECT ret, high - low AS spread, volume, close * 2 AS twice, close FROM r WHERE ret IS NOT NULL), c AS (SELECT 'spread' AS feature, corr(spread, ret) AS k, count(*) AS n FROM s UNION ALL SELECT 'volume', corr(volume, ret), count(*) FROM s UNION ALL SELECT 'twice', corr(twice, ret), count(*) FROM s) SELECT feature, round(k * k / (1 - k * k) * (n - 2), 4) + 0.0 AS score FROM c")
def select_combined(spark, sf_dir):
    """close goes: it says what twice says. A constant goes for want of variance."""
    s = returned(spark, sf_dir).filter("ret IS NOT NULL").select("ret", (F.col("high") - F.col("low")).alias("spread"), "volume", "close", (F.col("close") * 2).alias("twice"), F.lit(1.0).alias("one"))
    return shown(clean.select_features(s, ["spread", "volume", "close", "twice", "one"], "ret", 5), 4)


@query(f"WITH {TICKS} SELECT symbol, count(*) AS n, round(avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS null_share, round(1 - avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS completeness, count(*) >= 60 AND avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END) <= 0.2 AS passes FROM t GROUP BY symbol")
def clean_quality_gate(spark, sf_dir):
    return shown(clean.quality_gate(tables.ticks(spark, sf_dir), ["symbol"], ["volume"], 60, 0.2))


@query("WITH k AS (SELECT l_orderkey, l_linenumber, l_suppkey % 1000 AS short, l_orderkey * 3000 AS wide FROM lineitem), t AS (SELECT max(l_linenumber) AS a, max(short) AS b, max(wide) AS c FROM k) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, short::BIGINT AS short, wide, CASE WHEN a < 128 THEN 'tinyint' WHEN a < 32768 THEN 'smallint' WHEN a < 2147483648 THEN 'int' ELSE 'bigint' END AS linenumber_type, CASE WHEN b < 128 THEN 'tinyint' WHEN b < 32768 THEN 'smallint' WHEN b < 2147483648 THEN 'int' ELSE 'bigint' END AS short_type, CASE WHEN c < 128 THEN 'tinyint' WHEN c < 32768 THEN 'smallint' WHEN c < 2147483648 THEN 'int' ELSE 'bigint' END AS wide_type FROM k, t")
def clean_narrow_types(spark, sf_dir):
    """Values after narrowing, and the types that they then have."""
    t = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 1000).alias("short"), (F.col("l_orderkey") * 3000).alias("wide"))
    slim = clean.narrow_types(t, ["l_linenumber", "short", "wide"])
    types = [F.typeof(c).alias(f"{c.removeprefix('l_')}_type") for c in ("l_linenumber", "short", "wide")]
    return slim.select("l_orderkey", *[F.col(c).cast("long").alias(c) for c in ("l_linenumber", "short", "wide")], *types)


@query(f"WITH {DAILY} SELECT symbol, strftime(day, {AT}) AS day, round(CASE WHEN count(close) OVER w >= 100 THEN avg(close) OVER w END, 6) + 0.0 AS mean, round(CASE WHEN count(close) OVER w >= 100 THEN stddev_samp(close) OVER w END, 6) + 0.0 AS sd FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 99 PRECEDING)")
def indicators_rolling_hundred(spark, sf_dir):
    w = ordered(["symbol"], "day").rowsBetween(-99, 0)
    enough = F.count("close").over(w) >= 100
    d = tables.daily(spark, sf_dir)
    return shown(d.select("symbol", "day", F.when(enough, F.avg("close").over(w)).alias("mean"), F.when(enough, F.stddev_samp("close").over(w)).alias("sd")))


# --- sources ---
@query("SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d 00:00:00') AS day, round(o_totalprice, 6) + 0.0 AS value FROM orders WHERE o_orderkey % 7 <> 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def parse_observations(spark, sf_dir):
    """Orders written as a provider's JSON, a payload per series, and parsed again; '.' stands for a missing value."""
    o = tables.read(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 7 == 0, ".").otherwise(F.col("o_totalprice").cast("string"))
    one = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), value.alias("value"))
    payloads = o.groupBy((F.col("o_orderkey") % 100).alias("series")).agg(F.to_json(F.struct(F.collect_list(one).alias("observations"))).alias("json"))
    got = parsers.observations(payloads, "json", "value", "1996-01-01", "1998-12-31")
    return shown(got)


# --- regimes and signals ---
SIDE = "CASE WHEN vol IS NULL OR vol <= a THEN 'low' WHEN vol <= b THEN 'medium' ELSE 'high' END"
REGIME = f"vv AS (SELECT symbol, day, ret, close, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END AS vol FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING)), qq AS (SELECT symbol, quantile_cont(vol, 0.33) AS a, quantile_cont(vol, 0.67) AS b FROM vv GROUP BY symbol), rg AS (SELECT vv.*, {SIDE} AS regime FROM vv JOIN qq USING (symbol))"


def labelled(spark, sf_dir) -> DataFrame:
    w = ordered(["symbol"], "day").rowsBetween(-19, 0)
    d = returned(spark, sf_dir).withColumn("vol", F.when(F.count("ret").over(w) >= 20, F.stddev_samp("ret").over(w)))
    q = d.groupBy("symbol").agg(F.percentile("vol", F.array(F.lit(0.33), F.lit(0.67))).alias("q"))
    side = F.when(F.col("vol").isNull() | (F.col("vol") <= F.col("q")[0]), "low").when(F.col("vol") <= F.col("q")[1], "medium").otherwise("high")
    return d.join(q, "symbol").withColumn("regime", side)


@query(f"WITH {DAILY}, {RET}, {REGIME} SELECT symbol, regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) + 0.0 AS share FROM rg GROUP BY symbol, regime")
def regimes_counts(spark, sf_dir):
    return shown(regimes.regime_counts(labelled(spark, sf_dir), ["symbol"]))


@query(f"WITH {DAILY}, {RET}, {REGIME}, gs AS (SELECT *, lag(ret) OVER {W} AS guess FROM rg) SELECT symbol, regime, count(ret - guess) AS n, round(sqrt(avg((ret - guess) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(ret - guess)), 6) + 0.0 AS mae, round(avg(CASE WHEN sign(ret) = sign(guess) THEN 1.0 WHEN ret IS NOT NULL AND guess IS NOT NULL THEN 0.0 END), 6) + 0.0 AS right_sign FROM gs GROUP BY symbol, regime")
def regimes_accuracy(spark, sf_dir):
    p = labelled(spark, sf_dir).withColumn("guess", F.lag("ret").over(ordered(["symbol"], "day")))
    return shown(regimes.accuracy_by_regime(p, ["symbol"], "ret", "guess").drop("corr"))


@query(f"WITH {DAILY}, {RET}, {REGIME}, f AS (SELECT symbol, regime, count(ret) AS n, sign(avg(ret)) AS side FROM rg GROUP BY ALL HAVING count(ret) > 50) SELECT symbol, regime, side::DOUBLE AS side, n, round(avg(side * ret), 6) + 0.0 AS mean, round(sum(side * ret), 6) + 0.0 AS total, round(stddev_samp(side * ret), 6) + 0.0 AS sd FROM rg JOIN f USING (symbol, regime) GROUP BY symbol, regime, side, n")
def regimes_rules(spark, sf_dir):
    return shown(regimes.rules_by_regime(labelled(spark, sf_dir), ["symbol"], ["day"]))


@query(f"WITH {DAILY}, {RET} SELECT symbol, strftime(day, {AT}) AS day, CASE WHEN abs(ret) > 0.005 THEN 1 ELSE 0 END AS signal FROM r")
def signals_scalp(spark, sf_dir):
    return shown(signals.scalp_signals(tables.daily(spark, sf_dir), ["symbol"], ["day"]).select("symbol", "day", "signal"))


@query(f"WITH {DAILY}, {RET}, v AS (SELECT symbol, ret, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w * sqrt(252) END AS v FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING)) SELECT symbol, round(stddev_samp(ret) * sqrt(252), 6) + 0.0 AS volatility, round(avg(v), 6) + 0.0 AS mean_volatility, CASE WHEN avg(v) > 8 THEN 'wide' ELSE 'narrow' END AS parameters FROM v GROUP BY symbol")
def signals_parameters(spark, sf_dir):
    return shown(signals.strategy_parameters(returned(spark, sf_dir), ["symbol"], ["day"], bound=8.0))


RESULTS = "rs AS (SELECT strategy, portfolio, avg(pnl / (entry_price * quantity)) AS score FROM tr GROUP BY ALL)"


def results(spark, sf_dir) -> DataFrame:
    t = options.trade_pnl(tables.trades(spark, sf_dir))
    return t.groupBy("strategy", "portfolio").agg(F.avg(F.col("pnl") / (F.col("entry_price") * F.col("quantity"))).alias("score"))


@query(f"WITH {TRADES}, {RESULTS}, a AS (SELECT strategy, avg(score) AS mean, median(score) AS median, stddev_samp(score) AS sd, avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) AS success, max(score) AS best, min(score) AS worst, count(*) AS n FROM rs GROUP BY strategy) SELECT strategy, {r('mean', 'median', 'sd', 'success', 'best', 'worst')}, n, rank() OVER (ORDER BY mean DESC)::INT AS place FROM a")
def ranking_strategies(spark, sf_dir):
    return shown(signals.rank_strategies(results(spark, sf_dir), "strategy", "score"))


@query(f"WITH {TRADES}, {RESULTS} SELECT n_name AS nation, round(avg(score) FILTER (strategy = 'F'), 6) + 0.0 AS \"F\", round(avg(score) FILTER (strategy = 'O'), 6) + 0.0 AS \"O\" FROM rs JOIN supplier ON portfolio = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def ranking_class_matrix(spark, sf_dir):
    s, n = tables.read(spark, sf_dir, "supplier"), tables.read(spark, sf_dir, "nation")
    dimension = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("portfolio"), F.col("n_name").alias("nation"))
    return shown(signals.class_matrix(results(spark, sf_dir), dimension, "portfolio", "nation", "strategy", "score", ["F", "O"]))


@query(f"WITH {PANEL}, a AS (SELECT strategy AS run, avg(ret) AS mean, stddev_samp(ret) AS sd FROM s GROUP BY strategy) SELECT run, round(mean, 8) + 0.0 AS mean, round(sd, 8) + 0.0 AS sd, mean = max(mean) OVER () AS is_best FROM a")
def ranking_runs(spark, sf_dir):
    long = tables.panel(spark, sf_dir).groupBy(F.col("strategy").alias("run")).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd")).select("run", F.inline(F.array(F.struct(F.lit("mean").alias("metric"), F.col("mean").alias("value")), F.struct(F.lit("sd").alias("metric"), F.col("sd").alias("value")))))
    return shown(signals.compare_runs(long, "run", ["mean", "sd"], "mean"), 8)


# --- performance ---
WIPED = f"{PANEL}, wp AS (SELECT strategy, day, CASE WHEN row_number() OVER (PARTITION BY strategy ORDER BY day) = 30 AND strategy LIKE '1%' THEN -1.0 WHEN row_number() OVER (PARTITION BY strategy ORDER BY day) = 40 AND strategy LIKE '2%' THEN -1.5 ELSE ret END AS ret FROM s)"


@query(f"WITH {WIPED} SELECT strategy, round(product(1 + ret) - 1, 6) + 0.0 AS total FROM wp GROUP BY strategy")
def performance_total_losses(spark, sf_dir):
    """Totals where a strategy loses everything, or more than it has."""
    n = F.row_number().over(ordered(["strategy"], "day"))
    ret = F.when((F.col("n") == 30) & F.col("strategy").startswith("1"), -1.0).when((F.col("n") == 40) & F.col("strategy").startswith("2"), -1.5).otherwise(F.col("ret"))
    return shown(performance.basic(tables.panel(spark, sf_dir).withColumn("n", n).withColumn("ret", ret), ["strategy"]).select("strategy", "total"))


RATIOS = f"{PANEL}, {EQUITY}, fa AS (SELECT strategy, min(drawdown) AS lo, avg(drawdown) FILTER (drawdown < 0) AS mf, sqrt(sum(drawdown * drawdown)) AS bu FROM dd GROUP BY strategy), ba AS (SELECT strategy, pow(product(1 + ret), 252 / count(*)) - 1 AS annual, avg(ret) AS m, sum(ret) AS s, sum(-ret) FILTER (ret < 0) AS pain FROM s GROUP BY strategy), ra AS (SELECT strategy, annual / nullif(abs(lo), 0) AS calmar, annual / nullif(abs(mf), 0) AS sterling, (m - 0.02 / 252) * 252 / nullif(bu, 0) AS burke, s / nullif(pain, 0) AS gain_pain FROM fa JOIN ba USING (strategy))"


@query(f"WITH {RATIOS} SELECT strategy, {r('calmar', 'sterling', 'burke', 'gain_pain')} FROM ra")
def performance_ratios(spark, sf_dir):
    return shown(performance.ratios(tables.panel(spark, sf_dir), ["strategy"], ["day"]))


@query(f"WITH {RATIOS}, l AS (SELECT strategy, 'calmar' AS metric, calmar AS value FROM ra UNION ALL SELECT strategy, 'gain_pain', gain_pain FROM ra UNION ALL SELECT strategy, 'deepest', lo FROM fa), t AS (SELECT metric, max(value) AS v FROM l GROUP BY metric) SELECT metric, min(strategy) AS winner, round(min(value), 6) + 0.0 AS value FROM l JOIN t USING (metric) WHERE value = v GROUP BY metric")
def performance_winners(spark, sf_dir):
    table = performance.every_metric(tables.panel(spark, sf_dir), ["strategy"], ["day"])
    return shown(performance.winners(table, "strategy", ["calmar", "gain_pain", "deepest"]))


@query(f"WITH {PANEL}, {EQUITY}, pd AS (SELECT strategy, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS positive_days, stddev_samp(ret) AS sd FROM s GROUP BY strategy), rv AS (SELECT strategy, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END AS v FROM s WINDOW w AS (PARTITION BY strategy ORDER BY day ROWS 19 PRECEDING)), rm AS (SELECT strategy, avg(v) AS v FROM rv GROUP BY strategy), m AS (SELECT *, lead(day) OVER w AS a, sum(CASE WHEN drawdown >= 0 THEN 1 ELSE 0 END) OVER w AS period FROM dd WINDOW w AS (PARTITION BY strategy ORDER BY day)), sp AS (SELECT strategy, period, min(day) AS f, arg_max(a, day) AS b, count(a) = count(*) AS done FROM m WHERE drawdown < 0 GROUP BY ALL), rc AS (SELECT strategy, avg(b - f) AS recovery_days FROM sp WHERE done GROUP BY strategy) SELECT strategy, round(positive_days, 6) + 0.0 AS positive_days, round((v - sd) * sqrt(252), 6) + 0.0 AS volatility_premium, round(recovery_days, 6) + 0.0 AS recovery_days FROM pd JOIN rm USING (strategy) LEFT JOIN rc USING (strategy)")
def performance_option_metrics(spark, sf_dir):
    return shown(performance.option_metrics(tables.panel(spark, sf_dir), ["strategy"], "day"))


CURVE = "dl AS (SELECT portfolio, CAST(ts AS DATE) AS day, sum(pnl) AS x FROM tr GROUP BY ALL), gr AS (SELECT portfolio, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dl GROUP BY portfolio), cu AS (SELECT portfolio, day, 10000000 + sum(coalesce(x, 0)) OVER (PARTITION BY portfolio ORDER BY day) AS equity FROM gr LEFT JOIN dl USING (portfolio, day))"


@query(f"WITH {TRADES}, {CURVE} SELECT portfolio, strftime(day, {AT}) AS day, round(equity, 2) + 0.0 AS equity FROM cu")
def backtest_equity_on_calendar(spark, sf_dir):
    t = options.trade_pnl(tables.trades(spark, sf_dir))
    return shown(performance.equity_on_calendar(t, ["portfolio"], 10_000_000.0), 2)


@query(f"WITH {TRADES}, {CURVE}, x AS (SELECT *, equity / nullif(lag(equity) OVER w, 0) - 1 AS ret, equity / max(equity) OVER w - 1 AS fall FROM cu WINDOW w AS (PARTITION BY portfolio ORDER BY day)), y AS (SELECT *, sum(CASE WHEN fall >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio ORDER BY day) AS run FROM x), l AS (SELECT portfolio, max(n) AS longest FROM (SELECT portfolio, run, count(*) AS n FROM y WHERE fall < 0 GROUP BY ALL) GROUP BY portfolio), a AS (SELECT portfolio, arg_max(equity, day) / arg_min(equity, day) - 1 AS total, count(ret) AS days, stddev_samp(ret) AS sd, avg(ret) AS m, min(fall) AS deepest FROM y GROUP BY portfolio), b AS (SELECT portfolio, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, abs(sum(pnl) FILTER (pnl > 0) / nullif(sum(pnl) FILTER (pnl <= 0), 0)) AS profit_factor, avg(pnl) AS expectancy FROM tr GROUP BY portfolio) SELECT portfolio, {r('total', digits=5)}, round(CASE WHEN total >= -1 THEN (1 + total) ** (252 / days) END - 1, 5) + 0.0 AS annual, round(sd * sqrt(252), 5) + 0.0 AS volatility, round((m - 0.02 / 252) / nullif(sd, 0) * sqrt(252), 5) + 0.0 AS sharpe, round((CASE WHEN total >= -1 THEN (1 + total) ** (252 / days) END - 1) / nullif(abs(deepest), 0), 5) + 0.0 AS calmar, {r('deepest', digits=5)}, coalesce(longest, 0) AS longest, trades, {r('win_rate', 'profit_factor', digits=5)}, round(expectancy, 3) + 0.0 AS expectancy FROM a JOIN b USING (portfolio) LEFT JOIN l USING (portfolio)")
def backtest_result(spark, sf_dir):
    t = options.trade_pnl(tables.trades(spark, sf_dir))
    found = performance.backtest_result(t, ["portfolio"], 10_000_000.0)
    return shown(found.withColumn("expectancy", F.round("expectancy", 3)), 5)


# --- portfolio risk and sizing ---
WHOLE = f"{PANEL}, {WEIGHTS}, al AS (SELECT day, sum(weight * ret) / (SELECT sum(weight) FROM wt) AS x FROM s JOIN wt USING (strategy) GROUP BY day)"


@query(f"WITH {WHOLE}, vr AS (SELECT -quantile_cont(x, 0.05) AS var, stddev_samp(x) AS sp FROM al), c AS (SELECT strategy, corr(ret, x) AS k, stddev_samp(ret) AS sd FROM s JOIN al USING (day) GROUP BY strategy), m AS (SELECT strategy, weight, k * sd / sp * var AS marginal, sd, sp FROM c JOIN wt USING (strategy), vr) SELECT strategy, {r('weight', 'marginal')}, round(weight * marginal, 6) + 0.0 AS component, round(sum(weight * sd) OVER () / sum(weight) OVER () / sp, 6) + 0.0 AS diversification FROM m")
def risk_component_var(spark, sf_dir):
    return shown(risk.component_var(tables.panel(spark, sf_dir), weights(spark, sf_dir)))


ALLOCATED = f"{WHOLE}, pm AS (SELECT (SELECT sum(weight * 0.9) FROM wt) * 1000000 AS invested, 3 AS active), run AS (SELECT product(1 + x) - 1 AS total, stddev_samp(x) * sqrt(252) AS volatility, avg(x) AS m FROM al), eq AS (SELECT day, exp(sum(ln(1 + x)) OVER (ORDER BY day)) AS e FROM al), fl AS (SELECT min(f) AS deepest FROM (SELECT e / max(e) OVER (ORDER BY day) - 1 AS f FROM eq)), me AS (SELECT invested, 1000000 - invested AS cash, (1000000 - invested) / 1000000 AS cash_share, active, total, volatility, m * 252 / volatility AS sharpe, deepest FROM pm, run, fl)"


def portfolio(spark, sf_dir) -> DataFrame:
    held = weights(spark, sf_dir).select("strategy", (F.col("weight") * 0.9).alias("current"), F.when(F.col("strategy") < "4", "active").otherwise("paused").alias("status"))
    return risk.portfolio_metrics(held, risk.portfolio_returns(tables.panel(spark, sf_dir), weights(spark, sf_dir)), 1_000_000.0)


@query(f"WITH {ALLOCATED} SELECT {r('invested', 'cash', 'cash_share', 'total', 'volatility', 'sharpe', 'deepest', digits=4)}, active FROM me")
def risk_portfolio_metrics(spark, sf_dir):
    return shown(portfolio(spark, sf_dir), 4)


CORRS = "co AS (SELECT x.strategy AS a, y.strategy AS b, corr(x.ret, y.ret) AS corr FROM s x JOIN s y ON x.day = y.day AND x.strategy < y.strategy GROUP BY ALL HAVING count(*) >= 60)"


@query(f"WITH {ALLOCATED}, {CORRS}, k AS (SELECT 'cash' AS \"check\", cash_share AS value, 0.2 AS bound FROM me WHERE cash_share < 0.2 UNION ALL SELECT 'drawdown', -deepest, 0.05 FROM me WHERE -deepest > 0.05 UNION ALL SELECT 'correlation', max(corr), 0.01 FROM co HAVING max(corr) > 0.01) SELECT \"check\", {r('value', 'bound', digits=5)} FROM k")
def risk_portfolio_checks(spark, sf_dir):
    corrs = risk.correlation_table(tables.panel(spark, sf_dir), "strategy", "day")
    return shown(risk.portfolio_checks(portfolio(spark, sf_dir), corrs, 0.2, 0.05, 0.01), 5)


@query(f"WITH {POSITIONS}, p AS (SELECT *, (position % 10) / 10 AS delta, (position % 40)::INT AS days FROM po), k AS (SELECT portfolio, position, 'size' AS kind, abs(value) / 1000000 AS value, 0.15 AS bound FROM p WHERE abs(value) / 1000000 > 0.15 UNION ALL SELECT portfolio, position, 'delta', abs(delta * value) / 1000000, 0.1 FROM p WHERE abs(delta * value) / 1000000 > 0.1 UNION ALL SELECT portfolio, position, 'expiry', days, 5 FROM p WHERE days < 5) SELECT portfolio, position, kind, {r('value', 'bound', digits=5)} FROM k")
def risk_position_limits(spark, sf_dir):
    p = positions(spark, sf_dir).withColumn("delta", F.col("position") % 10 / 10).withColumn("days", (F.col("position") % 40).cast("int"))
    return shown(risk.position_limits(p, ["portfolio", "position"], 1_000_000.0, 0.15, 0.1, 5), 5)


SIZED = f"{PANEL}, rv AS (SELECT strategy, ret, CASE WHEN count(ret) OVER w >= 21 THEN stddev_samp(ret) OVER w END AS v FROM s WINDOW w AS (PARTITION BY strategy ORDER BY day ROWS 20 PRECEDING)), ss AS (SELECT strategy, greatest(CASE WHEN count(ret) >= 20 THEN stddev_samp(ret) * sqrt(252) END, 0.05) AS volatility, least(0.9, greatest(0.2, 1 - coalesce(stddev_samp(v), 0.5))) AS confidence FROM rv GROUP BY strategy), sz AS (SELECT strategy, volatility, 2000 / volatility AS position, confidence FROM ss)"


def sized(spark, sf_dir) -> DataFrame:
    return risk.volatility_adjusted(tables.panel(spark, sf_dir), ["strategy"], "day", 100_000.0)


@query(f"WITH {SIZED} SELECT strategy, {r('volatility', 'position', 'confidence', digits=4)} FROM sz")
def sizing_volatility_adjusted(spark, sf_dir):
    return shown(sized(spark, sf_dir), 4)


@query(f"WITH {SIZED}, {CORRS}, t AS (SELECT (position / 100000) ** 2 AS x FROM sz UNION ALL SELECT 2 * p.position / 100000 * q.position / 100000 * corr FROM co JOIN sz p ON p.strategy = a JOIN sz q ON q.strategy = b), k AS (SELECT sqrt(sum(x)) AS risk FROM t) SELECT strategy, round(position, 3) + 0.0 AS position, round(risk, 5) + 0.0 AS risk, round(position * CASE WHEN risk > 0.05 THEN 0.05 / risk ELSE 1 END, 3) + 0.0 AS scaled FROM sz, k")
def sizing_scale_down(spark, sf_dir):
    corrs = risk.correlation_table(tables.panel(spark, sf_dir), "strategy", "day")
    out = risk.scale_down(sized(spark, sf_dir).select("strategy", "position"), corrs, 100_000.0, 0.05)
    return out.select("strategy", (F.round("position", 3) + 0.0).alias("position"), (F.round("risk", 5) + 0.0).alias("risk"), (F.round("scaled", 3) + 0.0).alias("scaled"))


@query(f"WITH {SIZED}, kl AS (SELECT strategy, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS h, avg(ret) FILTER (ret > 0) / avg(-ret) FILTER (ret < 0) AS o FROM s GROUP BY strategy), m AS (SELECT strategy, 'volatility' AS method, position, confidence FROM sz UNION ALL SELECT strategy, 'fixed', coalesce(greatest(0.5, least(2.0, 0.8 / volatility)), 1) * 2000, 0.5 FROM sz UNION ALL SELECT strategy, 'kelly', greatest(0, least(0.25, h - (1 - h) / o)) * 100000, h FROM kl) SELECT strategy, arg_min(method, row(position, method)) AS smallest, round(min(position), 3) + 0.0 AS least, arg_max(method, row(position, method)) AS largest, round(max(position), 3) + 0.0 AS most, arg_max(method, row(confidence, method)) AS surest FROM m GROUP BY strategy")
def sizing_compare_methods(spark, sf_dir):
    """By volatility, a fixed share scaled by volatility, and Kelly's share (a quarter at most), each from the panel."""
    s = sized(spark, sf_dir)
    fixed = risk.fixed_fraction(s, 100_000.0, 0.02, 0.8).select("strategy", "position", F.lit(0.5).alias("confidence"))
    won = risk.validator_metrics(tables.panel(spark, sf_dir), ["strategy"])
    kelly = won.select("strategy", (F.least(F.lit(0.25), F.col("kelly")) * 100_000).alias("position"), F.col("hit_ratio").alias("confidence"))
    return shown(risk.compare_methods({"volatility": s.select("strategy", "position", "confidence"), "fixed": fixed, "kelly": kelly}, "strategy"), 3)


# --- options ---
LEGS = f"{CHAIN}, lg AS (SELECT portfolio || '-' || strftime(day, '%Y%m%d') AS position, portfolio, CASE (portfolio + dayofyear(day)) % 6 WHEN 0 THEN 'condor' WHEN 1 THEN 'strangle' WHEN 2 THEN 'vertical' WHEN 3 THEN 'covered_call' WHEN 4 THEN 'cash_secured_put' ELSE 'other' END AS strategy, avg(spot) OVER (PARTITION BY portfolio, day) AS spot, option_type, strike, CASE WHEN quantity > 25 THEN -1 ELSE 1 END AS quantity, CASE WHEN quantity > 25 THEN iv * strike ELSE iv * strike END AS premium FROM ch)"


def legs(spark, sf_dir) -> DataFrame:
    c = tables.chain(spark, sf_dir)
    names = ["condor", "strangle", "vertical", "covered_call", "cash_secured_put", "other"]
    strategy = F.element_at(F.array(*map(F.lit, names)), ((F.col("portfolio") + F.dayofyear("day")) % 6 + 1).cast("int"))
    mean = c.groupBy("portfolio", "day").agg((options.steady_sum(F.col("spot")) / F.count("spot")).alias("spot"))
    return c.drop("spot").join(mean, ["portfolio", "day"]).select(F.concat_ws("-", "portfolio", F.date_format("day", "yyyyMMdd")).alias("position"), "portfolio", strategy.alias("strategy"), "spot", "option_type", "strike", F.when(F.col("quantity") > 25, -1).otherwise(1).alias("quantity"), (F.col("iv") * F.col("strike")).alias("premium"))


#: A short pair's maintenance is of its margin before the least; it has no least, so three quarters of the initial one.
MAINTENANCE = "CASE kind WHEN 'long_pair' THEN 0 WHEN 'cash_secured_put' THEN initial ELSE initial * 0.75 END"
MARGIN = f"""{LEGS}, nk AS (SELECT *, greatest(0.2 * spot * 100 * abs(quantity) + premium * abs(quantity) - greatest(0, CASE WHEN option_type = 'call' THEN strike - spot ELSE spot - strike END) * 100 * abs(quantity), 100) AS naked FROM lg),
g AS (SELECT position, strategy, count(*) AS n, count(*) FILTER (option_type = 'call') AS calls, count(*) FILTER (option_type = 'put') AS puts, count(*) FILTER (quantity < 0) AS shorts, count(*) FILTER (quantity < 0 AND option_type = 'call') AS sc, count(*) FILTER (quantity < 0 AND option_type = 'put') AS sp, min(spot) AS spot,
 sum(premium * quantity) AS premium, sum(CASE WHEN quantity < 0 THEN naked ELSE premium * quantity END) AS by_leg, max(strike) FILTER (option_type = 'call') AS hc, min(strike) FILTER (option_type = 'call') AS lc, max(strike) FILTER (option_type = 'put') AS hp, min(strike) FILTER (option_type = 'put') AS lp, max(naked) FILTER (option_type = 'call') AS cm, max(naked) FILTER (option_type = 'put') AS pmg,
 sum(premium * abs(quantity)) FILTER (quantity < 0 AND option_type = 'call') AS cp, min(row(strike, premium * abs(quantity))) FILTER (quantity < 0 AND option_type = 'put') AS put, max(strike) - min(strike) AS width FROM nk GROUP BY position, strategy),
k AS (SELECT *, CASE WHEN strategy = 'condor' AND calls = 2 AND puts = 2 THEN 'condor' WHEN strategy = 'strangle' AND calls = 1 AND puts = 1 THEN CASE WHEN shorts = 0 THEN 'long_pair' ELSE 'short_pair' END WHEN strategy = 'vertical' AND n = 2 AND (calls = 2 OR puts = 2) THEN CASE WHEN premium < 0 THEN 'credit' ELSE 'debit' END WHEN strategy = 'covered_call' AND sc > 0 THEN 'covered_call' WHEN strategy = 'cash_secured_put' AND sp > 0 THEN 'cash_secured_put' ELSE 'by_leg' END AS kind FROM g),
i AS (SELECT *, CASE kind WHEN 'condor' THEN greatest(greatest(hc - lc, hp - lp) * 100 + premium, 100) WHEN 'long_pair' THEN premium WHEN 'short_pair' THEN greatest(cm, pmg) + abs(premium) WHEN 'credit' THEN greatest(width * 100 + premium, 100) WHEN 'debit' THEN greatest(premium, 100) WHEN 'covered_call' THEN greatest(spot * 50 - cp, 100) WHEN 'cash_secured_put' THEN put[1] * 100 - put[2] ELSE greatest(by_leg, 100) END AS initial FROM k)"""


@query(f"WITH {MARGIN} SELECT position, strategy, kind, round(premium + {NUDGE}, 6) + 0.0 AS premium, round(initial + {NUDGE}, 6) + 0.0 AS initial, round(({MAINTENANCE}) + {NUDGE}, 6) + 0.0 AS maintenance, round((CASE kind WHEN 'condor' THEN greatest(hc - lc, hp - lp) * 100 + premium WHEN 'long_pair' THEN premium WHEN 'debit' THEN premium WHEN 'short_pair' THEN 'Infinity'::DOUBLE WHEN 'credit' THEN width * 100 + premium WHEN 'covered_call' THEN spot * 100 + cp WHEN 'cash_secured_put' THEN put[1] * 100 - put[2] END) + {NUDGE}, 6) + 0.0 AS most_loss, round((CASE kind WHEN 'long_pair' THEN 'Infinity'::DOUBLE WHEN 'condor' THEN -premium WHEN 'short_pair' THEN -premium WHEN 'credit' THEN -premium WHEN 'debit' THEN width * 100 - premium WHEN 'covered_call' THEN hc * 100 - spot * 100 + cp WHEN 'cash_secured_put' THEN put[2] END) + {NUDGE}, 6) + 0.0 AS most_profit FROM i")
def options_margins(spark, sf_dir):
    return shown(settled(options.margins(legs(spark, sf_dir), "position")))


@query(f"WITH {MARGIN} SELECT strategy, round(sum(initial), 4) + 0.0 AS initial, round(sum({MAINTENANCE}), 4) + 0.0 AS maintenance, round(sum(premium), 4) + 0.0 AS premium, count(*) AS positions FROM i GROUP BY strategy")
def options_portfolio_margin(spark, sf_dir):
    return shown(options.portfolio_margin(options.margins(legs(spark, sf_dir), "position"), ["strategy"]), 4)


@query(f"WITH {CHAIN}, m AS (SELECT *, greatest(0, CASE WHEN option_type = 'call' THEN spot - strike ELSE strike - spot END) AS i FROM ch), v AS (SELECT portfolio, (i + greatest(0.05, i * 0.1)) * quantity AS v, quantity, iv FROM m), t AS (SELECT portfolio, sum(v) AS value, sum(v - quantity * iv) AS unrealised, sum(abs(v)) AS gross FROM v GROUP BY portfolio) SELECT portfolio, round(value, 3) + 0.0 AS value, round(unrealised, 3) + 0.0 AS unrealised, round(value + 1000, 3) + 0.0 AS total, round(gross / (value + 1000), 3) + 0.0 AS leverage FROM t")
def options_mark_to_market(spark, sf_dir):
    c = tables.chain(spark, sf_dir).withColumn("mean_price", F.col("iv"))
    return shown(options.mark_to_market(c, ["portfolio"], 1000.0), 3)


@query(f"WITH {CHAIN} SELECT round(strike, 2) + 0.0 AS strike, round(avg(iv) FILTER (days = 7), 6) + 0.0 AS \"7\", round(avg(iv) FILTER (days = 70), 6) + 0.0 AS \"70\", round(avg(iv) FILTER (days = 175), 6) + 0.0 AS \"175\" FROM ch GROUP BY strike")
def options_surface_pivot(spark, sf_dir):
    return shown(options.surface_pivot(tables.chain(spark, sf_dir), [7, 70, 175]))


@query(f"WITH {POSITIONS}, p AS (SELECT portfolio, sum(value) / 1000 AS delta, count(*) / 100 AS gamma, sum(abs(value)) / 1000 AS vega, (portfolio % 7) / 100 AS hd, (portfolio % 5) / 1000 AS hg, 0.4 AS hv FROM po GROUP BY portfolio) SELECT portfolio, round(CASE WHEN abs(hd) > 0.01 THEN -delta / hd END, 2) + 0.0 AS delta_hedge, round(CASE WHEN abs(hg) > 0.001 THEN -gamma / hg END, 2) + 0.0 AS gamma_hedge, round(-vega / hv, 2) + 0.0 AS vega_hedge FROM p")
def options_hedges(spark, sf_dir):
    p = positions(spark, sf_dir).groupBy("portfolio").agg((F.sum("value") / 1000).alias("delta"), (F.count(F.lit(1)) / 100).alias("gamma"), (F.sum(F.abs("value")) / 1000).alias("vega"))
    p = p.withColumn("hedge_delta", F.col("portfolio") % 7 / 100).withColumn("hedge_gamma", F.col("portfolio") % 5 / 1000).withColumn("hedge_vega", F.lit(0.4))
    return shown(options.hedge_quantities(p).select("portfolio", "delta_hedge", "gamma_hedge", "vega_hedge"), 2)


# --- text ---
@query(r"WITH w AS (SELECT source, (DATE '2024-01-01' + (doc_id % 60)::INT) AS day, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x IN ('rise', 'gain', 'strong', 'growth', 'up', 'the')) AS p, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x IN ('fall', 'loss', 'weak', 'down', 'of')) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT source, day, CASE WHEN len(p) + len(n) > 0 THEN (len(p) - len(n)) / (len(p) + len(n)) ELSE 0 END AS score FROM w), t AS (SELECT * FROM s WHERE (SELECT max(day) FROM s) - day < 30), d AS (SELECT source, day, avg(score) AS m FROM t GROUP BY ALL) SELECT t.source, round(avg(score), 6) + 0.0 AS mean, round(any_value(l.m), 6) + 0.0 AS latest, count(*) AS n FROM t JOIN (SELECT source, arg_max(m, day) AS m FROM d GROUP BY source) l ON l.source IS NOT DISTINCT FROM t.source GROUP BY t.source")
def sentiment_summary(spark, sf_dir):
    """With two frequent words among the lists, as the synthetic texts hold few of the finance words."""
    docs = tables.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    score = sentiment.lexicon_score(F.col("text"), ["rise", "gain", "strong", "growth", "up", "the"], ["fall", "loss", "weak", "down", "of"])
    news = docs.select("source", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("day"), score.alias("score"))
    return shown(sentiment.sentiment_summary(news, "source", "day", "score", 30))


# --- validation ---
@query(f"WITH {DAILY}, c AS (SELECT symbol, count(*) AS n FROM d GROUP BY symbol HAVING count(*) >= 130), f AS (SELECT symbol, n, unnest(range(0, 6)) AS fold FROM c) SELECT symbol, fold::INT AS fold, lo AS train_low, lo + 99 AS train_high, lo + 105 AS test_low, lo + 129 AS test_high FROM (SELECT symbol, fold, ((fold + 1) * 1103515245 + 12345) % 2147483648 % (n - 129) AS lo FROM f)")
def validation_drawn_folds(spark, sf_dir):
    return validation.drawn_folds(tables.daily(spark, sf_dir), ["symbol"], 6, 100, 25, 5)


@query(f"WITH {DAILY}, {RET}, x AS (SELECT symbol, row_number() OVER {W} - 1 AS i, ret AS y, lag(ret) OVER {W} AS x FROM r), fo AS (SELECT symbol, unnest(range(0, (count(*) - 315) // 63 + 1)) AS fold FROM x GROUP BY symbol HAVING count(*) >= 315), j AS (SELECT x.*, fold, i >= fold * 63 + 252 AS tested FROM x JOIN fo ON x.symbol = fo.symbol AND i BETWEEN 0 AND fold * 63 + 314 WHERE x IS NOT NULL AND y IS NOT NULL), l AS (SELECT symbol, fold, covar_samp(x, y) / nullif(var_samp(x), 0) AS b, avg(x) AS mx, avg(y) AS my FROM j WHERE NOT tested GROUP BY ALL), e AS (SELECT symbol, fold, avg((y - my - b * (x - mx)) ** 2) FILTER (NOT tested) AS a, avg((y - my - b * (x - mx)) ** 2) FILTER (tested) AS t FROM j JOIN l USING (symbol, fold) GROUP BY ALL) SELECT symbol, round(avg(a), 5) + 0.0 AS train, round(avg(t), 5) + 0.0 AS test, round(avg(t / a), 5) + 0.0 AS ratio, round(stddev_samp(t / a), 5) + 0.0 AS spread, round(CASE WHEN count(*) > 1 THEN regr_slope(t / a, fold) END, 5) + 0.0 AS trend, round(CASE WHEN count(*) > 1 THEN regr_r2(t / a, fold) END, 5) + 0.0 AS trend_r2 FROM e GROUP BY symbol")
def validation_overfit(spark, sf_dir):
    w = ordered(["symbol"], "day")
    d = returned(spark, sf_dir).select("symbol", "day", F.col("ret").alias("y"), F.lag("ret").over(w).alias("x"))
    rows = validation.fold_rows(d, validation.walk_forward(d, ["symbol"], 252, 63, 63), ["symbol"], ["day"]).filter("x IS NOT NULL AND y IS NOT NULL")
    return shown(validation.overfit(rows, ["symbol"], "x", "y"), 5)


@query(f"WITH {TRADES}, a AS (SELECT portfolio, round(avg(pnl), 6) AS mean, round(-stddev_samp(pnl), 6) AS calm FROM tr GROUP BY portfolio) SELECT portfolio, round(mean, 3) + 0.0 AS mean, round(calm, 3) + 0.0 AS calm FROM a x WHERE calm IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a y WHERE y.mean >= x.mean AND y.calm >= x.calm AND (y.mean > x.mean OR y.calm > x.calm))")
def sweep_pareto(spark, sf_dir):
    """Goals count to six digits: portfolios with the same trades are equal, in whatever order their trades were added up."""
    t = options.trade_pnl(tables.trades(spark, sf_dir)).groupBy("portfolio").agg(F.round(F.avg("pnl"), 6).alias("mean"), F.round(-F.stddev_samp("pnl"), 6).alias("calm"))
    return shown(validation.pareto(t.filter("calm IS NOT NULL"), "portfolio", "mean", "calm"), 3)

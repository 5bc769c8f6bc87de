"""Queries over the driver tables, one for each operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions import indicators, options, smoothing
from quantframe.functions.windows import ordered, returns
from quantframe.jobs.registry import query
from quantframe.operators import align, bars, clean, performance, regimes, risk, sentiment, signals, validation
from quantframe.sources import tables


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, days and times as text, so that rows compare across engines."""
    def one(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            return (F.round(c, digits) + 0.0).alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema.fields])


#: What lies this little below the middle of two shown values goes up too.
NUDGE = 2e-9


def settled(df: DataFrame) -> DataFrame:
    """Doubles nudged up by less than is shown: one halfway between two shown values, as sums of prices with few digits are, goes the same way whatever its last bits are."""
    return df.select(*[(F.col(f.name) + NUDGE).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


# --- the same derived tables, in SQL ---
TICKS = "t AS (SELECT user_id AS symbol, ts, event_id AS id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"
DAILY = """p AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS price, l_quantity AS q, row(l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS o FROM lineitem),
d AS (SELECT symbol, day, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, sum(q) AS volume FROM p GROUP BY ALL)"""
PANEL = """v AS (SELECT o_orderpriority AS strategy, CAST(date_trunc('week', o_orderdate) AS DATE) AS day, avg(o_totalprice) AS value FROM orders GROUP BY ALL),
s AS (SELECT * FROM (SELECT strategy, day, (value / lag(value) OVER (PARTITION BY strategy ORDER BY day) - 1) / 10 AS ret FROM v) WHERE ret IS NOT NULL)"""
TRADES = """tr AS (SELECT *, (CASE WHEN direction = 'long' THEN exit_price - entry_price ELSE entry_price - exit_price END) * quantity - commission AS pnl FROM (
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS trade_id, l_suppkey AS portfolio, l_linestatus AS strategy, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS direction, l_quantity AS quantity,
    l_extendedprice / l_quantity AS entry_price, l_extendedprice / l_quantity * (1 + l_tax - l_discount) AS exit_price, l_extendedprice * 0.001 AS commission, l_shipdate AS ts FROM lineitem))"""
CHAIN = """ch AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS contract, l_suppkey AS portfolio, p_partkey AS symbol, CAST(l_shipdate AS DATE) AS day, p_retailprice AS strike,
  CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS option_type, l_extendedprice / l_quantity AS spot, p_size * 7 AS days, l_discount * 3 + 0.1 AS iv, l_quantity AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey)"""
W = "(PARTITION BY symbol ORDER BY day)"
AT = "'%Y-%m-%d 00:00:00'"
TS = "'%Y-%m-%d %H:%M:%S'"


def r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c.rpartition('.')[2]}" for c in columns)


# --- bars ---
@query(f"WITH {TICKS} SELECT symbol, strftime(date_trunc('hour', ts), {TS}) AS bar, {r('open', 'high', 'low', 'close', 'volume')}, n FROM (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, row(ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, id)) AS close, sum(volume) AS volume, count(*) AS n FROM t GROUP BY symbol, date_trunc('hour', ts))")
def bars_hourly_ohlcv(spark, sf_dir):
    return shown(bars.time_bars(tables.ticks(spark, sf_dir), ["symbol"], "hour"))


@query(f"WITH {TICKS} SELECT symbol, strftime(b, {TS}) AS bar, {r('open', 'high', 'low', 'close', 'volume')}, n FROM (SELECT symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS b, arg_min(price, row(ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, id)) AS close, sum(volume) AS volume, count(*) AS n FROM t WHERE isodow(ts) < 6 GROUP BY ALL)")
def bars_half_hour_business_days(spark, sf_dir):
    return shown(bars.time_bars(tables.ticks(spark, sf_dir), ["symbol"], "30 minutes", business_days=True))


@query(f"WITH {DAILY} SELECT symbol, strftime(date_trunc('week', day) + INTERVAL 6 DAY, {AT}) AS bar, {r('close', 'volume', 'high', 'open')} FROM (SELECT symbol, date_trunc('week', day) AS day, arg_max(close, day) AS close, sum(volume) AS volume, median(high) AS high, stddev_samp(open) AS open FROM d GROUP BY symbol, date_trunc('week', day))")
def bars_weekly_resample(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    return shown(bars.resample(d, ["symbol"], "week", {"close": "last", "volume": "sum", "high": "median", "open": "std"}, ts="day", tie="day"))


@query(f"WITH {TICKS}, i AS (SELECT *, CAST(ts AS DATE) AS session_date FROM t WHERE isodow(ts) < 6 AND CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00'), e AS (SELECT * FROM i QUALIFY count(*) OVER (PARTITION BY symbol, session_date) >= 2) SELECT symbol, strftime(session_date, {AT}) AS session_date, strftime(b, {TS}) AS bar, {r('open', 'high', 'low', 'close', 'volume')}, n FROM (SELECT symbol, session_date, date_trunc('hour', ts) AS b, arg_min(price, row(ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, id)) AS close, sum(volume) AS volume, count(*) AS n FROM e GROUP BY ALL)")
def bars_trading_sessions(spark, sf_dir):
    return shown(bars.session_bars(tables.ticks(spark, sf_dir), ["symbol"], "09:30", "16:00", "hour", 2))


@query(f"WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) - 1 AS r FROM t), w AS (SELECT *, unnest(range(CAST(greatest(0, ceil((r - 19) / 10)) AS BIGINT), r // 10 + 1)) AS win FROM n) SELECT symbol, CAST(win AS INT) AS \"window\", {r('open', 'high', 'low', 'close', 'volume')}, strftime(s, {TS}) AS start, strftime(e, {TS}) AS \"end\", strftime(c, {TS}) AS centre, n FROM (SELECT symbol, win, arg_min(price, r) AS open, max(price) AS high, min(price) AS low, arg_max(price, r) AS close, sum(volume) AS volume, min(ts) AS s, max(ts) AS e, max(ts) FILTER (r = win * 10 + 10) AS c, count(*) AS n FROM w GROUP BY ALL) WHERE n = 20")
def bars_rolling_counts(spark, sf_dir):
    return shown(bars.count_windows(tables.ticks(spark, sf_dir), ["symbol"], 20, 0.5))


@query(f"WITH {TICKS}, m AS (SELECT *, CASE WHEN abs(price / nullif(lag(price) OVER w, 0) - 1) >= 0.5 THEN 1 ELSE 0 END AS e FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts, id)), b AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY symbol ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS event_bar FROM m) SELECT symbol, event_bar, {r('open', 'high', 'low', 'close', 'volume')}, strftime(s, {TS}) AS start, n FROM (SELECT symbol, event_bar, arg_min(price, row(ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, id)) AS close, sum(volume) AS volume, min(ts) AS s, count(*) AS n FROM b GROUP BY ALL)")
def bars_event_driven(spark, sf_dir):
    return shown(bars.event_bars(tables.ticks(spark, sf_dir), ["symbol"], 0.5))


@query(f"WITH RECURSIVE {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) AS r FROM t WHERE volume IS NOT NULL), w AS (SELECT symbol, r, 0 AS bar, volume AS held FROM n WHERE r = 1 UNION ALL SELECT n.symbol, n.r, CASE WHEN w.held >= 200 THEN w.bar + 1 ELSE w.bar END, CASE WHEN w.held >= 200 THEN n.volume ELSE w.held + n.volume END FROM w JOIN n ON n.symbol = w.symbol AND n.r = w.r + 1) SELECT symbol, bar::BIGINT AS volume_bar, {r('open', 'high', 'low', 'close', 'volume')}, n FROM (SELECT n.symbol, bar, arg_min(price, n.r) AS open, max(price) AS high, min(price) AS low, arg_max(price, n.r) AS close, sum(volume) AS volume, count(*) AS n FROM n JOIN w USING (symbol, r) GROUP BY n.symbol, bar)")
def bars_volume(spark, sf_dir):
    return shown(bars.volume_bars(tables.ticks(spark, sf_dir), ["symbol"], 200.0))


@query(f"WITH {TICKS} SELECT id, round(sum(price * volume) OVER w / nullif(sum(volume) OVER w, 0), 6) + 0.0 AS vwap FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING)")
def vwap_cumulative(spark, sf_dir):
    return shown(bars.vwap(tables.ticks(spark, sf_dir), ["symbol"]).select("id", "vwap"))


@query(f"WITH {TICKS}, m AS (SELECT *, price / nullif(lag(price) OVER (PARTITION BY symbol ORDER BY ts, id), 0) - 1 AS ret FROM t), v AS (SELECT *, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END AS vol FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts, id ROWS 19 PRECEDING)), q AS (SELECT symbol, quantile_cont(vol, 0.33) AS a, quantile_cont(vol, 0.67) AS b FROM v GROUP BY symbol) SELECT id, CASE WHEN vol <= a THEN 'low' WHEN vol >= b THEN 'high' ELSE 'medium' END AS volatility_regime FROM v JOIN q USING (symbol)")
def bars_volatility_buckets(spark, sf_dir):
    return bars.volatility_buckets(tables.ticks(spark, sf_dir), ["symbol"]).select("id", "volatility_regime")


@query(f"WITH {TICKS}, b AS (SELECT symbol, count(DISTINCT date_trunc('day', ts)) AS bars, count(*) AS rows FROM t GROUP BY symbol) SELECT symbol, rows, bars, round(rows / bars, 6) + 0.0 AS compression FROM b")
def bars_bucket_statistics(spark, sf_dir):
    t = tables.ticks(spark, sf_dir)
    return shown(bars.bucket_statistics(t, bars.time_bars(t, ["symbol"], "day"), ["symbol"]))


# --- alignment ---
CALENDAR = "c AS (SELECT symbol, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY symbol), cal AS (SELECT * FROM c WHERE isodow(day) < 6)"


@query(f"WITH {DAILY}, {CALENDAR} SELECT cal.symbol, strftime(cal.day, {AT}) AS day, {r('close', 'volume')} FROM cal LEFT JOIN d USING (symbol, day)")
def align_reindex_business_days(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    return shown(align.on_business_days(d, ["symbol"], ["close", "volume"]))


@query(f"WITH {DAILY}, {CALENDAR} SELECT cal.symbol, strftime(cal.day, {AT}) AS day, {r('close', 'volume')} FROM cal ASOF LEFT JOIN d ON cal.symbol = d.symbol AND cal.day >= d.day")
def align_as_of_business_days(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    return shown(align.on_business_days(d, ["symbol"], ["close", "volume"], carry=True))


@query(f"WITH {DAILY}, {CALENDAR}, j AS (SELECT cal.symbol, cal.day, close FROM cal LEFT JOIN d USING (symbol, day)), f AS (SELECT symbol, day, last_value(close IGNORE NULLS) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS forward, first_value(close IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS backward FROM j WINDOW w AS {W}) SELECT symbol, strftime(day, {AT}) AS day, {r('forward', 'backward')} FROM f")
def align_limited_fills(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    j = align.on_business_days(d, ["symbol"], ["close"])
    return shown(j.select("symbol", "day", align.fill(j, ["symbol"], ["day"], "close", "ffill", 5).alias("forward"), align.fill(j, ["symbol"], ["day"], "close", "bfill", 5).alias("backward")))


@query(f"WITH {DAILY}, {CALENDAR}, j AS (SELECT cal.symbol, cal.day, close, row_number() OVER (PARTITION BY cal.symbol ORDER BY cal.day) AS n FROM cal LEFT JOIN d USING (symbol, day)), k AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN row(n, close) END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS p, first_value(CASE WHEN close IS NOT NULL THEN row(n, close) END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM j) SELECT symbol, strftime(day, {AT}) AS day, round(CASE WHEN close IS NOT NULL THEN close WHEN q IS NULL THEN p[2] ELSE p[2] + (q[2] - p[2]) * (n - p[1]) / (q[1] - p[1]) END, 6) + 0.0 AS close FROM k")
def align_interpolate(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    j = align.on_business_days(d, ["symbol"], ["close"])
    return shown(align.interpolate(j, ["symbol"], ["day"], "close"))


@query(f"WITH {DAILY}, {CALENDAR}, b AS (SELECT cal.symbol, cal.day, d.day AS pd, d.close AS pc FROM cal ASOF LEFT JOIN d ON cal.symbol = d.symbol AND cal.day >= d.day), a AS (SELECT cal.symbol, cal.day, d.day AS qd, d.close AS qc FROM cal ASOF LEFT JOIN d ON cal.symbol = d.symbol AND cal.day <= d.day) SELECT symbol, strftime(day, {AT}) AS day, round(CASE WHEN qd IS NOT NULL AND (pd IS NULL OR qd - day <= day - pd) THEN qc ELSE pc END, 6) + 0.0 AS close FROM b JOIN a USING (symbol, day)")
def align_nearest_day(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    return shown(align.nearest(align.business_calendar(d, ["symbol"]), d, ["symbol"], "day", "close"))


@query(f"WITH {DAILY}, m AS (SELECT o_custkey % 10 + 1 AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, avg(o_totalprice) AS orders FROM orders GROUP BY ALL) SELECT d.symbol, strftime(d.day, {AT}) AS day, {r('close')}, round(orders, 4) + 0.0 AS macro_orders FROM d ASOF LEFT JOIN m ON d.symbol = m.symbol AND d.day >= m.day")
def align_macro_onto_daily(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    m = tables.read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10 + 1).alias("symbol"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("day")).agg(F.avg("o_totalprice").alias("orders"))
    macro = align.as_of(d.select("symbol", "day"), m, ["symbol"], "day", ["orders"], "macro_")
    return shown(d.select("symbol", "day", "close").join(macro, ["symbol", "day"]).select("symbol", "day", "close", F.round("macro_orders", 4).alias("macro_orders")))


@query(f"WITH {TICKS}, g AS (SELECT symbol, epoch(date_trunc('second', ts)) - lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM t), n AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL), m AS (SELECT symbol, gap AS mode_gap FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, gap) = 1), q AS (SELECT symbol, mode_gap, sum(CASE WHEN abs(gap - mode_gap) <= mode_gap * 0.1 THEN n ELSE 0 END) / sum(n) AS regularity FROM n JOIN m USING (symbol) GROUP BY ALL), a AS (SELECT symbol, count(*) AS n, avg(CASE WHEN hour(ts) BETWEEN 9 AND 16 THEN 1.0 ELSE 0.0 END) AS business_hours, avg(CASE WHEN isodow(ts) > 5 THEN 1.0 ELSE 0.0 END) AS weekends FROM t GROUP BY symbol) SELECT symbol, n, mode_gap::BIGINT AS mode_gap, {r('regularity', 'business_hours', 'weekends')}, CASE WHEN mode_gap <= 60 THEN 'tick' WHEN mode_gap <= 3600 THEN 'minute' WHEN mode_gap <= 86400 THEN 'hourly' WHEN mode_gap <= 604800 THEN 'daily' WHEN mode_gap <= 2678400 THEN 'weekly' WHEN mode_gap <= 8035200 THEN 'monthly' WHEN mode_gap IS NOT NULL THEN 'annual' ELSE 'annual' END AS frequency FROM a LEFT JOIN q USING (symbol)")
def align_temporal_profile(spark, sf_dir):
    return shown(align.profile(tables.ticks(spark, sf_dir), ["symbol"], "ts").select("symbol", "n", "mode_gap", "regularity", "business_hours", "weekends", "frequency"))


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


@query(f"WITH {PANEL} SELECT strftime(day, {AT}) AS day, {', '.join(f"round(max(ret) FILTER (strategy = '{k}'), 6) + 0.0 AS {v}" for k, v in PRIORITIES.items())} FROM s GROUP BY day")
def join_pivot_series(spark, sf_dir):
    p = align.pivot_series(tables.panel(spark, sf_dir), "day", "strategy", "ret", list(PRIORITIES))
    return shown(p.select("day", *[F.col(k).alias(v) for k, v in PRIORITIES.items()]))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1")
def clean_last_per_timestamp(spark, sf_dir):
    line = tables.read(spark, sf_dir, "lineitem").withColumn("tie", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return align.last_per_timestamp(line, ["l_suppkey"], "l_shipdate", "tie").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


# --- cleaning ---
@query(f"WITH {DAILY}, q AS (SELECT symbol, quantile_cont(volume, 0.25) AS a, quantile_cont(volume, 0.75) AS b FROM d GROUP BY symbol) SELECT symbol, strftime(day, {AT}) AS day, round(greatest(least(volume, b + 2 * (b - a)), a - 2 * (b - a)), 6) + 0.0 AS volume FROM d JOIN q USING (symbol)")
def clean_cap_outliers(spark, sf_dir):
    return shown(clean.cap_outliers(tables.daily(spark, sf_dir).select("symbol", "day", "volume"), ["symbol"], "volume"))


@query(f"WITH {DAILY}, q AS (SELECT symbol, avg(volume) AS m, stddev_samp(volume) AS s FROM d GROUP BY symbol) SELECT symbol, strftime(day, {AT}) AS day, {r('volume')} FROM d JOIN q USING (symbol) WHERE abs(volume - m) <= 1.5 * s")
def clean_drop_outliers(spark, sf_dir):
    return shown(clean.drop_outliers(tables.daily(spark, sf_dir).select("symbol", "day", "volume"), ["symbol"], ["volume"], 1.5))


@query(f"WITH {DAILY}, q AS (SELECT symbol, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.5) AS b, quantile_cont(close, 0.75) AS c, avg(close) AS m, stddev_pop(close) AS s FROM d GROUP BY symbol) SELECT symbol, strftime(day, {AT}) AS day, round((close - b) / CASE WHEN c = a THEN 1 ELSE c - a END, 6) + 0.0 AS robust, round((close - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS standard FROM d JOIN q USING (symbol)")
def clean_scale(spark, sf_dir):
    d = tables.daily(spark, sf_dir).select("symbol", "day", "close")
    both = clean.scale(clean.scale(d, ["symbol"], "close", robust=True).withColumnRenamed("scaled", "robust"), ["symbol"], "close")
    return shown(both.select("symbol", "day", "robust", F.col("scaled").alias("standard")))


@query("SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def clean_label_codes(spark, sf_dir):
    return clean.label_codes(tables.read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "p_brand", F.col("code").cast("long").alias("code"))


@query("SELECT 'l_quantity' AS \"column\", 0.0 AS null_share, count(DISTINCT l_quantity) AS \"distinct\", min(l_quantity) AS least, max(l_quantity) AS greatest, round(var_samp(l_quantity), 4) AS variance FROM lineitem UNION ALL SELECT 'l_discount', 0.0, count(DISTINCT l_discount), min(l_discount), max(l_discount), round(var_samp(l_discount), 4) FROM lineitem")
def clean_column_quality(spark, sf_dir):
    return shown(clean.column_quality(tables.read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"]), 4)


@query(f"WITH {DAILY}, x AS (SELECT corr(close, high) AS ch, corr(close, volume) AS cv, corr(high, volume) AS hv FROM d) SELECT 'close' AS a, 'high' AS b, round(ch, 6) AS corr FROM x UNION ALL SELECT 'close', 'volume', round(cv, 6) FROM x UNION ALL SELECT 'high', 'volume', round(hv, 6) FROM x")
def select_correlations(spark, sf_dir):
    return shown(clean.correlations(tables.daily(spark, sf_dir), ["close", "high", "volume"]))


@query(f"WITH {DAILY}, x AS (SELECT corr(open, close) AS a, corr(volume, close) AS b, count(*) AS n FROM d) SELECT 'open' AS feature, round(a * a / (1 - a * a) * (n - 2), 4) + 0.0 AS score FROM x UNION ALL SELECT 'volume', round(b * b / (1 - b * b) * (n - 2), 4) + 0.0 FROM x")
def select_f_scores(spark, sf_dir):
    return shown(clean.f_scores(tables.daily(spark, sf_dir), ["open", "volume"], "close"), 4)


@query(f"WITH {DAILY}, m AS (SELECT symbol, volume, abs(close / nullif(lag(close) OVER {W}, 0) - 1) AS move FROM d) SELECT symbol, round(avg(CASE WHEN volume > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS positive_volume, round(coalesce(avg(CASE WHEN move > 0.5 THEN 1.0 WHEN move IS NOT NULL THEN 0.0 END), 0), 6) + 0.0 AS large_moves, 0::BIGINT AS repeated_times FROM m GROUP BY symbol")
def clean_integrity(spark, sf_dir):
    return shown(clean.integrity(tables.daily(spark, sf_dir), ["symbol"], ["day"], "close", "volume"))


# --- indicators ---
def mean(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER (PARTITION BY symbol ORDER BY day ROWS {n - 1} PRECEDING) >= {n} THEN avg({c}) OVER (PARTITION BY symbol ORDER BY day ROWS {n - 1} PRECEDING) END"


def dev(c: str, n: int, kind: str = "samp") -> str:
    return f"CASE WHEN count({c}) OVER (PARTITION BY symbol ORDER BY day ROWS {n - 1} PRECEDING) >= {n} THEN stddev_{kind}({c}) OVER (PARTITION BY symbol ORDER BY day ROWS {n - 1} PRECEDING) END"


RET = f"r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret, ln(close / nullif(lag(close) OVER {W}, 0)) AS log_ret FROM d)"


@query(f"WITH {DAILY}, {RET}, f AS (SELECT symbol, day, ret, log_ret, {dev('ret', 10)} * sqrt(252) AS vol_10, {dev('ret', 20)} * sqrt(252) AS vol_20, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING) >= 20 THEN sqrt(avg(ln(high / low) ** 2) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING) * (252 / (4 * ln(2)))) END AS parkinson, {mean('close', 20)} AS sma_20, {mean('close', 50)} AS sma_50, close, close / nullif(lag(close, 10) OVER {W}, 0) - 1 AS momentum_10, close / nullif(lag(close, 20) OVER {W}, 0) - 1 AS momentum_20, volume / ({mean('volume', 20)}) AS volume_ratio FROM r) SELECT symbol, strftime(day, {AT}) AS day, {r('ret', 'log_ret', 'vol_10', 'vol_20', 'parkinson', 'sma_20', 'sma_50', 'momentum_10', 'momentum_20', 'volume_ratio')}, round(close / sma_20 - 1, 6) + 0.0 AS sma_distance, round(sign(sma_20 - sma_50), 6) + 0.0 AS crossover FROM f")
def indicators_features(spark, sf_dir):
    f = indicators.features(tables.daily(spark, sf_dir), ["symbol"], ["day"])
    return shown(f.drop("open", "high", "low", "close", "volume"))


@query(f"WITH {DAILY}, s AS (SELECT *, close - lag(close) OVER {W} AS step FROM d), g AS (SELECT symbol, day, count(step) OVER w AS n, avg(greatest(step, 0)) FILTER (step IS NOT NULL) OVER w AS gain, avg(greatest(-step, 0)) FILTER (step IS NOT NULL) OVER w AS loss FROM s WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 13 PRECEDING)) SELECT symbol, strftime(day, {AT}) AS day, round(CASE WHEN n < 14 THEN NULL WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END, 6) + 0.0 AS rsi FROM g")
def indicators_rsi(spark, sf_dir):
    return shown(indicators.rsi(tables.daily(spark, sf_dir), ["symbol"], ["day"]).select("symbol", "day", "rsi"))


@query(f"WITH {DAILY}, b AS (SELECT symbol, day, close, {mean('close', 20)} AS m, 2 * ({dev('close', 20, 'pop')}) AS w FROM d) SELECT symbol, strftime(day, {AT}) AS day, round(m, 6) + 0.0 AS bb_middle, round(m + w, 6) + 0.0 AS bb_upper, round(m - w, 6) + 0.0 AS bb_lower, round(CASE WHEN w <> 0 THEN (close - m + w) / (2 * w) END, 6) + 0.0 AS bb_position FROM b")
def indicators_bollinger(spark, sf_dir):
    return shown(indicators.bollinger(tables.daily(spark, sf_dir), ["symbol"], ["day"]).select("symbol", "day", "bb_middle", "bb_upper", "bb_lower", "bb_position"))


@query(f"WITH {DAILY}, k AS (SELECT symbol, day, volume, list(volume) OVER (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING) AS h FROM d) SELECT symbol, strftime(day, {AT}) AS day, round(CASE WHEN len(h) = 30 THEN (len(list_filter(h, lambda x: x < volume)) + (len(list_filter(h, lambda x: x = volume)) + 1) / 2) / 30 END, 6) + 0.0 AS rank FROM k")
def indicators_volatility_rank(spark, sf_dir):
    return shown(indicators.volatility_rank(tables.daily(spark, sf_dir), ["symbol"], ["day"], "volume", 30).select("symbol", "day", "rank"))


@query(f"WITH {DAILY}, f AS (SELECT symbol, day, lead(close, 1) OVER {W} / close - 1 AS fwd_1, lead(close, 5) OVER {W} / close - 1 AS fwd_5, lead(close, 20) OVER {W} / close - 1 AS fwd_20 FROM d) SELECT symbol, strftime(day, {AT}) AS day, {r('fwd_1', 'fwd_5', 'fwd_20')}, CASE WHEN fwd_1 > 0.02 THEN 1 WHEN fwd_1 < -0.02 THEN -1 WHEN fwd_1 IS NOT NULL THEN 0 END::INT AS target FROM f")
def indicators_forward_returns(spark, sf_dir):
    return shown(indicators.forward_returns(tables.daily(spark, sf_dir), ["symbol"], ["day"]).select("symbol", "day", "fwd_1", "fwd_5", "fwd_20", "target"))


@query(f"WITH {DAILY}, {RET}, g AS (SELECT symbol, day, log_ret, CASE WHEN ({mean('close', 10)}) > ({mean('close', 30)}) THEN 1 ELSE 0 END AS s FROM r), h AS (SELECT symbol, log_ret * lag(s) OVER {W} AS gain FROM g) SELECT symbol, round(sum(gain), 6) + 0.0 AS total, round(stddev_samp(gain) * sqrt(252), 6) + 0.0 AS volatility, round(CASE WHEN stddev_samp(gain) <> 0 THEN avg(gain) / stddev_samp(gain) * sqrt(252) END, 6) + 0.0 AS sharpe, count(*) AS n FROM h WHERE gain IS NOT NULL GROUP BY symbol")
def backtest_crossover(spark, sf_dir):
    return shown(indicators.crossover_backtest(tables.daily(spark, sf_dir), ["symbol"], ["day"]))


# --- regimes ---
@query(f"WITH {DAILY}, {RET}, v AS (SELECT symbol, day, ret, {dev('ret', 20)} AS vol FROM r), q AS (SELECT symbol, quantile_cont(vol, 0.33) AS a, quantile_cont(vol, 0.67) AS b FROM v GROUP BY symbol), g AS (SELECT symbol, day, ret, CASE WHEN vol > b THEN 2 WHEN vol > a THEN 1 ELSE 0 END AS regime FROM v JOIN q USING (symbol)), i AS (SELECT *, row_number() OVER {W} - row_number() OVER (PARTITION BY symbol, regime ORDER BY day) AS island FROM g), l AS (SELECT symbol, regime, avg(n) AS mean_run FROM (SELECT symbol, regime, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY ALL), s AS (SELECT symbol, regime, count(*) AS n, avg(ret) * 252 AS annual_return, stddev_samp(ret) * sqrt(252) AS volatility FROM g GROUP BY ALL) SELECT symbol, regime::INT AS regime, n, {r('annual_return', 'volatility', 'mean_run', digits=4)}, round(n / sum(n) OVER (PARTITION BY symbol), 4) + 0.0 AS frequency, round(CASE WHEN volatility <> 0 THEN annual_return / volatility END, 4) + 0.0 AS sharpe FROM s JOIN l USING (symbol, regime)")
def regimes_statistics(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    d = d.withColumn("ret", returns("close", ordered(["symbol"], "day")))
    w = ordered(["symbol"], "day").rowsBetween(-19, 0)
    d = d.withColumn("vol", F.when(F.count("ret").over(w) >= 20, F.stddev_samp("ret").over(w)))
    return shown(regimes.regime_statistics(regimes.volatility_regimes(d, ["symbol"], "vol"), ["symbol"], ["day"]), 4)


@query(f"WITH {DAILY}, m AS (SELECT symbol, day, close, {mean('close', 20)} AS a FROM d), g AS (SELECT symbol, day, CASE WHEN close / a - 1 > 0.02 THEN 1 WHEN close / a - 1 < -0.02 THEN -1 ELSE 0 END AS regime FROM m), n AS (SELECT regime, lead(regime) OVER {W} AS next FROM g), c AS (SELECT regime, next, count(*) AS n FROM n WHERE next IS NOT NULL GROUP BY ALL) SELECT regime::INT AS regime, next::INT AS next, n, round(n / sum(n) OVER (PARTITION BY regime), 6) + 0.0 AS share FROM c")
def regimes_trend_transitions(spark, sf_dir):
    d = tables.daily(spark, sf_dir).withColumn("mean", indicators.sma("close", ["symbol"], ["day"], 20))
    t = regimes.trend_regimes(d, "close", "mean").withColumnRenamed("trend", "regime")
    return shown(regimes.transitions(t, ["symbol"], ["day"]))


# --- options ---
def tail_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = "0.0"
    for c in reversed(options.TAIL):
        poly = f"(({poly} + {c}) * {t})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {poly} ELSE exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {poly} END)"


GREEKS = f"""a AS (SELECT *, days / 365 AS y, (ln(spot / strike) + (0.02 + iv * iv / 2) * (days / 365)) / (iv * sqrt(days / 365)) AS d1 FROM ch), b AS (SELECT *, d1 - iv * sqrt(y) AS d2, exp(-0.02 * y) AS df, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM a),
n AS (SELECT *, {tail_sql('d1')} AS n1, {tail_sql('d2')} AS n2 FROM b),
g AS (SELECT *, greatest(0, CASE WHEN option_type = 'call' THEN spot * n1 - strike * df * n2 ELSE spot * n1 - strike * df * n2 - spot + strike * df END) AS price, CASE WHEN option_type = 'call' THEN n1 ELSE n1 - 1 END AS delta, pdf / (spot * iv * sqrt(y)) AS gamma,
  (-spot * pdf * iv / (2 * sqrt(y)) - CASE WHEN option_type = 'call' THEN 0.02 * strike * df * n2 ELSE -0.02 * strike * df * (1 - n2) END) / 365 AS theta, spot * pdf * sqrt(y) / 100 AS vega, strike * y * df * CASE WHEN option_type = 'call' THEN n2 ELSE n2 - 1 END / 100 AS rho FROM n)"""


def dated(spark, sf_dir):
    return tables.chain(spark, sf_dir).withColumn("years", F.col("days") / 365)


def greeks(spark, sf_dir):
    return options.with_greeks(dated(spark, sf_dir))


@query(f"WITH {CHAIN}, {GREEKS} SELECT contract, {r('price', 'delta', 'gamma', 'theta', 'vega', 'rho')} FROM g")
def options_greeks(spark, sf_dir):
    return shown(greeks(spark, sf_dir).select("contract", "price", "delta", "gamma", "theta", "vega", "rho"))


@query(f"WITH {CHAIN}, {GREEKS}, p AS (SELECT portfolio, sum(delta * quantity) AS delta, sum(gamma * quantity) AS gamma, sum(theta * quantity) AS theta, sum(vega * quantity) AS vega, sum(rho * quantity) AS rho, sum(delta * quantity * spot * 100) AS dollar_delta, sum(gamma * quantity * spot * 100) AS dollar_gamma, sum(theta * quantity * 100) AS dollar_theta, sum(vega * quantity * 100) AS dollar_vega FROM g GROUP BY portfolio) SELECT portfolio, {r('delta', 'gamma', 'theta', 'vega', 'rho', 'dollar_delta', 'dollar_gamma', 'dollar_theta', 'dollar_vega', digits=3)} FROM p")
def options_portfolio_greeks(spark, sf_dir):
    return shown(options.portfolio_greeks(greeks(spark, sf_dir), ["portfolio"]), 3)


DAYS, MONEY = [7.0, 90.0, 180.0, 270.0, 365.0], [0.2, 0.6, 0.9, 1.1, 1.4, 2.0]


def bin_sql(x: str, edges: list[float]) -> str:
    return "(" + " + ".join(f"CASE WHEN {x} > {e} THEN 1 ELSE 0 END" for e in edges) + " - 1)"


@query(f"WITH {CHAIN}, x AS (SELECT iv, days, spot / strike AS moneyness, {bin_sql('days', DAYS)} AS day_bin, {bin_sql('spot / strike', MONEY)} AS moneyness_bin FROM ch) SELECT day_bin::INT AS day_bin, moneyness_bin::INT AS moneyness_bin, round(avg(iv), 6) + 0.0 AS mean_iv, count(*) AS n, round(avg(moneyness), 6) + 0.0 AS mean_moneyness, round(avg(days), 6) + 0.0 AS mean_days FROM x WHERE day_bin BETWEEN 0 AND 3 AND moneyness_bin BETWEEN 0 AND 4 GROUP BY ALL")
def options_volatility_surface(spark, sf_dir):
    return shown(options.surface(tables.chain(spark, sf_dir), DAYS, MONEY))


@query(f"WITH {TRADES} SELECT trade_id, round(pnl, 6) + 0.0 AS pnl FROM tr")
def trades_pnl(spark, sf_dir):
    return shown(options.trade_pnl(tables.trades(spark, sf_dir)).select("trade_id", "pnl"))


@query(f"WITH {TRADES}, a AS (SELECT portfolio, strategy, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl) FILTER (pnl > 0) AS mean_win, avg(pnl) FILTER (pnl <= 0) AS mean_loss, avg(pnl) AS expectancy, abs(sum(pnl) FILTER (pnl > 0) / nullif(sum(pnl) FILTER (pnl <= 0), 0)) AS profit_factor FROM tr GROUP BY ALL) SELECT portfolio, strategy, trades, {r('win_rate', 'mean_win', 'mean_loss', 'expectancy', 'profit_factor', digits=4)}, round(win_rate - (1 - win_rate) / nullif(abs(mean_win / nullif(mean_loss, 0)), 0), 4) + 0.0 AS kelly FROM a")
def performance_trade_statistics(spark, sf_dir):
    return shown(performance.trade_statistics(options.trade_pnl(tables.trades(spark, sf_dir)), ["portfolio", "strategy"]), 4)


@query(f"WITH {TRADES} SELECT portfolio, strftime(date_trunc('month', ts), {AT}) AS month, round(sum(pnl), 2) + 0.0 AS pnl, round(sum(commission), 2) + 0.0 AS commission, count(*) AS trades FROM tr GROUP BY portfolio, date_trunc('month', ts)")
def performance_monthly_pnl(spark, sf_dir):
    return shown(performance.monthly_pnl(options.trade_pnl(tables.trades(spark, sf_dir)), ["portfolio"]), 2)


# --- performance ---
@query(f"WITH {PANEL}, a AS (SELECT strategy, count(*) AS n, exp(sum(ln(1 + ret))) - 1 AS total, avg(ret) AS m, stddev_samp(ret) AS s, stddev_samp(ret) FILTER (ret < 0) AS z, stddev_samp(ret) FILTER (ret < 0.02 / 252) AS d FROM s GROUP BY strategy) SELECT strategy, n, {r('total')}, round((1 + total) ** (252 / n) - 1, 6) + 0.0 AS annual, round(s * sqrt(252), 6) + 0.0 AS volatility, round(z * sqrt(252), 6) + 0.0 AS downside, round((m - 0.02 / 252) / s * sqrt(252), 6) + 0.0 AS sharpe, round((m - 0.02 / 252) / d * sqrt(252), 6) + 0.0 AS sortino FROM a")
def performance_basic(spark, sf_dir):
    return shown(performance.basic(tables.panel(spark, sf_dir), ["strategy"]))


EQUITY = "e AS (SELECT strategy, day, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY day)) AS equity FROM s), dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY strategy ORDER BY day) - 1 AS drawdown FROM e)"


@query(f"WITH {PANEL}, {EQUITY} SELECT strategy, round(min(drawdown), 6) + 0.0 AS deepest, round(avg(drawdown) FILTER (drawdown < 0), 6) + 0.0 AS mean, round(arg_max(drawdown, day), 6) + 0.0 AS current, round(sqrt(sum(drawdown * drawdown)), 6) + 0.0 AS burke_root FROM dd GROUP BY strategy")
def performance_drawdowns(spark, sf_dir):
    return shown(performance.drawdown_summary(tables.panel(spark, sf_dir), ["strategy"], ["day"]))


@query(f"WITH {PANEL}, {EQUITY}, m AS (SELECT *, lag(day) OVER w AS b, lead(day) OVER w AS a, sum(CASE WHEN drawdown >= 0 THEN 1 ELSE 0 END) OVER w AS period FROM dd WINDOW w AS (PARTITION BY strategy ORDER BY day)) SELECT strategy, period::BIGINT AS period, strftime(arg_min(b, day), {AT}) AS peak, strftime(arg_min(day, row(drawdown, day)), {AT}) AS trough, strftime(arg_max_null(a, day), {AT}) AS recovery, round(min(drawdown), 6) + 0.0 AS depth, count(*) AS n FROM m WHERE drawdown < 0 GROUP BY strategy, period HAVING arg_max_null(a, day) IS NOT NULL")
def performance_drawdown_periods(spark, sf_dir):
    return shown(performance.drawdown_periods(tables.panel(spark, sf_dir), ["strategy"], "day"))


@query(f"WITH {PANEL}, q AS (SELECT strategy, quantile_cont(ret, 0.05) AS a, quantile_cont(ret, 0.01) AS b, quantile_cont(ret, 0.95) AS c FROM s GROUP BY strategy), z AS (SELECT s.strategy, ret, a, b, c, ret - avg(ret) OVER (PARTITION BY s.strategy) AS u FROM s JOIN q ON s.strategy = q.strategy) SELECT strategy, round(avg(u ** 3) / avg(u ** 2) ** 1.5, 6) + 0.0 AS skew, round(avg(u ** 4) / avg(u ** 2) ** 2 - 3, 6) + 0.0 AS kurtosis, round(first(a), 6) + 0.0 AS var_95, round(first(b), 6) + 0.0 AS var_99, round(avg(ret) FILTER (ret <= a), 6) + 0.0 AS cvar_95, round(avg(ret) FILTER (ret <= b), 6) + 0.0 AS cvar_99, round(abs(first(c) / first(a)), 6) + 0.0 AS tail_ratio FROM z GROUP BY strategy")
def performance_distribution(spark, sf_dir):
    return shown(performance.distribution(tables.panel(spark, sf_dir), ["strategy"]))


@query(f"WITH {PANEL}, k AS (SELECT day, avg(ret) AS b FROM s GROUP BY day), j AS (SELECT strategy, ret, b FROM s JOIN k USING (day)), a AS (SELECT strategy, covar_samp(ret, b) / var_pop(b) AS beta, avg(ret) AS mr, avg(b) AS mb, stddev_samp(ret - b) AS te, corr(ret, b) AS correlation, avg(ret) FILTER (b > 0) / avg(b) FILTER (b > 0) AS up_capture, avg(ret) FILTER (b < 0) / avg(b) FILTER (b < 0) AS down_capture FROM j GROUP BY strategy) SELECT strategy, {r('beta', 'correlation', 'up_capture', 'down_capture')}, round((mr - 0.02 / 252 - beta * (mb - 0.02 / 252)) * 252, 6) + 0.0 AS alpha, round(te * sqrt(252), 6) + 0.0 AS tracking_error, round((mr - mb) / te * sqrt(252), 6) + 0.0 AS information_ratio FROM a")
def performance_against_benchmark(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return shown(performance.against_benchmark(p, p.groupBy("day").agg(F.avg("ret").alias("ret")), ["strategy"], "day"))


@query(f"WITH {PANEL} SELECT strategy, strftime(day, {AT}) AS day, round(CASE WHEN count(ret) OVER w >= 52 AND stddev_samp(ret) OVER w <> 0 THEN avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252) END, 6) + 0.0 AS rolling_sharpe FROM s WINDOW w AS (PARTITION BY strategy ORDER BY day ROWS 51 PRECEDING)")
def performance_rolling_sharpe(spark, sf_dir):
    return shown(performance.rolling_sharpe(tables.panel(spark, sf_dir), ["strategy"], ["day"]).select("strategy", "day", "rolling_sharpe"))


# --- risk ---
def weights(spark, sf_dir):
    """A strategy's weight: its share of all orders."""
    return tables.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.count(F.lit(1)).alias("n")).select("strategy", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("weight"))


WEIGHTS = "wt AS (SELECT o_orderpriority AS strategy, count(*) / sum(count(*)) OVER () AS weight FROM orders GROUP BY o_orderpriority)"


@query(f"WITH {PANEL}, {WEIGHTS} SELECT strftime(day, {AT}) AS day, round(sum(weight * ret) / (SELECT sum(weight) FROM wt), 6) + 0.0 AS ret FROM s JOIN wt USING (strategy) GROUP BY day")
def risk_portfolio_returns(spark, sf_dir):
    return shown(risk.portfolio_returns(tables.panel(spark, sf_dir), weights(spark, sf_dir)))


@query(f"WITH {PANEL}, {WEIGHTS}, a AS (SELECT strategy, exp(sum(ln(1 + ret))) - 1 AS total, stddev_samp(ret) AS sd, avg(ret) AS m FROM s GROUP BY strategy) SELECT strategy, {r('weight', 'total')}, round(weight * total, 6) + 0.0 AS contribution, round(sd * sqrt(252), 6) + 0.0 AS volatility, round(m / sd * sqrt(252), 6) + 0.0 AS sharpe FROM a JOIN wt USING (strategy)")
def risk_attribution(spark, sf_dir):
    return shown(risk.attribution(tables.panel(spark, sf_dir), weights(spark, sf_dir)))


@query(f"WITH {PANEL}, l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY day DESC) <= 252), q AS (SELECT strategy, quantile_cont(ret, 0.05) AS q FROM l GROUP BY strategy), z AS (SELECT l.strategy, ret, q, ret - avg(ret) OVER (PARTITION BY l.strategy) AS u FROM l JOIN q ON l.strategy = q.strategy), a AS (SELECT strategy, count(*) AS n, first(q) AS q, avg(ret) AS m, stddev_samp(ret) AS s, avg(u ** 3) / avg(u ** 2) ** 1.5 AS g, avg(u ** 4) / avg(u ** 2) ** 2 - 3 AS k, avg(ret) FILTER (ret <= q) AS beyond FROM z GROUP BY strategy), b AS (SELECT *, -1.6448536269514722 AS zz, g * sqrt(n * (n - 1)) / (n - 2) AS sk, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6) AS ku FROM a) SELECT strategy, round(-q, 6) + 0.0 AS historical, round(-(m + zz * s), 6) + 0.0 AS parametric, round(-(m + (zz + (zz ** 2 - 1) * sk / 6 + (zz ** 3 - 3 * zz) * ku / 24 - (2 * zz ** 3 - 5 * zz) * sk * sk / 36) * s), 6) + 0.0 AS cornish_fisher, round(-q * sqrt(5), 6) + 0.0 AS weekly, round(-beyond, 6) + 0.0 AS shortfall FROM b")
def risk_value_at_risk(spark, sf_dir):
    return shown(risk.value_at_risk(tables.panel(spark, sf_dir), ["strategy"], "day"))


@query(f"WITH {PANEL} SELECT x.strategy AS a, y.strategy AS b, round(corr(x.ret, y.ret), 6) + 0.0 AS corr, count(*) AS n FROM s x JOIN s y ON x.day = y.day AND x.strategy < y.strategy GROUP BY ALL HAVING count(*) >= 60")
def risk_correlations(spark, sf_dir):
    return shown(risk.correlation_table(tables.panel(spark, sf_dir), "strategy", "day"))


POSITIONS = "po AS (SELECT l_suppkey AS portfolio, l_partkey AS position, sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS value FROM lineitem GROUP BY ALL)"


def positions(spark, sf_dir):
    line = tables.read(spark, sf_dir, "lineitem")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return line.groupBy(F.col("l_suppkey").alias("portfolio"), F.col("l_partkey").alias("position")).agg(F.sum(signed).alias("value"))


@query(f"WITH {POSITIONS}, t AS (SELECT portfolio, sum(abs(value)) AS exposure, max(abs(value)) / sum(abs(value)) AS concentration, count(*) AS positions FROM po GROUP BY portfolio), u AS (SELECT portfolio, 'exposure' AS kind, exposure AS value, 14000000.0 AS most FROM t UNION ALL SELECT portfolio, 'concentration', concentration, 0.01 FROM t UNION ALL SELECT portfolio, 'positions', positions, 520.0 FROM t) SELECT portfolio, kind, round(value, 2) + 0.0 AS value, round(most, 2) + 0.0 AS most, round(value / most * 100, 2) + 0.0 AS percent FROM u WHERE value > most")
def risk_limit_breaches(spark, sf_dir):
    return shown(risk.position_breaches(positions(spark, sf_dir), ["portfolio"], {"exposure": 14_000_000.0, "concentration": 0.01, "positions": 520.0}), 2)


@query(f"WITH {POSITIONS} SELECT portfolio, position, round(value, 2) + 0.0 AS value, n::INT AS turn, round(value * 0.8, 2) + 0.0 AS reduced FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY abs(value) DESC, position) AS n FROM po) WHERE n <= 3")
def risk_largest_positions(spark, sf_dir):
    return shown(risk.largest_positions(positions(spark, sf_dir), ["portfolio"]), 2)


@query(f"WITH {TRADES}, a AS (SELECT strategy, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS p, abs(avg(pnl) FILTER (pnl > 0) / avg(pnl) FILTER (pnl <= 0)) AS b, stddev_samp(pnl / (entry_price * quantity)) AS v FROM tr GROUP BY strategy) SELECT strategy, round(greatest(0, least(0.25, (b * p - (1 - p)) / b)), 6) + 0.0 AS share, round(least(greatest(0, least(0.25, (b * p - (1 - p)) / b)) * 100000, 2000 / v), 6) + 0.0 AS position FROM a")
def sizing_kelly(spark, sf_dir):
    t = options.trade_pnl(tables.trades(spark, sf_dir))
    vol = t.groupBy("strategy").agg(F.stddev_samp(F.col("pnl") / (F.col("entry_price") * F.col("quantity"))).alias("volatility"))
    stats = performance.trade_statistics(t, ["strategy"]).join(vol, "strategy")
    return shown(risk.kelly_sizes(stats, 100_000.0).select("strategy", "share", "position"))


@query("WITH q AS (SELECT l_suppkey AS portfolio, l_orderkey AS o, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN -round(l_quantity / 10) ELSE round(l_quantity / 10) END AS quantity, l_extendedprice / l_quantity AS price FROM lineitem), a AS (SELECT *, sum(quantity) OVER (PARTITION BY portfolio ORDER BY o, n, price, quantity ROWS UNBOUNDED PRECEDING) AS net FROM q), b AS (SELECT *, coalesce(sum(CASE WHEN net = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio ORDER BY o, n, price, quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS book FROM a) SELECT portfolio, o, n, round(net, 4) + 0.0 AS net, round(CASE WHEN net <> 0 THEN sum(quantity * price) OVER (PARTITION BY portfolio, book ORDER BY o, n, price, quantity ROWS UNBOUNDED PRECEDING) / net END, 3) + 0.0 AS mean_price FROM b")
def trades_position_book(spark, sf_dir):
    line = tables.read(spark, sf_dir, "lineitem")
    size = F.round(F.col("l_quantity") / 10)
    t = line.select(F.col("l_suppkey").alias("portfolio"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "R", -size).otherwise(size).alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return shown(risk.average_cost(t, ["portfolio"], ["o", "n", "price", "quantity"]).select("portfolio", "o", "n", "net", "mean_price"), 3)


# --- validation ---
@query(f"WITH {DAILY}, c AS (SELECT symbol, count(*) AS n FROM d GROUP BY symbol HAVING count(*) >= 315), f AS (SELECT symbol, unnest(range(0, (n - 315) // 21 + 1)) AS fold FROM c) SELECT symbol, fold::INT AS fold, 0 AS train_low, (fold * 21 + 251)::INT AS train_high, (fold * 21 + 252)::INT AS test_low, (fold * 21 + 314)::INT AS test_high FROM f")
def validation_walk_forward(spark, sf_dir):
    return validation.walk_forward(tables.daily(spark, sf_dir), ["symbol"], 252, 63, 21)


@query(f"WITH {DAILY}, {RET}, x AS (SELECT symbol, row_number() OVER {W} - 1 AS i, ret AS y, lag(ret) OVER {W} AS x FROM r), f AS (SELECT symbol, unnest(range(0, (count(*) - 315) // 63 + 1)) AS fold FROM x GROUP BY symbol HAVING count(*) >= 315), j AS (SELECT x.*, fold, CASE WHEN i >= fold * 63 + 252 THEN 'test' ELSE 'train' END AS role FROM x JOIN f ON x.symbol = f.symbol AND (i BETWEEN fold * 63 + 252 AND fold * 63 + 314 OR i BETWEEN 0 AND fold * 63 + 246) WHERE x IS NOT NULL AND y IS NOT NULL), l AS (SELECT symbol, fold, covar_samp(x, y) / var_samp(x) AS b, avg(x) AS mx, avg(y) AS my FROM j WHERE role = 'train' GROUP BY ALL) SELECT symbol, fold::INT AS fold, round(sqrt(avg((y - my - b * (x - mx)) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(y - my - b * (x - mx))), 6) + 0.0 AS mae, count(*) AS n FROM j JOIN l USING (symbol, fold) WHERE role = 'test' GROUP BY ALL")
def validation_linear_folds(spark, sf_dir):
    w = ordered(["symbol"], "day")
    d = tables.daily(spark, sf_dir).withColumn("y", returns("close", w))
    d = d.select("symbol", "day", "y", F.lag("y").over(w).alias("x"))
    return shown(validation.walk_forward_lines(d, ["symbol"], ["day"], "x", "y", 252, 63, 63, embargo=5))


@query(f"WITH {DAILY}, x AS (SELECT symbol, day, close AS a, lag(close) OVER {W} AS p FROM d), y AS (SELECT symbol, a, p, CASE WHEN sign(a - lag(a) OVER {W}) = sign(p - lag(p) OVER {W}) THEN 1.0 WHEN lag(a) OVER {W} IS NOT NULL AND lag(p) OVER {W} IS NOT NULL THEN 0.0 END AS g FROM x WHERE p IS NOT NULL) SELECT symbol, round(sqrt(avg((a - p) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(a - p)), 6) + 0.0 AS mae, round(1 - sum((a - p) ** 2) / nullif(var_pop(a) * count(*), 0), 6) + 0.0 AS r2, round(avg(g), 6) + 0.0 AS direction, round(corr(a, p), 6) + 0.0 AS information FROM y GROUP BY symbol")
def validation_prediction_metrics(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    d = d.select("symbol", "day", F.col("close").alias("a"), F.lag("close").over(ordered(["symbol"], "day")).alias("p")).filter("p IS NOT NULL")
    return shown(validation.prediction_metrics(d, ["symbol"], ["day"], "a", "p"))


@query(f"WITH {PANEL}, z AS (SELECT strategy, ret, ret - avg(ret) OVER (PARTITION BY strategy) AS u FROM s), a AS (SELECT strategy, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, avg(u ** 3) / avg(u ** 2) ** 1.5 AS g, avg(u ** 4) / avg(u ** 2) ** 2 - 3 AS k FROM z GROUP BY strategy) SELECT strategy, round(m / sd * sqrt(n), 6) + 0.0 AS t, round(n / 6 * (g ** 2 + k ** 2 / 4), 6) + 0.0 AS jarque_bera, round(exp(-n / 12 * (g ** 2 + k ** 2 / 4)), 6) + 0.0 AS p_value FROM a")
def validation_normality(spark, sf_dir):
    return shown(validation.normality(tables.panel(spark, sf_dir), ["strategy"]))


@query(f"WITH {PANEL}, l AS (SELECT strategy, ret, lag(ret, 1) OVER w AS a, lag(ret, 2) OVER w AS b, lag(ret, 3) OVER w AS c FROM s WINDOW w AS (PARTITION BY strategy ORDER BY day)) SELECT strategy, round(corr(ret, a), 6) + 0.0 AS ac_1, round(corr(ret, b), 6) + 0.0 AS ac_2, round(corr(ret, c), 6) + 0.0 AS ac_3 FROM l GROUP BY strategy")
def validation_autocorrelation(spark, sf_dir):
    return shown(validation.autocorrelation(tables.panel(spark, sf_dir), ["strategy"], ["day"], "ret", 3))


# --- text ---
#: A lexicon that occurs in the news texts of the driver tables; the operator takes any.
POSITIVE, NEGATIVE = ["the", "and", "la"], ["of", "to", "de"]


@query("WITH k AS (SELECT source, regexp_extract_all(lower(text), '[0-9A-Za-z_]+') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT source, len(list_filter(w, lambda x: x IN ('the', 'and', 'la'))) AS p, len(list_filter(w, lambda x: x IN ('of', 'to', 'de'))) AS n FROM k), s AS (SELECT source, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END AS x FROM c) SELECT source, round(avg(x), 3) + 0.0 AS mean, round(stddev_samp(x), 3) + 0.0 AS std, count(*) AS n FROM s GROUP BY source")
def sentiment_by_source(spark, sf_dir):
    news = tables.read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("source", sentiment.lexicon_score(F.col("text"), POSITIVE, NEGATIVE).alias("score"))
    return shown(sentiment.daily_sentiment(news, "source", "score"), 3)


@query(f"WITH {DAILY} SELECT symbol, strftime(day, {AT}) AS day, CASE WHEN volume <= 25 THEN 'extreme fear' WHEN volume <= 45 THEN 'fear' WHEN volume <= 55 THEN 'neutral' WHEN volume <= 75 THEN 'greed' ELSE 'extreme greed' END AS class FROM d")
def sentiment_classes(spark, sf_dir):
    return shown(tables.daily(spark, sf_dir).select("symbol", "day", sentiment.fear_class(F.col("volume")).alias("class")))


# --- recursive indicators, signals, costs, folds ---
NUMBERED = f"k AS (SELECT symbol, day, close, row_number() OVER {W} AS n FROM d)"


@query(f"WITH RECURSIVE {DAILY}, {NUMBERED}, e AS (SELECT symbol, n, day, close AS f, close AS s, 0.0::DOUBLE AS g FROM k WHERE n = 1 UNION ALL SELECT k.symbol, k.n, k.day, e.f + (k.close - e.f) * (2 / 13.0), e.s + (k.close - e.s) * (2 / 27.0), e.g + ((e.f + (k.close - e.f) * (2 / 13.0)) - (e.s + (k.close - e.s) * (2 / 27.0)) - e.g) * (2 / 10.0) FROM e JOIN k ON k.symbol = e.symbol AND k.n = e.n + 1) SELECT symbol, strftime(day, {AT}) AS day, round(f - s, 6) + 0.0 AS macd, round(g, 6) + 0.0 AS macd_signal, round(f - s - g, 6) + 0.0 AS macd_histogram FROM e")
def indicators_macd(spark, sf_dir):
    return shown(smoothing.macd(tables.daily(spark, sf_dir).select("symbol", "day", "close"), ["symbol"], ["day"]).drop("close"))


@query(f"WITH RECURSIVE {DAILY}, {NUMBERED}, c AS (SELECT symbol, day, n, greatest(close - lag(close) OVER {W}, 0) AS u, greatest(lag(close) OVER {W} - close, 0) AS v FROM k), e AS (SELECT symbol, n, u, v FROM c WHERE n = 2 UNION ALL SELECT c.symbol, c.n, e.u + (c.u - e.u) / 14, e.v + (c.v - e.v) / 14 FROM e JOIN c ON c.symbol = e.symbol AND c.n = e.n + 1) SELECT c.symbol, strftime(c.day, {AT}) AS day, round(CASE WHEN c.n <= 14 THEN NULL WHEN e.v = 0 THEN 100 ELSE 100 - 100 / (1 + e.u / e.v) END, 6) + 0.0 AS rsi FROM c LEFT JOIN e ON c.symbol = e.symbol AND c.n = e.n")
def indicators_wilder_rsi(spark, sf_dir):
    return shown(smoothing.wilder_rsi(tables.daily(spark, sf_dir).select("symbol", "day", "close"), ["symbol"], ["day"]).drop("close"))


@query(f"WITH {DAILY}, {RET}, v AS (SELECT symbol, day, ({dev('ret', 10)}) * sqrt(252) AS a, ({dev('ret', 20)}) * sqrt(252) AS b, ({dev('ret', 60)}) * sqrt(252) AS c FROM r), q AS (SELECT symbol, quantile_cont(b, 0.7) AS x, quantile_cont(b, 0.6) AS y FROM v GROUP BY symbol) SELECT symbol, strftime(day, {AT}) AS day, CASE WHEN b > x THEN -1 ELSE 0 END::INT AS condor, CASE WHEN b > y THEN -1 ELSE 0 END::INT AS strangle, CASE WHEN c - a > 0.05 THEN 1 ELSE 0 END::INT AS calendar FROM v JOIN q USING (symbol)")
def signals_premium(spark, sf_dir):
    return shown(signals.premium_signals(tables.daily(spark, sf_dir), ["symbol"], ["day"]).select("symbol", "day", "condor", "strangle", "calendar"))


@query(f"WITH {DAILY}, f AS (SELECT symbol, day, close, last_value(CASE WHEN volume > 40 THEN 1 WHEN volume < 15 THEN 0 END IGNORE NULLS) OVER {W} AS h FROM d), h AS (SELECT symbol, day, close, coalesce(h, 0) AS held FROM f), o AS (SELECT *, CASE WHEN held = 1 AND coalesce(lag(held) OVER {W}, 0) = 0 THEN 1 ELSE 0 END AS o FROM h), t AS (SELECT *, sum(o) OVER {W} AS trade FROM o) SELECT symbol, trade::BIGINT AS trade, count(*) AS n, round(arg_max(close, day) / arg_min(close, day) - 1, 6) + 0.0 AS gain FROM t WHERE held = 1 GROUP BY symbol, trade")
def backtest_entry_exit_trades(spark, sf_dir):
    d = tables.daily(spark, sf_dir)
    held = signals.position_state(d, ["symbol"], ["day"], F.col("volume") > 40, F.col("volume") < 15).filter("held = 1")
    return shown(held.groupBy("symbol", "trade").agg(F.count(F.lit(1)).alias("n"), (F.max_by("close", "day") / F.min_by("close", "day") - 1).alias("gain")))


@query(f"WITH {CHAIN}, x AS (SELECT *, CASE WHEN quantity % 2 = 0 THEN spot * 0.99 ELSE 0 END AS bid, spot * 1.01 AS ask, quantity * 10 AS volume FROM ch), y AS (SELECT *, CASE WHEN bid > 0 AND ask > 0 THEN ask - bid ELSE greatest(0.05, least(2, spot * 0.1 * greatest(0.5, 1 - ln(volume + 1) / 10))) END AS spread FROM x) SELECT contract, round(spread, 6) + 0.0 AS spread, round(spread / 2 * (1 + 0.5 * sqrt(quantity / volume)), 6) + 0.0 AS slippage, round(quantity * 0.65, 6) + 0.0 AS commission, round(greatest(0.01, spot + spread / 2 * (1 + 0.5 * sqrt(quantity / volume))), 6) + 0.0 AS fill FROM y")
def options_execution_costs(spark, sf_dir):
    c = tables.chain(spark, sf_dir)
    q = c.select("contract", "quantity", F.col("spot").alias("mid"), F.when(F.col("quantity") % 2 == 0, F.col("spot") * 0.99).otherwise(0.0).alias("bid"), (F.col("spot") * 1.01).alias("ask"), (F.col("quantity") * 10).alias("volume"), F.lit(1).alias("side"))
    return shown(options.execution_costs(q).select("contract", "spread", "slippage", "commission", "fill"))


CALL = "spot * n1 - strike * exp(-0.02 * y) * n2"
#: One Newton step a round for all contracts still moving, from 0.2, at most 100 rounds.
NEWTON = f"""mk AS MATERIALIZED (SELECT row_number() OVER () AS id, contract, option_type, spot, strike, y, price AS market FROM g),
nw AS (SELECT id, 0 AS step, 0.2::DOUBLE AS v, true AS moves FROM mk
UNION ALL SELECT id, step + 1, CASE WHEN isfinite(price) AND abs(price - market) >= 1e-6 AND vega > 0 THEN greatest(v - (price - market) / vega, 0.001) ELSE v END, isfinite(price) AND abs(price - market) >= 1e-6 AND vega > 0 FROM (
  SELECT *, CASE WHEN option_type = 'call' THEN {CALL} ELSE {CALL} - spot + strike * exp(-0.02 * y) END AS price, spot * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(y) AS vega FROM (
    SELECT *, {tail_sql('d1')} AS n1, {tail_sql('d2')} AS n2 FROM (
      SELECT *, d1 - v * sqrt(y) AS d2 FROM (SELECT nw.id, step, v, option_type, spot, strike, y, market, (ln(spot / strike) + (0.02 + v * v / 2) * y) / (v * sqrt(y)) AS d1 FROM nw JOIN mk USING (id) WHERE moves AND step < 100)))))"""


def legible(v):
    return F.when(v >= 1000, F.format_string("%.3e", v).cast("double")).otherwise(F.round(v * 1000) / 1000 + 0.0)


@query(f"WITH RECURSIVE {CHAIN}, {GREEKS}, {NEWTON} SELECT contract, CASE WHEN v >= 1000 THEN printf('%.3e', v)::DOUBLE ELSE round(v, 3) + 0.0 END AS implied FROM (SELECT id, arg_max(v, step) AS v FROM nw GROUP BY id) JOIN mk USING (id)")
def options_implied_volatility(spark, sf_dir):
    """The whole chain by Newton steps from the model's prices, those that stop for want of vega or at the least volatility included. To three decimals, and
    from 1000 on, where the last step divided by next to no vega, to four digits in all."""
    return options.implied_volatility(options.with_price(dated(spark, sf_dir))).select("contract", legible(F.col("implied")).alias("implied"))


@query()
def options_implied_volatility_chain(spark, sf_dir):
    """The same to six digits, which the last steps of flat prices needn't share with another engine."""
    return shown(options.implied_volatility(options.with_price(dated(spark, sf_dir))).select("contract", "implied"))


@query(f"WITH {DAILY}, c AS (SELECT symbol, count(*) AS n FROM d GROUP BY symbol), f AS (SELECT symbol, n, unnest(range(0, 5)) AS fold FROM c), g AS (SELECT *, fold * n // 5 AS a, (fold + 1) * n // 5 - 1 AS b FROM f) SELECT symbol, fold::INT AS fold, a AS test_low, b AS test_high, 0 AS before_low, a - 6 AS before_high, b + 11 AS after_low, n - 1 AS after_high FROM g")
def validation_purged_folds(spark, sf_dir):
    return validation.purged_folds(tables.daily(spark, sf_dir), ["symbol"], 5, 5, 10)


@query(f"WITH {DAILY}, g AS (SELECT symbol, ((row_number() OVER {W} - 1) * 6 // count(*) OVER (PARTITION BY symbol))::INT AS grp FROM d), c AS (SELECT a.x AS p, b.x AS q, row_number() OVER (ORDER BY a.x, b.x) - 1 AS fold FROM range(6) a(x) JOIN range(6) b(x) ON a.x < b.x) SELECT symbol, fold::INT AS fold, count(*) FILTER (grp IN (p, q)) AS tested, count(*) FILTER (abs(grp - p) > 1 AND abs(grp - q) > 1) AS trained FROM g, c GROUP BY symbol, fold")
def validation_combinatorial_folds(spark, sf_dir):
    rows = validation.combinatorial_folds(tables.daily(spark, sf_dir), ["symbol"], ["day"], 6, 2, 1)
    return rows.groupBy("symbol", "fold").agg(F.count(F.when(F.col("role") == "test", 1)).alias("tested"), F.count(F.when(F.col("role") == "train", 1)).alias("trained"))


@query(f"WITH {DAILY} SELECT symbol, strftime(day, {AT}) AS day, round(close, 6) + 0.0 AS close FROM d WHERE isodow(day) = 1")
def signals_weekly_rebalance(spark, sf_dir):
    return shown(signals.rebalance_days(tables.daily(spark, sf_dir), ["symbol"], "day", "weekly").select("symbol", "day", "close"))


@query("SELECT s_suppkey AS symbol, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND s_acctbal >= 1000")
def registry_by_region_and_liquidity(spark, sf_dir):
    """Symbols of two regions with enough liquidity: the dimension tables have 25 and 5 rows."""
    s, n, rg = (tables.read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(rg), n["n_regionkey"] == rg["r_regionkey"])
    return joined.filter("r_name IN ('ASIA', 'EUROPE') AND s_acctbal >= 1000").select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


# --- matching, attribution, sweeps, grades ---
@query(f"WITH {CHAIN}, m AS (SELECT portfolio, day, min(row(strike, spot, iv, contract)) AS f FROM ch WHERE option_type = 'call' AND strike > 0.8 * spot AND strike < 1.2 * spot GROUP BY ALL) SELECT portfolio, strftime(day, {AT}) AS day, round(f[1], 6) + 0.0 AS strike, round(f[2], 6) + 0.0 AS spot, round(f[3], 6) + 0.0 AS iv, f[4] AS contract FROM m")
def options_covered_call_match(spark, sf_dir):
    return shown(options.covered_calls(tables.chain(spark, sf_dir), ["portfolio"], 0.8, 1.2))


HELD = ["spot", "iv", "delta", "gamma", "theta", "vega"]


@query(f"WITH {CHAIN}, {GREEKS}, p AS (SELECT symbol, day, {', '.join(f'sum({n} * quantity) / sum(quantity) AS {n}' for n in HELD)} FROM g GROUP BY ALL), q AS (SELECT symbol, day, lag(delta) OVER {W} * (spot - lag(spot) OVER {W}) * 100 AS delta_pnl, lag(gamma) OVER {W} * (spot - lag(spot) OVER {W}) ** 2 * 50 AS gamma_pnl, lag(theta) OVER {W} * (day - lag(day) OVER {W}) * 100 AS theta_pnl, lag(vega) OVER {W} * (iv - lag(iv) OVER {W}) * 100 AS vega_pnl FROM p) SELECT symbol, strftime(day, {AT}) AS day, {r('delta_pnl', 'gamma_pnl', 'theta_pnl', 'vega_pnl', digits=3)}, round(delta_pnl + gamma_pnl + theta_pnl + vega_pnl, 3) + 0.0 AS total_pnl FROM q")
def options_pnl_attribution(spark, sf_dir):
    """All contracts of a symbol and day as one position, each with its quantity's weight."""
    weighted = [(F.sum(F.col(n) * F.col("quantity")) / F.sum("quantity")).alias(n) for n in HELD]
    one = greeks(spark, sf_dir).groupBy("symbol", "day").agg(*weighted)
    return shown(options.pnl_attribution(one, ["symbol"], ["day"]).select("symbol", "day", "delta_pnl", "gamma_pnl", "theta_pnl", "vega_pnl", "total_pnl"), 3)


SWEEP = [5, 10, 20]
GAINS = " UNION ALL ".join(f"SELECT symbol, {n} AS win, ret * lag(h) OVER {W} AS gain FROM (SELECT symbol, day, ret, CASE WHEN close > ({mean('close', n)}) THEN 1.0 ELSE 0.0 END AS h FROM r)" for n in SWEEP)


@query(f"WITH {DAILY}, {RET}, g AS ({GAINS}), s AS (SELECT symbol, win, CASE WHEN stddev_samp(gain) > 1e-12 THEN avg(gain) / stddev_samp(gain) * sqrt(252) END AS sharpe FROM g WHERE gain IS NOT NULL GROUP BY ALL) SELECT symbol, win::INT AS \"window\", round(sharpe, 6) + 0.0 AS sharpe, row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe, 9) DESC NULLS LAST, win)::INT AS place FROM s")
def sweep_moving_average(spark, sf_dir):
    return shown(validation.sharpe_grid(tables.daily(spark, sf_dir), ["symbol"], ["day"], "close", SWEEP))


@query(f"WITH {PANEL}, x AS (SELECT strategy, ret, -sign(avg(ret) OVER (PARTITION BY strategy ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) * ret AS a, sign(avg(ret) OVER (PARTITION BY strategy ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) * ret AS b FROM s) SELECT strategy, round(avg(ret), 8) + 0.0 AS hold, round(avg(a), 8) + 0.0 AS reversion, round(avg(b), 8) + 0.0 AS momentum FROM x GROUP BY strategy")
def validation_naive_rules(spark, sf_dir):
    rules = validation.naive_rules(tables.panel(spark, sf_dir), ["strategy"], ["day"])
    return shown(rules.groupBy("strategy").agg(*[F.avg(c).alias(c) for c in ("hold", "reversion", "momentum")]), 8)


@query(f"WITH {PANEL}, a AS (SELECT strategy, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS h, sum(ret) FILTER (ret > 0) / sum(-ret) FILTER (ret < 0) AS pf, avg(ret) FILTER (ret > 0) / avg(-ret) FILTER (ret < 0) AS o, quantile_cont(ret, 0.05) AS v FROM s GROUP BY strategy) SELECT strategy, round(h, 6) + 0.0 AS hit_ratio, round(pf, 6) + 0.0 AS profit_factor, round(greatest(0, least(1, h - (1 - h) / o)), 6) + 0.0 AS kelly, round(v, 6) + 0.0 AS var_95, CASE WHEN h >= 0.9 THEN 'A' WHEN h >= 0.8 THEN 'B' WHEN h >= 0.7 THEN 'C' WHEN h >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM a")
def validation_strategy_grades(spark, sf_dir):
    table = risk.validator_metrics(tables.panel(spark, sf_dir), ["strategy"])
    return shown(table.withColumn("grade", validation.grade(F.col("hit_ratio"))))


@query(f"WITH {DAILY}, {RET}, v AS (SELECT symbol, stddev_samp(ret) * sqrt(252) AS volatility FROM r GROUP BY symbol) SELECT symbol, round(volatility, 6) + 0.0 AS volatility, round(coalesce(greatest(0.5, least(2, 8 / nullif(volatility, 0))), 1) * 2000, 4) + 0.0 AS position FROM v")
def sizing_fixed_fraction(spark, sf_dir):
    d = tables.daily(spark, sf_dir).withColumn("ret", returns("close", ordered(["symbol"], "day")))
    vol = d.groupBy("symbol").agg((F.stddev_samp("ret") * 252**0.5).alias("volatility"))
    sized = risk.fixed_fraction(vol, 100_000.0, 0.02, 8.0)
    return shown(sized.withColumn("position", F.round("position", 4)))


@query(f"WITH {CHAIN} SELECT contract, round(spot / strike, 6) + 0.0 AS moneyness, greatest(0, (day + days::INT) - DATE '1998-01-01')::BIGINT AS left_days FROM ch WHERE option_type = 'put' AND day + days::INT > DATE '1998-01-01'")
def options_moneyness_and_expiry(spark, sf_dir):
    c = tables.chain(spark, sf_dir).withColumn("left_days", F.datediff(F.date_add("day", F.col("days").cast("int")), F.lit("1998-01-01").cast("date")).cast("long"))
    return shown(c.filter("option_type = 'put' AND left_days > 0").select("contract", (F.col("spot") / F.col("strike")).alias("moneyness"), "left_days"))

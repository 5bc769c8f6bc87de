"""Queries of strategies run over time, with recursive SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.jobs.queries import AT, CHAIN, DAILY, GREEKS, TICKS, TS, W, greeks, mean, r, shown, tail_sql
from quantframe.jobs.registry import query
from quantframe.operators import option_runs
from quantframe.sources import tables

VALUE = "list_sum(list_transform({legs}, lambda l: {f}(l.q * (greatest(0, CASE WHEN l.kind = 'call' THEN {spot} - l.strike ELSE l.strike - {spot} END) + greatest(0.05, 0.1 * greatest(0, CASE WHEN l.kind = 'call' THEN {spot} - l.strike ELSE l.strike - {spot} END))))))"


def fills(legs: list[option_runs.Leg]) -> dict[str, str]:
    """SQL over n of what one entry costs, pays in commissions and slips."""
    slip = lambda x: f"({(x.ask - x.bid) / 2!r} * (1 + 0.5 * sqrt(n / {x.volume!r})))"
    price = lambda x: f"({x.ask!r} + {slip(x)})" if x.sign > 0 else f"greatest(0.01, {x.bid!r} - {slip(x)})"
    return {"paid": " + ".join(f"{x.sign} * n * {price(x)}" for x in legs), "commission": f"{len(legs)} * (1.0 + 0.65 * n)", "slippage": " + ".join(f"n * {slip(x)}" for x in legs)}


def replay_sql(legs: list[option_runs.Leg], share: float, days: int) -> str:
    """Tables m (symbol, row, day, spot, enters) -> s: one step of each book a round."""
    cost, f = sum(x.ask if x.sign > 0 else x.bid for x in legs), fills(legs)
    new = ", ".join(f"{{'kind': '{x.kind}', 'strike': {x.strike!r} * spot, 'q': {x.sign} * n, 'until': day + {days}}}" for x in legs)
    pays = "list_sum(list_transform(list_filter(had, lambda l: l.until <= day), lambda l: l.q * greatest(0, CASE WHEN l.kind = 'call' THEN spot - l.strike ELSE l.strike - spot END)))"
    return f"""s AS (SELECT symbol, 0::BIGINT AS row, NULL::DATE AS day, 100000.0::DOUBLE AS cash, [{{'kind': '', 'strike': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'until': DATE '1900-01-01'}}][1:0] AS legs, 0.0::DOUBLE AS capital, 0.0::DOUBLE AS value, 0.0::DOUBLE AS gross, 0::INT AS traded, 0.0::DOUBLE AS commission, 0.0::DOUBLE AS slippage FROM m WHERE row = 1
UNION ALL SELECT symbol, row, day, cash - taken + coalesce({pays}, 0), list_filter(had, lambda l: l.until > day), cash, value, gross, traded, commission, slippage FROM (
  SELECT *, CASE WHEN enters THEN list_concat(legs, [{new}]) ELSE legs END AS had, CASE WHEN enters THEN {f['paid']} + {f['commission']} + {f['slippage']} ELSE 0 END AS taken, CASE WHEN enters THEN {len(legs)} ELSE 0 END AS traded, CASE WHEN enters THEN {f['commission']} ELSE 0 END AS commission, CASE WHEN enters THEN {f['slippage']} ELSE 0 END AS slippage FROM (
    SELECT m.symbol, m.row, m.day, m.spot, m.enters, s.cash, s.legs, coalesce({VALUE.format(legs='s.legs', f='', spot='m.spot')}, 0) AS value, coalesce({VALUE.format(legs='s.legs', f='abs', spot='m.spot')}, 0) AS gross, greatest(1, trunc(s.cash * {share!r} / {cost!r}))::DOUBLE AS n FROM s JOIN m ON m.symbol = s.symbol AND m.row = s.row + 1)))"""


def market_sql(when: str) -> str:
    return f"m AS (SELECT symbol, row_number() OVER {W} AS row, day, close AS spot, coalesce(close > ({mean('close', 20)}), false) AND {when} AS enters FROM d)"


def market(spark, sf_dir):
    """Daily bars with a signal where the close is over its 20-row mean."""
    from quantframe.functions.windows import full, rolling

    w = rolling(["symbol"], ["day"], 20)
    above = F.col("close") > full(F.avg("close").over(w), w, 20, F.col("close"))
    return tables.daily(spark, sf_dir).withColumn("signal", F.coalesce(above, F.lit(False)).cast("double"))


CURVE = f"c AS (SELECT symbol, row, day, capital, value AS position_value, capital + value AS total, CASE WHEN capital + value > 0 THEN gross / (capital + value) ELSE 0 END AS leverage, traded, commission, slippage FROM s WHERE row > 0)"


@query(f"WITH RECURSIVE {DAILY}, {market_sql('isodow(day) = 1')}, {replay_sql(option_runs.CONDOR, 0.1, 30)}, {CURVE} SELECT symbol, strftime(day, {AT}) AS day, {r('capital', 'position_value', 'total', digits=2)}, {r('leverage')}, traded AS legs_traded, {r('commission', 'slippage', digits=2)} FROM c")
def options_backtest_condor(spark, sf_dir):
    """Condors entered on Mondays, sized by the capital then left: the whole curve of each symbol."""
    curve = option_runs.option_backtest(market(spark, sf_dir), ["symbol"], "day", "close", "signal", rebalance="weekly").drop("open_legs")
    return shown(curve.withColumns({c: F.round(c, 2) for c in ("capital", "position_value", "total", "commission", "slippage")}))


@query(f"""WITH RECURSIVE {DAILY}, {market_sql('day(day) = 1')}, {replay_sql(option_runs.STRANGLE, 0.05, 45)}, {CURVE},
x AS (SELECT *, total / lag(total) OVER {W} - 1 AS ret, total / first(total) OVER {W} AS grown FROM c), y AS (SELECT *, max(grown) FILTER (row > 1) OVER (PARTITION BY symbol ORDER BY day) AS peak, count(*) OVER (PARTITION BY symbol) AS n FROM x),
z AS (SELECT symbol, any_value(n) AS n, max(grown) FILTER (row = n) AS g, stddev_samp(ret) * sqrt(252) AS volatility, min(grown / peak - 1) FILTER (row > 1) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (ret IS NOT NULL) AS win_rate, sum(traded)::BIGINT AS trades, sum(commission) AS commissions, sum(slippage) AS slippage, max(total) FILTER (row = n) AS final, avg(leverage) AS mean_leverage FROM y GROUP BY symbol)
SELECT symbol, round(g - 1, 6) + 0.0 AS total_return, round(CASE WHEN g >= 0 THEN g ** (252 / n) END - 1, 6) + 0.0 AS annual_return, {r('volatility')}, round(CASE WHEN volatility > 0 THEN (CASE WHEN g >= 0 THEN g ** (252 / n) END - 1) / volatility ELSE 0 END, 6) + 0.0 AS sharpe, {r('max_drawdown', 'win_rate')}, trades, {r('commissions', 'slippage', 'final', digits=4)}, {r('mean_leverage')} FROM z""")
def options_backtest_metrics(spark, sf_dir):
    """Strangles entered on firsts of months: what each symbol's curve comes to."""
    curve = option_runs.option_backtest(market(spark, sf_dir), ["symbol"], "day", "close", "signal", option_runs.STRANGLE, share=0.05, rebalance="monthly", days=45)
    table = option_runs.backtest_metrics(curve, ["symbol"], "day")
    return shown(table.withColumns({c: F.round(c, 4) for c in ("commissions", "slippage", "final")}))


@query(f"""WITH RECURSIVE {CHAIN}, {GREEKS}, q AS (SELECT portfolio, day, floor(strike / 100) * 100 AS strike, spot, price, contract FROM g WHERE option_type = 'call'),
f AS (SELECT portfolio, day, min(row(strike, contract, spot, price)) AS f FROM q WHERE strike > 0.8 * spot AND strike < 1.2 * spot GROUP BY ALL), e AS (SELECT portfolio, day, f[1] AS strike, f[3] AS spot, f[4] AS price FROM f),
h AS (SELECT portfolio, strike, day, arg_min(row(spot, price), contract) AS b FROM q GROUP BY ALL),
x AS (SELECT e.*, min(h.day) AS exit_day FROM e LEFT JOIN h ON e.portfolio = h.portfolio AND e.strike = h.strike AND h.day >= e.day + 20 GROUP BY ALL),
nx AS (SELECT x.*, (SELECT min(e.day) FROM e WHERE e.portfolio = x.portfolio AND e.day > x.exit_day) AS next_day FROM x),
t AS (SELECT nx.* FROM nx WHERE day = (SELECT min(day) FROM e WHERE e.portfolio = nx.portfolio) UNION ALL SELECT nx.* FROM t JOIN nx ON nx.portfolio = t.portfolio AND nx.day = t.next_day)
SELECT t.portfolio, strftime(t.day, {AT}) AS entry_day, strftime(exit_day, {AT}) AS exit_day, round(t.strike, 6) + 0.0 AS strike, round(t.spot, 6) + 0.0 AS entry_spot, round(b[1], 6) + 0.0 AS exit_spot, round(t.price, 4) + 0.0 AS call_sold, round(b[2], 4) + 0.0 AS call_bought, round((b[1] - t.spot) * 100 - 1, 4) + 0.0 AS stock_pnl, round(t.price - b[2] + t.price * 100 - 1, 3) + 0.0 AS call_pnl, exit_day IS NOT NULL AS closed
FROM t LEFT JOIN h ON h.portfolio = t.portfolio AND h.strike = t.strike AND h.day = t.exit_day""")
def options_covered_call_run(spark, sf_dir):
    """Covered calls held 20 days and then until their strike is quoted, one after the other, for each portfolio."""
    quotes = greeks(spark, sf_dir).filter("option_type = 'call'").withColumn("strike", F.floor(F.col("strike") / 100) * 100)
    runs = option_runs.covered_call_run(quotes, ["portfolio"], 0.8, 1.2)
    return shown(runs.withColumns({c: F.round(c, d) for c, d in (("call_sold", 4), ("call_bought", 4), ("stock_pnl", 4), ("call_pnl", 3))}))


@query()
def regimes_hidden(spark, sf_dir):
    """Regimes of daily returns under one hidden-Markov model of all symbols, with their probabilities: iterative, so without SQL."""
    from quantframe.functions.windows import ordered, returns
    from quantframe.operators import hidden

    d = tables.daily(spark, sf_dir).withColumn("ret", returns("close", ordered(["symbol"], "day"), log=True))
    found = hidden.regimes(d, ["symbol"], ["day"], "ret", rounds=20)
    return shown(found.select("symbol", "day", "ret", "regime", *[F.col("probabilities")[i].alias(f"chance_{i}") for i in range(3)]))


# --- windows over windows, refits, residuals, corrupt input ---
FROM_RET = "rr AS (SELECT symbol, day, close, close / lag(close) OVER w - 1 AS ret, row_number() OVER w AS pos FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day))"


def returned(spark, sf_dir):
    from quantframe.functions.windows import ordered, returns

    return tables.daily(spark, sf_dir).select("symbol", "day", "close", returns("close", ordered(["symbol"], "day")).alias("ret"))


def last_n(c: str, how: str, n: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY day ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) OVER {w} = {n} THEN {how}({c}) OVER {w} END"


@query(f"WITH {DAILY}, {FROM_RET}, e AS (SELECT symbol, day, {last_n('grown', 'product', 20)} AS rolling_equity FROM (SELECT *, 1 + ret AS grown FROM rr)), pk AS (SELECT *, {last_n('rolling_equity', 'max', 20)} AS rolling_peak FROM e), f AS (SELECT *, rolling_equity / rolling_peak - 1 AS fall FROM pk) SELECT symbol, strftime(day, {AT}) AS day, {r('rolling_equity', 'rolling_peak', digits=5)}, round({last_n('fall', 'min', 20)}, 6) + 0.0 AS rolling_max_drawdown FROM f")
def performance_rolling_drawdown(spark, sf_dir):
    """Equity of the last 20 days, its largest in 20 days, and the deepest fall from that in 20 days."""
    from quantframe.functions.sliding import rolling_drawdown

    found = rolling_drawdown(returned(spark, sf_dir), ["symbol"], ["day"], 20)
    return shown(found.select("symbol", "day", F.round("rolling_equity", 5).alias("rolling_equity"), F.round("rolling_peak", 5).alias("rolling_peak"), "rolling_max_drawdown"))


def lagged(spark, sf_dir):
    """Rows with a return and the two before it."""
    from quantframe.functions.windows import ordered

    w = ordered(["symbol"], "day")
    return returned(spark, sf_dir).withColumn("y", F.ln(1 + F.col("ret"))).withColumn("x1", F.lag("y").over(w)).withColumn("x2", F.lag("y", 2).over(w)).select("symbol", "day", "y", "x1", "x2")


LAGGED = f"{FROM_RET}, l AS (SELECT symbol, day, y, lag(y) OVER {W} AS x1, lag(y, 2) OVER {W} AS x2 FROM (SELECT *, ln(1 + ret) AS y FROM rr)), k AS (SELECT * FROM l WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)"
SEEN = "OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
GUESSES = f"""{LAGGED}, z AS (SELECT *, count(*) {SEEN} AS n, avg(y) {SEEN} AS my, avg(x1) {SEEN} AS m1, avg(x2) {SEEN} AS m2, covar_pop(x1, x1) {SEEN} AS s11, covar_pop(x2, x2) {SEEN} AS s22, covar_pop(x1, x2) {SEEN} AS s12, covar_pop(x1, y) {SEEN} AS s1y, covar_pop(x2, y) {SEEN} AS s2y FROM k),
gs AS (SELECT *, CASE WHEN n >= 30 THEN my + (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) * (x1 - m1) + (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) * (x2 - m2) END AS guess, CASE WHEN n >= 30 THEN my END AS base FROM z)"""


@query(f"WITH {DAILY}, {GUESSES} SELECT symbol, strftime(day, {AT}) AS day, {r('y', 'guess', digits=5)} FROM gs")
def validation_recursive_refits(spark, sf_dir):
    """Each return by a line on the two before it, refitted at every row."""
    from quantframe.operators import regressions

    found = regressions.recursive_predictions(lagged(spark, sf_dir), ["symbol"], ["day"], ["x1", "x2"], "y")
    return shown(found.select("symbol", "day", F.round("y", 5).alias("y"), F.round("guess", 5).alias("guess")))


def guessed(spark, sf_dir):
    """Refitted guesses with the mean of all earlier rows as a baseline."""
    from quantframe.functions.windows import ordered
    from quantframe.operators import regressions
    from pyspark.sql import Window

    found = regressions.recursive_predictions(lagged(spark, sf_dir), ["symbol"], ["day"], ["x1", "x2"], "y")
    seen = ordered(["symbol"], "day").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("base", F.when(F.col("guess").isNotNull(), F.avg("y").over(seen)))


LAGS = ", ".join(f"lag(e, {k}) OVER {W} AS l{k}" for k in range(1, 11))
ACS = ", ".join(f"CASE WHEN n // 4 > {k} THEN coalesce(corr(e, l{k}), 0) END AS ac_{k}" for k in range(1, 11))
RESIDUALS = f"""u AS (SELECT symbol, day, y, guess, y - guess AS e FROM gs WHERE guess IS NOT NULL), v AS (SELECT *, {LAGS}, row_number() OVER {W} AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM u),
q AS (SELECT symbol, n, avg(e) AS mean, stddev_pop(e) AS deviation, skewness(e) * (n - 2) / sqrt(n * (n - 1)) AS skew, kurtosis_pop(e) AS kurtosis, {ACS}, coalesce(corr(abs(e), guess), 0) AS size_correlation, var_pop(e) FILTER (pos <= n // 2) / var_pop(e) FILTER (pos > n // 2) AS variance_ratio, n * coalesce(corr(e * e, guess), 0) ** 2 AS changing_variance FROM v GROUP BY symbol, n)"""


@query(f"WITH {DAILY}, {GUESSES}, {RESIDUALS}, j AS (SELECT *, n / 6 * (skew ** 2 + kurtosis ** 2 / 4) AS jarque_bera, sqrt(changing_variance) AS root FROM q) SELECT symbol, n, {r('mean', 'deviation', 'skew', 'kurtosis', *[f'ac_{k}' for k in range(1, 11)], 'size_correlation', 'variance_ratio', digits=4)}, round(jarque_bera, 3) + 0.0 AS jarque_bera, round(exp(-jarque_bera / 2), 4) + 0.0 AS jarque_bera_p, round(changing_variance, 4) + 0.0 AS changing_variance, round(2 * (1 - {tail_sql('root')}), 4) + 0.0 AS changing_variance_p FROM j")
def validation_residuals(spark, sf_dir):
    """Residuals of the refitted line: shape, correlations at ten lags, changing variance by two stages."""
    from quantframe.operators import underfit

    found = underfit.residual_diagnosis(guessed(spark, sf_dir), ["symbol"], ["day"], "y", "guess")
    return shown(found.withColumn("jarque_bera", F.round("jarque_bera", 3)).withColumns({c: F.round(c, 4) for c in found.columns if c not in ("symbol", "n", "jarque_bera")}))


R2 = """f5 AS (SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY day DESC) - 1) // 63 AS fold, y, guess, base FROM gs WHERE guess IS NOT NULL),
g5 AS (SELECT symbol, fold, 1 - avg((y - guess) ** 2) / var_pop(y) AS a, 1 - avg((y - base) ** 2) / var_pop(y) AS b FROM f5 WHERE fold < 5 GROUP BY ALL HAVING count(*) = 63), h5 AS (SELECT symbol, avg(a) AS r2_guess, avg(b) AS r2_base FROM g5 GROUP BY symbol HAVING count(*) = 5)"""
LARGEST = "greatest(0, " + ", ".join(f"coalesce(abs(ac_{k}), 0)" for k in range(1, 11)) + ")"


@query(f"WITH {DAILY}, {GUESSES}, {RESIDUALS}, {R2}, i5 AS (SELECT h5.*, {LARGEST} AS largest_ac, (r2_base > r2_guess + 0.1)::INT AS better_baselines FROM h5 JOIN q USING (symbol)), k5 AS (SELECT *, CASE WHEN r2_guess < 0.1 THEN 0.4 WHEN r2_guess < 0.3 THEN 0.2 ELSE 0 END + 0.3 * better_baselines + CASE WHEN largest_ac > 0.3 THEN 0.2 ELSE 0 END AS score FROM i5) SELECT symbol, {r('r2_guess', 'r2_base', 'largest_ac', digits=4)}, better_baselines, round(score, 4)::DOUBLE + 0.0 AS score, CASE WHEN round(score, 9) >= 0.6 THEN 'HIGH' WHEN round(score, 9) >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM k5")
def validation_underfit_risk(spark, sf_dir):
    from quantframe.operators import underfit

    found = underfit.underfit_risk(guessed(spark, sf_dir), ["symbol"], ["day"], "y", "guess", ["base"])
    return shown(found.withColumns({c: F.round(c, 4) for c in ("r2_guess", "r2_base", "largest_ac")}))


def corrupted(spark, sf_dir):
    """Ticks as lines of text, some of them corrupt as files from outside are: words and infinities for numbers, gaps, wrong magnitudes, times twice, broken lines."""
    t = tables.read(spark, sf_dir, "events")
    i = F.col("event_id")
    value = F.when(i % 97 == 0, "n/a").when(i % 89 == 0, "inf").when(i % 83 == 0, "").when(i % 79 == 0, (F.col("value") * 1000 + 10_000).cast("string")).otherwise(F.col("value").cast("string"))
    ts = F.when(i % 73 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:00:00"))
    line = F.when(i % 71 == 0, F.lit("broken")).otherwise(F.concat_ws(",", F.col("user_id").cast("string"), ts, value))
    return t.select(i.alias("id"), line.alias("value"))


@query("""WITH e AS (SELECT *, event_id % 71 = 0 AS broken, event_id AS i FROM events),
t AS (SELECT i, CASE WHEN NOT broken THEN user_id END AS symbol, CASE WHEN NOT broken AND i % 73 <> 0 THEN date_trunc('hour', ts) END AS ts, broken, i % 73 = 0 AS untimed,
  CASE WHEN i % 97 = 0 THEN 'word' WHEN i % 89 = 0 THEN 'inf' WHEN i % 83 = 0 THEN 'gap' ELSE '' END AS kind, CASE WHEN i % 97 = 0 OR i % 89 = 0 OR i % 83 = 0 OR broken THEN NULL WHEN i % 79 = 0 THEN value * 1000 + 10000 ELSE value END AS price FROM e),
s AS (SELECT symbol, quantile_cont(price, [0.25, 0.5, 0.75]) AS q FROM t GROUP BY symbol),
m AS (SELECT t.*, abs(price - q[2]) > 10 * (q[3] - q[1]) AS far, ts IS NOT NULL AND lead(1) OVER (PARTITION BY t.symbol, ts ORDER BY i) IS NOT NULL AS again FROM t JOIN s ON t.symbol IS NOT DISTINCT FROM s.symbol)
SELECT i AS id, coalesce(symbol, -1) AS symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(price, 6) + 0.0 AS price, array_to_string(list_filter([CASE WHEN broken THEN 'unreadable' END, CASE WHEN NOT broken AND untimed THEN 'not_a_time' END, CASE WHEN NOT broken AND kind = 'gap' THEN 'missing price' END, CASE WHEN NOT broken AND kind = 'word' THEN 'not_a_number price' END, CASE WHEN NOT broken AND kind = 'inf' THEN 'infinite price' END, CASE WHEN far THEN 'outlier price' END, CASE WHEN again THEN 'repeated' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM m""")
def clean_quarantine(spark, sf_dir):
    """Every line of a corrupt file: its typed fields, and why it is set aside, if it is."""
    from quantframe.operators import quarantine

    schema = "symbol bigint, ts timestamp_ntz, price double"
    marked = quarantine.sanitise(quarantine.read_lines(corrupted(spark, sf_dir), schema), schema, ["symbol"], "ts", "id", ["price"])
    return shown(marked.select("id", F.coalesce("symbol", F.lit(-1)).alias("symbol"), "ts", "price", F.concat_ws(", ", "reasons").alias("reasons")))


# --- fitted and drawn: iterative or random, so without SQL; tests hold them against numpy ---
@query()
def validation_complexity_curves(spark, sf_dir):
    """Errors of ridge, lasso and mixed lines over twenty penalties, from one pass over each symbol's rows."""
    from quantframe.operators import regressions

    found = regressions.complexity_curves(lagged(spark, sf_dir), ["symbol"], ["day"], ["x1", "x2"], "y", horizon=30)
    return shown(found.select("symbol", "model", "penalty", "train_score", "test_score", F.col("weights")[0].alias("w1"), F.col("weights")[1].alias("w2"), "best"))


@query()
def validation_overfit_risk(spark, sf_dir):
    """Signs of over-fitting of a line on the two returns before: walk-forward errors, learning curve, tests, score and level."""
    from quantframe.operators import regressions
    from quantframe.sources.shared import materialise

    rows = materialise(lagged(spark, sf_dir), "lagged")
    walk = materialise(regressions.walk_forward_fits(rows, ["symbol"], ["day"], ["x1", "x2"], "y", least=120), "walk")
    learning = materialise(regressions.learning_curve(rows, ["symbol"], ["day"], ["x1", "x2"], "y", least=120, horizon=30), "learning")
    return shown(regressions.overfit_risk(walk, learning, ["symbol"]))


@query()
def risk_monte_carlo(spark, sf_dir):
    """Compounded returns of each strategy's panel, bootstrapped over 52 weeks."""
    from quantframe.operators import resampling

    return shown(resampling.monte_carlo(tables.panel(spark, sf_dir), ["strategy"], ["strategy", "day"], periods=52))


@query()
def risk_simulated_value_at_risk(spark, sf_dir):
    from quantframe.operators import resampling

    return shown(resampling.simulated_value_at_risk(tables.panel(spark, sf_dir), ["strategy"], ["day"], value=100_000.0))


@query(f"""WITH {DAILY}, h AS (SELECT symbol, day, symbol * 100000 + (day - DATE '1970-01-01') AS o, CASE WHEN (day - DATE '1970-01-01') % 11 <> 0 THEN close END AS a, CASE WHEN (day - DATE '1970-01-01') % 13 <> 0 THEN volume * 40 END AS b, CASE WHEN (day - DATE '1970-01-01') % 7 <> 3 THEN high + low END AS c FROM d),
pr AS (SELECT x.o, y.o AS oo, x.a AS xa, x.b AS xb, x.c AS xc, y.a, y.b, y.c, ((x.a - y.a) IS NOT NULL)::INT + ((x.b - y.b) IS NOT NULL)::INT + ((x.c - y.c) IS NOT NULL)::INT AS n, coalesce((x.a - y.a) ** 2, 0) + coalesce((x.b - y.b) ** 2, 0) + coalesce((x.c - y.c) ** 2, 0) AS s FROM h AS x JOIN h AS y ON x.symbol = y.symbol AND x.o <> y.o WHERE x.a IS NULL OR x.b IS NULL OR x.c IS NULL),
di AS (SELECT *, sqrt(s * 3 / n) AS dist FROM pr WHERE n > 0),
fa AS (SELECT o, avg(a) AS v FROM (SELECT * FROM di WHERE xa IS NULL AND a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o ORDER BY dist, oo) <= 5) GROUP BY o), fb AS (SELECT o, avg(b) AS v FROM (SELECT * FROM di WHERE xb IS NULL AND b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o ORDER BY dist, oo) <= 5) GROUP BY o), fc AS (SELECT o, avg(c) AS v FROM (SELECT * FROM di WHERE xc IS NULL AND c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o ORDER BY dist, oo) <= 5) GROUP BY o),
me AS (SELECT symbol, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM h GROUP BY symbol)
SELECT h.symbol, strftime(h.day, {AT}) AS day, round(coalesce(h.a, fa.v, ma), 6) + 0.0 AS a, round(coalesce(h.b, fb.v, mb), 6) + 0.0 AS b, round(coalesce(h.c, fc.v, mc), 6) + 0.0 AS c FROM h JOIN me USING (symbol) LEFT JOIN fa ON h.o = fa.o LEFT JOIN fb ON h.o = fb.o LEFT JOIN fc ON h.o = fc.o""")
def clean_knn_imputation(spark, sf_dir):
    """Gaps in three columns of daily bars, filled from the five nearest days of the same symbol."""
    from quantframe.operators import neighbours

    days = F.datediff("day", F.lit("1970-01-01"))
    t = tables.daily(spark, sf_dir).select("symbol", "day", (F.col("symbol") * 100_000 + days).alias("o"), F.when(days % 11 != 0, F.col("close")).alias("a"), F.when(days % 13 != 0, F.col("volume") * 40).alias("b"), F.when(days % 7 != 3, F.col("high") + F.col("low")).alias("c"))
    found = neighbours.impute(t, ["symbol"], "o", ["a", "b", "c"])
    return shown(found.select("symbol", "day", "a", "b", "c"))


# --- fills, signals, allocations, breaches, payloads ---
@query(f"WITH {DAILY}, h AS (SELECT symbol, day, CASE WHEN (day - DATE '1970-01-01') % 5 <> 0 THEN close END AS x FROM d) SELECT symbol, strftime(day, {AT}) AS day, round(coalesce(x, 0), 6) + 0.0 AS zero, round(coalesce(x, avg(x) OVER (PARTITION BY symbol)), 6) + 0.0 AS mean FROM h")
def align_zero_and_mean_fill(spark, sf_dir):
    from quantframe.operators import align

    t = tables.daily(spark, sf_dir).withColumn("x", F.when(F.datediff("day", F.lit("1970-01-01")) % 5 != 0, F.col("close")))
    return shown(t.select("symbol", "day", *[align.fill(t, ["symbol"], ["day"], "x", how).alias(how) for how in ("zero", "mean")]))


HELD = f"fl AS (SELECT *, CASE WHEN close > ({mean('close', 5)}) * 1.05 THEN 1 WHEN close < ({mean('close', 5)}) THEN 0 END AS flag FROM d), he AS (SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS held FROM fl), tu AS (SELECT *, coalesce(lag(held) OVER {W}, 0) AS was, lag(close) OVER {W} AS pc FROM he), eq AS (SELECT *, held <> was AS turns, 100 * product(CASE WHEN was = 1 AND pc <> 0 THEN close / pc ELSE 1 END * CASE WHEN held <> was THEN 0.999 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity, sum((held = 1 AND was = 0)::INT) OVER (PARTITION BY symbol ORDER BY day) AS trade FROM tu)"


@query(f"WITH {DAILY}, {HELD}, fe AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY day) - 1 AS fall FROM eq) SELECT symbol, round(ln(arg_max(equity, day)), 4) + 0.0 AS log_final, count(DISTINCT CASE WHEN held = 1 THEN trade END) AS trades, round(avg(held), 6) + 0.0 AS held_share, round(min(fall), 5) + 0.0 AS deepest FROM fe GROUP BY symbol")
def signals_long_flat(spark, sf_dir):
    """In while the close is well over its five-row mean, out once it is under it, with a fee each way."""
    from quantframe.functions.windows import full, rolling
    from quantframe.operators import signals

    w = rolling(["symbol"], ["day"], 5)
    t = tables.daily(spark, sf_dir).withColumn("m", full(F.avg("close").over(w), w, 5, F.col("close")))
    table = signals.long_flat(t, ["symbol"], ["day"], "close", F.col("close") > F.col("m") * 1.05, F.col("close") < F.col("m"))
    told = signals.long_flat_statistics(table, ["symbol"], "day")
    return shown(told.select("symbol", F.round(F.ln("final"), 4).alias("log_final"), "trades", "held_share", F.round("deepest", 5).alias("deepest")))


@query(f"WITH {DAILY}, {FROM_RET}, sg AS (SELECT *, sign(close - ({mean('close', 10)})) AS signal FROM rr) SELECT symbol, strftime(day, {AT}) AS day, round(ret * lag(signal) OVER {W}, 6) + 0.0 AS gain FROM sg")
def signals_strategy_returns(spark, sf_dir):
    from quantframe.functions.windows import full, rolling
    from quantframe.operators import signals

    w = rolling(["symbol"], ["day"], 10)
    t = returned(spark, sf_dir).withColumn("signal", F.signum(F.col("close") - full(F.avg("close").over(w), w, 10, F.col("close"))))
    return shown(t.select("symbol", "day", signals.strategy_returns(t, ["symbol"], ["day"], "signal").alias("gain")))


@query("WITH a AS (SELECT o_orderpriority AS strategy, sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS current FROM orders GROUP BY 1), t AS (SELECT *, 0.05 * (ascii(strategy) - 45) / 1.0 AS target FROM a) SELECT strategy, round(current, 6) + 0.0 AS current, round(target, 6) + 0.0 AS target, round(target - current, 6) + 0.0 AS change FROM t WHERE abs(target - current) > 0.02")
def risk_rebalancing(spark, sf_dir):
    """Allocations off their targets by over two per cent."""
    from quantframe.operators import risk
    from pyspark.sql import Window

    sums = tables.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.sum("o_totalprice").alias("x"))
    t = sums.select("strategy", (F.col("x") / F.sum("x").over(Window.partitionBy(F.lit(1)))).alias("current"), (0.05 * (F.ascii("strategy") - 45)).alias("target"))
    return shown(risk.rebalancing(t, 0.02))


SEVERITY = "CASE sum(l_quantity)::BIGINT % 4 WHEN 1 THEN 'warning' WHEN 2 THEN 'critical' WHEN 3 THEN 'emergency' END"
BREACHES = f"b0 AS (SELECT l_suppkey AS portfolio, l_returnflag || l_linestatus AS kind, year(l_shipdate) AS y, {SEVERITY} AS severity FROM lineitem WHERE year(l_shipdate) IN (1996, 1997) GROUP BY ALL), bs AS (SELECT portfolio, kind, o.severity AS was, n.severity AS now FROM (SELECT * FROM b0 WHERE y = 1996 AND severity IS NOT NULL) o FULL JOIN (SELECT * FROM b0 WHERE y = 1997 AND severity IS NOT NULL) n USING (portfolio, kind))"


def breaches(spark, sf_dir):
    from quantframe.operators import risk

    line = tables.read(spark, sf_dir, "lineitem")
    step = F.sum("l_quantity").cast("long") % 4
    severity = F.when(step == 1, "warning").when(step == 2, "critical").when(step == 3, "emergency")
    of = lambda y: line.filter(F.year("l_shipdate") == y).groupBy(F.col("l_suppkey").alias("portfolio"), F.concat("l_returnflag", "l_linestatus").alias("kind")).agg(severity.alias("severity")).filter("severity IS NOT NULL")
    return risk.breach_state(of(1996), of(1997), ["portfolio"])


@query(f"WITH {BREACHES} SELECT portfolio, kind, was, now, CASE WHEN now IS NULL THEN 'ended' WHEN was IS NULL THEN 'fresh' ELSE 'going on' END AS state FROM bs")
def risk_breach_states(spark, sf_dir):
    return breaches(spark, sf_dir)


@query(f"WITH {BREACHES} SELECT portfolio, count(*) FILTER (now = 'warning') AS warning, count(*) FILTER (now = 'critical') AS critical, count(*) FILTER (now = 'emergency') AS emergency, count(*) FILTER (now = 'emergency') > 0 OR count(*) FILTER (now = 'critical') >= 2 AS halt FROM bs WHERE now IS NOT NULL GROUP BY portfolio")
def risk_halts(spark, sf_dir):
    from quantframe.operators import risk

    return risk.halts(breaches(spark, sf_dir), ["portfolio"])


@query(f"WITH {DAILY} SELECT strftime(day, {TS}) AS ts, {r('low', 'high', 'open', 'close', 'volume')} FROM d")
def sources_candles(spark, sf_dir):
    """Daily bars as a provider sends them, arrays of numbers, and read back."""
    from quantframe.sources import parsers

    bar = F.array(F.unix_timestamp(F.col("day").cast("timestamp")).cast("double"), *[F.col(c).cast("double") for c in ("low", "high", "open", "close", "volume")])
    sent = tables.daily(spark, sf_dir).groupBy("symbol").agg(F.collect_list(bar).alias("candles"))
    return shown(parsers.candles(sent, "candles"))


@query(f"WITH {DAILY}, x AS (SELECT symbol, day, close % 40 AS vix, (volume % 16) / 10 AS put_call FROM d) SELECT symbol, strftime(day, {AT}) AS day, round((CASE WHEN vix < 20 THEN 1 WHEN vix > 30 THEN -1 ELSE 0 END + CASE WHEN put_call < 0.8 THEN 1 WHEN put_call > 1.2 THEN -1 ELSE 0 END) / 2, 6) + 0.0 AS sentiment FROM x")
def sentiment_market(spark, sf_dir):
    from quantframe.operators import sentiment

    t = tables.daily(spark, sf_dir).select("symbol", "day", sentiment.market_sentiment(F.col("close") % 40, F.col("volume") % 16 / 10).cast("double").alias("sentiment"))
    return shown(t)


# --- what streams give, over tables ---
def live_ticks(spark, sf_dir):
    return tables.ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH {TICKS} SELECT symbol, strftime(time_bucket(INTERVAL 6 HOUR, ts), {TS}) AS bar, {r('open', 'high', 'low', 'close', 'volume')}, n FROM (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts) AS ts, arg_min(price, row(ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, id)) AS close, sum(volume) AS volume, count(*) AS n FROM t GROUP BY symbol, time_bucket(INTERVAL 6 HOUR, ts))")
def stream_live_bars(spark, sf_dir):
    from quantframe.streaming import monitor

    return shown(monitor.live_bars(live_ticks(spark, sf_dir), ["symbol"], "6 hours", "1 hour"))


@query(f"WITH {TICKS}, w AS (SELECT symbol, price, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY * k AS fin FROM t, (SELECT unnest([1, 2]) AS k)) SELECT symbol, strftime(fin, {TS}) AS \"at\", round(avg(price), 6) + 0.0 AS mean, round(stddev_samp(price), 6) + 0.0 AS sd, round(max(price) - min(price), 6) + 0.0 AS range, count(*) AS n FROM w GROUP BY symbol, fin")
def stream_look_back(spark, sf_dir):
    """Sliding windows of two days, a day apart."""
    from quantframe.streaming import monitor

    return shown(monitor.look_back(live_ticks(spark, sf_dir), ["symbol"], "2 days", "1 day", "1 hour"))


@query(f"WITH {TICKS}, g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) >= INTERVAL 8 HOUR, true)::INT AS new FROM t), x AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts) AS session FROM g) SELECT symbol, strftime(min(ts), {TS}) AS start, strftime(max(ts) + INTERVAL 8 HOUR, {TS}) AS end, count(*) AS n, round(sum(volume), 6) + 0.0 AS volume FROM x GROUP BY symbol, session")
def stream_sessions(spark, sf_dir):
    from quantframe.streaming import monitor

    return shown(monitor.activity_sessions(live_ticks(spark, sf_dir), ["symbol"], "8 hours", "1 hour"))


@query()
def stream_alerts(spark, sf_dir):
    """Portfolios of daily results and positions replayed through the alerts' state: drawdown, concentration and volatility spikes by threshold. Cooldowns follow on
    each other, so without SQL; tests hold the replay against plain histories, and the stream against the replay."""
    from quantframe.streaming import alerts

    line = tables.read(spark, sf_dir, "lineitem")
    each = line.groupBy(F.col("l_suppkey").cast("string").alias("portfolio"), F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("strategy")).agg(F.sum("l_extendedprice").alias("value"))
    days = each.groupBy("portfolio", "day").agg(F.sum("value").alias("pnl"), F.sort_array(F.collect_list(F.struct("strategy", "value"))).alias("positions"))
    updates = days.select("portfolio", F.col("day").cast("timestamp").alias("ts"), F.datediff("day", F.lit("1970-01-01")).cast("long").alias("id"), "pnl", "positions")
    limits = [alerts.Threshold("deep", "max_drawdown", 0.8, "warning", 30 * 86400.0), alerts.Threshold("deeper", "max_drawdown", 0.95, "critical", 7 * 86400.0), alerts.Threshold("one place", "max_position_pct", 0.8, "warning", 10 * 86400.0), alerts.Threshold("jumpy", "volatility_spike", 1.5, "emergency", 86400.0)]
    return shown(alerts.replay(updates, limits))

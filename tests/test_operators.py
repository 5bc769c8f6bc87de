"""Cases worked by hand, and operators that SQL can't express."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantframe.functions import options
from quantframe.functions.windows import compounded, ordered
from quantframe.operators import align, bars, clean, risk, sentiment
from quantframe.sources import parsers


def frame(spark, rows, schema):
    kinds = [c.rsplit(" ", 1)[1] for c in schema.split(", ")] if "<" not in schema else []
    floats = [tuple(float(x) if k == "double" and x is not None else x for x, k in zip(row, kinds)) for row in rows] if kinds else rows
    return spark.createDataFrame(floats, schema)


def test_volume_bars_discard_the_overshoot(spark):
    assert bars.volume_bar_ids(np.array([6.0, 6, 9, 2, 5]), 10).tolist() == [0, 0, 1, 1, 2]
    rows = [(s, i, i, 100.0 + i, v) for s in (1, 2) for i, v in enumerate([6.0, 6, 9, 2, 5])]
    got = bars.volume_bars(frame(spark, rows, "symbol int, ts int, id int, price double, volume double"), ["symbol"], 10.0)
    assert sorted((r["symbol"], r["volume_bar"], r["volume"], r["n"]) for r in got.collect()) == [(s, b, v, n) for s in (1, 2) for b, v, n in ((0, 12.0, 2), (1, 11.0, 2), (2, 5.0, 1))]


def test_volume_bars_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = np.random.default_rng(0)
    v = rng.integers(1, 30, 500).astype(float)
    got = bars.volume_bars(frame(spark, [(1, i, i, 1.0, float(x)) for i, x in enumerate(v)], "symbol int, ts int, id int, price double, volume double"), ["symbol"], 100.0)
    want, held = [0.0], False
    for x in v:
        if held:
            want.append(0.0)
        want[-1] += x
        held = want[-1] >= 100
    assert [r["volume"] for r in got.orderBy("volume_bar").collect()] == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_event_bars_and_count_windows(spark):
    df = frame(spark, [(1, i, i, p, 1.0) for i, p in enumerate([100.0, 101, 120, 121])], "symbol int, ts int, id int, price double, volume double")
    assert sorted(r["n"] for r in bars.event_bars(df, ["symbol"], 0.1).collect()) == [1, 3]
    df = frame(spark, [(1, i, i, 1.0, 1.0) for i in range(8)], "symbol int, ts int, id int, price double, volume double")
    assert sorted(r["start"] for r in bars.count_windows(df, ["symbol"], 4, 0.5).collect()) == [0, 2, 4]


def test_fills(spark):
    df = frame(spark, [(1, i, v) for i, v in enumerate([1.0, None, None, None, 5.0])], "k int, i int, v double")
    got = [r["x"] for r in df.withColumn("x", align.fill(df, ["k"], ["i"], "v", "ffill", 2)).orderBy("i").collect()]
    assert got == [1, 1, 1, None, 5]
    df = frame(spark, [(1, i, v) for i, v in enumerate([1.0, None, None, 4.0, None])], "k int, i int, v double")
    assert [r["v"] for r in align.interpolate(df, ["k"], ["i"], "v", 1).orderBy("i").collect()] == [1, 2, None, 4, 4]


def test_outliers_codes_and_sanitising(spark):
    df = frame(spark, [(1, v) for v in (1.0, 2, 100, 4, 5)], "k int, v double")
    assert sorted(r["v"] for r in clean.cap_outliers(df, ["k"], "v").collect()) == [1, 2, 4, 5, 11]
    codes = clean.label_codes(frame(spark, [("b",), (None,), ("a",), ("b",)], "c string"), "c").collect()
    assert sorted((r["c"] or "", r["code"]) for r in codes) == [("", None), ("a", 0), ("b", 1), ("b", 1)]
    got = clean.sanitize(frame(spark, [("1.5",), ("x",), ("Infinity",), (None,)], "v string"), ["v"]).collect()
    assert [r["v"] for r in got] == [1.5, None, None, None]
    df = frame(spark, [(float(i), i * 2.0 + (i % 3), float((i * 7) % 11)) for i in range(50)], "a double, b double, c double")
    assert clean.uncorrelated(df, ["a", "b", "c"]) == ["b", "c"]


def test_greeks_at_expiry_and_parity(spark):
    df = frame(spark, [(90.0, 100.0, 0.0, 0.2, "put"), (100.0, 95.0, 0.5, 0.3, "call"), (100.0, 95.0, 0.5, 0.3, "put")], "spot double, strike double, years double, iv double, option_type string")
    put0, call, put = options.with_greeks(df).collect()
    assert (put0["price"], put0["delta"], put0["gamma"]) == (10, 1, 0)
    assert call["price"] - put["price"] == pytest.approx(100 - 95 * math.exp(-0.01), abs=1e-9)
    d1 = (math.log(100 / 95) + (0.02 + 0.045) * 0.5) / (0.3 * math.sqrt(0.5))
    assert call["delta"] == pytest.approx(0.5 * (1 + math.erf(d1 / math.sqrt(2))), abs=1e-6)


def test_condor_margin(spark):
    legs = [(1, "put", 90.0, 1.0, 1.0), (1, "put", 95.0, -1.0, 2.0), (1, "call", 105.0, -1.0, 2.0), (1, "call", 110.0, 1.0, 1.0)]
    r = options.condor_margin(frame(spark, legs, "p int, option_type string, strike double, quantity double, premium double"), "p").first()
    assert (r["premium"], r["width"], r["margin"], r["break_even_low"], r["break_even_high"]) == (200, 500, 300, 93, 107)


def test_compounding_with_losses_beyond_all(spark):
    df = frame(spark, [(1, i, x) for i, x in enumerate([0.1, -2.0, 0.5, -1.0, 0.2])], "k int, i int, r double")
    got = [r["c"] for r in df.withColumn("c", compounded("r", ordered(["k"], "i"))).orderBy("i").collect()]
    assert got == pytest.approx(list(np.cumprod([1.1, -1.0, 1.5, 0.0, 1.2])))


def test_parsers(spark):
    payload = frame(spark, [('{"observations": [{"date": "2023-01-01", "value": "1.5"}, {"date": "2023-02-01", "value": "."}]}',)], "j string")
    assert [tuple(r) for r in parsers.observations(payload, "j", "x").select(F.date_format("day", "yyyy-MM-dd"), "x").collect()] == [("2023-01-01", 1.5)]
    c = parsers.candles(frame(spark, [([[60.0, 1.0, 4.0, 2.0, 3.0, 9.0]],)], "c array<array<double>>"), "c").first()
    assert (c["low"], c["high"], c["open"], c["close"], c["volume"]) == (1, 4, 2, 3, 9)
    p = parsers.price_points(frame(spark, [(1, [[1000.0, 10.0], [2000.0, 11.0]], [[1000.0, 5.0]])], "k int, p array<array<double>>, v array<array<double>>"), ["k"], "p", "v").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in p] == [(10, 11, 0)]
    f = parsers.fear_greed(frame(spark, [([(1000.0, 80.0)],)], "p array<struct<x: double, y: double>>"), "p").first()
    assert (f["class"], f["normalised"]) == ("extreme greed", 0.6)
    s = parsers.standardise(frame(spark, [("2023-01-01 10:00:00", "7"), ("bad", "8")], "`Date Time` string, `Close-Price` string"), "Date Time", ["Close-Price"]).collect()
    assert len(s) == 1 and s[0]["close_price"] == 7


def test_returns_file_round_trip(spark, tmp_path):
    (tmp_path / "r.csv").write_text("date,returns\n2023-01-02,0.01\nbad,1\n")
    df = parsers.read_returns(spark, str(tmp_path / "r.csv"))
    parsers.write_results(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_rebalancing_and_sentiment(spark):
    got = risk.rebalancing(frame(spark, [("a", 0.5, 0.4), ("b", 0.5, 0.49)], "strategy string, target double, current double"), 0.05).collect()
    assert [(r["strategy"], round(r["change"], 2)) for r in got] == [("a", 0.1)]
    r = frame(spark, [(15.0, 0.7), (35.0, 1.3), (25.0, 1.0)], "v double, p double").select(sentiment.market_sentiment(F.col("v"), F.col("p")).alias("s")).collect()
    assert [x["s"] for x in r] == [1, -1, 0]


def test_implied_volatility_finds_the_model(spark):
    df = frame(spark, [(100.0, 95.0, 0.5, v, k) for v in (0.1, 0.3, 0.9) for k in ("call", "put")], "spot double, strike double, years double, iv double, option_type string")
    for r in options.implied_volatility(options.with_greeks(df)).collect():
        assert r["implied"] == pytest.approx(r["iv"], abs=1e-4)


def newton(market, s, k, t, kind, rate=0.02):
    """Brute force: one contract, step by step."""
    def cdf(x):
        u = 1 / (1 + options.TAIL_RATE * abs(x))
        tail = math.exp(-x * x / 2) / math.sqrt(2 * math.pi) * sum(c * u ** (n + 1) for n, c in enumerate(options.TAIL))
        return 1 - tail if x >= 0 else tail

    v = 0.2
    for _ in range(100 if t > 0 else 0):
        d1 = (math.log(s / k) + (rate + v * v / 2) * t) / (v * math.sqrt(t))
        price = s * cdf(d1) - k * math.exp(-rate * t) * cdf(d1 - v * math.sqrt(t))
        price -= 0 if kind == "call" else s - k * math.exp(-rate * t)
        vega = s * math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * math.sqrt(t)
        if abs(price - market) < 1e-6 or vega == 0:
            break
        v = max(0.001, v - (price - market) / vega)
    return v if t > 0 else 0.0


def test_implied_volatility_of_the_whole_chain(spark, sf_dir):
    from quantframe.jobs import registry

    rows = [(p, s, 100.0, t, kind) for s in (20.0, 60.0, 95.0, 100.0, 130.0, 400.0) for t in (0.0, -0.1, 0.02, 0.5) for kind in ("call", "put") for p in (0.0, 0.5, 7.0, 95.0, 310.0)]
    got = options.implied_volatility(spark.createDataFrame(rows, "price double, spot double, strike double, years double, option_type string")).collect()
    ends = [newton(*r) for r in rows]
    assert [r["implied"] for r in got] == pytest.approx([newton(r["price"], r["spot"], r["strike"], r["years"], r["option_type"]) for r in got], rel=1e-6)
    assert 0.0 in ends and 0.001 in ends and max(ends) > 10
    chain = registry.QUERIES["options_implied_volatility_chain"](spark, sf_dir)
    assert chain.count() == registry.QUERIES["options_greeks"](spark, sf_dir).count() and chain.filter("implied IS NULL OR isnan(implied)").count() == 0


def test_exponential_means_carry_over_batches(spark):
    import pandas as pd

    from quantframe.functions.smoothing import exponential

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    x = np.random.default_rng(1).normal(size=43)
    df = frame(spark, [(k, i, float(v)) for k in (1, 2) for i, v in enumerate(x)], "k int, i int, x double")
    got = [r["m"] for r in exponential(df, ["k"], ["i"], {"m": ("x", 0.2)}).filter("k = 2").orderBy("i").collect()]
    assert got == pytest.approx(pd.Series(x).ewm(alpha=0.2, adjust=False).mean().tolist())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_monte_carlo_and_legs(spark):
    from quantframe.operators import signals

    r = signals.monte_carlo(spark, 0.0, 0.01, 2000, 20).first()
    assert abs(r["mean"]) < 0.01 and 0.03 < r["sd"] < 0.06 and r["low"] < r["var"] < 0 < r["high"]
    legs = options.strategy_legs(frame(spark, [(100.0,)], "spot double"), options.CONDOR_LEGS).collect()
    assert [(x["option_type"], x["strike"], x["sign"]) for x in legs] == [("put", 90, 1), ("put", 95, -1), ("call", 105, -1), ("call", pytest.approx(110), 1)]

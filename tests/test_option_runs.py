"""Books that run over time, against plain replays."""

import datetime as dt
import math
import random

import pytest

from quantframe.operators import option_runs as runs

START = dt.date(2024, 1, 1)


def replay(rows, legs, capital, share, enters, days):
    """rows (day, spot, signal) of one portfolio: a list of positions, no heap, no stream."""
    cash, held, out = capital, [], []
    for day, spot, signal in rows:
        if spot is None:
            continue
        pay = lambda kind, strike: max(0.0, spot - strike) if kind == "call" else max(0.0, strike - spot)
        marks = [q * (pay(k, x) + max(0.05, pay(k, x) / 10)) for k, x, q, _ in held]
        out.append([day, cash, sum(marks), cash + sum(marks), 0, 0.0])
        if enters(day) and signal is not None and signal > 0.5:
            n = max(1, math.trunc(cash * share / sum(leg.ask if leg.sign > 0 else leg.bid for leg in legs)))
            for leg in legs:
                half = (leg.ask - leg.bid) / 2
                slip = half * (1 + 0.5 * math.sqrt(n / leg.volume))
                price = leg.ask + slip if leg.sign > 0 else max(0.01, leg.bid - slip)
                cash -= leg.sign * n * price + 1 + 0.65 * n + n * slip
                out[-1][4] += 1
                out[-1][5] += 1 + 0.65 * n
                held.append((leg.kind, leg.strike * spot, leg.sign * n, day + dt.timedelta(days=days)))
        cash += sum(q * pay(k, x) for k, x, q, until in held if until <= day)
        held = [h for h in held if h[3] > day]
    return out


def series(seed, n):
    rng, spot, rows = random.Random(seed), 100.0, []
    for i in range(n):
        spot *= 1 + rng.gauss(0, 0.02)
        rows.append((START + dt.timedelta(days=i), spot if i % 17 else None, rng.choice([0.0, 1.0, None])))
    return rows


@pytest.mark.parametrize("legs, how, enters", [(runs.CONDOR, "weekly", lambda d: d.weekday() == 0), (runs.STRANGLE, "monthly", lambda d: d.day == 1), (runs.STRANGLE, "daily", lambda d: True)])
def test_back_test_equals_a_plain_replay(spark, legs, how, enters):
    books = {"a": series(1, 300), "b": series(2, 90), None: series(3, 40)}
    df = spark.createDataFrame([(k, *row) for k, rows in books.items() for row in rows], "book string, day date, spot double, signal double")
    curve = runs.option_backtest(df, ["book"], "day", "spot", "signal", legs, capital=50_000.0, share=0.2, rebalance=how, days=20)
    got = curve.collect()
    for book, rows in books.items():
        mine = sorted((r for r in got if r["book"] == book), key=lambda r: r["day"])
        want = replay(rows, legs, 50_000.0, 0.2, enters, 20)
        assert [r["day"] for r in mine] == [w[0] for w in want]
        for r, w in zip(mine, want):
            assert [r["capital"], r["position_value"], r["total"], r["legs_traded"], r["commission"]] == pytest.approx(w[1:], rel=1e-9, abs=1e-6)
    assert any(r["open_legs"] for r in got)


def test_size_follows_capital_and_metrics(spark):
    rows = [("x", START + dt.timedelta(days=i), 100.0 + i % 7, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "book string, day date, spot double, signal double")
    small, large = (runs.option_backtest(df, ["book"], "day", "spot", "signal", runs.STRANGLE, capital=c, rebalance="weekly") for c in (1e4, 1e6))
    traded = [t.agg({"commission": "sum"}).first()[0] for t in (small, large)]
    assert traded[1] > 50 * traded[0]
    table = runs.backtest_metrics(small, ["book"], "day").first()
    totals = [r["total"] for r in small.orderBy("day").collect()]
    rets = [b / a - 1 for a, b in zip(totals, totals[1:])]
    grown, peak, deepest = 1.0, -math.inf, 0.0
    for r in rets:
        grown *= 1 + r
        peak = max(peak, grown)
        deepest = min(deepest, grown / peak - 1)
    assert table["max_drawdown"] == pytest.approx(deepest) and table["total_return"] == pytest.approx(totals[-1] / totals[0] - 1)
    assert table["win_rate"] == pytest.approx(sum(r > 0 for r in rets) / len(rets)) and table["final"] == totals[-1]
    assert runs.option_backtest(df.limit(0), ["book"], "day", "spot", "signal").count() == 0


def test_a_long_book_streams_over_many_batches(spark):
    df = spark.range(30_000).selectExpr("1 AS book", "date_add(DATE '1950-01-01', cast(id AS int)) AS day", "100 + id % 13 AS spot", "1.0 AS signal")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = [r["total"] for r in runs.option_backtest(df, ["book"], "day", "spot", "signal", rebalance="monthly").orderBy("day").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = replay([(dt.date(1950, 1, 1) + dt.timedelta(days=i), 100.0 + i % 13, 1.0) for i in range(30_000)], runs.CONDOR, 1e5, 0.1, lambda d: d.day == 1, 30)
    assert got == pytest.approx([w[3] for w in want])


def test_covered_calls_follow_one_another(spark):
    d = lambda i: START + dt.timedelta(days=i)
    quotes = [(d(0), 120.0, 100.0, 1.0, "far"), (d(0), 105.0, 100.0, 3.0, "b"), (d(0), 104.0, 100.0, 4.0, "a"), (d(3), 104.0, 101.0, 4.5, "c"), (d(19), 104.0, 103.0, 2.0, "early"), (d(25), 105.0, 103.0, 2.5, "other"), (d(26), 104.0, 102.0, 2.0, "d"), (d(26), 105.0, 102.0, 1.0, "same day"), (d(27), 108.0, 103.0, 5.0, "e"), (d(28), None, 103.0, 5.0, "f"), (d(60), 104.0, 103.0, 5.0, "g")]
    df = spark.createDataFrame([("p", *q) for q in quotes] + [("q", *quotes[0])], "book string, day date, strike double, spot double, price double, contract string")
    got = sorted(tuple(r) for r in runs.covered_call_run(df, ["book"]).drop("closed").collect())
    assert got == [("p", d(0), d(26), 104.0, 100.0, 102.0, 4.0, 2.0, 199.0, 401.0), ("p", d(27), None, 108.0, 103.0, None, 5.0, None, None, None)]

"""Implied volatilities to the last bit, which rounding hides only as long as no Newton step divides by next to no vega."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quantframe.functions import options
from quantframe.jobs import registry  # isort: skip
from quantframe.jobs import queries


def test_unrounded_volatilities_are_those_of_the_sql(spark, sf_dir):
    sql = registry.ORACLES["options_implied_volatility"]
    plain = sql[: sql.rindex("SELECT contract, CASE")] + "SELECT contract, market, v FROM (SELECT id, arg_max(v, step) AS v FROM nw GROUP BY id) JOIN mk USING (id)"
    db = duckdb.connect()
    for t in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(db.execute(plain).fetchall())
    got = options.implied_volatility(options.with_price(queries.dated(spark, sf_dir))).select("contract", "price", "implied").collect()
    assert max(v for _, _, v in want) > 1000  # steps that overshot are among them
    assert sorted(map(tuple, got)) == want


def test_prices_with_and_without_greeks(spark):
    rows = [(s, 100.0, t, v, kind) for s in (60.0, 100.0, 160.0) for t in (0.0, 0.02, 1.0) for v in (0.1, 0.4) for kind in ("call", "put")] + [(None, 100.0, 1.0, 0.2, "call")]
    df = spark.createDataFrame(rows, "spot double, strike double, years double, iv double, option_type string")
    both = options.with_price(options.with_greeks(df).withColumnRenamed("price", "model")).collect()
    for r in both:
        assert math.isclose(r["price"], r["model"], rel_tol=1e-9, abs_tol=1e-9)


def test_rows_stop_for_themselves():
    s, k, t, call = np.array([100.0, 100.0, 900.0, 100.0, np.nan]), np.array([100.0, 100.0, 900.0, 1e-3, 100.0]), np.array([1.0, 0.0, 0.5, 0.02, 1.0]), np.array([True, True, False, True, True])
    market = np.array([10.0, 5.0, 80.0, 120.0, 1.0])
    together = options.newton_volatility(market, s, k, t, call, 0.02)
    alone = [options.newton_volatility(*(x[i : i + 1] for x in (market, s, k, t, call)), 0.02)[0] for i in range(len(s))]
    assert together.tolist() == alone and together[1] == 0 and together[4] == 0.2


def test_halves_of_three_decimals_go_up(spark):
    shown = [r[0] for r in spark.createDataFrame([(0.0625,), (1.0005,), (0.2,), (1234.5678,)], "v double").select(queries.legible(F.col("v"))).collect()]
    assert shown == [*[round(math.floor(v * 1000 + 0.5)) / 1000 for v in (0.0625, 1.0005, 0.2)], 1235.0]


def test_margins_are_the_same_in_any_order_of_legs(spark):
    rng = np.random.default_rng(3)
    legs = [(f"p{p}", ("condor", "covered_call", "other")[p % 3], float(rng.uniform(1, 5000)), ("call", "put")[int(rng.integers(2))], float(rng.uniform(900, 1000)), int(rng.choice([-1, 1])), float(rng.uniform(90, 400))) for p in range(90) for _ in range(5)]
    names = "position string, strategy string, spot double, option_type string, strike double, quantity int, premium double"
    sums = []
    for rows in (legs, legs[::-1], sorted(legs, key=lambda x: x[-1])):
        df = spark.createDataFrame(rows, names).coalesce(1)
        spot = df.groupBy("position").agg((options.steady_sum(F.col("spot")) / F.count("spot")).alias("spot"))
        sums.append(sorted(map(tuple, options.margins(df.drop("spot").join(spot, "position"), "position").collect())))
    assert sums[0] == sums[1] == sums[2]
    assert [r[3] for r in sums[0]] == [math.fsum(x[-1] * x[-2] for x in legs if x[0] == r[0]) for r in sums[0]]


def test_steady_sums_of_odd_values(spark):
    df = spark.createDataFrame([("none", None), ("some", None), ("some", 0.1), ("inf", float("inf")), ("inf", 1.0), ("nan", float("nan")), ("large", 1e15), ("large", 0.25)], "k string, x double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(options.steady_sum(F.col("x")).alias("s")).collect()}
    assert (got["none"], got["some"], got["inf"], got["large"]) == (None, 0.1, math.inf, 1e15 + 0.25) and math.isnan(got["nan"])

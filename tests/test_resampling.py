"""Simulated distributions against resampling in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantframe.operators import resampling


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, float(x)) for k, n, m in (("a", 300, 0.001), ("b", 80, -0.004), (None, 40, 0.0)) for i, x in enumerate(rng.normal(m, 0.02, n))]
    return spark.createDataFrame(rows, "key string, at int, ret double").repartition(4)


def series(table, key):
    return np.array([r["ret"] for r in table.filter(F.col("key").eqNullSafe(key)).collect()])


def test_weights_are_poisson():
    u = resampling.uniform(np.arange(2000, dtype=np.uint64) * np.uint64(977), 50, 3)
    for mean in (0.3, 1.0, 4.0):
        w = resampling.poisson(u, np.full(2000, mean))
        assert w.mean() == pytest.approx(mean, rel=0.02) and w.var() == pytest.approx(mean, rel=0.03)
    assert abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.06


@pytest.mark.parametrize("periods", [None, 60])
def test_bootstrap_equals_exact_resampling(table, periods):
    got = {r["key"]: r for r in resampling.monte_carlo(table, ["key"], ["key", "at"], number=2000, periods=periods).collect()}
    rng = np.random.default_rng(9)
    for key in ("a", "b", None):
        x = series(table, key)
        n = periods or len(x)
        exact = np.exp(np.log1p(x)[rng.integers(0, len(x), (20_000, n))].sum(axis=1)) - 1
        r, spread = got[key], exact.std()
        assert r["mean"] == pytest.approx(exact.mean(), abs=0.12 * spread) and r["deviation"] == pytest.approx(spread, rel=0.12)
        for c, q in (("low", 2.5), ("high", 97.5), ("var_5", 5)):
            assert r[c] == pytest.approx(np.percentile(exact, q), abs=0.25 * spread)
        assert r["loss"] == pytest.approx((exact < 0).mean(), abs=0.05) and r["large_loss"] == pytest.approx((exact < -0.2).mean(), abs=0.05)


def test_partitions_and_reruns_agree(table):
    one, many = (sorted((str(r["key"]), r["replicate"], round(r["total"], 9)) for r in resampling.replicates(t, ["key"], ["key", "at"], "ret", 50, None, 7).collect()) for t in (table.coalesce(1), table.repartition(7)))
    assert one == many and len(one) == 150


def test_normal_draws_and_value_at_risk(table):
    got = {r["key"]: r for r in resampling.monte_carlo(table, ["key"], ["at"], number=4000, periods=50, method="normal").collect()}
    for key in ("a", "b"):
        x = series(table, key)
        drawn = (1 + np.random.default_rng(2).normal(x.mean(), x.std(ddof=1), (20_000, 50))).prod(axis=1) - 1
        assert got[key]["mean"] == pytest.approx(drawn.mean(), abs=0.1 * drawn.std()) and got[key]["deviation"] == pytest.approx(drawn.std(), rel=0.08)
    risk = {(r["key"], r["confidence"]): r for r in resampling.simulated_value_at_risk(table, ["key"], ["at"], value=1000.0, last=60).collect()}
    x = np.array([r["ret"] for r in table.filter("key = 'a' AND at >= 240").collect()])
    want = -(x.mean() - 1.644854 * x.std(ddof=1)) * 1000
    assert risk["a", 0.95]["var_1"] == pytest.approx(want, rel=0.06) and risk["a", 0.99]["var_21"] == pytest.approx(risk["a", 0.99]["var_1"] * 21**0.5)


def test_empty(table):
    assert resampling.monte_carlo(table.limit(0), ["key"], ["at"]).count() == 0

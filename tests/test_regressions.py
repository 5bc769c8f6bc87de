"""Fits from sums of products against fits on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantframe.operators import regressions as rg


def series(seed, n, p=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 5, 0.2][:p] + [100, 0, -3][:p]
    return x, x @ np.array([0.5, -0.2, 1.5])[:p] + rng.normal(size=n) * (1 + np.arange(n) / n)


DATA = {"a": series(1, 620), "b": series(2, 400), "c": series(3, 50)}
XS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, i, *map(float, x[i]), float(y[i])) for k, (x, y) in DATA.items() for i in range(len(y))]
    rows += [("a", 9999, None, 1.0, 1.0, 1.0), ("b", 9999, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "key string, at int, x0 double, x1 double, x2 double, y double").repartition(3)


def plain(x, y):
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def mse(c, x, y):
    return float(((y - c[0] - x @ c[1:]) ** 2).mean())


def test_walk_forward_equals_refits(table):
    got = {(r["key"], r["fold"]): r for r in rg.walk_forward_fits(table, ["key"], ["at"], XS, "y", least=100, steps=3, step=20).collect()}
    want = {}
    for key, (x, y) in DATA.items():
        start, fold = 100, 0
        while start + 60 <= len(y):
            c = plain(x[:start], y[:start])
            want[key, fold] = (start, mse(c, x[:start], y[:start]), mse(c, x[start : start + 60], y[start : start + 60]))
            start, fold = start + 20, fold + 1
    assert got.keys() == want.keys() and len(want) > 20
    for k, w in want.items():
        assert tuple(got[k])[2:] == pytest.approx(w, rel=1e-7)


def test_learning_curve_equals_refits(table):
    got = {(r["key"], r["size"]): tuple(r)[2:] for r in rg.learning_curve(table, ["key"], ["at"], XS, "y", least=150, horizon=30, sizes=6).collect()}
    want = {}
    for key, (x, y) in DATA.items():
        n = len(y)
        if 150 > 0.8 * n:
            continue
        for i in range(6):
            size = (5 * 150 * 5 + i * (4 * n - 750)) // 25
            scores = []
            for k in (-2, -1, 0):
                a, b = size + 30 * k, size + 30 * (k + 1)
                c = plain(x[:a], y[:a])
                scores.append((-mse(c, x[:a], y[:a]), -mse(c, x[a:b], y[a:b])))
            s = np.array(scores)
            if size + 30 <= n:
                want[key, size] = (s[:, 0].mean(), s[:, 0].std(), s[:, 1].mean(), s[:, 1].std())
    assert got.keys() == want.keys() and len(want) >= 10
    for k, w in want.items():
        assert got[k] == pytest.approx(w, rel=1e-6)


def objective(kind, alpha, w, b, x, y):
    e = y - b - x @ w
    if kind == "ridge":
        return e @ e + alpha * w @ w
    part = 1.0 if kind == "lasso" else 0.5
    return e @ e / (2 * len(y)) + alpha * part * abs(w).sum() + alpha * (1 - part) / 2 * w @ w


def test_complexity_curves(table):
    grid = [1e-4, 0.05, 1.0, 10.0]
    rows = rg.complexity_curves(table, ["key"], ["at"], XS, "y", horizon=40, folds=5, penalties=grid).collect()
    assert {r["key"] for r in rows} == {"a", "b"} and len(rows) == 2 * 3 * 4
    rng = np.random.default_rng(0)
    for r in rows:
        x, y = DATA[r["key"]]
        n = len(y) * 4 // 5
        w, b = np.array(r["weights"]), float(y[:n].mean() - x[:n].mean(axis=0) @ np.array(r["weights"]))
        assert r["train_score"] == pytest.approx(-mse(np.append(b, w), x[:n], y[:n]), rel=1e-7)
        least = objective(r["model"], r["penalty"], w, b, x[:n], y[:n])
        for _ in range(200):  # no other weights do better
            d = rng.normal(size=3) * rng.choice([1e-5, 1e-3, 0.1])
            assert objective(r["model"], r["penalty"], w + d, float(y[:n].mean() - x[:n].mean(axis=0) @ (w + d)), x[:n], y[:n]) >= least - 1e-9 * abs(least)
        if r["model"] == "ridge":
            scores = []
            for k in range(5, 0, -1):
                a = len(y) - k * 40
                xc, yc = x[:a] - x[:a].mean(axis=0), y[:a] - y[:a].mean()
                w = np.linalg.solve(xc.T @ xc + r["penalty"] * np.eye(3), xc.T @ yc)
                scores.append(-mse(np.append(y[:a].mean() - x[:a].mean(axis=0) @ w, w), x[a : a + 40], y[a : a + 40]))
            assert r["test_score"] == pytest.approx(np.mean(scores), rel=1e-7)
    assert sum(r["best"] for r in rows) == 6


def test_student_and_risk(table):
    # two-sided chances from tables: t = 2.228 with 10, 12.706 with 1, 1.96 with very many degrees of freedom
    assert rg.student_two_sided(np.array([2.228139, 12.7062, 1.959964, 0.0]), np.array([10.0, 1.0, 1e7, 5.0])) == pytest.approx([0.05, 0.05, 0.05, 1.0], abs=1e-6)
    walk = rg.walk_forward_fits(table, ["key"], ["at"], XS, "y", least=100, steps=2, step=25)
    learning = rg.learning_curve(table, ["key"], ["at"], XS, "y", least=100, horizon=30)
    for r in rg.overfit_risk(walk, learning, ["key"]).collect():
        f = sorted((w["fold"], w["train_error"], w["test_error"]) for w in walk.filter(F.col("key") == r["key"]).collect())
        train, test = np.array([x[1] for x in f]), np.array([x[2] for x in f])
        assert r["ratio"] == pytest.approx(test.mean() / train.mean()) and r["stability"] == pytest.approx(test.std() / test.mean())
        d = train - test
        assert r["paired_t"] == pytest.approx(d.mean() / d.std(ddof=1) * len(d) ** 0.5) and 0 <= r["paired_p"] <= 1
        assert r["trend_slope"] == pytest.approx(np.polyfit(range(len(f)), test, 1)[0])
        score = (0.3 if r["ratio"] > 2 else 0.15 if r["ratio"] > 1.5 else 0) + (0.2 if r["stability"] > 0.3 else 0.1 if r["stability"] > 0.15 else 0)
        score += 0.25 * (r["trend_slope"] < 0 and r["trend_p"] < 0.05) + (-0.1 if r["converging"] else 0.15) + 0.2 * (r["gap"] is not None and r["gap"] > 0.1)
        assert r["score"] == pytest.approx(score) and r["level"] == ("HIGH" if score >= 0.5 else "MEDIUM" if score >= 0.25 else "LOW")


def test_recursive_predictions_equal_refitting(spark, table):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")
    try:
        got = {(r["key"], r["at"]): r["guess"] for r in rg.recursive_predictions(table, ["key"], ["at"], XS, "y", least=20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(len(y) for _, y in DATA.values())
    for key, (x, y) in DATA.items():
        for i in range(0, len(y), 7):
            if i < 20:
                assert got[key, i] is None
            else:
                c = plain(x[:i], y[:i])
                assert got[key, i] == pytest.approx(c[0] + x[i] @ c[1:], rel=1e-7)


def test_equal_columns_and_empty(spark, table):
    twice = table.withColumn("x1", F.col("x0"))
    got = rg.recursive_predictions(twice, ["key"], ["at"], ["x0", "x1"], "y", least=5).filter("key = 'c' AND at = 40").first()
    x, y = DATA["c"]
    c = plain(x[:40, :1], y[:40])
    assert got["guess"] == pytest.approx(c[0] + c[1] * x[40, 0], rel=1e-6)
    none = table.limit(0)
    assert rg.recursive_predictions(none, ["key"], ["at"], XS, "y").count() == 0 == rg.complexity_curves(none, ["key"], ["at"], XS, "y").count()

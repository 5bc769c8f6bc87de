"""Hidden-Markov regimes against a plain forward-backward and Viterbi per series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantframe.operators import hidden


def plain_pass(m, x):
    """Filtered and smoothed by the textbook recursions over one series, in plain loops."""
    n, k = len(x), len(m.mean)
    dens = lambda v: np.exp(-0.5 * ((v - m.mean) / m.deviation) ** 2) / (m.deviation * np.sqrt(2 * np.pi))
    alpha, c = np.zeros((n, k)), np.zeros(n)
    for t in range(n):
        a = (m.start if t == 0 else alpha[t - 1] @ m.move) * dens(x[t])
        c[t] = a.sum()
        alpha[t] = a / c[t]
    beta = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = m.move @ (dens(x[t + 1]) * beta[t + 1]) / c[t + 1]
    gamma = alpha * beta
    xi = sum((np.outer(alpha[t], dens(x[t + 1]) * beta[t + 1]) * m.move / c[t + 1] for t in range(n - 1)), np.zeros((k, k)))
    return gamma, xi, np.log(c).sum()


def plain_viterbi(m, x):
    logs = -0.5 * ((np.array(x)[:, None] - m.mean) / m.deviation) ** 2 - np.log(m.deviation)
    now, back = np.log(m.start) + logs[0], []
    for t in range(1, len(x)):
        terms = now[:, None] + np.log(m.move)
        back.append(terms.argmax(axis=0))
        now = terms.max(axis=0) + logs[t]
    path = [int(now.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def series():
    rng, out = np.random.default_rng(3), {}
    for key, n in (("a", 230), ("b", 41), ("c", 1), (None, 90)):
        state, x = 0, []
        for _ in range(n):
            state = state if rng.random() < 0.95 else int(rng.integers(0, 3))
            x.append(float(rng.normal([0.1, 0.0, -0.2][state], [0.3, 1.0, 2.5][state])))
        out[key] = x
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, i, v) for k, x in series().items() for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, ("a", 1000, None)], "key string, at int, x double")


MODEL = hidden.Model(np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.06, 0.04], [0.1, 0.85, 0.05], [0.02, 0.08, 0.9]]), np.array([0.1, 0.0, -0.1]), np.array([0.4, 1.1, 2.0]), [])


@pytest.mark.parametrize("block_rows", [7, 60, 4096])
def test_counts_and_regimes_equal_plain_recursions(spark, table, block_rows):
    blocks = hidden.as_blocks(table, ["key"], ["at"], "x", block_rows)
    got = hidden.expected(MODEL, blocks, ["key"])
    passes = {k: plain_pass(MODEL, x) for k, x in series().items()}
    want = np.concatenate([sum(g[0] for g, _, _ in passes.values()), sum(xi for _, xi, _ in passes.values()).ravel(), *[sum((passes[k][0] * (np.array(x)[:, None] ** p)).sum(axis=0) for k, x in series().items()) for p in (0, 1, 2)], [sum(v for _, _, v in passes.values())]])
    # with several blocks the likelihood is that of each given what entered, which adds up to the same
    assert got == pytest.approx(want, rel=1e-8)
    rows = hidden.regimes(table, ["key"], ["at"], "x", block_rows=block_rows, model=MODEL).collect()
    for key, x in series().items():
        mine = sorted((r for r in rows if r["key"] == key), key=lambda r: r["at"])
        assert [r["regime"] for r in mine] == plain_viterbi(MODEL, x)
        assert np.array([r["probabilities"] for r in mine]) == pytest.approx(passes[key][0], abs=1e-9)
    assert len(rows) == sum(map(len, series().values()))


def test_likelihood_never_falls_and_blocks_change_nothing(spark, table):
    models = [hidden.fit(hidden.as_blocks(table, ["key"], ["at"], "x", n), ["key"], 2, rounds=6) for n in (50, 4096)]
    for m in models:
        assert all(b >= a - 1e-9 * abs(a) for a, b in zip(m.likelihood, m.likelihood[1:])) and len(m.likelihood) > 2
        assert m.deviation[0] < m.deviation[1]
    assert models[0].mean == pytest.approx(models[1].mean, rel=1e-6) and models[0].move == pytest.approx(models[1].move, rel=1e-6)


def test_one_long_series_is_many_blocks(spark):
    df = spark.range(200_000).selectExpr("1 AS key", "id AS at", "if(id div 5000 % 2 = 0, 0.2, 3.0) * (hash(id) / 2147483648.0) AS x")
    got = hidden.regimes(df, ["key"], ["at"], "x", k=2, rounds=3, block_rows=4096)
    right = got.filter(F.col("regime") == F.expr("cast(at div 5000 % 2 AS int)")).count()
    assert got.count() == 200_000 and right > 198_000


def test_no_rows_and_constant_series(spark):
    with pytest.raises(ValueError):
        hidden.regimes(spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0)], "key string, at int, x double"), ["key"], ["at"], "x")

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantframe.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=3, lowest=50, highest=95, scale=256.0, every=50):
    """rows (id, vector, label): all scores of each anchor, sorted."""
    rows = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    long_ = lambda x: max(-(2**63), min(2**63 - 1, x))
    out = []
    for a, (ai, av, al) in enumerate(rows):
        if ai is None or ai % every:
            continue
        scores = [(sum(x * y for x, y in zip(av, v)), i, lab) for b, (i, v, lab) in enumerate(rows) if b != a]
        for ps, pi, _ in sorted((s for s in scores if s[2] == al), key=order)[:positives]:
            fit = sorted((s for s in scores if s[2] != al and lowest * ps <= 100 * s[0] <= highest * ps), key=order)[:negatives]
            out += [(ai, pi, k + 1, ni, long_(ps), long_(ns)) for k, (ns, ni, _) in enumerate(fit)]
    return sorted(out, key=str)


def run(df, every=50, **kw):
    return sorted((tuple(r) for r in hn.mine(df, F.col("vec_id") % every == 0, **kw).collect()), key=str)


@pytest.mark.parametrize("size", [1, 40, 2000, 10**7, 10**12, 2**62])
def test_packed_scores_are_exact(size):
    rng = np.random.default_rng(4)
    for width in (1, 7, 64):
        a, rows = (rng.integers(-size, size, (n, width)) for n in (hn.SLICE + 3, 21))
        rows[3] = rows[4]
        anchors = hn.Anchors(np.arange(len(a)), np.zeros(len(a)), a)
        got = np.concatenate([s for _, s in hn.packed_scores(anchors, rows)])
        assert (got == a.astype(object) @ rows.T.astype(object)).all()


def test_several_candidates_share_an_integer():
    rng = np.random.default_rng(5)
    a, rows = rng.integers(-30, 30, (4, 16)), rng.integers(-30, 30, (100, 16))
    widths = []
    real = np.zeros

    class Spy:
        def __getattr__(self, name):
            return getattr(np, name)

        def zeros(self, shape, dtype=float):
            widths.append(shape)
            return real(shape, dtype)

    hn.np, held = Spy(), hn.np
    try:
        list(hn.packed_scores(hn.Anchors(np.arange(4), np.zeros(4), a), rows))
    finally:
        hn.np = held
    assert widths[0][0] == 16 and widths[0][1] <= 34  # three rows or more to a word


def fixture():
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 0 if i % 2 else 1) for i in range(150)]  # ties
    rows += [rows[0], rows[50], rows[50], (None, rows[100][1], rows[100][2]), (None, rows[3][1], 2)]
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 0), (2200, rows[5][1], None), (2250, [], 1), (2300, [0.5, 0.25], 2)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_matches_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert run(df) == want and len(want) > 50
    assert run(df, block_anchors=3) == want
    assert run(df, positives=2, negatives=7, lowest=-20, highest=100) == brute(rows, 2, 7, -20, 100)
    assert run(df.withColumn("id", F.lit("x")).withColumn("rank", F.lit(1))) == want


def test_wide_components_and_no_anchors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 1e13, 5)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df, every=10) == brute(rows, every=10)
    assert run(df.filter("vec_id % 50 > 0")) == [] and run(df.limit(0)) == []


def test_query_matches_brute_force(spark, sf_dir):
    rows = [(r[0], r[1], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in hn.query(spark, sf_dir).collect()), key=str) == brute(rows)

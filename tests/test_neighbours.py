"""Nearest-neighbour imputation against comparing every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantframe.operators import neighbours


def brute(rows, width, k):
    """rows (key, o, x..): all pairs of each key."""
    out = {}
    for key, o, *q in rows:
        mine = [(o2, x) for key2, o2, *x in rows if key2 == key and o2 != o]
        for c in range(width):
            if q[c] is not None:
                continue
            near = []
            for o2, x in mine:
                shared = [(a - b) ** 2 for a, b in zip(q, x) if a is not None and b is not None]
                if x[c] is not None and shared:
                    near.append((math.sqrt(sum(shared) * width / len(shared)), o2, x[c]))
            near = sorted(near)[:k]
            all_ = [x[c] for key2, _, *x in rows if key2 == key and x[c] is not None]
            out[o, c] = sum(v for _, _, v in near) / len(near) if near else sum(all_) / len(all_) if all_ else None
    return out


def table(n, width, seed, share=0.15):
    rng, rows = random.Random(seed), []
    for o in range(n):
        key = rng.choice(["hot"] * 8 + ["b", None])
        base = rng.gauss(0, 1)
        rows.append((key, o, *[None if rng.random() < share else round(base * (c + 1) + rng.gauss(0, 0.3), 2) for c in range(width)]))
    return rows


@pytest.mark.parametrize("width, k, block", [(3, 5, 16), (2, 3, 64), (4, 1, 8)])
def test_equals_all_pairs(spark, width, k, block):
    rows = table(260, width, width)
    rows += [("alone", 9000, *[None] * width), ("few", 9001, 1.0, *[None] * (width - 1)), ("few", 9002, *[2.0] * width), ("hot", 9003, *[None] * width), ("apart", 9004, 1.0, *[None] * (width - 1)), ("apart", 9005, *[None] * (width - 1), 7.0)]
    names = [f"x{i}" for i in range(width)]
    df = spark.createDataFrame(rows, f"key string, o long, {', '.join(f'{n} double' for n in names)}").repartition(3)
    got = {r["o"]: r for r in neighbours.impute(df, ["key"], "o", names, k, block, block_rows=90).collect()}
    assert len(got) == len(rows)
    want = brute(rows, width, k)
    for _, o, *x in rows:
        for c, v in enumerate(x):
            expected = v if v is not None else want[o, c]
            assert got[o][names[c]] == (None if expected is None else pytest.approx(expected)), (o, c)


def test_few_pairs_are_compared_and_nothing_missing_needs_none(spark, monkeypatch):
    df = spark.range(100_000).selectExpr("id % 2 AS key", "id AS o", "(id * 7919 % 100003) / 1000.0D AS a", "if(id % 500 = 3, null, (id * 7919 % 100003) / 500.0D + (id % 7) / 100.0D) AS b")
    seen = []
    real = neighbours.finished
    monkeypatch.setattr(neighbours, "finished", lambda *a: (seen.append(a[-1]), real(*a))[1])
    got = neighbours.impute(df, ["key"], "o", ["a", "b"])
    assert got.filter("b IS NULL").count() == 0 and got.filter("o % 500 = 3 AND abs(b - 2 * a) > 0.2").count() == 0
    pairs = seen[0].agg(F.sum("pairs")).first()[0]
    assert 0 < pairs < 200 * 100_000 / 25  # 200 queries; all pairs would be 200 times 50,000
    assert neighbours.impute(df.dropna().limit(50), ["key"], "o", ["a", "b"]).count() == 50
    assert neighbours.impute(df.limit(0), ["key"], "o", ["a", "b"]).count() == 0

"""Sliding aggregates, residual tests and corrupt input on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantframe.functions.sliding import numbered, rolling_drawdown, sliding
from quantframe.operators import quarantine, underfit


@pytest.mark.parametrize("n", [1, 2, 5, 16])
def test_sliding_equals_each_window(spark, n):
    rng = random.Random(n)
    data = {k: [rng.choice([None, *map(float, range(9))]) if k == "holes" else rng.gauss(0, 1) for _ in range(m)] for k, m in (("a", 40), ("holes", 60), ("short", 3))}
    df = numbered(spark.createDataFrame([(k, i, x) for k, v in data.items() for i, x in enumerate(v)], "key string, at int, x double"), ["key"], ["at"])
    for how, over in (("sum", sum), ("max", max), ("min", min)):
        for r in sliding(df, ["key"], "x", n, how, "y").collect():
            v = data[r["key"]][max(0, r["at"] - n + 1) : r["at"] + 1]
            want = over(v) if len(v) == n and None not in v else None
            assert r["y"] == (pytest.approx(want) if want is not None else None)


def test_total_losses_end_the_windows_they_are_in(spark):
    rets = [0.1, -0.2, 0.05, -1.0, *[0.02, -0.03] * 8]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(rets)], "key string, at int, ret double")
    rows = rolling_drawdown(df, ["key"], ["at"], 3).orderBy("at").collect()
    assert [r["rolling_equity"] is None for r in rows[:8]] == [True, True, False, True, True, True, False, False]
    equity = [math.prod(1 + x for x in rets[i - 2 : i + 1]) if i >= 6 else None for i in range(len(rets))]
    falls = [equity[i] / max(equity[i - 2 : i + 1]) - 1 if i >= 8 else None for i in range(len(rets))]
    assert rows[-1]["rolling_max_drawdown"] == pytest.approx(min(falls[-3:])) and rows[9]["rolling_max_drawdown"] is None


def test_residuals_with_memory_and_changing_variance(spark):
    rng, rows, e = random.Random(4), [], 0.0
    for i in range(400):
        e = 0.8 * e + rng.gauss(0, 1)
        p = rng.uniform(0, 5)
        rows += [("memory", i, e, 0.0), ("spread", i, p + rng.gauss(0, 0.2 + p), p), ("plain", i, p + rng.gauss(0, 1), p), ("gone", i, None, p)]
    got = {r["key"]: r for r in underfit.residual_diagnosis(spark.createDataFrame(rows, "key string, at int, y double, guess double"), ["key"], ["at"], "y", "guess").collect()}
    assert set(got) == {"memory", "spread", "plain"}
    assert got["memory"]["ac_1"] > 0.7 and abs(got["plain"]["ac_1"]) < 0.15
    assert got["spread"]["changing_variance_p"] < 0.001 < 0.01 < got["plain"]["changing_variance_p"]


LINES = ["1,2024-01-01 00:00:00,10", "1,2024-01-01 00:00:00,11", "1,2024-01-01 01:00:00,abc", "1,2024-01-01 02:00:00,", "1,2024-01-01 03:00:00,Infinity", "1,never,12", "just text", "", "1,2024-01-01 04:00:00,9999", "1,2024-01-01 05:00:00,11,extra", *[f"1,2024-01-02 {h:02d}:00:00,{10 + h % 3}" for h in range(20)], "x,2024-01-01 00:00:00,NaN"]


def test_no_line_is_lost(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "id int, value string")
    schema = "symbol bigint, ts timestamp_ntz, price double"
    marked = quarantine.sanitise(quarantine.read_lines(lines, schema), schema, ["symbol"], "ts", "id", ["price"])
    got = {r["id"]: r["reasons"] for r in marked.collect()}
    assert len(got) == len(LINES)
    assert got[0] == ["repeated"] and got[1] == [] and got[2] == ["not_a_number price"] and got[3] == ["missing price"] and got[4] == ["infinite price"] and got[5] == ["not_a_time"]
    assert got[6] == ["unreadable"] and got[8] == ["outlier price"] and got[9] == ["unreadable"] and got[30] == ["infinite price"]
    clean, apart = quarantine.parted(marked)
    assert clean.count() + apart.count() == len(LINES) and {r["_line"] for r in apart.collect()} <= set(LINES)
    assert clean.columns == ["id", "symbol", "ts", "price"]
    counts = {r["reason"]: r["n"] for r in quarantine.reason_counts(marked).collect()}
    assert counts["clean"] == clean.count() and counts["infinite price"] == 2
    assert quarantine.sanitise(quarantine.read_lines(lines.limit(0), schema), schema, ["symbol"], "ts", "id", ["price"]).count() == 0

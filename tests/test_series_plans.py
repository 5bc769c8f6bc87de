"""One-pass forms against the joins that they stand for."""

import datetime as dt

import pytest

from quantframe.operators import align, validation


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("train, test, step, embargo, expanding", [(8, 3, 3, 0, True), (8, 6, 2, 2, True), (8, 3, 5, 1, False), (6, 5, 2, 0, False)])
def test_fold_lines(spark, train, test, step, embargo, expanding):
    data = [(k, i, None if i % 11 == 3 else float((i * 7 + k) % 13), float((i * i + k) % 17)) for k in (1, 2) for i in range(30 + k)] + [(3, 0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "k int, i int, x double, y double")
    folded = validation.fold_rows(df, validation.walk_forward(df, ["k"], train, test, step, expanding), ["k"], ["i"], embargo)
    want = validation.linear_fold_errors(folded.filter("x IS NOT NULL AND y IS NOT NULL"), ["k"], "x", "y")
    got = validation.walk_forward_lines(df, ["k"], ["i"], "x", "y", train, test, step, embargo, expanding)
    assert rows(got) == rows(want) and want.count() > 0


def test_business_days(spark):
    day = dt.date(2024, 1, 4)  # a Thursday
    at = lambda n: day + dt.timedelta(n)
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(2), 2.0), ("a", at(5), None), ("a", at(5), None), ("a", None, 9.0)], "k string, day date, v double")
    held = [tuple(r) for r in align.on_business_days(df, ["k"], ["v"], carry=True).orderBy("day").collect()]
    assert held == [("a", at(0), 1.0), ("a", at(1), 1.0), ("a", at(4), 2.0), ("a", at(5), 2.0)]
    plain = [tuple(r) for r in align.on_business_days(df, ["k"], ["v"]).orderBy("day").collect()]
    assert plain == [("a", at(0), 1.0), ("a", at(1), None), ("a", at(4), None), ("a", at(5), None), ("a", at(5), None)]
    assert align.on_business_days(df.limit(0), ["k"], ["v"]).count() == 0

"""Long or flat portfolios with fees against a replay, and chains of a user's steps."""

import pytest
from pyspark.sql import functions as F

from quantframe.operators import signals


def test_long_flat_equals_a_replay(spark):
    prices = [10.0, 11.0, 12.0, 11.0, 9.0, 9.5, 10.5, 12.0, 8.0, 8.5]
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(prices)] + [("b", 0, 5.0)], "key string, at int, price double")
    table = signals.long_flat(df, ["key"], ["at"], "price", F.col("at").isin(1, 5, 6), F.col("at").isin(0, 3, 8), 1000.0, 0.01)
    rows = {r["at"]: r for r in table.filter("key = 'a'").collect()}
    cash, shares, fees = 1000.0, 0.0, 0.0
    for i, p in enumerate(prices):
        if i in (1, 5, 6) and not shares:
            fees, shares, cash = fees + cash * 0.01, cash * 0.99 / p, 0.0
        elif i in (0, 3, 8) and shares:
            fees, cash, shares = fees + shares * p * 0.01, shares * p * 0.99, 0.0
        assert rows[i]["equity"] == pytest.approx(cash + shares * p) and rows[i]["held"] == (shares > 0)
    told = {r["key"]: r for r in signals.long_flat_statistics(table, ["key"], "at", 1000.0).collect()}
    assert told["a"]["fees"] == pytest.approx(fees) and told["a"]["trades"] == 2 and told["a"]["final"] == pytest.approx(cash)
    assert told["b"]["total_return"] == 0 and told["b"]["trades"] == 0


def test_steps_follow_one_another_and_errors_name_theirs(spark):
    df = spark.range(10)
    steps = [("double", lambda t: t.withColumn("x", F.col("id") * 2)), ("large", lambda t: t.filter("x > 6")), ("sum", lambda t: t.agg(F.sum("x").alias("s")))]
    assert signals.transformed(df, steps).first()["s"] == sum(2 * i for i in range(4, 10))
    with pytest.raises(Exception) as e:
        signals.transformed(df, [*steps[:1], ("wrong", lambda t: t.filter("nothing > 1"))])
    assert any("wrong" in n for n in e.value.__notes__)

"""Two-level scans give the rows of plain windows, and spread one long series over many tasks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantframe.operators import align, long_series


@pytest.fixture(scope="module")
def hot(spark):
    """Nine rows of ten in one series."""
    return spark.range(20_000).selectExpr("if(id % 10 > 0, 'hot', if(id % 20 = 0, null, concat('k', id % 7))) AS key", "id AS at", "if(id % 4 > 0 or id % 1000 < 300, null, id * 1.0D) AS a", "if(id % 9 > 0, null, concat('v', id)) AS b", "(id * 7919 % 211 - 100) / 5000.0D AS ret", "100 + id % 13 AS price", "1.0D * (id % 5) AS volume")


def same(got, want, columns):
    rows = [sorted(map(tuple, t.select(*columns).collect()), key=str) for t in (got, want)]
    assert len(rows[0]) == len(rows[1])
    for x, y in zip(*rows):
        assert all(a is b is None or a == pytest.approx(b, rel=1e-9) for a, b in zip(x, y))


@pytest.mark.parametrize("block_rows", [500, 10**6])
def test_fills_drawdowns_and_vwap_equal_plain_windows(spark, hot, block_rows):
    w = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("a", "b")})
    assert long_series.forward_fill(hot, ["key"], ["at"], ["a", "b"], block_rows).exceptAll(plain).count() == 0
    equity = F.exp(F.sum(F.ln(1 + F.col("ret"))).over(w))
    plain = hot.withColumn("equity", equity).withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
    same(long_series.drawdown(hot, ["key"], ["at"], block_rows=block_rows).select("at", "equity", "peak", "drawdown"), plain, ["at", "equity", "peak", "drawdown"])
    plain = hot.withColumn("all", F.sum("volume").over(w)).withColumn("vwap", F.when(F.col("all") != 0, F.sum(F.col("price") * F.col("volume")).over(w) / F.col("all")))
    same(long_series.vwap(hot, ["key"], ["at"], block_rows=block_rows), plain, ["at", "vwap"])


def test_as_of_equals_the_single_window(spark, hot):
    left = hot.filter("at % 3 = 0").select("key", "at", "price")
    right = hot.filter("at % 5 = 1 OR at % 15 = 0").select("key", "at", "volume", F.col("ret").alias("r"))
    got = long_series.as_of(left, right, ["key"], "at", ["volume", "r"], "x_", block_rows=700)
    want = align.as_of(left.select("key", "at"), right, ["key"], "at", ["volume", "r"], "x_")
    assert got.columns == ["key", "at", "price", "x_volume", "x_r"] and got.count() == left.count()
    assert got.select("key", "at", "x_volume", "x_r").exceptAll(want).count() == 0


def test_no_block_holds_much_of_a_hot_series(spark, hot):
    blocked = long_series.in_blocks(hot, ["key"], ["at"], 500)
    sizes = [r["count"] for r in blocked.groupBy("_block").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 1500
    ends = blocked.filter("key = 'hot'").groupBy("_block").agg(F.min("at").alias("low"), F.max("at").alias("high")).orderBy("low").collect()
    assert all(a["high"] < b["low"] and a["_block"] < b["_block"] for a, b in zip(ends, ends[1:]))


def test_ties_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, None), ("a", 2, None)], "key string, at int, v double")
    got = long_series.forward_fill(df, ["key"], ["at"], ["v"], 1).filter("at = 2").first()
    assert got["v"] == 1.0 and long_series.forward_fill(df.limit(0), ["key"], ["at"], ["v"]).count() == 0

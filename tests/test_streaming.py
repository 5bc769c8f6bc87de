"""Streams read from files, held against batch results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantframe.streaming import monitor


@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(s, start + dt.timedelta(seconds=17 * i + s), i, 100.0 + ((i * 37 + s * 11) % 23) - 11, 1.0 + i % 5) for s in (1, 2) for i in range(400)]
    path = str(tmp_path_factory.mktemp("ticks"))
    spark.createDataFrame(rows, "symbol long, ts timestamp, id long, price double, volume double").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def streamed(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def source(spark, path):
    return spark.readStream.schema("symbol long, ts timestamp, id long, price double, volume double").parquet(path)


def test_live_bars_equal_closed_batch_bars(spark, ticks, tmp_path):
    got = streamed(spark, monitor.live_bars(source(spark, ticks), ["symbol"], "10 minutes", "1 minute"), tmp_path, "live_bars").collect()
    want = {tuple(r) for r in monitor.live_bars(spark.read.parquet(ticks), ["symbol"], "10 minutes", "1 minute").collect()}
    assert got and {tuple(r) for r in got} <= want and len(got) >= len(want) - 4


def test_look_back_and_sessions(spark, ticks, tmp_path):
    got = streamed(spark, monitor.look_back(source(spark, ticks), ["symbol"], "30 minutes", "10 minutes", "1 minute"), tmp_path, "look_back", "update").count()
    assert got == monitor.look_back(spark.read.parquet(ticks), ["symbol"], "30 minutes", "10 minutes", "1 minute").count()
    assert monitor.activity_sessions(spark.read.parquet(ticks), ["symbol"], "1 minute", "1 minute").count() == 2


def test_alerts_hold_their_cooldown(spark, ticks, tmp_path):
    values = source(spark, ticks).select("symbol", "ts", "id", F.col("price").alias("value"))
    rows = streamed(spark, monitor.drawdown_alerts(values, 0.1, 300), tmp_path, "alerts").collect()
    assert len(rows) == 800
    for s in (1, 2):
        peak, last = float("-inf"), float("-inf")
        for r in sorted((r for r in rows if r["symbol"] == s), key=lambda r: r["id"]):
            peak = max(peak, r["value"])
            fires = r["value"] / peak - 1 < -0.1 and r["ts"].timestamp() - last >= 300
            last = r["ts"].timestamp() if fires else last
            assert r["peak"] == peak and r["alert"] == fires
    active = monitor.active_alerts(spark.table("alerts"))
    assert active.count() == 2


def test_tick_decisions(spark):
    df = spark.createDataFrame([(90.0, 100.0), (110.0, 100.0), (100.0, 100.0)], "price double, reference double")
    assert [r["decision"] for r in monitor.tick_sizes(df, 1000.0, 0.1, 0.05).collect()] == ["buy", "sell", "hold"]

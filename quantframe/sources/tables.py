"""Series, trades, chains and dimensions derived from the driver tables; every result has key columns and ``ts``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, id, price, volume: one row per event."""
    volume = F.get_json_object("props", "$.k").cast("double")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"), volume.alias("volume"))


#: Rows of a task that works along series: sorts and windows over them hold little memory.
TASK_ROWS = 250_000


def by_series(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key to tasks of about TASK_ROWS rows, so that no task grows with the table (Parquet counts its rows without reading them)."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(parts, key)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day, open, high, low, close, volume: bars of each supplier's shipping days, with calendar gaps.

    A bar has about one line, so combining before the exchange would save nothing: rows are dealt by symbol once, and the
    aggregate and every later window over a symbol's days work on that partitioning and order.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("day"), price.alias("price"), order.alias("o"), "l_quantity")
    bars = [F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.sum("l_quantity").alias("volume")]
    return by_series(line, "symbol").groupBy("symbol", "day").agg(*bars)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, day, ret: weekly returns of order values per priority."""
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    values = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("strategy"), week.alias("day")).agg(F.avg("o_totalprice").alias("value"))
    from quantframe.functions.windows import ordered

    before = F.lag("value").over(ordered(["strategy"], "day"))
    return values.withColumn("ret", (F.col("value") / before - 1) / 10).filter("ret IS NOT NULL").select("strategy", "day", "ret")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, portfolio, strategy, direction, quantity, entry_price, exit_price, commission, ts."""
    side = F.when(F.col("l_returnflag") == "R", "short").otherwise("long")
    entry = F.col("l_extendedprice") / F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trade_id"), F.col("l_suppkey").alias("portfolio"), F.col("l_linestatus").alias("strategy"), side.alias("direction"), F.col("l_quantity").alias("quantity"),
        entry.alias("entry_price"), (entry * (1 + F.col("l_tax") - F.col("l_discount"))).alias("exit_price"), (F.col("l_extendedprice") * 0.001).alias("commission"), F.col("l_shipdate").alias("ts"),
    )


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One option row per line item: symbol, day, strike, option_type, spot, days, iv, quantity, portfolio."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    line = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("contract"), F.col("l_suppkey").alias("portfolio"), F.col("p_partkey").alias("symbol"), F.to_date("l_shipdate").alias("day"), F.col("p_retailprice").alias("strike"), kind.alias("option_type"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("spot"), (F.col("p_size") * 7).alias("days"), (F.col("l_discount") * 3 + 0.1).alias("iv"), F.col("l_quantity").alias("quantity"),
    )

"""Payloads of data providers to typed series; fetching them is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.functions.windows import ordered
from quantframe.operators.sentiment import fear_class

OBSERVATIONS = "observations array<struct<date: string, value: string>>"


def observations(payloads: DataFrame, json: str, name: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """day and the series' value; '.' and other text is no value and dropped."""
    rows = payloads.select(F.inline(F.from_json(json, OBSERVATIONS)["observations"])).select(F.expr("try_cast(date AS date)").alias("day"), F.expr("try_cast(value AS double)").alias(name))
    rows = rows.filter(F.col(name).isNotNull() & F.col("day").isNotNull())
    return rows.filter(F.col("day").between(low or "0001-01-01", high or "9999-12-31"))


def candles(payloads: DataFrame, column: str) -> DataFrame:
    """Arrays [epoch seconds, low, high, open, close, volume] to bars."""
    at = lambda i: F.element_at("c", i)
    names = {"low": 2, "high": 3, "open": 4, "close": 5, "volume": 6}
    return payloads.select(F.explode(column).alias("c")).select(F.timestamp_seconds(at(1)).alias("ts"), *[at(i).alias(n) for n, i in names.items()])


def price_points(payloads: DataFrame, keys: list[str], prices: str, volumes: str) -> DataFrame:
    """Points [epoch ms, value], paired by place: open is the previous close, high and low 2 % around the close, a missing volume 0."""
    rows = payloads.select(*keys, F.posexplode(prices).alias("place", "p"), F.col(volumes).alias("v"))
    rows = rows.select(*keys, F.timestamp_millis(F.col("p")[0].cast("long")).alias("ts"), F.col("p")[1].alias("close"), F.coalesce(F.expr("try_element_at(v, place + 1)[1]"), F.lit(0.0)).alias("volume"))
    opened = rows.withColumn("open", F.lag("close").over(ordered(keys, "ts")))
    return opened.withColumn("high", F.col("close") * 1.02).withColumn("low", F.col("close") * 0.98).filter("open IS NOT NULL AND close IS NOT NULL")


def fear_greed(payloads: DataFrame, points: str) -> DataFrame:
    """Points {x: ms, y: index} to ts, index, class and (index - 50) / 50."""
    rows = payloads.select(F.inline(points)).select(F.timestamp_millis(F.col("x").cast("long")).alias("ts"), F.col("y").alias("index"))
    return rows.withColumn("class", fear_class(F.col("index"))).withColumn("normalised", (F.col("index") - 50) / 50)


def plain_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def standardise(df: DataFrame, time: str, numeric: list[str]) -> DataFrame:
    """Plain column names, ``ts`` from the time column, numbers where they parse (else null); rows without a time are dropped."""
    def one(c: str) -> Column:
        if c == time:
            return F.expr(f"try_cast(`{c}` AS timestamp_ntz)").alias("ts")
        return F.expr(f"try_cast(`{c}` AS double)").alias(plain_name(c)) if c in numeric else F.col(f"`{c}`").alias(plain_name(c))

    return df.select(*[one(c) for c in df.columns]).filter("ts IS NOT NULL")


def option_chain(calls: DataFrame, puts: DataFrame) -> DataFrame:
    """Calls and puts in one table, with option_type and plain names."""
    both = calls.withColumn("option_type", F.lit("call")).unionByName(puts.withColumn("option_type", F.lit("put")), allowMissingColumns=True)
    return both.withColumnsRenamed({c: plain_name(c) for c in both.columns})


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a date index first and a column ``returns``."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.expr(f"try_cast(`{raw.columns[0]}` AS date)").alias("day"), F.expr("try_cast(returns AS double)").alias("ret")).filter("day IS NOT NULL")


def write_results(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)

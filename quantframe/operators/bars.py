"""Bars: time, session, count, event, volume and volatility buckets of tick or bar series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.windows import ordered, returns, rolling


def ohlcv(price: str, volume: str, order: Column) -> list[Column]:
    return [F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume")]


def bin_start(ts: str, freq: str) -> Column:
    """Start of the bin: a date_trunc unit, or 'N minute(s)' / 'N hour(s)' counted from midnight 1970. Weeks are labelled by their Sunday, months by their last day."""
    if freq == "week":
        return F.next_day(F.date_sub(F.to_date(ts), 1), "SUN").cast("timestamp_ntz")
    if freq == "month":
        return F.last_day(ts).cast("timestamp_ntz")
    if " " not in freq:
        return F.date_trunc(freq, F.col(ts)).cast("timestamp_ntz")
    n, unit = freq.split()
    step = int(n) * {"minute": 60, "hour": 3600}[unit.rstrip("s")]
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(F.floor(seconds / step) * step).cast("timestamp_ntz")


def time_bars(df: DataFrame, keys: list[str], freq: str, ts: str = "ts", price: str = "price", volume: str = "volume", tie: str = "id", business_days: bool = False) -> DataFrame:
    """One OHLCV row per key and bin that has rows; pass business_days to leave weekends out."""
    df = df.filter(F.weekday(ts) < 5) if business_days else df
    return df.groupBy(*keys, bin_start(ts, freq).alias("bar")).agg(*ohlcv(price, volume, F.struct(ts, tie)), F.count(F.lit(1)).alias("n"))


AGGREGATES = {
    "last": lambda c, o: F.max_by(c, F.when(F.col(c).isNotNull(), o)), "first": lambda c, o: F.min_by(c, F.when(F.col(c).isNotNull(), o)), "mean": lambda c, o: F.avg(c), "median": lambda c, o: F.percentile(c, F.lit(0.5)),
    "sum": lambda c, o: F.sum(c), "min": lambda c, o: F.min(c), "max": lambda c, o: F.max(c), "std": lambda c, o: F.stddev_samp(c), "var": lambda c, o: F.var_samp(c),
}


def resample(df: DataFrame, keys: list[str], freq: str, how: dict[str, str], ts: str = "ts", tie: str = "id") -> DataFrame:
    """how: column -> one of AGGREGATES, each over the bin's non-null values."""
    order = F.struct(ts, tie)
    return df.groupBy(*keys, bin_start(ts, freq).alias("bar")).agg(*[AGGREGATES[h](c, order).alias(c) for c, h in how.items()])


def session_bars(df: DataFrame, keys: list[str], start: str, end: str, freq: str, least: int, ts: str = "ts", zone: str = "UTC", **columns) -> DataFrame:
    """Bars inside the session's hours on weekdays (both ends count); sessions with under ``least`` rows are dropped."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))
    clock = F.date_format(local, "HH:mm:ss.SSSSSS")
    inside = df.withColumn("session_date", F.to_date(local)).filter((F.weekday(local) < 5) & clock.between(f"{start}:00.000000", f"{end}:00.000000"))
    enough = inside.withColumn("session_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys, "session_date"))).filter(F.col("session_rows") >= least)
    return time_bars(enough, [*keys, "session_date"], freq, ts, **columns)


def count_windows(df: DataFrame, keys: list[str], size: int, overlap: float, ts: str = "ts", tie: str = "id", price: str = "price", volume: str = "volume") -> DataFrame:
    """Full windows of ``size`` rows, each int(size * (1 - overlap)) rows (one at least) after the last; labelled by first, last and middle row."""
    step = max(1, int(size * (1 - overlap)))
    numbered = df.withColumn("row", F.row_number().over(ordered(keys, ts, tie)) - 1)
    low = F.greatest(F.lit(0), F.ceil((F.col("row") - (size - 1)) / step)).cast("int")
    spread = numbered.withColumn("window", F.explode(F.sequence(low, F.floor(F.col("row") / step).cast("int"))))
    middle = F.max(F.when(F.col("row") == F.col("window") * step + size // 2, F.col(ts))).alias("centre")
    return spread.groupBy(*keys, "window").agg(*ohlcv(price, volume, F.col("row")), F.min(ts).alias("start"), F.max(ts).alias("end"), middle, F.count(F.lit(1)).alias("n")).filter(F.col("n") == size)


def event_bars(df: DataFrame, keys: list[str], threshold: float = 0.01, least: int = 1, ts: str = "ts", tie: str = "id", price: str = "price", volume: str = "volume") -> DataFrame:
    """A bar ends at a row whose price moved by the threshold or more; what is left at the end is a bar too."""
    w = ordered(keys, ts, tie)
    moved = F.coalesce(F.abs(returns(price, w)) >= threshold, F.lit(False))
    marked = df.withColumn("ends", moved.cast("int"))
    bar = F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("event_bar", bar).groupBy(*keys, "event_bar").agg(*ohlcv(price, volume, F.struct(ts, tie)), F.min(ts).alias("start"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def volume_bar_ids(volumes: np.ndarray, threshold: float) -> np.ndarray:
    """A bar closes once its volume reaches the threshold, and the next one starts at zero."""
    total, ids, start, bar = np.cumsum(volumes), np.zeros(len(volumes), np.int64), 0, 0
    while start < len(volumes):
        before = total[start - 1] if start else 0.0
        end = int(np.searchsorted(total, before + threshold * (1 - 1e-12), side="left")) + 1
        ids[start:end] = bar
        start, bar = end, bar + 1
    return ids


def volume_bars(df: DataFrame, keys: list[str], threshold: float, ts: str = "ts", tie: str = "id", price: str = "price", volume: str = "volume") -> DataFrame:
    """Volume bars; the reset at each close makes this a scan per key. Rows stream through each task in key order, so a long series needs no more memory than a batch."""
    cols = [*keys, ts, tie, price, volume]
    sorted_rows = df.select(*cols).filter(F.col(volume).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, ts, tie)
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("volume_bar", T.LongType()), T.StructField("place", T.LongType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, bar, place = None, 0.0, 0, 0
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            cuts = [*np.flatnonzero(change), len(batch)] if len(batch) else []
            for low, high in zip(cuts, cuts[1:]):
                key = tuple(batch[keys].iloc[low])
                if key != now:
                    now, held, bar = key, 0.0, 0
                v = batch[volume].to_numpy(float)[low:high].copy()
                v[0] += held
                ids = volume_bar_ids(v, threshold)
                out[low:high] = ids + bar
                last = v[ids == ids[-1]].sum()
                bar, held = (bar + int(ids[-1]) + 1, 0.0) if last >= threshold * (1 - 1e-12) else (bar + int(ids[-1]), last)
            yield batch.assign(volume_bar=out, place=np.arange(place, place + len(batch)))
            place += len(batch)

    barred = sorted_rows.mapInPandas(scan, schema)
    return barred.groupBy(*keys, "volume_bar").agg(*ohlcv(price, volume, F.col("place")), F.count(F.lit(1)).alias("n"))


def vwap(df: DataFrame, keys: list[str], ts: str = "ts", tie: str = "id", price: str = "price", volume: str = "volume") -> DataFrame:
    w = ordered(keys, ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    traded = F.sum(volume).over(w)
    return df.withColumn("vwap", F.when(traded != 0, F.sum(F.col(price) * F.col(volume)).over(w) / traded))


def volatility_buckets(df: DataFrame, keys: list[str], window: int = 20, ts: str = "ts", tie: str = "id", price: str = "price") -> DataFrame:
    """Rows with volatility_regime low / medium / high by the key's 33 % and 67 % quantiles of rolling volatility (none yet: medium)."""
    w = ordered(keys, ts, tie)
    moved = df.withColumn("ret", returns(price, w))
    r = rolling(keys, [ts, tie], window)
    vol = moved.withColumn("vol", F.when(F.count("ret").over(r) >= window, F.stddev_samp("ret").over(r)))
    cuts = vol.groupBy(*keys).agg(F.percentile("vol", F.array(F.lit(0.33), F.lit(0.67))).alias("q"))
    regime = F.when(F.col("vol") <= F.col("q")[0], "low").when(F.col("vol") >= F.col("q")[1], "high").otherwise("medium")
    return vol.join(cuts, keys).withColumn("volatility_regime", regime).drop("q")


def bucket_statistics(original: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before and after, and rows per bar, for each key."""
    a, b = original.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"))
    return a.join(b, keys, "left").withColumn("compression", F.col("rows") / F.col("bars"))


def fill_empty_bins(bars: DataFrame, keys: list[str], step: str, bar: str = "bar", sums: tuple[str, ...] = ("volume", "n")) -> DataFrame:
    """bars with a row for each empty bin between a key's first and last: sums are zero there, other columns null. step: an interval ('1 hour')."""
    span = bars.groupBy(*keys).agg(F.min(bar).alias("low"), F.max(bar).alias("high"))
    grid = span.select(*keys, F.explode(F.sequence("low", "high", F.expr(f"INTERVAL {step}"))).alias(bar))
    out = grid.join(bars, [*keys, bar], "left")
    return out.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in sums else F.col(c) for c in bars.columns])


def aggregate_bars(df: DataFrame, keys: list[str], freq: str, *aggregates: Column, ts: str = "ts") -> DataFrame:
    """Bars of the caller's own aggregates: any columns over a bin's rows, built-in or a grouped pandas function."""
    return df.groupBy(*keys, bin_start(ts, freq).alias("bar")).agg(*aggregates)


def hour_profile(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "price") -> DataFrame:
    """Mean, deviation, least and greatest value by hour of the day."""
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(value).alias("n"))

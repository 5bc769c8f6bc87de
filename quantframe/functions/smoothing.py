"""Exponential smoothing and the indicators on it. A recursion per key: rows stream through sorted partitions, and each task carries the last value of the key it is in, so a long series needs no more memory than a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.windows import ordered


def exponential(df: DataFrame, keys: list[str], by: list[str], means: dict[str, tuple[str, float]]) -> DataFrame:
    """means: new column -> (column, alpha). Each starts at the key's first value; a null keeps the mean as it was."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *by)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in means]])

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, {}
        for batch in batches:
            out = {n: np.full(len(batch), np.nan) for n in means}
            change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            cuts = [*np.flatnonzero(change), len(batch)] if len(batch) else []
            for low, high in zip(cuts, cuts[1:]):
                key = tuple(batch[keys].iloc[low])
                if key != now:
                    now, last = key, dict.fromkeys(means, np.nan)
                for n, (column, alpha) in means.items():
                    values = pd.concat([pd.Series([last[n]]), batch[column].iloc[low:high].astype(float)], ignore_index=True)
                    done = values.ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]
                    out[n][low:high], last[n] = done, done[-1]
            yield batch.assign(**out)

    return rows.mapInPandas(smooth, schema)


def wilder_rsi(df: DataFrame, keys: list[str], by: list[str], price: str = "close", n: int = 14) -> DataFrame:
    """RSI on means with alpha 1/n, from the n-th change on."""
    w = ordered(keys, *by)
    step = F.col(price) - F.lag(price).over(w)
    moved = df.withColumn("up", F.greatest(step, F.lit(0.0))).withColumn("down", F.greatest(-step, F.lit(0.0))).withColumn("up", F.when(step.isNotNull(), F.col("up"))).withColumn("down", F.when(step.isNotNull(), F.col("down"))).withColumn("place", F.row_number().over(w))
    means = exponential(moved, keys, by, {"gain": ("up", 1 / n), "loss": ("down", 1 / n)})
    rsi = F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.when(F.col("loss") != 0, F.col("loss"))))
    return means.withColumn("rsi", F.when(F.col("place") > n, rsi)).drop("up", "down", "place", "gain", "loss")


def macd(df: DataFrame, keys: list[str], by: list[str], price: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Line, signal and histogram; alpha 2 / (n + 1)."""
    means = exponential(df, keys, by, {"quick": (price, 2 / (fast + 1)), "slow": (price, 2 / (slow + 1))})
    lined = means.withColumn("macd", F.col("quick") - F.col("slow")).drop("quick", "slow")
    return exponential(lined, keys, by, {"macd_signal": ("macd", 2 / (signal + 1))}).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))

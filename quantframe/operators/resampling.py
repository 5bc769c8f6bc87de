"""Simulated distributions of returns: Poisson bootstrap in one pass, and draws from a fitted normal.

A replicate gives each row a Poisson weight whose mean is the number of periods over the number of rows. The weight comes from a
hash of row and replicate, so rows are read once and never copied, retried tasks agree, and a key's rows may lie in any
number of tasks: each adds up weight and weighted log return per replicate, and the sums are added by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.joins import beside
from quantframe.operators.option_runs import by_key

ODD, HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def uniform(row: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """A number in (0, 1) for each row (a 64-bit hash) and replicate."""
    with np.errstate(over="ignore"):
        x = row[:, None] ^ ((np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * ODD)[None, :]
        for mult in (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(30))) * mult
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion, a mean for each line of u."""
    out, p = np.zeros(u.shape), np.repeat(np.exp(-mean)[:, None], u.shape[1], 1)
    below = p.copy()
    for k in range(1, 10_000):
        more = u > below
        if not more.any():
            break
        out += more
        p = p * mean[:, None] / k
        below = below + p
        if not (p[more] > 1e-18).any() and k > mean.max(initial=0):
            break
    return out


def replicates(df: DataFrame, keys: list[str], row: list[str], ret: str, number: int, periods: int | None, seed: int) -> DataFrame:
    """keys, replicate, total: compounded return of ``periods`` (the key's rows, if none) drawn with replacement, for each replicate."""
    rows = df.filter(F.col(ret) > -1).select(*keys, F.xxhash64(*row).alias("_h"), F.ln(1 + F.col(ret)).alias("_l"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    given = beside(rows, sizes, keys).sortWithinPartitions(*keys)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_n", T.LongType()), T.StructField("_w", T.ArrayType(T.DoubleType())), T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, part in by_key(batch, keys):
                w, s = np.zeros(number), np.zeros(number)
                for a in range(0, len(part), 1024):  # bounds the matrix of weights
                    some = part.iloc[a : a + 1024]
                    n = some["_n"].to_numpy(float)
                    weight = poisson(uniform(some["_h"].to_numpy().view(np.uint64), number, seed), (periods or n) / n * np.ones(len(n)))
                    w, s = w + weight.sum(axis=0), s + some["_l"].to_numpy() @ weight
                out.append((*key, int(part["_n"].iloc[0]), w.tolist(), s.tolist()))
            yield pd.DataFrame(out, columns=schema.names)

    parts = given.mapInPandas(add, schema).select(*keys, "_n", F.posexplode(F.arrays_zip("_w", "_s")).alias("replicate", "_x"))
    sums = parts.groupBy(*keys, "_n", "replicate").agg(F.sum("_x._w").alias("_w"), F.sum("_x._s").alias("_s"))
    length = F.lit(float(periods)) if periods else F.col("_n").cast("double")
    # scaled to the number of periods, so that chance varies which rows are drawn and not how many
    return sums.select(*keys, "replicate", F.when(F.col("_w") > 0, F.exp(length * F.col("_s") / F.col("_w")) - 1).otherwise(0.0).alias("total"))


def normal_replicates(df: DataFrame, keys: list[str], ret: str, number: int, periods: int | None, seed: int) -> DataFrame:
    """keys, replicate, total: compounded return of ``periods`` draws from the normal with the key's mean and sample deviation; drawn per key from a seed of its own. A draw at or under -1 ends at -1."""
    fitted = df.groupBy(*keys).agg(F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"), F.count(ret).alias("_n"), (F.xxhash64(*keys).bitwiseAND(2**62 - 1)).alias("_seed"))
    schema = T.StructType([*[fitted.schema[k] for k in keys], T.StructField("replicate", T.IntegerType()), T.StructField("total", T.DoubleType())])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                r = batch.iloc[i]
                rng, left, total = np.random.default_rng([seed, int(r["_seed"])]), int(periods or r["_n"]), np.ones(number)
                while left:  # 256 periods at a time
                    step = min(left, 256)
                    total = total * np.maximum(1 + rng.normal(r["_m"], 0.0 if np.isnan(r["_s"]) else r["_s"], (number, step)), 0).prod(axis=1)
                    left -= step
                out = pd.DataFrame({"replicate": np.arange(number), "total": total - 1})
                for k in reversed(keys):
                    out.insert(0, k, batch[k].iloc[[i] * number].to_numpy())
                yield out

    return fitted.filter("_n > 0").mapInPandas(draw, schema)


def monte_carlo(df: DataFrame, keys: list[str], row: list[str], ret: str = "ret", number: int = 1000, periods: int | None = None, confidence: float = 0.95, method: str = "bootstrap", seed: int = 1) -> DataFrame:
    """Per key: mean, deviation (population), bounds of the confidence interval, 5 % quantile, chance of a loss and of one over 20 % of the compounded return, over ``number`` replicates.
    row: the columns that tell a key's rows apart."""
    table = replicates(df, keys, row, ret, number, periods, seed) if method == "bootstrap" else normal_replicates(df, keys, ret, number, periods, seed)
    t = F.col("total")
    q = F.percentile("total", F.array(*[F.lit(x) for x in ((1 - confidence) / 2, (1 + confidence) / 2, 0.05)]))
    told = table.groupBy(*keys).agg(F.avg(t).alias("mean"), F.stddev_pop(t).alias("deviation"), q.alias("q"), F.avg((t < 0).cast("double")).alias("loss"), F.avg((t < -0.2).cast("double")).alias("large_loss"))
    return told.select(*keys, "mean", "deviation", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.col("q")[2].alias("var_5"), "loss", "large_loss")


def simulated_value_at_risk(df: DataFrame, keys: list[str], row: list[str], ret: str = "ret", value: float = 1.0, number: int = 10_000, confidences: tuple[float, ...] = (0.95, 0.99), last: int = 252, seed: int = 1) -> DataFrame:
    """Per key and confidence: the loss of ``value`` that one draw from the normal of the last ``last`` returns exceeds with the rest of the chance, and over 5 and 21 days by the root of time."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in row])
    recent = df.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= last)
    draws = normal_replicates(recent, keys, ret, number, 1, seed)
    q = F.percentile("total", F.array(*[F.lit(1 - c) for c in confidences]))
    told = draws.groupBy(*keys).agg(q.alias("q")).select(*keys, F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in confidences]).alias("confidence"), F.col("q").alias("q"))).alias("x"))
    loss = F.greatest(-F.col("x.q"), F.lit(0.0)) * value
    return told.select(*keys, F.col("x.confidence").alias("confidence"), loss.alias("var_1"), (loss * 5**0.5).alias("var_5"), (loss * 21**0.5).alias("var_21"))

"""Hidden-Markov regimes: one Gaussian model for all series, fitted by expected counts that are summed over them.

A series of any length is cut into blocks of ``block_rows`` rows at most, each an array in one row of a written table; a short series is one block. What runs along
a series has two levels. Within a block, the product of its transition and emission matrices is a k x k matrix. Along a
series, those matrices, a row a block, give what enters and leaves each block. With these at its ends, every block
works out its own rows by itself: states' probabilities and expected counts for the fit, the likeliest path for the
regimes. Blocks of a batch advance together, as numpy arrays.

The fit starts from quantiles and equal deviations, and repeats until the likelihood per row gains less than ``gain``; each
round writes the blocks' entries to the shared folder, and the model itself is a few numbers. Regimes are numbered by rising
deviation. Rows with a null take no part; a model needs at least two different values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.joins import beside
from quantframe.operators.long_series import BLOCK, in_blocks, inside
from quantframe.sources.shared import materialise

#: Cells (blocks times the longest one's rows) that advance together.
TOGETHER = 500_000
#: Rows of a task that cuts series into blocks.
RANGE = 200_000


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    likelihood: list[float]

    def ordered(self) -> Model:
        o = np.lexsort((self.mean, self.deviation))
        return Model(self.start[o], self.move[np.ix_(o, o)], self.mean[o], self.deviation[o], self.likelihood)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log densities of values, a column a state; padding (NaN) says nothing."""
        z = (x[..., None] - self.mean) / self.deviation
        return np.where(np.isnan(x)[..., None], 0.0, -0.5 * z * z - np.log(self.deviation) - 0.5 * np.log(2 * np.pi))


def as_blocks(df: DataFrame, keys: list[str], by: list[str], column: str, block_rows: int) -> DataFrame:
    """keys, _block, rows (an array of by and x in order), xs (their x alone, which the fit reads), first and last (of its key), written once."""
    rows = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(*keys, *by, F.col(column).cast("double").alias("x"))
    cut = in_blocks(materialise(rows, "hidden-rows"), keys, by, max(RANGE, block_rows))
    within = F.floor((F.row_number().over(inside(keys, *by, "x")) - 1) / block_rows)
    cut = cut.withColumn(BLOCK, F.col(BLOCK) * F.lit(1 << 32) + within)
    made = cut.groupBy(*keys, BLOCK).agg(F.sort_array(F.collect_list(F.struct(*by, "x"))).alias("rows"))  # block_rows at most
    made = materialise(made, "hidden-cut")
    ends = made.groupBy(*keys).agg(F.min(BLOCK).alias("_low"), F.max(BLOCK).alias("_high"))
    made = beside(made, ends, keys).select(*keys, BLOCK, "rows", F.col("rows.x").alias("xs"), (F.col(BLOCK) == F.col("_low")).alias("first"), (F.col(BLOCK) == F.col("_high")).alias("last"))
    return materialise(made.withColumn("id", F.monotonically_increasing_id()), "hidden-blocks")


def padded(rows: pa.ListArray) -> np.ndarray:
    lengths, values = pc.list_value_length(rows).to_numpy(), rows.flatten().to_numpy()
    out = np.full((len(lengths), lengths.max()), np.nan)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches by rising length of xs, so that little is padding."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("xs")).to_numpy()
        order, a = np.argsort(lengths, kind="stable"), 0
        while a < len(order):
            fits = (np.arange(1, len(order) - a + 1) * lengths[order[a:]] <= TOGETHER).sum()
            yield batch.take(pa.array(order[a : a + max(1, fits)]))
            a += max(1, fits)


def products(model: Model, x: np.ndarray, best: bool) -> np.ndarray:
    """Per block a matrix: log of the sum (or the largest) over paths from each state at its first row to each at its last, emissions included."""
    logs, move = model.logs(x), np.log(np.maximum(model.move, 1e-300))
    n, k = len(x), len(model.mean)
    out = np.full((n, k, k), -np.inf)
    out[:, range(k), range(k)] = logs[:, 0]
    for t in range(1, x.shape[1]):
        there = ~np.isnan(x[:, t])
        terms = out[there][:, :, :, None] + move[None, None]
        top = terms.max(axis=2)
        step = top if best else top + np.log(np.exp(terms - np.where(np.isfinite(top), top, 0)[:, :, None]).sum(axis=2))
        out[there] = step + logs[there, t][:, None, :]
    return out


def entries(model: Model, blocks: DataFrame, keys: list[str], best: bool) -> DataFrame:
    """id, enter, leave: for blocks of series with several. Forward-backward: the state's log weights before the block's first row and after its last. Best path: the states at its two ends."""
    k = len(model.mean)
    several = blocks.filter("NOT (first AND last)").select(*keys, BLOCK, "id", "first", "xs")

    def block(batches):
        for part in slices(batches):
            m = products(model, padded(part.column("xs")), best)
            yield part.drop_columns(["xs"]).append_column("matrix", pa.array(list(m.reshape(len(m), k * k)), pa.list_(pa.float64())))

    schema = T.StructType([*[blocks.schema[c] for c in [*keys, BLOCK, "id", "first"]], T.StructField("matrix", T.ArrayType(T.DoubleType()))])
    move, start = np.log(np.maximum(model.move, 1e-300)), np.log(np.maximum(model.start, 1e-300))

    def summed(x):
        top = x.max(axis=0)
        return top + np.log(np.exp(x - top).sum(axis=0))

    def along(t: pd.DataFrame) -> pd.DataFrame:
        """One series, a row a block."""
        t = t.sort_values(BLOCK)
        m = [np.array(x).reshape(k, k) for x in t["matrix"]]
        over = (lambda x: x.max(axis=0)) if best else summed
        before, last = [start], []  # weights of the states at the first row of each block, without its emission, and at its last row
        for x in m:
            last.append(over(before[-1][:, None] + x))
            before.append(over(last[-1][:, None] + move))
            before[-1] -= before[-1].max()
        if not best:
            after = [np.zeros(k)]
            for x in reversed(m[1:]):
                w = summed((x + after[-1][None, :]).T)
                after.append(summed((move + w[None, :]).T))
                after[-1] -= after[-1].max()
            enter = [np.full(k, np.nan), *[x - x.max() for x in last[:-1]]]
            return pd.DataFrame({"id": t["id"].to_numpy(), "enter": enter, "leave": after[::-1]})
        ends, state = [], int(np.argmax(last[-1]))
        for i in range(len(m) - 1, -1, -1):
            first = int(np.argmax(before[i] + m[i][:, state]))
            ends.append((first, state))
            state = int(np.argmax(last[i - 1] + move[:, first])) if i else state
        ends.reverse()
        return pd.DataFrame({"id": t["id"].to_numpy(), "enter": [np.array([float(a)]) for a, _ in ends], "leave": [np.array([float(b)]) for _, b in ends]})

    return materialise(several.mapInArrow(block, schema).groupBy(*keys).applyInPandas(along, "id long, enter array<double>, leave array<double>"), "hidden-entries")


def with_entries(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    return blocks.join(ends, "id", "left")


def posterior(model: Model, x: np.ndarray, enter: list, leave: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of blocks: the states' probabilities at each row, expected moves, starts of series, and the log likelihood given what entered."""
    n, length, k = len(x), x.shape[1], len(model.mean)
    b = model.logs(x)
    top = b.max(axis=2, keepdims=True)
    b = np.exp(b - top)
    opens = np.array([e is None or e[0] is None or np.isnan(e[0]) for e in enter])  # Arrow takes NaN in lists for null
    before = np.stack([np.ones(k) if o else np.exp(np.array(e)) for o, e in zip(opens, enter)])
    before /= before.sum(axis=1, keepdims=True)
    there = ~np.isnan(x)
    alpha, scale = np.zeros((n, length, k)), np.ones((n, length))
    now = np.where(opens[:, None], model.start[None], before @ model.move)
    for t in range(length):
        weights = now * b[:, t]
        scale[:, t] = np.where(there[:, t], weights.sum(axis=1), 1.0)
        now = np.where(there[:, t][:, None], weights / scale[:, t][:, None], now)
        alpha[:, t] = now
        if t + 1 < length:
            now = np.where(there[:, t + 1][:, None], alpha[:, t] @ model.move, alpha[:, t])
    beta = np.stack([np.ones(k) if e is None else np.exp(np.array(e)) for e in leave])
    gamma, moves = np.zeros((n, length, k)), np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        g = alpha[:, t] * beta
        gamma[:, t] = np.where(there[:, t][:, None], g / g.sum(axis=1, keepdims=True), 0)
        on = there[:, t] if t else there[:, t] & ~opens
        came = alpha[:, t - 1] if t else before
        pair = came[:, :, None] * model.move[None] * (b[:, t] * beta)[:, None, :]
        pair = pair / pair.sum(axis=(1, 2), keepdims=True)
        moves += pair[on].sum(axis=0)
        back = (b[:, t] * beta) @ model.move.T
        beta = np.where(there[:, t][:, None], back / back.max(axis=1, keepdims=True), beta)
    starts = gamma[opens, 0].sum(axis=0)
    return gamma, moves, starts, float((np.log(scale) + np.where(there, top[..., 0], 0)).sum())


def expected(model: Model, blocks: DataFrame, keys: list[str]) -> np.ndarray:
    """Sums over all blocks: starts (k), moves (k x k), and per state weight, weight * x and weight * x^2; then the log likelihood. One row to the driver."""
    k = len(model.mean)
    names = [f"s{i}" for i in range(k + k * k + 3 * k + 1)]

    def count(batches):
        total = np.zeros(len(names))
        for part in slices(batches):
            x = padded(part.column("xs"))
            gamma, moves, starts, likelihood = posterior(model, x, part.column("enter").to_pylist(), part.column("leave").to_pylist())
            v = np.nan_to_num(x)[..., None]
            total += np.concatenate([starts, moves.ravel(), *[(gamma * v**p).sum(axis=(0, 1)) for p in (0, 1, 2)], [likelihood]])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=names)

    sums = with_entries(blocks.select("id", "xs"), entries(model, blocks, keys, False)).select("xs", "enter", "leave").mapInArrow(count, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()
    return np.array(list(sums), float)


def fit(blocks: DataFrame, keys: list[str], k: int = 3, rounds: int = 50, gain: float = 1e-6, least: float = 1e-3) -> Model:
    """A model of a table of ``as_blocks``. least: no deviation falls below this share of the overall one."""
    x = blocks.select(F.explode("xs").alias("x"))
    told = x.agg(F.count("x").alias("n"), F.stddev_pop("x").alias("s"), F.percentile_approx("x", [(i + 0.5) / k for i in range(k)], 10_000).alias("q")).first()
    if not told["n"] or not told["s"]:
        raise ValueError("a model needs at least two different values")
    stay = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))
    # deviations differ at the start, as states with equal means and deviations would stay alike
    model = Model(np.full(k, 1 / k), stay / stay.sum(axis=1, keepdims=True), np.array(told["q"], float), told["s"] * np.linspace(0.5, 1.5, k), [])
    for _ in range(rounds):
        s = expected(model, blocks, keys)
        starts, moves, (w, wx, wxx), likelihood = s[:k], s[k : k + k * k].reshape(k, k), s[k + k * k : -1].reshape(3, k), s[-1]
        model.likelihood.append(likelihood)
        if len(model.likelihood) > 1 and likelihood - model.likelihood[-2] < gain * told["n"]:
            break
        w = np.maximum(w, 1e-12)
        mean = wx / w
        out = moves.sum(axis=1, keepdims=True)
        move = np.where(out > 1e-12, moves / np.maximum(out, 1e-300), model.move)
        model = Model(starts / starts.sum(), move, mean, np.sqrt(np.maximum(wxx / w - mean**2, (least * told["s"]) ** 2)), model.likelihood)
    return model.ordered()


def best_path(model: Model, x: np.ndarray, enter: list, leave: list) -> np.ndarray:
    """The likeliest states of blocks, from a given state at the first row and to one at the last, where given."""
    logs, move = model.logs(x), np.log(np.maximum(model.move, 1e-300))
    n, length, k = len(x), x.shape[1], len(model.mean)
    fixed = [None if e is None else int(e[0]) for e in enter]
    now = np.stack([np.log(np.maximum(model.start, 1e-300)) if f is None else np.where(np.arange(k) == f, 0.0, -np.inf) for f in fixed]) + logs[:, 0]
    came = np.tile(np.arange(k), (n, length, 1))
    for t in range(1, length):
        there = ~np.isnan(x[:, t])
        terms = now[:, :, None] + move[None]
        came[there, t] = terms.argmax(axis=1)[there]
        now = np.where(there[:, None], terms.max(axis=1) + logs[:, t], now)
    out = np.zeros((n, length), np.int64)
    state = np.array([int(np.argmax(v)) if e is None else int(e[0]) for v, e in zip(now, leave)])
    for t in range(length - 1, -1, -1):
        out[:, t] = state
        state = came[np.arange(n), t, state]
    return out


def regimes(df: DataFrame, keys: list[str], by: list[str], column: str, k: int = 3, rounds: int = 50, gain: float = 1e-6, block_rows: int = 4096, model: Model | None = None) -> DataFrame:
    """keys, by, x (the column), regime (of the likeliest path) and probabilities (of each regime, by all rows of the series) under one model, fitted unless it is given."""
    blocks = as_blocks(df, keys, by, column, block_rows)
    model = model or fit(blocks, keys, k, rounds, gain)
    paths = entries(model, blocks, keys, True).withColumnsRenamed({"enter": "first_state", "leave": "last_state"})
    rows = with_entries(with_entries(blocks, entries(model, blocks, keys, False)), paths).select(*keys, "rows", "xs", "enter", "leave", "first_state", "last_state")
    made = T.StructType([*[rows.schema[c] for c in keys], T.StructField("rows", rows.schema["rows"].dataType), T.StructField("regimes", T.ArrayType(T.IntegerType())), T.StructField("chances", T.ArrayType(T.ArrayType(T.DoubleType())))])

    k = len(model.mean)

    def tell(batches):
        for part in slices(batches):
            x = padded(part.column("xs"))
            state = {c: part.column(c).to_pylist() for c in ("enter", "leave", "first_state", "last_state")}
            path = best_path(model, x, state["first_state"], state["last_state"])
            gamma = posterior(model, x, state["enter"], state["leave"])[0]
            there = ~np.isnan(x)
            ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
            each = pa.ListArray.from_arrays(pa.array(np.arange(0, ends[-1] * k + 1, k), pa.int32()), pa.array(gamma[there].ravel()))
            told = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (pa.array(path[there], pa.int32()), each)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*keys, "rows"]), *told], names=[*keys, "rows", "regimes", "chances"])

    zipped = rows.mapInArrow(tell, made).select(*keys, F.explode(F.arrays_zip("rows", "regimes", "chances")).alias("r"))
    return zipped.select(*keys, *[F.col(f"r.rows.{c}").alias(c) for c in by], F.col("r.rows.x").alias(column), F.col("r.regimes").alias("regime"), F.col("r.chances").alias("probabilities"))

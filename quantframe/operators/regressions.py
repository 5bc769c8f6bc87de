"""Regressions with several columns over growing training sets, from sums of products: data is read once, whatever the number of fits.

Rows are cut at the edges of all training and test stretches, and one aggregate makes a row per key and stretch with counts,
means and centred products of regressors and target. Sets are then merged stretches, a fit is the solution of a small system,
and an error on other rows follows from their products, so grids of penalties and folds cost no pass over rows. Rows with a
null among the columns are left out before they are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.windows import ordered
from quantframe.operators.option_runs import by_key, keyed_stream
from quantframe.operators.performance import correlation, safe

#: The penalties of the complexity curves, ten to the powers from -4 to 1, and the share of the first norm in the mixed one.
PENALTIES = np.logspace(-4, 1, 20)
MIX = 0.5


@dataclass
class Moments:
    """Count, means and centred sums of products of (regressors.., target) over some rows."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * other.n / n, self.products + other.products + np.outer(apart, apart) * self.n * other.n / n)

    def error(self, w: np.ndarray, at_zero: float) -> float:
        """Mean squared error of a line on these rows."""
        d = np.append(-w, 1.0)
        return float(d @ self.products @ d / self.n + (d @ self.mean - at_zero) ** 2)


def total(parts: list[Moments], width: int) -> Moments:
    out = Moments(0.0, np.zeros(width), np.zeros((width, width)))
    for p in parts:
        out = out + p
    return out


def line(m: Moments, kind: str = "plain", penalty: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and intercept: plain least squares (the shortest of equals), ridge in closed form, lasso or mixed by coordinate descent. Penalties are on weights alone;
    ridge adds penalty * |w|^2 to the squared error, the others penalty * norm to half its mean."""
    xx, xy = m.products[:-1, :-1], m.products[:-1, -1]
    if kind == "plain":
        w = np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
    elif kind == "ridge":
        w = np.linalg.solve(xx + penalty * np.eye(len(xy)), xy)
    else:
        first, second = (penalty * m.n, 0.0) if kind == "lasso" else (penalty * m.n * MIX, penalty * m.n * (1 - MIX))
        w = np.zeros(len(xy))
        for _ in range(10_000):
            before = w.copy()
            for j in range(len(w)):
                rest = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                scale = xx[j, j] + second
                w[j] = np.sign(rest) * max(abs(rest) - first, 0.0) / scale if scale > 0 else 0.0
            if abs(w - before).max(initial=0) <= 1e-12 * max(1.0, abs(w).max(initial=0)):
                break
    return w, float(m.mean[-1] - w @ m.mean[:-1])


def lines(sets: list[Moments], kind: str, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``line`` of each set and penalty, all at once: weights (set, penalty, regressor) and intercepts. Each line stops by its own last step, as it would alone."""
    products, mean, n = np.array([m.products for m in sets]), np.array([m.mean for m in sets]), np.array([m.n for m in sets])
    xx, xy = products[:, None, :-1, :-1], products[:, None, :-1, -1]
    width, penalty = xy.shape[-1], penalties[None, :]
    if kind == "plain":
        w = np.repeat((np.linalg.pinv(xx, rcond=1e-12) @ xy[..., None])[..., 0], len(penalties), axis=1)
    elif kind == "ridge":
        w = np.linalg.solve(xx + penalty[..., None, None] * np.eye(width), np.repeat(xy, len(penalties), axis=1)[..., None])[..., 0]
    else:
        size = (n[:, None] * penalty).ravel()
        first, second = (size, np.zeros_like(size)) if kind == "lasso" else (size * MIX, size * (1 - MIX))
        of = np.repeat(np.arange(len(sets)), len(penalties))
        w, live = np.zeros((len(size), width)), np.arange(len(size))
        for _ in range(10_000):
            left, right, now = products[of[live], :-1, :-1], products[of[live], :-1, -1], w[live]
            before = now.copy()
            for j in range(width):
                rest = right[:, j] - (left[:, j] * now).sum(axis=1) + left[:, j, j] * now[:, j]
                scale = left[:, j, j] + second[live]
                now[:, j] = np.where(scale > 0, np.sign(rest) * np.maximum(abs(rest) - first[live], 0.0) / np.where(scale > 0, scale, 1.0), 0.0)
            w[live] = now
            live = live[abs(now - before).max(axis=1) > 1e-12 * np.maximum(1.0, abs(now).max(axis=1))]
            if not len(live):
                break
        w = w.reshape(len(sets), len(penalties), width)
    return w, mean[:, None, -1] - (w * mean[:, None, :-1]).sum(axis=-1)


def plain_errors(trained: list[Moments], tested: list[Moments]) -> tuple[list[float], list[float]]:
    """Errors of each training set's least squares there and on its test set, all at once."""
    fits = lines(trained, "plain", np.zeros(1))
    return errors(trained, *fits)[:, 0].tolist(), errors(tested, *fits)[:, 0].tolist()


def errors(sets: list[Moments], w: np.ndarray, at_zero: np.ndarray) -> np.ndarray:
    """``Moments.error`` of each set by the lines (set, penalty) of ``lines``."""
    d = np.concatenate([-w, np.ones((*w.shape[:-1], 1))], axis=-1)
    squares = np.einsum("spi,sij,spj->sp", d, np.array([m.products for m in sets]), d)
    with np.errstate(divide="ignore", invalid="ignore"):
        return squares / np.array([m.n for m in sets])[:, None] + (np.einsum("spi,si->sp", d, np.array([m.mean for m in sets])) - at_zero) ** 2


def moments(df: DataFrame, keys: list[str], by: list, xs: list[str], y: str, stretch) -> DataFrame:
    """keys, rows (of the key), stretch and its moments; stretch: a function of a row's number and its key's rows."""
    columns = [*xs, y]
    whole = df.select(*keys, *[c for c in by if isinstance(c, str) and c not in keys and c not in columns], *[F.col(c).cast("double") for c in columns]).dropna(subset=columns)
    numbered = whole.withColumn("_row", F.row_number().over(ordered(keys, *by)) - 1).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return numbered.withColumn("stretch", stretch(F.col("_row"), F.col("rows"))).filter("stretch IS NOT NULL").groupBy(*keys, "rows", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*[F.covar_pop(columns[i], columns[j]) * F.count(F.lit(1)) for i, j in pairs]).alias("products"),
    )


def held(t: pd.DataFrame, width: int) -> dict[int, Moments]:
    upper = np.triu_indices(width)
    out = {}
    for s, n, mean, products in zip(t["stretch"], t["n"], t["mean"], t["products"]):
        m = np.zeros((width, width))
        m[upper] = products
        out[int(s)] = Moments(float(n), np.array(mean, float), m + np.triu(m, 1).T)
    return out


def per_series(table: DataFrame, keys: list[str], work, columns: str) -> DataFrame:
    """work: a key's moments (a row per stretch: few) and its number of rows -> rows."""
    schema = T.StructType([*[table.schema[k] for k in keys], *T._parse_datatype_string(columns).fields])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        made = work(t, int(t["rows"].iloc[0]))
        if not made:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in schema.names})
        out = pd.DataFrame(made, columns=schema.names[len(keys) :])
        for k in reversed(keys):
            out.insert(0, k, t[k].iloc[[0] * len(out)].to_numpy())
        return out

    return table.groupBy(*keys).applyInPandas(run, schema)


def walk_forward_fits(df: DataFrame, keys: list[str], by: list, xs: list[str], y: str, least: int = 252, steps: int = 3, step: int = 21) -> DataFrame:
    """keys, fold, train_rows, train_error, test_error: least squares on the first ``least`` rows and on those ``step`` longer each time, tested on the next ``steps`` * ``step`` rows; full folds only."""
    width = len(xs) + 1
    table = moments(df, keys, by, xs, y, lambda row, _: F.when(row < least, 0).otherwise(F.floor((row - least) / step) + 1).cast("int"))

    def work(t, rows):
        folds = max(0, (rows - least) // step - steps + 1)
        if not folds:
            return
        m, trained = held(t, width), [total([], width)]
        for fold in range(folds):
            trained.append(trained[-1] + m[fold])
        tested = [total([m[fold + 1 + i] for i in range(steps)], width) for fold in range(folds)]
        for fold, (n, train, test) in enumerate(zip(trained[1:], *plain_errors(trained[1:], tested))):
            yield fold, int(n.n), train, test

    return per_series(table, keys, lambda t, rows: list(work(t, rows)), "fold int, train_rows int, train_error double, test_error double")


def size_cuts(rows, least: int, sizes: int):
    """Training sizes from ``least`` to 4/5 of the rows, equally far apart; works on columns and on numbers."""
    whole = lambda x: F.floor(x) if isinstance(x, Column) else int(x // 1)
    return [whole((5 * least * (sizes - 1) + i * (4 * rows - 5 * least)) / (5 * (sizes - 1))) for i in range(sizes)]


def cut_at(row: Column, cuts: list[Column]) -> Column:
    return sum((row >= c).cast("int") for c in cuts)


def learning_curve(df: DataFrame, keys: list[str], by: list, xs: list[str], y: str, least: int = 252, horizon: int = 63, sizes: int = 10, folds: int = 3) -> DataFrame:
    """keys, size, train_mean, train_deviation, test_mean, test_deviation of scores (the squared error, negative): for training sizes from ``least`` to 4/5 of the rows, over ``folds`` tests of ``horizon`` rows that end ``horizon`` after it."""
    width = len(xs) + 1
    table = moments(df, keys, by, xs, y, lambda row, rows: cut_at(row, [c + k * horizon for c in size_cuts(rows, least, sizes) for k in range(1 - folds, 2)]))

    def work(t, rows):
        m, cuts = held(t, width), size_cuts(rows, least, sizes)
        edges = sorted(c + k * horizon for c in cuts for k in range(1 - folds, 2))
        upto = {0: total([], width)}
        for stretch in range(len(edges) + 1):  # moments of all rows before each edge
            upto[stretch + 1] = upto[stretch] + m[stretch] if stretch in m else upto[stretch]
        before = {e: upto[i + 1] for i, e in reversed(list(enumerate(edges)))}
        kept = [size for size in cuts if least <= rows * 0.8 and size + horizon <= rows and size - (folds - 1) * horizon > 0]
        if not kept:
            return
        starts = [size + k * horizon for size in kept for k in range(1 - folds, 1)]
        a = -np.array(plain_errors([before[e] for e in starts], [between(m, edges, e, e + horizon, width) for e in starts])).reshape(2, len(kept), folds)
        for size, *scores in zip(kept, *[x.tolist() for v in a for x in (v.mean(axis=1), v.std(axis=1))]):
            yield (size, *scores)

    return per_series(table, keys, lambda t, rows: list(work(t, rows)), "size int, train_mean double, train_deviation double, test_mean double, test_deviation double")


def between(m: dict[int, Moments], edges: list[int], low: int, high: int, width: int) -> Moments:
    """Moments of the rows from one edge to another."""
    first, last = edges.index(low) + edges.count(low), edges.index(high)
    return total([m[s] for s in range(first, last + 1) if s in m], width)


def complexity_curves(df: DataFrame, keys: list[str], by: list, xs: list[str], y: str, horizon: int = 63, folds: int = 5, penalties: list[float] | None = None) -> DataFrame:
    """keys, model (ridge, lasso, mixed), penalty, train_score, test_score, weights, best: scores are the squared error, negative. Tests are the last ``folds`` stretches of ``horizon`` rows, each
    after training on all rows before it; the training score and the weights are those of the first 4/5 of the rows; best has the highest test score, ties the smaller penalty."""
    width, grid = len(xs) + 1, [float(p) for p in (PENALTIES if penalties is None else penalties)]
    cuts = lambda rows: [rows - k * horizon for k in range(folds, 0, -1)]
    table = moments(df, keys, by, xs, y, lambda row, rows: cut_at(row, cuts(rows)) * 2 + (row >= F.floor(rows * 4 / 5)).cast("int"))

    def work(t, rows):
        m = held(t, width)
        if rows - folds * horizon <= 0 or not any(s % 2 == 0 for s in m):
            return
        upto = [total([v for s, v in sorted(m.items()) if s // 2 <= i], width) for i in range(folds)]
        tested = [total([v for s, v in m.items() if s // 2 == i + 1], width) for i in range(folds)]
        first = total([v for s, v in sorted(m.items()) if s % 2 == 0], width)
        for kind in ("ridge", "lasso", "mixed"):
            fits, zero = lines([*upto, first], kind, np.array(grid))
            test, train = -errors(tested, fits[:-1], zero[:-1]).mean(axis=0), -errors([first], fits[-1:], zero[-1:])[0]
            found = [(kind, p, float(a), float(b), w.tolist()) for p, a, b, w in zip(grid, train, test, fits[-1])]
            best = max(range(len(grid)), key=lambda i: (found[i][3], -grid[i]))
            for i, row in enumerate(found):
                yield (*row, i == best)

    return per_series(table, keys, lambda t, rows: list(work(t, rows)), "model string, penalty double, train_score double, test_score double, weights array<double>, best boolean")


def student_two_sided(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """Chance that Student's t is further from 0: the regularised incomplete beta function, by its continued fraction."""
    from math import lgamma

    out = np.full(len(t), np.nan)
    for i, (v, df) in enumerate(zip(t, freedom)):
        if not np.isfinite(v) or not df > 0:
            out[i] = 0.0 if df > 0 and np.isinf(v) else np.nan
            continue
        x, a, b = df / (df + v * v), df / 2, 0.5
        if x >= 1:
            out[i] = 1.0
            continue
        swap = x > (a + 1) / (a + b + 2)
        x, a, b = (1 - x, b, a) if swap else (x, a, b)
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + up * d), 1 + up / c
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        part = np.exp(a * np.log(x) + b * np.log1p(-x) - (lgamma(a) + lgamma(b) - lgamma(a + b))) * h / a
        out[i] = 1 - part if swap else part
    return out


def two_sided(t: Column, freedom: Column) -> Column:
    return F.pandas_udf(lambda a, b: pd.Series(student_two_sided(a.to_numpy(float), b.to_numpy(float))), T.DoubleType())(t, freedom)


def trend(table: DataFrame, keys: list[str], position: str, value: str, prefix: str) -> DataFrame:
    """Per key: slope of value over position, r2, and the chance of a slope as far from 0 without a trend."""
    t = table.groupBy(*keys).agg(F.count(value).alias("_n"), safe(F.covar_pop(value, position), F.var_pop(position)).alias(f"{prefix}_slope"), correlation(F.col(value), F.col(position)).alias("_r"))
    r2 = F.col("_r") ** 2
    stat = F.abs("_r") * F.sqrt((F.col("_n") - 2) / F.greatest(1 - r2, F.lit(1e-300)))
    return t.withColumn(f"{prefix}_r2", r2).withColumn(f"{prefix}_p", F.when(F.col("_n") > 2, two_sided(stat, (F.col("_n") - 2).cast("double")))).drop("_n", "_r")


#: What each sign of over-fitting adds to the risk, and the bounds of the levels.
RISKS = {"ratio": ((2.0, 0.3), (1.5, 0.15)), "stability": ((0.3, 0.2), (0.15, 0.1)), "degrading": 0.25, "converging": -0.1, "not_converging": 0.15, "gap": (0.1, 0.2)}
LEVELS = ((0.5, "HIGH"), (0.25, "MEDIUM"))


def stepped(value: Column, steps: tuple) -> Column:
    (a, x), (b, z) = steps
    return F.when(value > a, x).when(value > b, z).otherwise(0.0)


def level(score: Column, levels: tuple) -> Column:
    (a, x), (b, z) = levels
    return F.when(score >= a, x).when(score >= b, z).otherwise("LOW")


def overfit_risk(walk: DataFrame, learning: DataFrame, keys: list[str], significance: float = 0.05) -> DataFrame:
    """From tables of ``walk_forward_fits`` and ``learning_curve``, per key: ratio and stability of test errors, their trend, the paired t test of training against test errors, convergence and last gap of the learning curve, score and level."""
    gap = F.col("train_error") - F.col("test_error")
    t = walk.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), safe(F.avg("test_error"), F.avg("train_error")).alias("ratio"), safe(F.stddev_pop("test_error"), F.avg("test_error")).alias("stability"), F.avg(gap).alias("_m"), F.stddev_samp(gap).alias("_s"))
    t = t.withColumn("paired_t", safe(F.col("_m"), F.col("_s")) * F.sqrt("folds")).withColumn("paired_p", two_sided(F.col("paired_t"), (F.col("folds") - 1).cast("double"))).drop("_m", "_s")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("size"))
    curve = learning.withColumn("_at", place)
    ends = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("sizes"), F.max_by(F.col("train_mean") - F.col("test_mean"), "_at").alias("gap"))
    out = t.join(trend(walk, keys, "fold", "test_error", "trend"), keys, "left").join(ends, keys, "left").join(trend(curve, keys, "_at", "test_mean", "learning"), keys, "left")
    told = F.coalesce(F.col("sizes"), F.lit(0)) > 3
    converging = F.coalesce(told & (F.col("learning_slope") > 0) & (F.col("learning_p") < significance), F.lit(False))
    degrading = F.coalesce((F.col("trend_slope") < 0) & (F.col("trend_p") < significance), F.lit(False))
    wide, adds = RISKS["gap"]
    score = stepped(F.col("ratio"), RISKS["ratio"]) + stepped(F.col("stability"), RISKS["stability"]) + F.when(degrading, RISKS["degrading"]).otherwise(0.0) + F.when(converging, RISKS["converging"]).otherwise(RISKS["not_converging"]) + F.when(told & (F.col("gap") > wide), adds).otherwise(0.0)
    return out.withColumn("converging", converging).withColumn("score", score).withColumn("level", level(F.round("score", 9), LEVELS))


def recursive_predictions(df: DataFrame, keys: list[str], by: list[str], xs: list[str], y: str, least: int = 30) -> DataFrame:
    """df's rows without nulls in xs and y, with guess: the row's y by least squares with an intercept on all earlier rows of its key, from ``least`` of them on.

    The state of a key is the matrix of its sums of products, centred at its first row; it is carried along the sorted stream, and all
    rows of a batch are solved together, so no row is read twice. Of equally good fits the one with the shortest weights is taken."""
    rows = keyed_stream(df.dropna(subset=[*xs, y]), keys, by)
    schema = T.StructType([*rows.schema.fields, T.StructField("guess", T.DoubleType())])
    p = len(xs) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, a, b, origin, seen = object(), None, None, None, 0
        for batch in batches:
            guesses = [np.zeros(0)]
            for key, part in by_key(batch, keys):
                v = part[[*xs, y]].to_numpy(float)
                if key != now:
                    now, a, b, origin, seen = key, np.zeros((p, p)), np.zeros(p), v[0].copy(), 0
                v = v - origin
                x = np.column_stack([np.ones(len(v)), v[:, :-1]])
                grown_a = a + np.concatenate([np.zeros((1, p, p)), np.cumsum(x[:, :, None] * x[:, None, :], axis=0)])
                grown_b = b + np.concatenate([np.zeros((1, p)), np.cumsum(x * v[:, -1:], axis=0)])
                size = np.sqrt(np.maximum(np.einsum("nii->ni", grown_a[:-1]), 1e-300))
                scaled = grown_a[:-1] / (size[:, :, None] * size[:, None, :])
                w = (np.linalg.pinv(scaled, rcond=1e-11, hermitian=True) @ (grown_b[:-1] / size)[:, :, None])[:, :, 0] / size
                guess = (x * w).sum(axis=1) + origin[-1]
                guess[np.arange(seen, seen + len(v)) < least] = np.nan
                guesses.append(guess)
                a, b, seen = grown_a[-1], grown_b[-1], seen + len(v)
            yield batch.assign(guess=np.concatenate(guesses))

    told = rows.mapInPandas(run, schema)
    return told.withColumn("guess", F.when(~F.isnan("guess"), F.col("guess")))

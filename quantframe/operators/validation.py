"""Time-ordered validation: folds as tables, joined by row number; metrics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions.windows import ordered


def walk_forward(df: DataFrame, keys: list[str], train: int, test: int, step: int, expanding: bool = True) -> DataFrame:
    """keys, fold, train_low, train_high, test_low, test_high (row numbers from 0, both ends in), for all full folds of each key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= train + test)
    folds = counts.select(*keys, F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - train - test) / step).cast("int"))).alias("fold"))
    start = F.col("fold") * step + train
    low = F.lit(0) if expanding else F.col("fold") * step
    return folds.select(*keys, "fold", low.alias("train_low"), (start - 1).alias("train_high"), start.alias("test_low"), (start + test - 1).alias("test_high"))


def fold_rows(df: DataFrame, folds: DataFrame, keys: list[str], by: list, embargo: int = 0) -> DataFrame:
    """Rows of df with fold and role; training rows within ``embargo`` rows of the test rows are left out."""
    numbered = df.withColumn("row", F.row_number().over(ordered(keys, *by)) - 1)
    joined = numbered.join(folds, keys)
    tested, trained = F.col("row").between(F.col("test_low"), F.col("test_high")), F.col("row").between(F.col("train_low"), F.col("train_high") - embargo)
    return joined.filter(tested | trained).withColumn("role", F.when(tested, "test").otherwise("train")).drop("train_low", "train_high", "test_low", "test_high")


def linear_fold_errors(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key and fold: a line fitted on training rows by aggregates, and its errors on the test rows."""
    trained = F.col("role") == "train"
    cx, cy = F.when(trained, F.col(x)), F.when(trained, F.col(y))
    line = rows.groupBy(*keys, "fold").agg((F.covar_samp(cx, cy) / F.when(F.var_samp(cx) != 0, F.var_samp(cx))).alias("slope"), F.avg(cx).alias("mx"), F.avg(cy).alias("my"))
    tested = rows.filter("role = 'test'").join(line, [*keys, "fold"])
    guess = F.col("my") + F.col("slope") * (F.col(x) - F.col("mx"))
    return tested.withColumn("guess", guess).groupBy(*keys, "fold").agg(F.sqrt(F.avg((F.col(y) - F.col("guess")) ** 2)).alias("rmse"), F.avg(F.abs(F.col(y) - F.col("guess"))).alias("mae"), F.count("guess").alias("n"))


def walk_forward_lines(df: DataFrame, keys: list[str], by: list, x: str, y: str, train: int, test: int, step: int, embargo: int = 0, expanding: bool = True) -> DataFrame:
    """What ``linear_fold_errors`` gives over the folds of ``walk_forward``, in one ordered pass: the line of a fold is a running aggregate
    at its last training row, read by the test rows that follow, so no row is copied to the folds that train on it. The embargo is below ``train``."""
    w = ordered(keys, *by)
    whole = F.col(x).isNotNull() & F.col(y).isNotNull()
    seen = w.rowsBetween(Window.unboundedPreceding if expanding else 1 - train, -embargo)
    cx, cy = F.when(whole, F.col(x)), F.when(whole, F.col(y))
    spread = F.var_samp(cx).over(seen)
    slope = F.covar_samp(cx, cy).over(seen) / F.when(spread != 0, spread)
    rows = df.select(*keys, *by, x, y, (F.row_number().over(w) - 1).alias("row"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("rows"), slope.alias("slope"), F.avg(cx).over(seen).alias("mx"), F.avg(cy).over(seen).alias("my"))
    past = F.col("row") + 1 - train
    ends = (past >= 0) & (past % step == 0) & (F.col("row") + 1 + test <= F.col("rows"))
    cut = F.when(ends, F.struct((past / step).cast("int").alias("fold"), F.col("row").alias("at"), "slope", "mx", "my"))
    before = F.array(F.last("cut", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))) if test <= step else F.collect_list("cut").over(w.rowsBetween(-test, -1))
    tested = rows.withColumn("cut", cut).withColumn("folds", before).filter(whole).withColumn("f", F.explode("folds")).filter(F.col("row") - F.col("f.at") <= test)
    miss = F.col(y) - (F.col("f.my") + F.col("f.slope") * (F.col(x) - F.col("f.mx")))
    return tested.select(*keys, F.col("f.fold").alias("fold"), miss.alias("miss")).groupBy(*keys, "fold").agg(F.sqrt(F.avg(F.col("miss") ** 2)).alias("rmse"), F.avg(F.abs("miss")).alias("mae"), F.count("miss").alias("n"))


def prediction_metrics(df: DataFrame, keys: list[str], by: list, actual: str, predicted: str) -> DataFrame:
    """rmse, mae, r2, share of steps in the right direction, information coefficient."""
    w = ordered(keys, *by)
    a, p = F.col(actual), F.col(predicted)
    right = (F.signum(a - F.lag(actual).over(w)) == F.signum(p - F.lag(predicted).over(w))).cast("double")
    table = df.withColumn("right", right).groupBy(*keys).agg(F.sqrt(F.avg((a - p) ** 2)).alias("rmse"), F.avg(F.abs(a - p)).alias("mae"), F.sum((a - p) ** 2).alias("sse"), F.var_pop(actual).alias("v"), F.count(F.lit(1)).alias("n"), F.avg("right").alias("direction"), F.corr(actual, predicted).alias("information"))
    return table.select(*keys, "rmse", "mae", (1 - F.col("sse") / F.when(F.col("v") * F.col("n") != 0, F.col("v") * F.col("n"))).alias("r2"), "direction", "information")


def normality(df: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """t statistic of the mean, Jarque-Bera statistic and its p-value."""
    table = df.groupBy(*keys).agg(F.count(ret).alias("n"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s"), F.skewness(ret).alias("g"), F.kurtosis(ret).alias("k"))
    jb = F.col("n") / 6 * (F.col("g") ** 2 + F.col("k") ** 2 / 4)
    return table.select(*keys, F.when(F.col("s") != 0, F.col("m") / F.col("s") * F.sqrt("n")).alias("t"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("p_value"))


def autocorrelation(df: DataFrame, keys: list[str], by: list, column: str, lags: int = 5) -> DataFrame:
    w = ordered(keys, *by)
    lagged = df.select(*keys, column, *[F.lag(column, k).over(w).alias(f"lag_{k}") for k in range(1, lags + 1)])
    return lagged.groupBy(*keys).agg(*[F.corr(column, f"lag_{k}").alias(f"ac_{k}") for k in range(1, lags + 1)])


def sharpe_grid(df: DataFrame, keys: list[str], by: list, price: str, windows: list[int]) -> DataFrame:
    """Parameter sweep: Sharpe of holding above the moving average, for each window; the best per key ranks first."""
    w = ordered(keys, *by)
    held = df.withColumn("ret", F.col(price) / F.lag(price).over(w) - 1)
    for n in windows:
        mean = F.when(F.count(price).over(w.rowsBetween(1 - n, 0)) >= n, F.avg(price).over(w.rowsBetween(1 - n, 0)))
        held = held.withColumn(f"s_{n}", F.when(F.col(price) > mean, 1.0).otherwise(0.0))
    gains = [F.struct(F.lit(n).alias("window"), (F.col("ret") * F.lag(f"s_{n}").over(w)).alias("gain")) for n in windows]
    long = held.withColumn("gains", F.array(*gains)).select(*keys, F.inline("gains")).filter("gain IS NOT NULL")
    table = long.groupBy(*keys, "window").agg(F.avg("gain").alias("m"), F.stddev_samp("gain").alias("s"))
    scored = table.select(*keys, "window", F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * math.sqrt(252)).alias("sharpe"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.round("sharpe", 9)), "window")))


def purged_folds(df: DataFrame, keys: list[str], folds: int, purge: int, embargo: int) -> DataFrame:
    """keys, fold, test_low, test_high, and the two stretches of training rows around them, less purge before and embargo after."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    spread = counts.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    low, high = F.floor(F.col("fold") * F.col("n") / folds), F.floor((F.col("fold") + 1) * F.col("n") / folds) - 1
    return spread.select(*keys, "fold", low.alias("test_low"), high.alias("test_high"), F.lit(0).alias("before_low"), (low - 1 - purge).alias("before_high"), (high + 1 + embargo).alias("after_low"), (F.col("n") - 1).alias("after_high"))


def combinatorial_folds(df: DataFrame, keys: list[str], by: list, groups: int, tested: int, embargo: int = 0) -> DataFrame:
    """Rows with each combination of ``tested`` of the key's ``groups`` equal stretches as test, and as training those at least ``embargo`` groups away."""
    from itertools import combinations

    combos = [list(c) for c in combinations(range(groups), tested)]
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    grouped = df.withColumn("group", F.floor((F.row_number().over(ordered(keys, *by)) - 1) * groups / n).cast("int"))
    picks = F.array(*[F.struct(F.lit(i).alias("fold"), F.array(*map(F.lit, c)).alias("test")) for i, c in enumerate(combos)])
    spread = grouped.select("*", F.inline(picks))
    inside = F.array_contains("test", F.col("group"))
    near = F.exists("test", lambda t: F.abs(t - F.col("group")) <= embargo)
    return spread.filter(inside | ~near).withColumn("role", F.when(inside, "test").otherwise("train")).drop("test", "group")


def naive_rules(df: DataFrame, keys: list[str], by: list, ret: str = "ret") -> DataFrame:
    """Returns of three plain rules: hold; against the mean of the last five returns; with that of the last ten."""
    w = ordered(keys, *by)
    mean = lambda n: F.avg(ret).over(w.rowsBetween(-n, -1))
    return df.withColumn("hold", F.col(ret)).withColumn("reversion", -F.signum(mean(5)) * F.col(ret)).withColumn("momentum", F.signum(mean(10)) * F.col(ret))


def grade(score):
    """A to F by score."""
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def drawn_folds(df: DataFrame, keys: list[str], folds: int, train: int, test: int, gap: int = 0, seed: int = 1) -> DataFrame:
    """Monte-Carlo folds: ``folds`` training blocks of each key at starts drawn by a linear congruential step from the seed, and their test blocks after a gap; row numbers from 0."""
    room = F.col("n") - train - gap - test + 1
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(room > 0)
    drawn = counts.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    low = (((F.col("fold") + F.lit(seed).cast("long")) * 1103515245 + 12345) % 2147483648 % room).alias("train_low")
    start = F.col("train_low")
    return drawn.select(*keys, "fold", low).select(*keys, "fold", "train_low", (start + train - 1).alias("train_high"), (start + train + gap).alias("test_low"), (start + train + gap + test - 1).alias("test_high"))


def overfit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key: mean training and test error (mse) of a line over its folds, their ratio, the ratio's deviation, and its slope and r2 over the folds."""
    trained = F.col("role") == "train"
    cx, cy = F.when(trained, F.col(x)), F.when(trained, F.col(y))
    line = rows.groupBy(*keys, "fold").agg((F.covar_samp(cx, cy) / F.when(F.var_samp(cx) != 0, F.var_samp(cx))).alias("slope"), F.avg(cx).alias("mx"), F.avg(cy).alias("my"))
    error = F.col(y) - F.col("my") - F.col("slope") * (F.col(x) - F.col("mx"))
    folds = rows.join(line, [*keys, "fold"]).withColumn("e", error * error).groupBy(*keys, "fold").agg(F.avg(F.when(trained, F.col("e"))).alias("train"), F.avg(F.when(~trained, F.col("e"))).alias("test"))
    ratio = F.when(F.col("train") != 0, F.col("test") / F.col("train"))
    return folds.withColumn("ratio", ratio).groupBy(*keys).agg(F.avg("train").alias("train"), F.avg("test").alias("test"), F.avg("ratio").alias("ratio"), F.stddev_samp("ratio").alias("spread"), F.regr_slope("ratio", "fold").alias("trend"), F.regr_r2("ratio", "fold").alias("trend_r2"))


def pareto(trials: DataFrame, trial: str, first: str, second: str) -> DataFrame:
    """Trials that no other one equals or beats in both goals while it beats it in one (higher is better), by one sort: of each first goal the best second, if above those of all greater first goals."""
    # trials are few: a running maximum over all of them in order of the first goal
    w = Window.orderBy(F.desc(first))
    strict = trials.groupBy(first).agg(F.max(second).alias("best_second")).withColumn("before", F.max("best_second").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    kept = trials.join(strict, first).filter((F.col(second) == F.col("best_second")) & (F.col("before").isNull() | (F.col(second) > F.col("before"))))
    return kept.select(trial, first, second)

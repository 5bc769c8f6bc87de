"""What residuals tell about a model that fits too little, per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions.joins import beside
from quantframe.functions.options import normal_cdf
from quantframe.functions.windows import ordered
from quantframe.operators.performance import correlation, safe
from quantframe.operators.regressions import level

#: What each sign of under-fitting adds to the risk, and the bounds of the levels.
LOW_R2 = ((0.1, 0.4), (0.3, 0.2))
BASELINE, CORRELATED = (0.1, 0.3), (0.3, 0.2)
LEVELS = ((0.6, "HIGH"), (0.3, "MEDIUM"))


def residual_diagnosis(df: DataFrame, keys: list[str], by: list, actual: str, predicted: str, lags: int = 10) -> DataFrame:
    """Per key, over rows with both values: n, mean, deviation, skew and excess kurtosis of the residuals (population), their correlations at lags 1 to ``lags`` (0 where there are none, null from n / 4 on),
    correlation of their size with the prediction, variance of the first half over the second's, Jarque-Bera and its chance, and the two-stage test of changing variance:
    n times the r2 of squared residuals over predictions, and the chance of more under equal variance."""
    rows = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).withColumn("_e", F.col(actual) - F.col(predicted))
    w, e = ordered(keys, *by), F.col("_e")
    half = F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / 2)
    made = rows.select(*keys, F.col(predicted).alias("_p"), "_e", (F.row_number().over(w) <= half).alias("_early"), *[F.lag("_e", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    table = made.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("deviation"), F.skewness(e).alias("skew"), F.kurtosis(e).alias("kurtosis"), *[correlation(e, F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)],
        F.coalesce(correlation(F.abs(e), F.col("_p")), F.lit(0.0)).alias("size_correlation"), safe(F.var_pop(F.when(F.col("_early"), e)), F.var_pop(F.when(~F.col("_early"), e))).alias("variance_ratio"), correlation(e * e, F.col("_p")).alias("_r"),
    )
    n = F.col("n")
    jb = n / 6 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4)
    changing = n * F.coalesce(F.col("_r"), F.lit(0.0)) ** 2
    each = [F.when(F.floor(n / 4) > k, F.coalesce(F.col(f"_c{k}"), F.lit(0.0))).alias(f"ac_{k}") for k in range(1, lags + 1)]
    return table.select(*keys, "n", "mean", "deviation", "skew", "kurtosis", *each, "size_correlation", "variance_ratio", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jarque_bera_p"), changing.alias("changing_variance"), (2 * (1 - normal_cdf(F.sqrt(changing)))).alias("changing_variance_p"))


def fold_r2(df: DataFrame, keys: list[str], by: list, actual: str, predictions: list[str], folds: int = 5, size: int = 63) -> DataFrame:
    """keys and, for each prediction, its mean r2 over the last ``folds`` stretches of ``size`` rows that have all values; keys with fewer rows are left out."""
    whole = F.col(actual).isNotNull()
    for p in predictions:
        whole = whole & F.col(p).isNotNull()
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])) - 1
    rows = df.filter(whole).withColumn("_fold", F.floor(back / size)).filter(F.col("_fold") < folds)
    a = F.col(actual)
    each = rows.groupBy(*keys, "_fold").agg(F.count(F.lit(1)).alias("_n"), F.var_pop(a).alias("_v"), *[F.avg((a - F.col(p)) ** 2).alias(f"_e_{p}") for p in predictions]).filter(F.col("_n") == size)
    r2 = [F.avg(1 - safe(F.col(f"_e_{p}"), F.col("_v"))).alias(f"r2_{p}") for p in predictions]
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), *r2).filter(F.col("_k") == folds).drop("_k")


def underfit_risk(df: DataFrame, keys: list[str], by: list, actual: str, predicted: str, baselines: list[str], folds: int = 5, size: int = 63) -> DataFrame:
    """Per key: r2 of the model and of each baseline over folds, the largest correlation of residuals at lags 1 to 10, how many baselines are better by over 0.1, score and level."""
    scores = fold_r2(df, keys, by, actual, [predicted, *baselines], folds, size)
    told = residual_diagnosis(df, keys, by, actual, predicted)
    largest = F.greatest(F.lit(0.0), *[F.coalesce(F.abs(f"ac_{k}"), F.lit(0.0)) for k in range(1, 11)])
    r2 = F.col(f"r2_{predicted}")
    margin, adds = BASELINE
    better = sum(((F.col(f"r2_{b}") > r2 + margin).cast("int") for b in baselines), F.lit(0))
    (very_low, most), (low, some) = LOW_R2
    bound, more = CORRELATED
    out = beside(scores, told.select(*keys, largest.alias("largest_ac")), keys).withColumn("better_baselines", better)
    score = F.when(r2 < very_low, most).when(r2 < low, some).otherwise(0.0) + adds * F.col("better_baselines") + F.when(F.col("largest_ac") > bound, more).otherwise(0.0)
    return out.withColumn("score", score).withColumn("level", level(F.round("score", 9), LEVELS))

"""Cleaning, scaling and selection of columns, per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_key(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """df with statistics of its key beside each row: an aggregate with a row per key, joined back."""
    table = df.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])
    return df.join(table, keys)


def quantiles(column: str, *shares: float) -> Column:
    return F.percentile(column, F.array(*[F.lit(s) for s in shares]))


def cap_outliers(df: DataFrame, keys: list[str], column: str, times: float = 2.0) -> DataFrame:
    """Values beyond the quartiles by over ``times`` their distance are set to that bound."""
    q1, q3 = F.col("q")[0], F.col("q")[1]
    capped = F.greatest(F.least(F.col(column), q3 + (q3 - q1) * times), q1 - (q3 - q1) * times)
    return per_key(df, keys, q=quantiles(column, 0.25, 0.75)).withColumn(column, F.when(F.col(column).isNotNull(), capped)).drop("q")


def drop_outliers(df: DataFrame, keys: list[str], columns: list[str], k: float = 3.0) -> DataFrame:
    """Rows within k sample deviations of the mean in every column."""
    stats = {f"m_{c}": F.avg(c) for c in columns} | {f"s_{c}": F.stddev_samp(c) for c in columns}
    inside = [F.abs(F.col(c) - F.col(f"m_{c}")) <= k * F.col(f"s_{c}") for c in columns]
    out = per_key(df, keys, **stats)
    for test in inside:
        out = out.filter(test)
    return out.drop(*stats)


def scale(df: DataFrame, keys: list[str], column: str, robust: bool = False) -> DataFrame:
    """Standard (population deviation) or robust (median, quartile distance); a scale of zero counts as one."""
    if robust:
        out, middle, width = per_key(df, keys, q=quantiles(column, 0.25, 0.5, 0.75)), F.col("q")[1], F.col("q")[2] - F.col("q")[0]
    else:
        out, middle, width = per_key(df, keys, q=F.struct(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))), F.col("q.m"), F.col("q.s")
    return out.withColumn("scaled", (F.col(column) - middle) / F.when(width == 0, 1.0).otherwise(width)).drop("q")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """code: the place of the value among the distinct ones in order; null stays null. The distinct values are numbered in one task, as few as label encoding is for."""
    codes = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("code", F.dense_rank().over(Window.orderBy(column)) - 1)
    return df.join(codes, column, "left")


def column_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: share of nulls, distinct values, least, greatest, sample variance; one pass."""
    stats = [F.struct(F.lit(c).alias("column"), (F.count(F.when(F.col(c).isNull(), 1)) / F.count(F.lit(1))).alias("null_share"), F.count_distinct(c).alias("distinct"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest"), F.var_samp(c).alias("variance")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr for each pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("s")).select(F.inline("s"))


def uncorrelated(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """Columns that stay; of a pair with a larger |corr|, the earlier goes. Collects a row per pair of columns."""
    gone = {r["a"] for r in correlations(df, columns).filter(F.abs("corr") > most).collect()}
    return [c for c in columns if c not in gone]


def f_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, score: r^2 / (1 - r^2) * (n - 2)."""
    stats = [F.struct(F.lit(c).alias("feature"), F.corr(c, target).alias("r"), F.count(F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), 1)).alias("n")) for c in features]
    table = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    return table.select("feature", (F.col("r") ** 2 / (1 - F.col("r") ** 2) * (F.col("n") - 2)).alias("score"))


def sanitize(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Text to numbers (bad: null), infinities to null."""
    def clean(c: str) -> Column:
        value = F.expr(f"try_cast(`{c}` AS double)")
        return F.when(F.abs(value) < float("inf"), value).alias(c)

    return df.select(*[clean(c) if c in numeric else F.col(c) for c in df.columns])


def integrity(df: DataFrame, keys: list[str], order: list[str], price: str, volume: str) -> DataFrame:
    """Per key: share of positive volumes, of large moves (over 50 %), of duplicate timestamps."""
    w = Window.partitionBy(*keys).orderBy(*order)
    moved = df.withColumn("move", F.abs(F.col(price) / F.when(F.lag(price).over(w) != 0, F.lag(price).over(w)) - 1)).withColumn("again", (F.lag(order[0]).over(w) == F.col(order[0])).cast("int"))
    return moved.groupBy(*keys).agg(F.avg((F.col(volume) > 0).cast("double")).alias("positive_volume"), F.coalesce(F.avg((F.col("move") > 0.5).cast("double")), F.lit(0.0)).alias("large_moves"), F.coalesce(F.sum("again"), F.lit(0)).alias("repeated_times"))


def null_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """One pass; one row comes to the driver."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first() if columns else {}
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}


def drop_sparse_columns(df: DataFrame, columns: list[str], most: float = 0.5) -> DataFrame:
    """Without those of the columns that are null in over ``most`` of the rows."""
    return df.drop(*[c for c, share in null_shares(df, columns).items() if share > most])


def drop_null_rows(df: DataFrame, columns: list[str], how: str = "any") -> DataFrame:
    return df.dropna(how, subset=columns)


def load_parts(parts: list[DataFrame], keys: list[str], by: list[str], columns: list[str], times: float = 2.0) -> DataFrame:
    """Parts that overlap, as one table: equal rows once, values filled forward and capped over the whole key."""
    rows = reduce(lambda x, y: x.unionByName(y), parts).dropDuplicates()
    w = Window.partitionBy(*keys).orderBy(*by)
    for c in columns:
        rows = rows.withColumn(c, F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = cap_outliers(rows, keys, c, times)
    return rows


def variances(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return {c: row[c] or 0.0 for c in columns}


def varying(df: DataFrame, columns: list[str], least: float = 0.01) -> list[str]:
    return [c for c, v in variances(df, columns).items() if v > least]


def top_by_variance(df: DataFrame, columns: list[str], n: int) -> list[str]:
    found = variances(df, columns)
    return sorted(found, key=lambda c: (-found[c], c))[:n]


def select_features(df: DataFrame, columns: list[str], target: str, n: int, least: float = 0.01, most: float = 0.95) -> DataFrame:
    """feature, score: enough variance first, then no pair too alike, then the n best scores."""
    left = uncorrelated(df, varying(df, columns, least), most)
    return f_scores(df, left, target).orderBy(F.desc("score"), "feature").limit(n)


def quality_gate(df: DataFrame, keys: list[str], columns: list[str], least_rows: int, most_null: float) -> DataFrame:
    """Per key: rows, share of null cells, completeness, and whether it passes."""
    nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    table = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.sum(nulls) / (F.count(F.lit(1)) * len(columns))).alias("null_share"))
    return table.withColumn("completeness", 1 - F.col("null_share")).withColumn("passes", (F.col("n") >= least_rows) & (F.col("null_share") <= most_null))


def narrow_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole-number columns cast to the narrowest type that holds their range; doubles to float where the caller asks by listing them."""
    ranges = df.agg(*[F.min(c).alias(f"low_{c}") for c in columns], *[F.max(c).alias(f"high_{c}") for c in columns]).first()
    out = df
    for c in columns:
        if df.schema[c].dataType.typeName() in ("double", "float"):
            out = out.withColumn(c, F.col(c).cast("float"))
        elif ranges[f"low_{c}"] is not None:
            widest = max(-ranges[f"low_{c}"] - 1, ranges[f"high_{c}"])
            kind = "byte" if widest < 2**7 else "short" if widest < 2**15 else "int" if widest < 2**31 else "long"
            out = out.withColumn(c, F.col(c).cast(kind))
    return out

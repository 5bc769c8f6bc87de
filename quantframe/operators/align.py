"""Alignment of series of different frequencies: calendars, as-of joins, filling, profiles and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.windows import back_fill, backward, forward_fill, ordered
from quantframe.operators import bars, clean
from quantframe.sources.shared import materialise


def business_calendar(df: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Each key's weekdays from its first to its last day."""
    span = df.groupBy(*keys).agg(F.min(day).alias("low"), F.max(day).alias("high"))
    return span.select(*keys, F.explode(F.sequence("low", "high")).alias(day)).filter(F.weekday(day) < 5)


def last_per_timestamp(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """One row per key and timestamp: the one with the largest tie."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(*keys, ts).orderBy(F.desc(tie)))).filter("turn = 1").drop("turn")


def reindex(df: DataFrame, calendar: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    return calendar.join(df, [*keys, day], "left")


def on_business_days(df: DataFrame, keys: list[str], columns: list[str], day: str = "day", carry: bool = False) -> DataFrame:
    """df on each key's weekdays from its first to its last day, in one ordered pass without a join.

    Weekdays without a row get nulls or, with ``carry``, each column's last value before them, weekends included. Rows that
    share a day all stay; with ``carry`` one of them does. Rows with a null day are left out.
    """
    w = ordered(keys, day)
    following = F.lead(day).over(w)
    own = F.array() if carry else F.array(day)
    days = F.when(following > F.col(day), F.sequence(F.col(day), F.date_sub(following, 1))).when(following == F.col(day), own.cast("array<date>")).otherwise(F.array(day))
    held = [forward_fill(c, w).alias(c) if carry else F.col(c) for c in columns]
    spread = df.filter(F.col(day).isNotNull()).select(*keys, F.col(day).alias("row_day"), *held, days.alias("days"))
    spread = spread.select(*keys, F.explode("days").alias(day), "row_day", *columns).filter(F.weekday(day) < 5)
    return spread.select(*keys, day, *[F.col(c) if carry else F.when(F.col(day) == F.col("row_day"), F.col(c)).alias(c) for c in columns])


def as_of(grid: DataFrame, source: DataFrame, keys: list[str], ts: str, columns: list[str], prefix: str = "", limit: int | None = None) -> DataFrame:
    """For each grid row the source's latest values at or before it: one union and one ordered window, no range join."""
    a = grid.select(*keys, ts, *[F.lit(None).cast(source.schema[c].dataType).alias(c) for c in columns], F.lit(1).alias("grid"))
    b = source.select(*keys, ts, *columns, F.lit(0).alias("grid"))
    w = ordered(keys, ts, "grid")
    filled = a.unionByName(b).select(*keys, ts, "grid", *[forward_fill(c, w, limit).alias(prefix + c) for c in columns])
    return filled.filter("grid = 1").drop("grid")


def nearest(grid: DataFrame, source: DataFrame, keys: list[str], day: str, column: str) -> DataFrame:
    """The value of the nearest day; of two equally near ones, the later."""
    a = grid.select(*keys, day, F.lit(None).cast("date").alias("at"), F.lit(None).cast(source.schema[column].dataType).alias(column), F.lit(1).alias("grid"))
    b = source.select(*keys, day, F.col(day).alias("at"), column, F.lit(0).alias("grid"))
    w = Window.partitionBy(*keys)
    before, after = w.orderBy(day, "grid"), w.orderBy(F.desc(day), "grid")
    both = a.unionByName(b).withColumn("p", F.last(F.when(F.col("grid") == 0, F.struct("at", column)), ignorenulls=True).over(before)).withColumn("q", F.last(F.when(F.col("grid") == 0, F.struct("at", column)), ignorenulls=True).over(after))
    later = F.col("p").isNull() | (F.datediff(F.col("q.at"), day) <= F.datediff(day, F.col("p.at")))
    return both.filter("grid = 1").select(*keys, day, F.when(later & F.col("q").isNotNull(), F.col(f"q.{column}")).otherwise(F.col(f"p.{column}")).alias(column))


def merge(sources: dict[str, DataFrame], keys: list[str], ts: str, how: str = "full") -> DataFrame:
    """Columns of all sources side by side, prefixed by the source's name. Sources are series, so none is broadcast: filled calendars have many more rows than the planner expects of them."""
    named = [df.select(*keys, ts, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in (*keys, ts)]) for name, df in sources.items()]
    return reduce(lambda x, y: x.join(y.hint("merge"), [*keys, ts], how), named)


def pivot_series(df: DataFrame, ts: str, series: str, value: str, values: list[str]) -> DataFrame:
    return df.groupBy(ts).pivot(series, values).agg(F.first(value))


def fill(df: DataFrame, keys: list[str], by: list, column: str, how: str, limit: int | None = None) -> Column:
    w = ordered(keys, *by)
    if how == "ffill":
        return forward_fill(column, w, limit)
    if how == "bfill":
        return back_fill(column, keys, by, limit)
    if how == "mean":
        return F.coalesce(F.col(column), F.avg(column).over(Window.partitionBy(*keys)))
    return F.coalesce(F.col(column), F.lit(0.0))


def interpolate(df: DataFrame, keys: list[str], by: list, column: str, limit: int | None = None) -> DataFrame:
    """Linear by position; trailing nulls repeat the last value, leading ones stay; at most ``limit`` rows after a value."""
    w = ordered(keys, *by)
    known = F.when(F.col(column).isNotNull(), F.struct("position", F.col(column).alias("value")))
    placed = df.withColumn("position", F.row_number().over(w)).withColumn("known", known)
    placed = placed.withColumn("p", F.last("known", ignorenulls=True).over(w)).withColumn("q", F.last("known", ignorenulls=True).over(backward(keys, *by)))
    gap = F.col("position") - F.col("p.position")
    line = F.col("p.value") + (F.col("q.value") - F.col("p.value")) * gap / (F.col("q.position") - F.col("p.position"))
    value = F.when(F.col(column).isNotNull(), F.col(column)).when(F.col("q").isNull(), F.col("p.value")).otherwise(line)
    if limit is not None:
        value = F.when(F.col(column).isNotNull() | (gap <= limit), value)
    return placed.withColumn(column, value).drop("position", "known", "p", "q")


#: The longest usual gap in seconds of each frequency class, and the corrected names.
FREQUENCIES = [(60, "tick", "minute"), (3600, "minute", "hourly"), (86400, "hourly", "daily"), (604800, "daily", "weekly"), (2678400, "weekly", "monthly"), (8208000, "monthly", "quarterly"), (31968000, "quarterly", "annual")]


def profile(df: DataFrame, keys: list[str], ts: str, corrected: bool = False) -> DataFrame:
    """Start, end, rows, most frequent gap (the least of several), its frequency class, regularity, share in business hours and on weekends."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    gapped = df.select(*keys, ts, (seconds - F.lag(seconds).over(ordered(keys, ts))).alias("gap"))
    gaps = gapped.filter("gap IS NOT NULL").groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    mode = gaps.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("gap")).alias("minus"))).alias("top")).select(*keys, (-F.col("top.minus")).alias("mode_gap"))
    regular = gaps.join(mode, keys).groupBy(*keys, "mode_gap").agg((F.sum(F.when(F.abs(F.col("gap") - F.col("mode_gap")) <= F.col("mode_gap") * 0.1, F.col("n")).otherwise(0)) / F.sum("n")).alias("regularity"))
    whole = df.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"), F.avg(F.hour(ts).between(9, 16).cast("double")).alias("business_hours"), F.avg((F.weekday(ts) >= 5).cast("double")).alias("weekends"))
    name = F.lit("annual")
    for most, kept, right in reversed(FREQUENCIES):
        name = F.when(F.col("mode_gap") <= most, right if corrected else kept).otherwise(name)
    name = F.when(F.col("mode_gap").isNull(), "irregular").otherwise(name)
    return whole.join(regular, keys, "left").withColumn("frequency", name)


def common_range(sources: dict[str, DataFrame], ts: str, how: str = "inner") -> dict[str, DataFrame]:
    """All sources within one range: inner (the latest start to the earliest end), outer, or that of the first source. Collects two values a source."""
    spans = [df.agg(F.min(ts), F.max(ts)).first() for df in sources.values()]
    lows, highs = [s[0] for s in spans if s[0] is not None], [s[1] for s in spans if s[1] is not None]
    if not lows:
        return sources
    pick = {"inner": (max, min), "outer": (min, max)}.get(how, (lambda x: x[0], lambda x: x[0]))
    low, high = pick[0](lows), pick[1](highs)
    return {name: df.filter(F.col(ts).between(F.lit(low), F.lit(high))) for name, df in sources.items()}


def members(df: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose keys stand in the index."""
    return df.join(index.select(*on), on, "left_semi")


PRICES = ("price", "close", "open", "high", "low")


def column_rules(df: DataFrame, but: list[str]) -> dict[str, str]:
    """How each column goes to a lower frequency: prices and text by their last value, volumes by their sum, other numbers by their mean."""
    rules = {}
    for f in df.schema.fields:
        if f.name not in but:
            name, number = f.name.lower(), isinstance(f.dataType, T.NumericType)
            rules[f.name] = "last" if not number or any(p in name for p in PRICES) else "sum" if "volume" in name else "mean"
    return rules


def to_frequency(df: DataFrame, keys: list[str], freq: str, ts: str, tie: str | None = None) -> DataFrame:
    """df at a lower frequency, each column by its rule."""
    return bars.resample(df, keys, freq, column_rules(df, [*keys, ts, tie or ts]), ts, tie or ts)


def many_to_frequency(sources: dict[str, DataFrame], keys: list[str], freq: str, ts: str) -> DataFrame:
    """Last values of all sources at one frequency, side by side."""
    rules = {name: {c: "last" for c in df.columns if c not in (*keys, ts)} for name, df in sources.items()}
    return merge({name: bars.resample(df, keys, freq, rules[name], ts, ts) for name, df in sources.items()}, keys, "bar")


def align(df: DataFrame, keys: list[str], ts: str, tie: str, columns: list[str], limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """One row per key and business day, filled forward over at most ``limit`` rows; and per key its rows before and after, filled cells and coverage."""
    once = last_per_timestamp(df, keys, ts, tie)
    grid = reindex(once.select(*keys, ts, *columns), business_calendar(once, keys, ts), keys, ts)
    w = ordered(keys, ts)
    out = grid.select(*keys, ts, *[F.col(c).alias(f"raw_{c}") for c in columns], *[forward_fill(c, w, limit).alias(c) for c in columns])
    filled = sum(((F.col(c).isNotNull() & F.col(f"raw_{c}").isNull()).cast("long") for c in columns), F.lit(0))
    held = sum((F.col(c).isNotNull().cast("long") for c in columns), F.lit(0))
    after = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_after"), F.sum(filled).alias("cells_filled"), (F.sum(held) / (F.count(F.lit(1)) * len(columns))).alias("coverage"))
    report = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before")).join(after, keys)
    return out.select(*keys, ts, *columns), report


def combine(sources: dict[str, DataFrame], keys: list[str], ts: str, limit: int = 5, sparse: float = 0.5, cap: float = 2.0) -> DataFrame:
    """Sources within their common range, on business days, filled forward, side by side; columns with too many nulls go, outliers are capped, values scaled."""
    ranged = common_range(sources, ts)
    calendar = reduce(lambda x, y: x.union(y), [df.select(*keys, ts) for df in ranged.values()])
    grid = business_calendar(calendar, keys, ts)
    filled = {name: as_of(grid, df, keys, ts, [c for c in df.columns if c not in (*keys, ts)], limit=limit) for name, df in ranged.items()}
    wide = materialise(merge(filled, keys, ts, "inner"), "combined")  # read again for each column's statistics
    values = [c for c in wide.columns if c not in (*keys, ts)]
    wide = clean.drop_sparse_columns(wide, values, sparse)
    for c in [c for c in wide.columns if c not in (*keys, ts)]:
        wide = clean.scale(clean.cap_outliers(wide, keys, c, cap), keys, c).drop(c).withColumnRenamed("scaled", c)
    return wide

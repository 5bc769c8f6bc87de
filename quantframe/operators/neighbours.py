"""Imputation by nearest neighbours with exact bounds, per key.

The distance of two rows counts the columns that both have: the root of all columns' number over theirs, times the sum of squares.
A row's missing column becomes the mean of that column over the ``k`` nearest rows of its key that have it (ties: the smaller
order); with fewer of them, over all; with none that shares a column, the column's mean in the key; and it stays null where
no row of the key has it.

A key of few rows is worked out where its rows meet, by one exchange of the table. Keys of more rows go through indexes instead:
no pair of rows is looked at without need. Rows are put into indexes, each a set of columns that are null and the pivot, the first
column that isn't; a query looks into those whose pivots are its own first, second.. column, so that every row that shares
a column with it is in one of them exactly once. Within an index, rows are sorted by pivot and cut into blocks. A query's block is compared
with its own neighbourhood first, and then, while any of its queries may still find a nearer row, with blocks twice as far out,
round by round: the difference in the pivot bounds all distances beyond. Blocks meet by block number, so a round is an
equi-join, and a hot key is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.joins import beside
from quantframe.operators.long_series import BLOCK, in_blocks
from quantframe.sources.shared import materialise
from quantframe.sources.tables import TASK_ROWS

BEST = "array<struct<d:double,o:long,v:double>>"


def number_along(df: DataFrame, keys: list[str], by: list[str], block_rows: int) -> DataFrame:
    """df with _at, the row's number within its key from 0, by two levels: within blocks, and from the blocks' counts."""
    cut = in_blocks(df, keys, by, block_rows)
    sizes = cut.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*keys, BLOCK, (F.sum("_n").over(Window.partitionBy(*keys).orderBy(BLOCK)) - F.col("_n")).alias("_before"))
    within = cut.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*by)) - 1)
    return beside(within, before, [*keys, BLOCK]).withColumn("_at", F.col("_before") + F.col("_in")).drop("_in", "_before", BLOCK)


#: Records that a task writes at once.
WRITTEN = 20_000


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins and ends, and all values; nulls among doubles are NaN. No Python object per value."""
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def nearest(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least finite distances of each row, rows in order and each by rising distance, ties by column."""
    most = np.partition(dist, k - 1, axis=1)[:, k - 1] if dist.shape[1] > k else np.full(len(dist), np.inf)
    row, at = np.nonzero((dist <= most[:, None]) & np.isfinite(dist))
    rising = np.lexsort((dist[row, at], row))
    row, at = row[rising], at[rising]
    first = np.searchsorted(row, np.arange(len(dist)))
    kept = np.arange(len(row)) - first[row] < k
    return row[kept], at[kept]


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row of q to each of x; endless where they share no column."""
    both = (~np.isnan(q)).astype(float) @ (~np.isnan(x)).astype(float).T
    squares = np.zeros((len(q), len(x)))
    for c in range(q.shape[1]):  # a column at a time bounds the memory
        d = q[:, c][:, None] - x[None, :, c]
        squares += np.where(np.isnan(d), 0.0, d * d)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both > 0, np.sqrt(squares * q.shape[1] / both), np.inf)


def fill(x: np.ndarray, k: int, block: int) -> np.ndarray:
    """The rows of one key, by rising order, with their gaps filled; ``block`` rows with gaps are compared with all at a time."""
    out, gaps = x.copy(), np.isnan(x)
    for c in range(x.shape[1]):
        if not gaps[:, c].all():
            out[gaps[:, c], c] = x[~gaps[:, c], c].mean()
    asking = np.flatnonzero(gaps.any(axis=1) & ~gaps.all(axis=1))
    for at in range(0, len(asking), block):
        of = asking[at : at + block]
        dist = distances(x[of], x)
        dist[np.arange(len(of)), of] = np.inf
        for c in range(x.shape[1]):
            asks, there = np.flatnonzero(gaps[of, c]), np.flatnonzero(~gaps[:, c])
            if len(asks) and len(there):
                row, near = nearest(dist[np.ix_(asks, there)], k)
                n = np.bincount(row, minlength=len(asks))
                total = np.bincount(row, x[there[near], c], minlength=len(asks))
                out[of[asks[n > 0]], c] = total[n > 0] / n[n > 0]
    return out


def fill_keys(columns: list[str], k: int, block: int):
    """The function for mapInArrow over rows by key and order, with _n, their key's rows, and _at, their number in it from 1: the rows with their gaps filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.concat_batches([held, batch])
            n, at = (batch.column(c).to_numpy() for c in ("_n", "_at"))
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(float)
            first = np.flatnonzero(at == 1)
            first = first[first + n[first] <= len(n)]  # the rest of the last key is in the next batch
            for a, b in zip(first, first + n[first]):
                if np.isnan(x[a:b]).any():
                    x[a:b] = fill(x[a:b], k, block)
            end = int(first[-1] + n[first[-1]]) if len(first) else 0
            held, names = batch.slice(end), [c for c in batch.schema.names if c not in ("_n", "_at")]
            yield pa.RecordBatch.from_arrays([pa.array(x[:end, columns.index(c)], from_pandas=True) if c in columns else batch.column(c).slice(0, end) for c in names], names=names)

    return run


def compare(columns: int, k: int):
    """The function for mapInArrow over pairs of blocks (orders and values of queries, and of rows): best k (distance, order, value) of each query and missing column in this pair, and how many distances were worked out."""

    def pair(q: np.ndarray, of: np.ndarray, x: np.ndarray, order: np.ndarray) -> Iterator[tuple]:
        by_order = np.argsort(order, kind="stable")
        x, order = x[by_order], order[by_order]
        dist = distances(q, x)
        dist[of[:, None] == order[None, :]] = np.inf
        for c in range(columns):
            asks, there = np.flatnonzero(np.isnan(q[:, c])), np.flatnonzero(~np.isnan(x[:, c]))
            if len(asks):
                near = dist[np.ix_(asks, there)]
                row, at = nearest(near, k)
                yield of[asks], np.full(len(asks), c, np.int32), np.full(len(asks), len(x)), np.bincount(row, minlength=len(asks)), near[row, at], order[there[at]], x[there[at], c]

    def written(parts: list[tuple]) -> pa.RecordBatch:
        o, c, pairs, n, d, near, v = (np.concatenate(p) for p in zip(*parts))
        best = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.StructArray.from_arrays([pa.array(d), pa.array(near), pa.array(v)], names=["d", "o", "v"]))
        return pa.RecordBatch.from_arrays([pa.array(o), pa.array(c), pa.array(pairs), best], names=["o", "c", "pairs", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            (qa, of), (_, q), (xa, order), (_, x) = (lists(batch.column(n)) for n in ("asked_o", "asked_x", "row_o", "row_x"))
            for a, b, e, f in zip(qa[:-1], qa[1:], xa[:-1], xa[1:]):
                found = list(pair(q[a * columns : b * columns].reshape(-1, columns), of[a:b], x[e * columns : f * columns].reshape(-1, columns), order[e:f]))
                parts += found
                held += sum(len(p[0]) for p in found)
                if held >= WRITTEN:
                    yield written(parts)
                    parts, held = [], 0
            if parts:  # copies of slices: nothing points into a batch that is gone
                yield written(parts)
                parts, held = [], 0

    return run


def flat(rows: Column, name: str) -> list[Column]:
    """Orders, and values one row after the other, of an array of (o, x): two plain arrays."""
    return [rows["o"].alias(f"{name}_o"), F.flatten(rows["x"]).alias(f"{name}_x")]


#: Keys of at most this many blocks of rows are worked out where their rows meet.
FEW = 8


def impute(df: DataFrame, keys: list[str], order: str, columns: list[str], k: int = 5, block: int = 256, block_rows: int = 200_000) -> DataFrame:
    """df with the columns imputed; ``order`` is an integer, unique within the table. NaN counts as null."""
    rows = materialise(df.withColumns({c: known(c) for c in columns}), "knn-table")
    many = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW * block).select(*keys), "knn-keys")
    hot = many.limit(1).count() > 0
    few = beside(rows, many, keys, "left_anti") if hot else rows
    w = Window.partitionBy(*keys)
    met = few.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)), *keys)
    filled = met.withColumn("_at", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(w)).mapInArrow(fill_keys(columns, k, block), rows.schema)
    return filled.unionByName(impute_many(beside(rows, many, keys, "left_semi"), keys, order, columns, k, block, block_rows)) if hot else filled


def known(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def impute_many(df: DataFrame, keys: list[str], order: str, columns: list[str], k: int, block: int, block_rows: int) -> DataFrame:
    """The same by indexes and rounds, for keys of many rows."""
    width = len(columns)
    x = F.array(*[known(c) for c in columns])
    rows = materialise(df.select(*keys, F.col(order).cast("long").alias("o"), x.alias("x")), "knn-rows")
    null_at = lambda i: F.col("x")[i].isNull()
    # bit i: column i is there
    mask = sum((F.when(null_at(i), 0).otherwise(1 << i) for i in range(width)), F.lit(0)).cast("long")
    rows = rows.withColumn("mask", mask)
    full = (1 << width) - 1
    patterns = [r["mask"] for r in rows.filter(F.col("mask").between(1, full - 1)).select("mask").distinct().collect()]  # of columns, not of rows
    wanted = set()
    for p in patterns:
        empty = 0
        for i in range(width):
            if p >> i & 1:
                wanted.add((empty, i))
                empty |= 1 << i
    # index (empty, i): rows that lack the columns of ``empty`` and have column i. A query has all of both.
    indexes = F.array(*[F.when((F.col("mask").bitwiseAND(e) == 0) & (F.col("mask").bitwiseAND(1 << i) != 0), F.struct(F.lit(e).alias("e"), F.lit(i).alias("i"), F.col("x")[i].alias("pivot"))) for e, i in sorted(wanted)]) if wanted else F.array()
    out = [c for c in df.columns if c not in columns]
    if not wanted:
        return finished(df, keys, order, columns, rows, None)
    placed = rows.select(*keys, "o", "x", "mask", F.explode(F.array_compact(indexes)).alias("ix")).select(*keys, "o", "x", "mask", "ix.e", "ix.i", "ix.pivot")
    numbered = number_along(placed, [*keys, "e", "i"], ["pivot", "o"], block_rows)
    blocks = numbered.withColumn("b", F.floor(F.col("_at") / block))
    at = [*keys, "e", "i", "b"]
    donors = blocks.groupBy(*at).agg(F.collect_list(F.struct("o", "x")).alias("rows"), F.min("pivot").alias("low"), F.max("pivot").alias("high"))
    donors = materialise(donors.select(*at, *flat(F.col("rows"), "row"), "low", "high"), "knn-blocks")
    ends = materialise(donors.groupBy(*at[:-1]).agg(F.max("b").alias("last")), "knn-ends")
    # where a query stands in each of its indexes: as if it were a row there; its pivot finds the block
    asks = rows.filter(F.col("mask").between(1, full - 1))
    own = F.array(*[F.when((F.col("mask").bitwiseAND(1 << i) != 0) & (F.lit(e) == F.col("mask").bitwiseAND((1 << i) - 1)), F.struct(F.lit(e).alias("e"), F.lit(i).alias("i"), F.col("x")[i].alias("pivot"))) for e, i in sorted(wanted)])
    asks = asks.select(*keys, "o", "x", F.explode(F.array_compact(own)).alias("ix")).select(*keys, "o", "x", "ix.e", "ix.i", "ix.pivot")
    marks = donors.select(*at[:-1], F.col("low").alias("pivot"), F.lit(-1).cast("long").alias("o"), F.col("b").alias("mark"))
    both = marks.unionByName(asks, allowMissingColumns=True)
    w = Window.partitionBy(*at[:-1]).orderBy("pivot", "o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("b", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(0))).filter("mark IS NULL")
    # queries of an index without rows look nowhere
    queries = materialise(beside(found.drop("mark"), ends, at[:-1]), "knn-queries")
    missing = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.element_at("x", c + 1).isNull())
    best = materialise(asks.select("o", F.explode(missing).alias("c")).distinct().select("o", "c", F.array().cast(BEST).alias("best"), F.lit(0).cast("long").alias("pairs")), "knn-best")
    inner, outer = 0, 1
    while True:
        shifts = [s for s in range(-outer, outer + 1) if abs(s) > inner or inner == 0]
        spread = queries.select(*at, "o", "x", "last", F.explode(F.array(*[F.lit(s) for s in shifts])).alias("s")).withColumn("t", F.col("b") + F.col("s")).filter("t BETWEEN 0 AND last")
        grouped = spread.groupBy(*at, "t").agg(F.collect_list(F.struct("o", "x")).alias("asked")).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("asked") - 1) / block).cast("int"))))
        grouped = grouped.select(*at[:-1], F.col("t").alias("b"), *flat(F.slice("asked", F.col("part") * block + 1, block), "asked"))
        pairs = beside(grouped, donors.select(*at, "row_o", "row_x"), at).select("asked_o", "asked_x", "row_o", "row_x")
        more = pairs.mapInArrow(compare(width, k), f"o long, c int, pairs long, best {BEST}")
        together = best.select("o", "c", "pairs", "best").unionAll(more.select("o", "c", "pairs", "best"))
        kept = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k)
        best = materialise(together.groupBy("o", "c").agg(kept.alias("best"), F.sum("pairs").alias("pairs")), "knn-best")
        # the pivot's distance to the nearest block not looked at bounds all rows there
        reach = best.withColumn("d", F.when(F.size("best") >= k, F.element_at("best", -1)["d"]).otherwise(F.lit(float("inf")))).groupBy("o").agg(F.max("d").alias("d"))
        left, right = (donors.select(*at[:-1], (F.col("b") + s).alias("b"), F.col(c).alias(n)) for s, c, n in ((outer + 1, "high", "below"), (-outer - 1, "low", "above")))
        open_ = beside(beside(queries.join(reach, "o"), left, at, "left"), right, at, "left")
        scale = F.sqrt(F.lit(float(width)) / F.size(F.filter("x", lambda v: v.isNotNull())))
        near = lambda c: F.col(c).isNotNull() & (F.abs(F.col("pivot") - F.col(c)) * scale * (1 - 1e-12) <= F.col("d"))
        queries = materialise(open_.filter(near("below") | near("above")).select(*at, "o", "x", "pivot", "last"), "knn-queries")
        if not queries.limit(1).count():
            return finished(df, keys, order, columns, rows, best).select(*df.columns)
        inner, outer = outer, outer * 2


def finished(df: DataFrame, keys: list[str], order: str, columns: list[str], rows: DataFrame, best: DataFrame | None) -> DataFrame:
    means = rows.groupBy(*keys).agg(*[F.avg(F.col("x")[i]).alias(f"_m{i}") for i in range(len(columns))])
    out = beside(df, means, keys, "left")
    if best is not None:
        found = best.filter(F.size("best") > 0).select("o", "c", (F.aggregate("best", F.lit(0.0), lambda a, b: a + b["v"]) / F.size("best")).alias("v"))
        wide = found.groupBy("o").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"_v{i}") for i in range(len(columns))]).withColumnRenamed("o", "_o")
        out = out.join(wide, F.col(order) == F.col("_o"), "left")
    def filled(i: int, c: str) -> Column:
        return F.coalesce(known(c), *([F.col(f"_v{i}")] if best is not None else []), F.col(f"_m{i}")).alias(c)

    return out.select(*[filled(columns.index(c), c) if c in columns else F.col(c) for c in df.columns])

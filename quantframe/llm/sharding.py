"""Uniform shuffle into exact shards by a hypergeometric communication matrix.

A uniform random permutation of all rows sends a random number of rows from each input partition to each output cell;
those numbers follow the multivariate hypergeometric law with the partition sizes and cell sizes as margins. So:

1. count the rows of each input partition;
2. draw the matrix of partition-to-cell counts: a binary tree over the partitions splits the cell sizes, and each task
   walks from the root to its own leaf, so that no one holds the whole matrix;
3. permute locally: each task deals its rows to cells in random order, in exactly the drawn numbers;
4. exchange by cell, and permute again inside each cell.

A cell is a run of at most about ``cell_rows`` slots of one shard, so that no task ever holds a whole shard. Shard sizes
differ by one at most, slots have no gaps, and every ordering is equally likely. The draws depend on the seed alone, and
a task that is run again (a lost executor) draws the same numbers.

The task-local steps need partitions that come back with the same rows in the same order. A plain scan of files does
that; pass ``stable=True`` for one. Any other input is first written to the shared folder.

Defined cases: null text has size 16 and the CRC of no bytes; rows that repeat and null ids are rows like any other; an
empty table gives an empty result; other columns pass through, and a column named like a result is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.common import materialise, utf8

RESULTS = ("shard", "slot")
#: numpy draws hypergeometric numbers exactly below this population.
NUMPY_MOST = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good items among ``drawn`` from good + bad; by inversion around the mode where numpy's own sampler ends."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = int(14 * math.sqrt(drawn * share * (1 - share) * (total - drawn) / max(1, total - 1))) + 14
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) / (k[:-1] + 1)) + np.log((drawn - k[:-1]) / (bad - drawn + k[:-1] + 1))
    weight = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, len(k) - 1)])


def split_sizes(rng: np.random.Generator, sizes: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` rows fall in each cell, where the cells have room for ``sizes`` rows."""
    if sizes.sum() < NUMPY_MOST:
        return rng.multivariate_hypergeometric(sizes, drawn, method="marginals")
    if len(sizes) == 1:
        return np.array([drawn])
    half = len(sizes) // 2
    left = hypergeometric(rng, int(sizes[:half].sum()), int(sizes[half:].sum()), drawn)
    return np.concatenate([split_sizes(rng, sizes[:half], left), split_sizes(rng, sizes[half:], drawn - left)])


def matrix_row(seed: int, counts: np.ndarray, sizes: np.ndarray, partition: int) -> np.ndarray:
    """Row ``partition`` of the communication matrix with row sums ``counts`` and column sums ``sizes``."""
    low, high, left = 0, len(counts), np.asarray(sizes, dtype=np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])  # the same draw in every task below this node
        first = split_sizes(rng, left, int(counts[low:mid].sum()))
        low, high, left = (low, mid, first) if partition < mid else (mid, high, left - first)
    return left


def cell_sizes(rows: int, shards: int, cells_per_shard: int) -> np.ndarray:
    """Rows of each cell: shards differ by one row at most, and so do the cells of a shard."""
    shard = np.arange(shards, dtype=np.int64)
    per_shard = rows // shards + (shard < rows % shards)
    edge = np.arange(cells_per_shard + 1, dtype=np.int64)
    return np.diff(per_shard[:, None] * edge // cells_per_shard, axis=1).ravel()


def dealt(seed: int, counts: list[int], sizes: np.ndarray):
    """Local permutation: the function for mapInArrow that adds ``cell`` and a random ``order`` to each row."""
    counts = np.asarray(counts, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = TaskContext.get().partitionId()
        row = matrix_row(seed, counts, sizes, mine)
        rng = np.random.default_rng([seed, mine, 1 << 20])
        cells = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int64), row))
        at = 0
        for batch in batches:
            take = cells[at : at + batch.num_rows]
            if len(take) != batch.num_rows:
                raise RuntimeError(f"partition {mine} has over {len(cells)} rows, other than when counted: its input isn't stable")
            at += batch.num_rows
            order = rng.integers(0, 2**63 - 1, len(take), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(take), pa.array(order)], names=[*batch.schema.names, "cell", "order"])
        if at != len(cells):
            raise RuntimeError(f"partition {mine} has {at} rows and had {len(cells)} when counted: its input isn't stable")

    return deal


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 7, cell_rows: int = 20_000, stable: bool = False) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (0 to the shard's rows - 1), in uniformly random order."""
    carried = [c for c in df.columns if c.lower() not in RESULTS]
    df = df.select(*carried)
    if not stable:
        df = materialise(df, "shard-input")
    # one row for each partition: the sizes of the table's files in rows, not its data
    seen = {r["p"]: r["n"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [seen.get(p, 0) for p in range(max(seen, default=-1) + 1)]
    total = sum(counts)
    cells = max(1, -(-total // (shards * cell_rows)))
    rows = df.select(F.struct(*carried).alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType()), T.StructField("order", T.LongType())])
    sent = rows.mapInArrow(dealt(seed, counts, cell_sizes(total, shards, cells)), schema) if total else rows.limit(0).selectExpr("row", "0L AS cell", "0L AS order")
    shard = F.expr(f"cell div {cells}")
    start = F.expr(f"(({total // shards} + if(cell div {cells} < {total % shards}, 1, 0)) * (cell % {cells})) div {cells}")
    # the exchange by cell, and the second permutation inside it
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("order"))
    return sent.withColumn("rank", rank).select("row.*", shard.cast("int").alias("shard"), (start + F.col("rank") - 1).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = shuffle_into_shards(docs, 40, stable=True)
    return placed.select("doc_id", (F.length(utf8(F.col("text"))) + F.lit(16)).cast("long").alias("size"), F.crc32(utf8(F.col("text"))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

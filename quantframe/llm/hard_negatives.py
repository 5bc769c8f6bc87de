"""Hard-negative mining with exact integer scores, by Kronecker-packed products.

Vectors become integers, floor(scale * x) per component, and a pair's score is the integer inner product (a shorter vector
is padded with zeros). An anchor's positives are its best other rows of the same label; for each positive, its hard
negatives are the best rows of another label whose score is between ``lowest`` and ``highest`` per cent of the positive's.
Higher scores come first, then smaller ids, then null ids.

The products are packed. In a block of candidates each component is biased to be non-negative, and so are the anchors'. A
bound of their products (Cauchy-Schwarz, or component by component) says how many bits a biased score takes, so that many
bits make a field, and the components of as many candidates as fit are put into the fields of one wide integer. One
multiplication of the anchor's component by that integer multiplies them all; as no field ever overflows or borrows, the
sum over components holds every candidate's biased score in its field, and taking the biases off again gives exact scores.
The wide integers are those below 2^53, which doubles hold exactly, so the multiplication runs as a matrix product; where
not even one field fits, Python's unbounded integers take their place.

Anchors pass in blocks of ``block_anchors``, which bounds what is broadcast, against all rows: a first pass finds positives,
a second one negatives below them. A task streams its rows once for each pass, and sends on no more than an anchor's best
few; no row is shuffled, and neither labels nor equal vectors are ever gathered in one place.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; rows that repeat are
rows of their own, each anchor and candidate; a row with a null id may be a partner; empty vectors score 0; components
beyond 64 bits are held at their limits, and so are scores in the result; an empty table, or one without anchors, gives an
empty result; extra columns are left out. Ids and labels are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantframe.llm.common import materialise, place_ranges, shared_path

#: Bits of the integers that a double holds exactly, and fields of a wider integer.
EXACT_BITS, WIDE_FIELDS = 53, 16
#: Rows of a block, at most, and components of one.
BLOCK_ROWS, BLOCK_COMPONENTS, SLICE = 4096, 1 << 20, 512
NO_ID = 2**63 - 1
LEAST = -(2**63)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Anchors:
    """A block of anchors: biased components, and what taking the bias off needs."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.low = vectors.min(axis=0) if len(vectors) else vectors.sum(axis=0)
        self.biased = vectors - self.low
        self.most = int(abs(vectors).max(initial=0))


def widened(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))) if vectors.shape[1] < width else vectors


def packed_scores(anchors: Anchors, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of the anchors, and the exact scores of each with all rows (int64, or Python integers where they may be wider)."""
    width = max(anchors.vectors.shape[1], rows.shape[1])
    rows, vectors, biased, low = widened(rows, width), widened(anchors.vectors, width), widened(anchors.biased, width), widened(anchors.low[None], width)[0]
    if (anchors.most + 1) * (int(abs(rows).max(initial=0)) + 1) * width * 4 >= 2**62:
        rows, vectors, biased, low = (x.astype(object) for x in (rows, vectors, biased, low))
    row_low = rows.min(axis=0)
    fields = rows - row_low
    by_component = int((biased.max(axis=0) * fields.max(axis=0)).sum())
    by_length = [float((x.astype(float) ** 2).sum(axis=1).max()) for x in (biased, fields)]
    bits = max(1, min(by_component, int((by_length[0] * by_length[1]) ** 0.5 * (1 + 1e-9)) + 1).bit_length())
    exact = bits <= EXACT_BITS and rows.dtype != object
    per_word = EXACT_BITS // bits if exact else WIDE_FIELDS
    groups = -(-len(rows) // per_word)
    words = np.zeros((width, groups), np.int64 if exact else object)
    for p in range(per_word):  # field p of the words holds rows p * groups and on
        part = fields[p * groups : (p + 1) * groups]
        words[:, : len(part)] += (part.T if exact else part.T.astype(object)) << (bits * p)
    carrier = words.astype(float) if exact else words
    off_rows, mask = fields @ low, (1 << bits) - 1
    for first in range(0, len(vectors), SLICE):
        some = slice(first, min(first + SLICE, len(vectors)))
        product = biased[some].astype(float) @ carrier if exact else biased[some].astype(object) @ carrier
        product = product.astype(np.int64) if exact else product
        scores = np.concatenate([(product >> (bits * p)) & mask for p in range(per_word)], axis=1)[:, : len(rows)]
        yield some, scores.astype(rows.dtype) + (vectors[some] @ row_low)[:, None] + off_rows[None, :]


def least_of(scores: np.ndarray):
    return -(1 << 400) if scores.dtype == object else LEAST


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of each line's k best allowed entries, ties by place; -1 where there are fewer."""
    least, lines = least_of(scores), np.arange(len(scores))
    open_ = np.where(allowed, scores, least)
    places, found = np.full((len(scores), k), -1, np.int64), np.full((len(scores), k), 0, object)
    for j in range(k):
        at = open_.argmax(axis=1)
        value = open_[lines, at]
        there = value != least
        if not there.any():
            break
        places[:, j] = np.where(there, at, -1)
        found[:, j] = value
        open_[lines, at] = least
    return places, found


class Best:
    """The k best (score, id) of each line over all blocks so far."""

    def __init__(self, lines: int, k: int):
        self.k, self.held = k, [[] for _ in range(lines)]

    def put(self, first: int, places: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        for i in np.flatnonzero(places[:, 0] >= 0).tolist():
            held = self.held[first + i]
            if len(held) == self.k and (int(found[i, 0]), -int(ids[places[i, 0]])) <= (held[-1][0], -held[-1][1]):
                continue
            held += [(int(s), int(ids[p])) for p, s in zip(places[i], found[i]) if p >= 0]
            held.sort(key=lambda x: (-x[0], x[1]))
            del held[self.k :]


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of integers as lines of one matrix, padded with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids (null: NO_ID), labels and vectors of bounded blocks in the order of ids."""
    for batch in batches:
        longest = max(np.diff(batch.column("vector").offsets.to_numpy()).max(initial=1), 1)
        step = int(max(1, min(BLOCK_ROWS, BLOCK_COMPONENTS // longest)))
        for first in range(0, batch.num_rows, step):
            some = batch.slice(first, step)
            ids = some.column("id").fill_null(NO_ID).to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], some.column("label").to_numpy()[order], matrix(some.column("vector"))[order]


def held_long(x: int) -> int:
    return max(LEAST, min(2**63 - 1, x))


def find_positives(anchors, k: int):
    """The function for mapInArrow: id, label, vector -> anchor (its place), score (text, as it may be wider than a long), id: this task's k + 1 best of the same label."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Anchors = anchors.value
        top = Best(len(own.ids), k + 1)
        for ids, labels, rows in blocks(batches):
            for some, scores in packed_scores(own, rows):
                top.put(some.start, *best(scores, own.labels[some, None] == labels[None, :], k + 1), ids)
        rows = [(a, s, i) for a, held in enumerate(top.held) for s, i in held]
        yield pa.RecordBatch.from_pydict({"anchor": pa.array([r[0] for r in rows], pa.int32()), "score": pa.array([str(r[1]) for r in rows], pa.string()), "id": pa.array([r[2] for r in rows], pa.int64())})

    return find


def find_negatives(anchors, positives, k: int, lowest: int, highest: int):
    """The function for mapInArrow: id, label, vector -> anchor, turn (the positive's), score (text), id: this task's k best below each positive."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Anchors = anchors.value
        turns = max((len(p) for p in positives.value), default=0)
        tops = [Best(len(own.ids), k) for _ in range(turns)]
        for ids, labels, rows in blocks(batches):
            for some, scores in packed_scores(own, rows):
                other = own.labels[some, None] != labels[None, :]
                for turn in range(turns):
                    at = [p[turn][0] if turn < len(p) else None for p in positives.value[some]]
                    # scores s with lowest * p <= 100 * s <= highest * p; no s where there is no such positive
                    under = [least_of(scores) if p is None else highest * p // 100 for p in at]
                    over = [0 if p is None else -(-lowest * p // 100) for p in at]
                    under, over = (np.array(x, dtype=scores.dtype)[:, None] for x in (under, over))
                    tops[turn].put(some.start, *best(scores, other & (scores <= under) & (scores >= over), k), ids)
        rows = [(a, t, s, i) for t, top in enumerate(tops) for a, held in enumerate(top.held) for s, i in held]
        yield pa.RecordBatch.from_pydict({"anchor": pa.array([r[0] for r in rows], pa.int32()), "turn": pa.array([r[1] for r in rows], pa.int32()), "score": pa.array([str(r[2]) for r in rows], pa.string()), "id": pa.array([r[3] for r in rows], pa.int64())})

    return find


def foremost(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key over all tasks, with their rank: decimals hold any score of 38 digits, and order those beyond by sign and length first."""
    digits = F.length(F.ltrim(F.col("score"), F.lit("-")))
    size = F.when(F.col("score").startswith("-"), -digits).otherwise(digits)
    text = F.when(F.col("score").startswith("-"), F.translate("score", "0123456789", "9876543210")).otherwise(F.col("score"))
    order = Window.partitionBy(*keys).orderBy(size.desc(), text.desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95, scale: float = 256.0, block_anchors: int = 16384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row where ``anchor`` holds; see the module."""
    spark = vectors.sparkSession
    sound = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    rows = vectors.filter(sound).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = materialise(rows, "hard-vectors")
    anchors = materialise(rows.filter("anchor AND id IS NOT NULL").select("id", "label", "vector", F.monotonically_increasing_id().alias("place")), "hard-anchors")
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    most = max(1, min(block_anchors, (BLOCK_COMPONENTS << 3) // longest))
    path, parts = shared_path(spark, "hard-negatives"), 0
    rows = rows.drop("anchor")
    for low, high in place_ranges(anchors, most):
        told = anchors.filter(F.col("place").between(low, high)).select("id", "label", "vector").toArrow()  # ``most`` rows
        block = Anchors(told.column("id").to_numpy(), told.column("label").to_numpy(), matrix(told.column("vector")))
        own = spark.sparkContext.broadcast(block)
        found = foremost(rows.mapInArrow(find_positives(own, positives), "anchor int, score string, id long"), ["anchor"], positives + 1)
        chosen: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        for r in sorted(found.collect(), key=lambda r: (r["anchor"], r["rank"])):  # positives + 1 for each anchor of the block
            chosen[r["anchor"]].append((int(r["score"]), r["id"]))
        for a, held in enumerate(chosen):  # the anchor itself is among the rows of its label
            itself = (sum(x * x for x in block.vectors[a].tolist()), int(block.ids[a]))
            if itself in held:
                held.remove(itself)
            del held[positives:]
        sent = spark.sparkContext.broadcast(chosen)
        found = foremost(rows.mapInArrow(find_negatives(own, sent, negatives, lowest, highest), "anchor int, turn int, score string, id long"), ["anchor", "turn"], negatives)
        named(found, own, sent).write.parquet(f"{path}/part={parts}")
        parts += 1
    if not parts:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*[f"{path}/part={k}" for k in range(parts)])


def named(found: DataFrame, anchors, positives) -> DataFrame:
    """Places of anchors and positives replaced by their ids and scores."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, turn = batch.column("anchor").to_pylist(), batch.column("turn").to_pylist()
            chosen = [positives.value[a][t] for a, t in zip(of, turn)]
            known = lambda ids: pa.array([None if i == NO_ID else i for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.value.ids[of], pa.int64()), known([i for _, i in chosen]), batch.column("rank"), known(batch.column("id").to_pylist()), pa.array([held_long(s) for s, _ in chosen], pa.int64()), pa.array([held_long(int(s)) for s in batch.column("score").to_pylist()], pa.int64())],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return found.mapInArrow(name, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS a, a.vec_id AS anchor_id, b.row AS b, b.vec_id AS id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM e AS a JOIN e AS b ON a.row <> b.row WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON p.a = n.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3
"""

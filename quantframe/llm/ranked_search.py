"""Ranked lexical search over all documents, by norm buckets with exact integer scores.

An item's score for a document is a sum of products, query part times document part, over the item's terms. Terms are runs
of letters and digits (any character beyond ASCII counts as one), A-Z lower-cased; a term's weight w falls with the number
of documents that hold it, and its impact d in a document grows with its occurrences there and falls with the document's
length. With the root of w on either side, both parts are vectors: x = sqrt(w) * d for documents, y = count * sqrt(w) for
items, and the score is x * y.

1. One pass counts the items' terms in each whole text. Document frequencies are an aggregate over its table.
2. Documents become vectors, which are dealt by range of length, longest first, with equal lengths spread by a hash, and
   sorted by length: each file of the written table is a range of lengths, each block of rows within it a bucket.
3. The longest vectors are searched first and give each item a first threshold, its k-th best score so far. No vector
   shorter than threshold / |y| of all items can matter: that filter reaches the scan, which skips whole row groups.
4. In every other bucket, an item whose |y| times the longest length there is below its threshold skips the bucket
   (Cauchy-Schwarz). Else its focus coordinates, the largest of y, are multiplied through the bucket's postings, and a
   document stays a candidate if that product plus a bound of the other coordinates' reaches the threshold: the rest of |y|
   times what the focus coordinates leave of |x|, or the sum of y times the bucket's largest x over them, if that is smaller. Candidates are scored anew in 64-bit integers. Thresholds rise as a task goes on.
5. Each task hands on at most k documents an item; their best are the result. Bounds are floating-point with a margin, and
   only ever let a document through; ties at the threshold are kept, so results are exact.

Items pass in blocks of ``block_items`` (fewer if they are very long), which bounds what is broadcast.

Defined cases: a null text has no terms; documents without terms count nowhere; a null document id sorts after all others;
rows that repeat are documents, and items, of their own; items without terms, or whose terms no document has, give no rows;
empty tables give an empty result; extra columns are left out. Document ids are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.common import materialise, place_ranges, shared_path, sliced, utf8

#: For each byte of UTF-8: itself, lower-cased, if it may stand in a term, else a space.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
NO_ID = 2**63 - 1
#: Postings and rows of a bucket, at most.
BUCKET_POSTINGS, BUCKET_ROWS = 1 << 20, 8192
#: The focus coordinates hold this share of the squared length of y.
FOCUS = 0.9
MARGIN = 1 + 1e-9
#: The share of the vectors, by length, that gives the first thresholds.
FIRST = 1 / 64


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function for mapInArrow: (item, text) -> item, terms, counts."""
    for batch in batches:
        found = [Counter(terms_of(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["item", "terms", "counts"])


def lists(values: np.ndarray, lengths: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)), pa.array(values))


def counted(vocabulary):
    """The function for mapInArrow: (id, text) -> id, n, terms, tf of the documents with any term; terms are numbers in the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            for some in sliced(batch, "text"):
                rows, total, at, tf, sizes = [], [], [], [], []
                for i, text in enumerate(some.column("text")):
                    words = terms_of(text.as_py())
                    if words:
                        found = Counter(filter(number.__contains__, words))
                        rows.append(i)
                        total.append(len(words))
                        at += map(number.__getitem__, found)
                        tf += found.values()
                        sizes.append(len(found))
                yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(rows, pa.int64())), pa.array(total, pa.int64()), lists(np.array(at, np.int32), sizes), lists(np.array(tf, np.int32), sizes)], names=["id", "n", "terms", "tf"])

    return count


def weigh(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(weights, n_docs: int, n_terms: int):
    """The function for mapInArrow: id, n, terms, tf -> id, length, terms, impacts of the documents with a term that weighs anything."""

    def impact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            of, tf = batch.column("terms").flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(np.int64)
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            d = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            some = (w[of] > 0) & (d > 0)
            of, d, row = of[some], d[some], row[some]
            sizes = np.bincount(row, minlength=len(sizes))
            length = np.sqrt(np.bincount(row, weights=w[of] * d.astype(float) ** 2, minlength=len(sizes)))
            there = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(there)), pa.array(length[there]), lists(of, sizes[there]), lists(d, sizes[there])], names=["id", "length", "terms", "impacts"])

    return impact


class Item:
    """An item's terms by falling coordinate of y, their integer weights, and the lengths that bounds need."""

    def __init__(self, terms: list[int], counts: list[int], weights: np.ndarray):
        of, n = np.array(terms, np.int64), np.array(counts, np.int64)
        y = n * np.sqrt(weights[of])
        order = np.argsort(-y, kind="stable")
        order = order[y[order] > 0]
        self.terms, self.y, self.whole = of[order], y[order], (n * weights[of])[order]
        squares = np.cumsum(self.y**2)
        self.length = math.sqrt(squares[-1]) if len(squares) else 0.0
        self.focus = int(np.searchsorted(squares, FOCUS * squares[-1])) + 1 if len(squares) else 0
        self.rest = math.sqrt(max(0.0, squares[-1] - squares[self.focus - 1])) if self.focus else 0.0


class Bucket:
    """Vectors of neighbouring lengths: by row, and as postings by term."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray):
        self.ids, self.length, self.terms, self.impacts = ids, length, terms, impacts
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(terms, kind="stable")
        self.by_term, self.rows = terms[order], np.repeat(np.arange(len(ids)), sizes)[order]
        self.x = np.sqrt(weights[self.by_term]) * impacts[order]
        starts = np.flatnonzero(np.diff(self.by_term, prepend=-1))
        self.held, self.most = self.by_term[starts], np.maximum.reduceat(self.x, starts) if len(starts) else self.x

    def candidates(self, item: Item, least: int) -> np.ndarray:
        """Rows that may score ``least`` or more."""
        terms, others = item.terms[: item.focus], item.terms[item.focus :]
        low, high = np.searchsorted(self.by_term, terms), np.searchsorted(self.by_term, terms, side="right")
        at = spans(low, high - low)
        rows, x = self.rows[at], self.x[at]
        near = np.bincount(rows, weights=x * np.repeat(item.y[: item.focus], high - low), minlength=len(self.ids))
        left = np.maximum(self.length**2 * MARGIN - np.bincount(rows, weights=x * x, minlength=len(self.ids)), 0)
        place = np.minimum(np.searchsorted(self.held, others), len(self.held) - 1)
        most = np.where(self.held[place] == others, self.most[place], 0) @ item.y[item.focus :]
        return np.flatnonzero((near + np.minimum(item.rest * np.sqrt(left), most)) * MARGIN >= least)

    def scores(self, rows: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; whole: the item's integer weight by term."""
        sizes = self.first[rows + 1] - self.first[rows]
        at = spans(self.first[rows], sizes)
        return np.add.reduceat(whole[self.terms[at]] * self.impacts[at], np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def buckets(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[Bucket]:
    for batch in batches:
        offsets = batch.column("terms").offsets.to_numpy()
        part = (offsets[:-1] - offsets[0]) // BUCKET_POSTINGS
        edges = sorted({0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), *range(0, batch.num_rows, BUCKET_ROWS), batch.num_rows})
        for a, b in zip(edges, edges[1:]):
            some = batch.slice(a, b - a)
            yield Bucket(some.column("id").fill_null(NO_ID).to_numpy(), some.column("length").to_numpy(), np.diff(some.column("terms").offsets.to_numpy()), some.column("terms").flatten().to_numpy(), some.column("impacts").flatten().to_numpy(), weights)


def searched(items, weights, thresholds: np.ndarray, k: int):
    """The function for mapInArrow: id, length, terms, impacts -> item (its place in the block), id, score: this task's k best of each."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = items.value, weights.value
        least, lengths = thresholds.copy(), np.array([i.length for i in own])
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
        whole = np.zeros(len(w), np.int64)
        for bucket in buckets(batches, w):
            for i in np.flatnonzero((lengths > 0) & (lengths * bucket.length.max(initial=0) * MARGIN >= least)).tolist():
                rows = bucket.candidates(own[i], least[i])
                if not len(rows):
                    continue
                whole[own[i].terms] = own[i].whole
                score = bucket.scores(rows, whole)
                whole[own[i].terms] = 0
                good = score >= least[i]
                if good.any():
                    score, ids = np.concatenate([top[i][0], score[good]]), np.concatenate([top[i][1], bucket.ids[rows[good]]])
                    best = np.lexsort((ids, -score))[:k]
                    top[i] = score[best], ids[best]
                    if len(best) == k:
                        least[i] = max(least[i], score[best[-1]])
        of = np.repeat(np.arange(len(own), dtype=np.int32), [len(s) for s, _ in top])
        yield pa.RecordBatch.from_pydict({"item": of, "id": np.concatenate([i for _, i in top]), "score": np.concatenate([s for s, _ in top])})

    return search


FOUND = "item int, id long, score long"


def foremost(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, items: pa.Table, k: int) -> DataFrame:
    """docs (id, text) -> item (place in items), id, score, rank."""
    spark, send = docs.sparkSession, docs.sparkSession.sparkContext.broadcast
    vocabulary = sorted({t for terms in items.column("terms").to_pylist() for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    counts = materialise(docs.mapInArrow(counted(send(number)), "id long, n long, terms array<int>, tf array<int>"), "search-counts")
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    told = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row for each of the items' terms
    df[told.column("term").to_numpy()] = told.column("df").to_numpy()
    w = np.where(df > 0, weigh(n_docs, df), 0)
    weights, own = send(w), send([Item([number[t] for t in terms], c, w) for terms, c in zip(items.column("terms").to_pylist(), items.column("counts").to_pylist())])
    vectors = counts.mapInArrow(impacts(weights, n_docs, n_terms), "id long, length double, terms array<int>, impacts array<long>")
    spread = F.xxhash64("id", "terms").alias("spread")  # equal lengths may be very many
    ordered = vectors.repartitionByRange(F.desc("length"), spread).sortWithinPartitions(F.desc("length"))
    vectors = materialise(ordered, "search-vectors")
    lengths = np.array([i.length for i in own.value])
    least = np.ones(len(lengths), np.int64)
    long_ = vectors.agg(F.percentile_approx("length", 1 - FIRST, 1000)).first()[0] or 0.0
    first = materialise(foremost(vectors.filter(F.col("length") >= long_).mapInArrow(searched(own, weights, least, k), FOUND), k), "search-first")
    for r in first.filter(F.col("rank") == k).select("item", "score").collect():  # a row per item
        least[r["item"]] = r["score"]
    useful = float((least[lengths > 0] / lengths[lengths > 0]).min(initial=np.inf)) / MARGIN
    rest = vectors.filter((F.col("length") < long_) & (F.col("length") >= useful))
    found = rest.mapInArrow(searched(own, weights, least, k), FOUND)
    return foremost(first.select("item", "id", "score").unionAll(found), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = 4096) -> DataFrame:
    """item_col, rank, id_col, score: each item's k best documents with a score above 0; see the module."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), utf8(F.col(item_text_col)).alias("text"))
    fields = [T.StructField("item", asked.schema["item"].dataType), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    asked = materialise(asked.mapInArrow(item_terms, T.StructType(fields)).withColumn("place", F.monotonically_increasing_id()), "search-items")
    longest = asked.agg(F.max(F.size("terms"))).first()[0] or 1
    out = T.StructType([T.StructField(item_col, asked.schema["item"].dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())])
    path, parts = shared_path(spark, "search-results"), []
    for low, high in place_ranges(asked, max(1, min(block_items, (1 << 22) // longest))):
        block = asked.filter(F.col("place").between(low, high))
        told = block.select("terms", "counts", "place").toArrow()  # block_items rows, with 4 M terms at most or one item's
        places = spark.createDataFrame([(i, p) for i, p in enumerate(told.column("place").to_pylist())], "item int, place long")
        named = block.select(F.col("item").alias("own"), "place").join(places, "place")
        found = search_block(rows, told, k).join(F.broadcast(named), "item")  # a row per item of the block
        parts.append(f"{path}/part={len(parts)}")
        found.select(F.col("own").alias(item_col), "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "score").write.parquet(parts[-1])
    return spark.read.schema(out).parquet(*parts) if parts else spark.createDataFrame([], out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS x FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(x))::BIGINT AS words FROM d WHERE len(x) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(x) AS n, unnest(x) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score FROM i JOIN df USING (term) JOIN tf USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

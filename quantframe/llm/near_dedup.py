"""Near-duplicate classes by DartMinHash over weighted word shingles.

A document is the multiset of its five-word shingles (lower case, words split at ASCII white space; a shorter text is one
shingle). Similarity is weighted Jaccard: shared over joint shingle counts.

Signature: each shingle owns an endless strip (weight x rank) on which hashed darts fall at rate one. A document with
count c of the shingle owns the strip's weights below c. Darts are thrown cell by cell: weights in dyadic cells, ranks in
dyadic cells from zero up; how many darts a cell has, and where, hangs on the hash of (shingle, cells) only, so two
documents see the same darts in what they share. Each dart also names one of ``bands * rows`` coordinates; the earliest
dart of a coordinate is its value, and throwing stops once all have one. Coordinates agree with probability equal to the
similarity.

Joining: texts with the same words become one node first. Nodes that agree in a whole band share a bucket. In buckets of
up to SMALL nodes all pairs are tested; in larger ones the node that shares most buckets is tested against the others.
Tests compute the exact similarity from the two shingle multisets; linked nodes form classes. Then the nodes
of a larger bucket that still spans several classes are cut into blocks, and a task compares each pair of blocks in memory, so
no pairs are written out but the links that join classes. So each link whose two texts share a bucket is found or joins
two nodes of one class, and no bucket is capped. With 32 bands of 5, texts at 0.8 share no bucket with a probability of 3 in a million.

Defined cases: null text counts as empty; all texts without words are one class; rows that repeat are one class; a null
doc_id is in its text's class and is its id only if the class has no other; an empty table gives an empty result; other
columns pass through, and a column named class_id is replaced.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.bloom import ODD, build_filter, in_filter, mix
from quantframe.llm.common import SPACE, materialise, or_empty
from quantframe.llm.graph import components

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 32, 5, 0.8
SMALL, BLOCK, ELEMENTS = 16, 1024, 1 << 21
FIRST_RANK = 0.25
CHUNK_WORDS = 60_000
HOT = 1000

def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word of the lower-cased texts, in order.

    A word's hash is a polynomial of its bytes, from running sums of bytes times powers of an odd base.
    """
    lowered = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([b"", *lowered, b""]), np.uint8)  # a space before each text and after the last
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    low, high = edge[0::2], edge[1::2]
    n = len(data)
    if len(_powers[0]) < n:
        size = 2 * n
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(size, base, np.uint64)), dtype=np.uint64) for base in (BASE, INVERSE)]
    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], dtype=np.uint64))
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    return np.searchsorted(ends, low, side="left"), mix((total[high] - total[low]) * _powers[1][low])


IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shingles(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), sorted by document and shingle."""
    doc, w = laid_out(texts)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.bincount(doc, minlength=len(texts))
    starts = np.cumsum(words) - words
    number = np.maximum(words - size + 1, np.minimum(words, 1))
    at = np.repeat(starts - (np.cumsum(number) - number), number) + np.arange(number.sum())
    owner = np.repeat(np.arange(len(texts)), number)
    h = np.zeros(len(at), np.uint64)
    padded = np.append(w, np.zeros(size, np.uint64))
    for j in range(size):
        step = h * ODD + padded[at + j]
        h = step if j == 0 else np.where(j < words[owner], step, h)
    key = mix(h)
    ends = np.cumsum(number)
    for low, high in zip((ends - number).tolist(), ends.tolist()):
        key[low:high].sort()
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])))
    return owner[first], key[first], np.diff(np.append(first, len(key)))


@functools.cache
def poisson_table(mean: float) -> np.ndarray:
    most = int(mean + 12 * math.sqrt(mean) + 30)
    k = np.arange(most)
    logs = k * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most)))])
    return np.cumsum(np.exp(logs))


def throw(key: np.ndarray, level: int, step: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Darts in cell (level, step) of each shingle: the shingle's position in key, and the dart's hash."""
    cell = mix(key + np.uint64((level * 64 + step + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    chance = uniform(cell)
    some = np.flatnonzero(chance >= table[0])
    n = np.searchsorted(table, chance[some], side="right")
    at = np.repeat(some, n)
    number = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    return at, mix(cell[at] + (number + np.uint64(1)) * ODD)


def signatures(texts: list[str | None], k: int, size: int = SHINGLE) -> np.ndarray:
    """A row of k dart hashes per document; all zero for a text without words."""
    return signatures_of(*shingles(texts, size), len(texts), k)


def signatures_of(doc: np.ndarray, key: np.ndarray, count: np.ndarray, docs: int, k: int) -> np.ndarray:
    out, best = np.zeros((docs, k), np.uint64), np.full(docs * k, np.inf)
    low, high, step = 0.0, FIRST_RANK, 0
    while len(doc):
        level = 0
        at = np.arange(len(doc))
        fresh: list[tuple[np.ndarray, ...]] = []
        while len(at := at[count[at] > 2**level - 1]):
            hit, dart = throw(key[at], level, step, poisson_table(2**level * (high - low)))
            hit = at[hit]
            if level:
                mine = 2**level - 1 + 2**level * uniform(mix(dart + np.uint64(1))) < count[hit]
                hit, dart = hit[mine], dart[mine]
            slot = doc[hit] * k + (mix(dart + np.uint64(2)) % np.uint64(k)).astype(np.int64)
            mine = np.isinf(best[slot])  # an earlier cell's dart is earlier
            dart = dart[mine]
            fresh.append((slot[mine], low + (high - low) * uniform(mix(dart + np.uint64(3))), dart))
            level += 1
        slot, rank, dart = (np.concatenate(x) for x in zip(*fresh))
        order = np.argsort(-rank)  # the last of a coordinate's darts to be set is the earliest
        best[slot[order]] = rank[order]
        out.ravel()[slot[order]] = dart[order]
        open_ = np.isinf(best.reshape(-1, k)).any(1)[doc]
        doc, key, count = doc[open_], key[open_], count[open_]
        low, high, step = high, 2 * high, step + 1
    return out


def chunks(texts: list[str | None]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") // 5 + 1
        if size > CHUNK_WORDS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def signed(bands: int, rows: int, size: int):
    """The function for mapInArrow that replaces the last column, a text, by its number of shingles and the hashes of its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, sizes = batch.column(batch.num_columns - 1).to_pylist(), [], []
            for part in chunks(texts):
                doc, key, count = shingles(texts[part], size)
                n = len(texts[part])
                sizes += np.bincount(doc, count, n).astype(np.int64).tolist()
                sig = signatures_of(doc, key, count, n, bands * rows).reshape(-1, bands, rows)
                h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2]).copy()
                for r in range(rows):
                    h = mix(h * ODD + sig[:, :, r])
                wordless = ~sig.any((1, 2))
                out += [None if wordless[i] else x for i, x in enumerate(h.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "shingles", "bands"])

    return sign


def multisets(bits: np.ndarray, size: int):
    """The function for mapInArrow over (digest, h, text): element hashes of texts that the filter may hold; copy j of a shingle is an element of its own."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).to_numpy().view(np.uint64)
            pick = np.flatnonzero(in_filter(bits, h))
            picked = batch.take(pa.array(pick))
            texts, out = picked.column(2).to_pylist(), []
            for part in chunks(texts):
                doc, key, count = shingles(texts[part], size)
                n = np.repeat(np.arange(len(key)), count)
                copy = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
                element = np.where(copy > 0, mix(key[n] + copy.astype(np.uint64) * ODD), key[n]).view(np.int64)
                ends = np.searchsorted(doc[n], np.arange(len(texts[part])), side="right")
                out += np.split(element, ends)[:-1]
            yield pa.RecordBatch.from_arrays([picked.column(0), pa.array(out, pa.list_(pa.int64()))], names=["digest", "elements"])

    return expand


def multisets_of(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """wanted: (node, digest, h); docs: (digest, h, text). Gives (node, elements), a table, in one pass over the documents."""
    found = docs.mapInArrow(multisets(build_filter(wanted.select("h")), size), "digest binary, elements array<long>")
    # the filter lets a few others pass: the join has the last word; a node's rows that repeat are dropped
    return materialise(wanted.join(found, "digest").dropDuplicates(["node"]).select("node", "elements"), "multisets")


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar, a table."""
    pairs = materialise(pairs, "pairs")
    near = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b").join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
    shared = F.size(F.array_intersect("ea", "eb"))
    return materialise(near.filter(shared >= F.lit(threshold) * (F.size("ea") + F.size("eb") - shared)).select("a", "b"), "near-links")


def near_links(nodes: DataFrame, docs: DataFrame, size: int, threshold: float, small: int) -> DataFrame:
    """nodes: (node, digest, h, shingles, bands). Gives (node, component) of linked nodes."""
    spread = nodes.select(F.explode("bands").alias("key"), "node", "shingles")
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(spread.join(shared, "key"), "buckets")
    rank = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = materialise(members.join(rank, "node"), "buckets-ranked")
    sets = multisets_of(materialise(nodes.select("node", "digest", "h").join(members.select("node").distinct(), "node"), "wanted"), docs, size)
    few, many = members.filter(F.col("n") <= small), members.filter(F.col("n") > small)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & comparable(F.col("x.shingles"), F.col("y.shingles"), threshold)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    centre = many.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), "shingles")).alias("top"))
    centre = materialise(centre.select("key", (-F.col("top.minus")).alias("centre"), F.col("top.shingles").alias("size")), "centres")
    star = many.join(centre, "key").filter((F.col("node") != F.col("centre")) & comparable(F.col("size"), F.col("shingles"), threshold))
    links = linked(pairs.unionByName(ordered(star, "centre", "node")).distinct(), sets, threshold)
    labels = components(links)
    if many.limit(1).count() == 0:
        return labels
    return components(links.unionByName(block_links(many, labels, sets, threshold)))


def block_links(many: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between classes inside the large buckets (key, node) that span several.

    A bucket's nodes are dealt to blocks of about BLOCK nodes and at most ELEMENTS shingles on average: those of a class that
    fills a block or more to blocks of its own, by their hash, whole smaller classes together. Each pair of blocks, unless
    both are of one class, is a group, and a task compares one side with the other.
    """
    now = materialise(many.join(labels, "node", "left").select("key", "node", "shingles", F.coalesce("component", "node").alias("component")), "buckets-now")
    load = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("shingles") / ELEMENTS)
    classes = now.groupBy("key", "component").agg(load.alias("load"))
    spans = classes.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("load") < 1, F.col("load"))).alias("small")).filter("kinds > 1")
    classes = materialise(classes.join(spans, "key").select("key", "component", "load", "small"), "bucket-classes")
    own = F.col("load") >= 1
    block = F.when(own, F.struct(F.col("component").alias("of"), F.pmod(F.xxhash64("node"), F.ceil("load")).alias("part")))
    block = block.otherwise(F.struct(F.lit(-1).cast("long").alias("of"), F.pmod(F.xxhash64("component"), F.ceil("small")).alias("part")))
    dealt = materialise(now.join(classes, ["key", "component"]).select("key", "node", "component", block.alias("block")), "blocks")
    blocks = dealt.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    x, y = (blocks.select("key", F.col("block").alias(n), F.col("low").alias(f"low_{n}"), F.col("high").alias(f"high_{n}")) for n in "ij")
    pairs = x.join(y, "key").filter("i <= j AND NOT (low_i = high_i AND low_j = high_j AND low_i = low_j)").select("key", "i", "j")
    pairs = materialise(pairs, "block-pairs")
    ends = pairs.select("key", "i", "j", F.col("i").alias("block")).unionByName(pairs.filter("i < j").select("key", "i", "j", F.col("j").alias("block")))
    held = dealt.join(ends, ["key", "block"]).join(sets, "node").select("key", "i", "j", (F.col("block") == F.col("i")).alias("left"), (F.col("block") == F.col("j")).alias("right"), "node", "component", "elements")
    return materialise(held.groupBy("key", "i", "j").applyInArrow(compared(threshold), "a long, b long"), "block-links")


def compared(threshold: float):
    """The function for applyInArrow over the nodes of two blocks: links that join two classes of them, as few as do."""

    def compare(group: pa.Table) -> pa.Table:
        left, right, node, of = (group[c].to_numpy() for c in ("left", "right", "node", "component"))
        lists = group["elements"].combine_chunks()
        ends = np.asarray(lists.offsets)
        flat, size = lists.values.to_numpy(), np.diff(ends)
        right = np.flatnonzero(right)
        value = np.concatenate([flat[ends[k] : ends[k + 1]] for k in right] or [flat[:0]])
        owner = np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while up.get(c, c) != c:
                up[c] = c = up.get(up[c], up[c])
            return c

        a, b = [], []
        for k in np.flatnonzero(left):
            mine = flat[ends[k] : ends[k + 1]]
            low = np.searchsorted(value, mine, "left")
            n = np.searchsorted(value, mine, "right") - low
            hits = owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            shared = np.bincount(hits, minlength=len(right))
            near = right[(shared >= threshold * (size[k] + size[right] - shared)) & (of[right] != of[k])]
            for m in near.tolist():
                p, q = top(int(of[k])), top(int(of[m]))
                if p != q:
                    up[max(p, q)] = min(p, q)
                    a.append(min(node[k], node[m]))
                    b.append(max(node[k], node[m]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def comparable(x: Column, y: Column, threshold: float) -> Column:
    """Whether multisets of these sizes can be similar at all."""
    return F.least(x, y) >= F.lit(threshold) * F.greatest(x, y)


def ordered(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, salts: int = 32) -> tuple[DataFrame, DataFrame]:
    """Two tables, for hot digests and for all others: digest, low (its smallest id), class_id, leads (it holds the class's smallest id), n."""
    normal = F.lower(F.trim(F.regexp_replace(or_empty(F.col(text_col)), SPACE, " ")))
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(normal.cast("binary"))).alias("digest"), F.col(text_col).alias("text"))
    described = materialise(texts.mapInArrow(signed(bands, rows, size), T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])), "signatures")
    salted = described.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
    grouped = salted.groupBy("digest").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
    nodes = materialise(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", F.xxhash64("digest", "low").alias("h"), "low", "n", "shingles", "bands"), "nodes")
    own = texts.select("digest", F.xxhash64("digest", "id").alias("h"), "text")
    labels = near_links(nodes.filter("bands IS NOT NULL"), own, size, threshold, small)
    placed = nodes.select("node", "digest", "low", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "digest"))  # a text with an id before those without
    named = placed.groupBy("component").agg(first.alias("first"))
    table = materialise(placed.join(named, "component").select("digest", "low", F.col("first.low").alias("class_id"), (F.col("digest") == F.col("first.digest")).alias("leads"), "n"), "classes")
    most = described.count() / HOT
    return table.filter(F.col("n") > most), table.filter(F.col("n") <= most)


def with_class(docs: DataFrame, id_col: str, text_col: str, carried: list[str], **options) -> DataFrame:
    """row, id, digest, low, class_id and leads of each document."""
    hot, cold = near_classes(docs, id_col, text_col, **options)
    normal = F.lower(F.trim(F.regexp_replace(or_empty(F.col(text_col)), SPACE, " ")))
    rows = docs.select(F.struct(*carried).alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(normal.cast("binary"))).alias("digest"))
    # under HOT digests have over 1/HOT of the rows, so that table is small; the rest meet in a shuffle join
    found = F.struct("low", "class_id", "leads")
    rows = rows.join(F.broadcast(hot.select("digest", found.alias("hot"))), "digest", "left")
    rows = rows.withColumn("at", F.when(F.col("hot").isNull(), F.concat(F.lit("d"), F.hex("digest"))).otherwise(F.concat(F.lit("h"), F.xxhash64("id").cast("string"))))
    cold = cold.select(F.concat(F.lit("d"), F.hex("digest")).alias("at"), found.alias("cold"))
    return rows.join(cold, "at", "left").withColumn("of", F.coalesce("hot", "cold")).select("row", "id", "digest", "of.low", "of.class_id", "of.leads")


def mark_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """docs (or the columns of ``carry``) with class_id: the smallest id among its near duplicates."""
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() != "class_id"]
    return with_class(docs, id_col, text_col, carried, **options).select("row.*", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, that with the smallest id, with the columns of docs. Of rows that repeat both id and words, that with the least hash of its text, or any of equal ones."""
    found = with_class(docs, id_col, text_col, docs.columns, **options)
    led = found.filter(F.col("leads") & F.col("id").eqNullSafe(F.col("low")))
    # each task drops all but one row of a digest before the exchange
    led = led.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy(F.xxhash64(F.col("row")[text_col]))))
    return led.filter("place = 1").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])

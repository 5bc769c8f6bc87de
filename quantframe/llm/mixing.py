"""Mixing sources to target weights by cube-method balanced sampling.

Sources share all words by weight; a target stops at ``most`` times its source's words, and the excess is shared again
by weight until no target is above. That is target = min(most * size, level * weight) for the one level at which the
targets add up, found from the table of sources (a row each).

A document of a source with target / size = r is taken floor(r) times, and once more with inclusion probability
p = r - floor(r). The cube method decides all of a source's extra copies together. Flight: a few undecided documents are
moved along the null space of the constraints (total words, number of documents) until one reaches 0 or 1, then the next
document joins them; every move keeps both totals and, in expectation, every probability.

Documents come by falling size, and a lone large one among small ones hardly moves: no choice of small ones keeps both
totals. So landing goes size by size. Once the next documents are at most half as large as an undecided one, those that follow are
held until they could together make up for that one's words and for itself in number, and one move decides it and shifts all
their probabilities a little, by what each can bear. Where the documents left can't bear both, words alone are kept, and the
number of documents changes by one or so. The last ``LAST`` documents, the smallest, are decided like that one after the
other, each against all smaller ones; those of up to ``SMALL`` of the target by the flight, and only the very last is drawn. So a large document's words are lost to chance only
where all smaller ones of its source together can't make up for them.

On Spark the flight is a tree. Documents are dealt to blocks of about ``block_rows`` within their source (a hot source
has many), and each block streams through the flight in constant memory. A block leaves at most two undecided, and the
first document of each size class (halving sizes) besides, untouched; those meet in blocks of blocks until one is left for
each source, where landing takes place. So taken words stay within about one small document of the target wherever a
source has documents of all sizes.

Defined cases: null source is the last source; null text has 0 words, and its copies cost nothing; rows that repeat and
null ids are rows like any other; a source without words has target 0; an empty table gives an empty result; other columns
pass through, and a column named like a result is replaced by it. All draws derive from the seed and the data; rows that are
alike in every column are interchangeable, and where over 1/1000 of all rows are alike they are dealt to blocks by their place.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.common import materialise, word_count

RESULTS = ("size", "source_size", "target", "copies", "taken")
#: A source table of more rows than this is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000
FAN_IN = 512
#: Units that wait for a large one to be decided, at most.
WAITING = 1024
#: The smallest units of a block, held for the landing.
LAST = 32
#: Documents of up to this share of the target keep the number of documents rather than the words.
SMALL = 0.001
#: Rows alike in every column are hot if they are over 1/HOT of all rows.
HOT = 1000


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, size) rows -> source, documents, source_size, target: one row per source, null source last."""
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("source_size"))
    # these windows run over a row per source; the order by code point is that of UTF-8 bytes
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    table = sources.select("source", "documents", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everyone = Window.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left, weighs = (F.sum(c).over(everyone) - F.coalesce(F.sum(x).over(before), F.lit(0.0)) for c, x in (("source_size", "cap"), ("weight", "weight")))
    level = left / weighs
    table = table.withColumn("level", level)
    # the first source, by cap / weight, that its share does not fill sets the level
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everyone)["level"]
    return table.select("source", "documents", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def direction(sizes: list[float], balanced: int) -> list[float]:
    """A null vector of the first ``balanced`` constraints (total size, number) over balanced + 1 units or fewer; empty if none."""
    n = len(sizes)
    if balanced == 2 and n == 3:
        a, b, c = sizes
        return [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]
    if n == 2 and (balanced == 1 or sizes[0] == sizes[1]):
        a, b = sizes
        return [b, -a] if a or b else [1.0, -1.0]
    return [1.0] if n == 1 and (balanced == 0 or (balanced == 1 and sizes[0] == 0)) else []


def shift(rng: np.random.Generator, units: list[list], u: list[float]) -> None:
    """Move the probabilities of units [size, p, ...] along u to where one of them is decided, one way or the other, so that all are kept in expectation."""
    up = min((1 - x[1]) / d if d > 0 else x[1] / -d for x, d in zip(units, u) if d)
    down = min(x[1] / d if d > 0 else (1 - x[1]) / -d for x, d in zip(units, u) if d)
    step = up if rng.random() * (up + down) < down else -down
    for x, d in zip(units, u):
        p = x[1] + step * d
        x[1] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def both_kept(large: list, others: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Moves of others that make up for the words and the number of a large unit, what each can bear, and how far its move until that is decided."""
    b, size = np.array([min(x[1], 1 - x[1]) for x in others]), np.array([x[0] for x in others])
    n, words, squares = b.sum(), (b * size).sum(), (b * size * size).sum()
    apart = n * squares - words * words
    if apart <= 1e-12 * n * squares:
        return None
    u = b * ((words * large[0] - squares) + (words - n * large[0]) * size) / apart
    return u, b, abs(u) * max(large[1], 1 - large[1])


def bearable(large: list, others: list[list]) -> bool:
    found = both_kept(large, others)
    return found is not None and bool((found[2] <= found[1]).all())


def against(large: list, others: list[list]) -> list[float] | None:
    """Moves of others that make up for a large unit's words by what each can bear, and for its number as far as they can; None if they have no words."""
    b, size = np.array([min(x[1], 1 - x[1]) for x in others]), np.array([x[0] for x in others])
    if not (b * size).sum() > 0:
        return None
    u, found = -large[0] * b / (b * size).sum(), both_kept(large, others) if len(others) > 2 else None
    if found is None:
        return u.tolist()
    apart, most = found[0] - u, b / max(large[1], 1 - large[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(apart > 0, (most - u) / apart, np.where(apart < 0, (-most - u) / apart, 1.0))
    return (u + min(1.0, max(0.0, float(share.min()))) * apart).tolist()


def move(rng: np.random.Generator, units: list[list], balanced: int) -> bool:
    """One step of the flight: along the null vector, if there is one."""
    u = direction([x[0] for x in units], balanced)
    if any(u):
        shift(rng, units, u)
    return any(u)


class Flight:
    """Stream of units of one block by falling size; ``done`` gets the decided ones."""

    def __init__(self, seed: list[int], land: bool, small: float = 0.0):
        self.rng, self.land, self.small, self.pool, self.back = np.random.default_rng(seed), land, small, [], []
        self.ahead: list[list] = []  # smaller units that wait for a large one to be decided
        self.tail: deque[list] = deque()  # the latest units, held for the landing
        self.head: float | None = None  # size of the first unit of this size class

    def held(self) -> list[list]:
        return [*self.pool, *self.ahead, *self.tail, *self.back]

    def settle(self, done: list, balanced: int, full: int) -> None:
        while len(self.pool) >= full and self.pool and move(self.rng, self.pool, balanced):
            done += [x for x in self.pool if x[1] in (0.0, 1.0)]
            self.pool = [x for x in self.pool if x[1] not in (0.0, 1.0)]

    def decide(self, large: list, others: list[list], done: list) -> list[list]:
        """Move a large unit against others until it is decided or none of them has words left, keeping the number too where they
        can bear that; the others still undecided."""
        while large[1] not in (0.0, 1.0):
            plan = against(large, others)
            if plan is None:
                break
            shift(self.rng, [large, *others], [1.0, *plan])
            done += [x for x in others if x[1] in (0.0, 1.0)]
            others = [x for x in others if x[1] not in (0.0, 1.0)]
        if large[1] in (0.0, 1.0):
            done.append(large)
        return others

    def land_large(self, done: list) -> None:
        large = max(self.pool, key=lambda x: x[0])
        waited = self.decide(large, self.ahead, done)
        self.pool = [x for x in self.pool if x[1] not in (0.0, 1.0)]
        self.ahead = []
        for x in waited:
            self.take(x, done)

    def take(self, unit: list, done: list) -> None:
        large = max((x for x in self.pool if x[0] >= 2 * unit[0] > 0), key=lambda x: x[0], default=None) if self.land else None
        if large is None:
            self.pool.append(unit)
            self.settle(done, 2, 3)
            return
        self.ahead.append(unit)
        n = len(self.ahead)
        if n >= WAITING or n >= 4 and not n & (n - 1) and bearable(large, self.ahead):  # looked at as they double
            self.land_large(done)

    def add(self, unit: list, done: list) -> None:
        if unit[1] in (0.0, 1.0):
            done.append(unit)
            return
        opens = self.head is None or unit[0] * 2 <= self.head and unit[0] < self.head
        self.head = unit[0] if opens else self.head
        if self.land:
            self.tail.append(unit)
            if len(self.tail) > LAST:
                self.take(self.tail.popleft(), done)
        elif opens:
            self.back.append(unit)
        else:
            self.take(unit, done)

    def end(self, done: list) -> list:
        """Units still undecided: at most two and one for each size class, and none after landing."""
        if not self.land:
            self.settle(done, 2, 2)
            return self.pool + self.back
        while self.ahead:
            before = len(self.held())
            self.land_large(done)
            if len(self.held()) == before:  # without words to move
                self.pool, self.ahead = self.pool + self.ahead, []
        left = sorted([*self.pool, *self.tail], key=lambda x: -x[0])
        while left and left[0][0] > self.small:  # the largest against all smaller ones
            others = self.decide(left[0], left[1:], done)
            if left[0][1] not in (0.0, 1.0):
                left[0][1] = float(self.rng.random() < left[0][1])
                done.append(left[0])
            left = others
        self.pool, self.tail = [], deque()
        for x in left:
            self.pool.append(x)
            self.settle(done, 2, 3)
        self.settle(done, 2, 2)
        self.settle(done, 1, 1)
        for x in self.pool:
            x[1] = float(self.rng.random() < x[1])
        done += self.pool
        self.pool = []
        return []


def flown(seed: int, land: bool):
    """The function for mapInArrow over rows sorted by (source_key, block): moves p, and releases rows as they are decided."""

    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flight = None, None
        for batch in batches:
            keys, blocks = batch.column("source_key").to_pylist(), batch.column("block").to_pylist()
            sizes, ps = batch.column("size").to_pylist(), batch.column("p").to_pylist()
            targets = batch.column("of").field("target").to_pylist()
            done: list[list] = []
            for i in range(batch.num_rows):
                if now != (keys[i], blocks[i]):
                    if flight:
                        done += flight.end(done)
                    now, flight = (keys[i], blocks[i]), Flight([seed, keys[i] & (2**63 - 1), blocks[i]], land, SMALL * targets[i])
                flight.add([float(sizes[i]), ps[i], i, None], done)
            yield from released(done, batch)
            for x in flight.held() if flight else []:  # few rows outlast their batch
                if x[3] is None:
                    x[3], x[2] = batch.take(pa.array([x[2]])), 0
        if flight:
            done = []
            done += flight.end(done)
            yield from released(done, None)

    def released(done, batch):
        own = [x for x in done if x[3] is None]
        if own:
            out = batch.take(pa.array([x[2] for x in own]))
            yield with_p(out, [x[1] for x in own])
        for x in done:
            if x[3] is not None:
                yield with_p(x[3], [x[1]])

    def with_p(batch, p):
        at = batch.schema.get_field_index("p")
        return batch.set_column(at, batch.schema.field(at), pa.array(p, pa.float64()))

    return fly


def flight_level(rows: DataFrame, seed: int, land: bool) -> DataFrame:
    parts = rows.repartition("source_key", "block").sortWithinPartitions("source_key", "block", F.desc("size"), "tie")
    return parts.mapInArrow(flown(seed, land), T.StructType(rows.schema.fields))


def mix_to_targets(sized: DataFrame, targets: DataFrame, seed: int = 11, block_rows: int = 2048, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """sized with source_size, target and copies (how often the mix takes the row)."""
    carried = [c for c in sized.columns if c.lower() not in RESULTS or c == size_col]
    targets = materialise(targets, "mix-targets")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    table = targets.withColumnRenamed("source", "its")
    rows = sized.select(F.struct(*carried).alias("row"), F.col(source_col).alias("of"), F.col(size_col).cast("double").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(size_col), F.struct(*carried)).alias("tie"))
    alike = rows.groupBy("tie").agg(F.count(F.lit(1)).alias("n"))
    alike = materialise(alike.filter(F.col("n") > F.lit(sized.count() / HOT)).select("tie", F.lit(True).alias("hot")), "mix-alike")  # fewer than HOT
    place = F.when(F.col("hot"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    rows = rows.join(F.broadcast(alike), "tie", "left").withColumn("place", place).drop("hot")
    rows = rows.join(F.broadcast(table) if few else table, F.col("of").eqNullSafe(F.col("its")), "inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    blocks = F.ceil(F.col("documents") / F.lit(block_rows))
    rows = rows.select("row", "size", "tie", F.struct("source_size", "target").alias("of"), F.xxhash64(F.col("its")).alias("source_key"), F.pmod(F.xxhash64("tie", "place"), blocks).alias("block"), F.floor(rate).cast("int").alias("whole"), (rate - F.floor(rate)).alias("p"))
    most_blocks = targets.agg(F.ceil(F.max("documents") / F.lit(block_rows))).first()[0] or 1
    decided, level = [], 0
    while True:
        last = most_blocks == 1
        rows = materialise(flight_level(rows, seed + level, last), f"mix-level-{level}")
        if last:
            decided.append(rows)
            break
        decided.append(rows.filter("p = 0 OR p = 1"))
        most_blocks, level = -(-most_blocks // FAN_IN), level + 1
        rows = rows.filter("p > 0 AND p < 1").withColumn("block", F.expr(f"block div {FAN_IN}"))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("row.*", F.col("of.source_size").alias("source_size"), F.col("of.target").alias("target"), (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, copies and taken."""
    carried = [c for c in docs.columns if c.lower() not in RESULTS]
    sized = docs.select(*carried, word_count(F.col("text")).alias("size"))
    targets = source_targets(sized.select("source", "size"))
    return mix_to_targets(sized, targets, **options).withColumn("taken", F.col("copies") * F.col("size"))


def repeat_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "text", "source")
    return mixed(whole, **options).filter("copies > 0").select("whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    mix = mix_to_targets(sized, source_targets(sized))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

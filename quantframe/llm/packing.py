"""Packing documents into sequences: pattern packing by non-negative least squares.

1. Every document is tokenised, followed by id 0, and cut into pieces only where it is longer than a sequence.
2. The histogram of piece lengths (a count per length, ``capacity`` numbers at most) goes to the driver. Patterns of one
   to three length classes that fill a sequence are enumerated, and non-negative least squares fits how often each
   pattern is used to the histogram. The counts are rounded down, and each use takes exact lengths from its classes, the
   last one as the best fit for the room left.
3. What is left in the histogram is packed by best fit: the longest length first, each time with the pair of lengths that
   leaves least room. Equal sequences are packed at once, so this takes a few steps per length however many pieces there are.
4. Each piece gets its rank among pieces of its length, in blocks (one length may hold a third of all rows), and finds
   its sequence and place by binary search in the packing plan.

The plan has at most a few entries per length and step, a few megabytes whatever the corpus, and goes to each task.

Defined cases: null text counts as empty and gives the piece [0]; rows that repeat, or repeat an id, are packed each for
itself; a text longer than a sequence gives full pieces and a last one that may be shorter; an empty table gives an empty
result; columns other than the id and text aren't carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.common import materialise, sliced
from quantframe.llm.tokens import word_tokens

CAPACITY = 2048
END = b"\0\0\0\0"
PIECE = "piece int, start long, length long, ids_crc32 long"


def cut(path: str | None, capacity: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in (part for whole in batches for part in sliced(whole, whole.schema.names[1], 1 << 21)):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = tokens.ids(text or "") + END
                for k, s in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[s : s + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part if with_ids else None)
            cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [batch.schema.names[0], "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return pieces


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    rows = docs.select(id_col, text_col)
    fields = [rows.schema[0], *T.StructType.fromDDL(PIECE).fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])]
    return rows.mapInArrow(cut(tokenizer, capacity, with_ids), T.StructType(fields))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(4 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        free[best] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 1e-9)
            if not low.any():
                x = z
                break
            ratio = x[low] / np.maximum(x[low] - z[low], 1e-300)
            x = x + min(1.0, ratio.min()) * (z - x)
            free &= x > 1e-9
            x[~free] = 0.0
            if not free.any():
                break
    return x


def enumerate_patterns(classes: int) -> list[tuple[int, ...]]:
    """Multisets of one to three length classes (1 to classes) whose sum fills a sequence."""
    pairs = [(classes - k, k) for k in range(1, classes // 2 + 1)]
    triples = [(classes - j - k, j, k) for k in range(1, classes // 3 + 1) for j in range(k, (classes - k) // 2 + 1)]
    return [(classes,), *pairs, *triples]


class Plan:
    """Entries (length, first rank, times in a sequence, repeats, first sequence, offset), as sequences are decided."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left, self.used, self.capacity, self.sequences, self.entries = counts.astype(np.int64).copy(), np.zeros_like(counts, dtype=np.int64), capacity, 0, []

    def available(self, taken: dict[int, int]) -> np.ndarray:
        """For each room, the longest length that fits and isn't used up by ``taken``; 0 if none."""
        free = self.left > 0
        for k, n in taken.items():
            free[k] = self.left[k] > n
        return np.maximum.accumulate(np.where(free, np.arange(len(free)), 0))

    def place(self, pattern: dict[int, int], most: int | None = None) -> int:
        repeats = min(int(self.left[k]) // n for k, n in pattern.items())
        repeats = repeats if most is None else min(repeats, most)
        offset = 0
        for k, n in sorted(pattern.items(), reverse=True):
            self.entries.append((k, int(self.used[k]), n, repeats, self.sequences, offset))
            self.used[k] += n * repeats
            self.left[k] -= n * repeats
            offset += k * n
        self.sequences += repeats
        return repeats


def fit_patterns(plan: Plan, width: int) -> None:
    """Use the patterns as often as least squares says, rounded down."""
    classes = plan.capacity // width
    of = np.minimum(np.maximum(1, (np.arange(plan.capacity + 1) + width // 2) // width), classes)
    patterns = enumerate_patterns(classes)
    a = np.zeros((classes, len(patterns)))
    for p, parts in enumerate(patterns):
        for c in parts:
            a[c - 1, p] += 1
    b = np.bincount(of, weights=plan.left, minlength=classes + 1)[1:]
    for p, uses in enumerate(np.floor(nnls(a, b) + 1e-9).astype(np.int64)):
        while uses > 0:
            taken: dict[int, int] = {}
            room = plan.capacity
            for k, c in enumerate(patterns[p]):
                fits = plan.available(taken)
                top = min(room, int(np.searchsorted(of, c, side="right")) - 1) if k < len(patterns[p]) - 1 or len(patterns[p]) == 1 else room
                length = int(fits[top])
                if not length or abs(int(of[length]) - c) > 1:
                    taken = {}
                    break
                taken[length] = taken.get(length, 0) + 1
                room -= length
            if not taken:
                break
            uses -= plan.place(taken, int(uses))


def best_fit(plan: Plan) -> None:
    """Pack what is left: the longest length, then again and again the one or two lengths that leave least room."""
    while plan.left.any():
        longest = int(np.flatnonzero(plan.left)[-1])
        taken, room = {longest: 1}, plan.capacity - longest
        while room:
            fits = plan.available(taken)
            if not fits[room]:
                break
            first = np.unique(fits[1 : room + 1])
            first = first[first > 0]
            # a pair of the same length needs two of it; where it has one, the check in place() would fail, so look below
            second = fits[room - first]
            for i in np.flatnonzero(second == first):
                if plan.left[first[i]] - taken.get(int(first[i]), 0) < 2:
                    second[i] = fits[first[i] - 1]
            filled = first + second
            pick = int(first[len(first) - 1 - int(filled[::-1].argmax())])
            taken[pick] = taken.get(pick, 0) + 1
            room -= pick
        plan.place(taken)


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, width: int = 16) -> Plan:
    """counts[k]: pieces of length k, for k up to capacity."""
    plan = Plan(counts, capacity)
    fit_patterns(plan, width)
    best_fit(plan)
    return plan


def located(entries: np.ndarray, where: tuple[int, int]):
    """The function for mapInArrow that turns (length, rank) into sequence_id and offset."""
    length, first, times, _, sequence, offset = entries.T
    keys = (length << 48) + first

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rank = batch.column(where[0]).to_numpy(zero_copy_only=False), batch.column(where[1]).to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, (of << 48) + rank, side="right") - 1
            copy, slot = np.divmod(rank - first[k], times[k])
            out = [c for i, c in enumerate(batch.columns) if i != where[1]]
            names = [c for i, c in enumerate(batch.schema.names) if i != where[1]]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence[k] + copy), pa.array(offset[k] + slot * of)], names=[*names, "sequence_id", "offset"])

    return locate


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, block_rows: int = 5000) -> DataFrame:
    """pieces (read from a table) with sequence_id and offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per length
        counts[r["length"]] = r["n"]
    blocks = max(1, -(-int(counts.sum()) // block_rows))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(blocks)))
    per_block = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = per_block.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy(id_col, "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "block"]).select(*pieces.columns, (F.col("before") + F.col("rank") - 1).alias("rank"))
    entries = np.array(sorted(plan_packing(counts, capacity).entries), np.int64).reshape(-1, 6)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(located(entries, (ranked.columns.index("length"), ranked.columns.index("rank"))), schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of each document, with its sequence and place there."""
    return pack_pieces(materialise(cut_documents(docs, id_col, text_col, capacity, tokenizer), "pieces"), id_col, capacity)


def build_sequences(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and ids, for documents with unique ids. A sequence is one row of bounded size."""
    pieces = cut_documents(docs, id_col, text_col, capacity, tokenizer, with_ids=True)
    joined = pieces.join(placed.select(id_col, "piece", "sequence_id", "offset"), [id_col, "piece"])
    parts = joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

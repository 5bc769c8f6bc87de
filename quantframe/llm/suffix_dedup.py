"""Removal of repeated byte strings by external induced suffix sorting of content-dealt shards.

A byte goes if it is covered by a string of ``depth`` bytes that starts at two places or more, in any documents.

1. Every string of ``depth`` bytes (a window) has an anchor: the least hash among its GRAM-byte strings. Equal windows have
   equal anchors, and the windows of one anchor stand in a row: a run.
2. The places of each anchor are counted over all documents. A window whose anchor stands at one place is unique. The runs
   of the others are cut out as segments (a Bloom filter of at most 8 MB holds their anchors; what it lets through by chance
   changes no result): all places of a window meet under its anchor.
3. Equal segments are merged with their count before the exchange. Windows of a merged segment are repeated.
4. The different segments of an anchor go to one shard, which is sorted by ``suffix_sort``, with its queues on disk beyond
   their share of memory. An anchor whose different segments have more bytes than a shard may (a passage in very many
   contexts) is split: windows whose first and last GRAM bytes stand together at one place only are unique; of the others,
   each task sends one of each kind to the shard that their ends deal them to, which is sorted in the same way. So no shard
   grows with a hot passage.
5. The windows' bytes are merged per text and cut out of each document.

What goes from a text hangs on its content alone, so rows with equal texts share one result.

Defined cases: null text counts as empty; texts shorter than ``depth`` keep everything; rows that repeat are removed in
full if long enough; an empty table gives an empty result; other columns pass through, and a column named like a result
is replaced by it. Texts may hold any bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.bloom import ODD, build_filter, in_filter, mix
from quantframe.llm.common import materialise, utf8
from quantframe.llm.suffix_sort import BREAK, END, FIRST, repeated

RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
DEPTH, GRAM = 200, 64
CHUNK_BYTES, SHARD_BYTES, PART_BYTES = 2 << 20, 3 << 19, 1 << 16
HOT = 1000


def grams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place, by doubling. Chance collisions only add candidates."""
    h, span = data.astype(np.uint64) + np.uint64(1), 1
    while span < GRAM:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + h[span:]
        span *= 2
    return mix(h).view(np.int64)


def sliding(h: np.ndarray, w: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each w consecutive values, by doubling."""
    m, span = h, 1
    while 2 * span <= w:
        m, span = least(m[:-span], m[span:]), 2 * span
    n = len(h) - w + 1
    return least(m[:n], m[w - span : w - span + n])


def parts(values: list[memoryview]) -> Iterator[tuple[int, list[memoryview]]]:
    """Consecutive texts of PART_BYTES together, or one longer text, with the number of the first."""
    first, size = 0, 0
    for k, v in enumerate(values):
        if k > first and size + len(v) > PART_BYTES:
            yield first, values[first:k]
            first, size = k, 0
        size += len(v)
    if first < len(values):
        yield first, values[first:]


class Runs:
    """The runs of windows with one anchor, the least gram hash in the window, in texts laid end to end."""

    def __init__(self, values: list[memoryview], depth: int):
        self.data, size = np.frombuffer(b"".join(values), np.uint8), np.fromiter(map(len, values), np.int64, len(values))
        self.ends = np.cumsum(size)
        windows, w = np.maximum(size - depth + 1, 0), depth - GRAM + 1
        if not windows.any():
            self.anchor = self.places = np.zeros(0, np.int64)
            return
        inside = np.repeat(np.tile([True, False], len(size)), np.column_stack([windows, size - windows]).ravel())[: len(self.data) - depth + 1]
        h = grams(self.data)
        a = sliding(h, w, np.minimum)
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (inside[1:] != inside[:-1])))
        n, held = np.diff(np.append(first, len(a))), inside[first]
        self.first, self.n, self.anchor = first[held], n[held], a[first[held]]
        # a gram is an anchor if it is the greatest among the anchors of the windows over it
        lowest = np.full(w - 1, np.iinfo(np.int64).min)
        at = np.flatnonzero(sliding(np.concatenate([lowest, np.where(inside, a, lowest[0]), lowest]), w, np.maximum) == h)
        self.places = h[at]
        order = np.argsort(self.places, kind="stable")
        again = (self.places[order][1:] == self.places[order][:-1]) & (np.diff(at[order]) <= w)
        self.own = np.isin(self.anchor, self.places[order][1:][again]) if again.any() else np.zeros(len(self.anchor), bool)


def views(column: pa.Array) -> list[memoryview]:
    return [memoryview(v.as_buffer()) for v in column]


def anchored(depth: int):
    """The function for mapInArrow: bytes -> anchor, places (2 stands for more than one), for each batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Runs(values, depth).places for _, values in parts(views(batch.column(0)))]
            a, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": a, "places": np.minimum(2, n)})

    return count


def segmented(bits: np.ndarray, depth: int):
    """The function for mapInArrow: (digest, bytes) -> anchor, digest, start, own (the anchor stands there twice), segment.

    A segment is a run of windows whose anchor the filter may hold.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"anchor": [], "digest": [], "start": [], "own": [], "segment": []}
            size = 0
            for k, values in parts(views(batch.column(1))):
                runs = Runs(values, depth)
                hit = np.flatnonzero(in_filter(bits, runs.anchor.view(np.uint64)))
                if not len(hit):
                    continue
                data, start = runs.data.tobytes(), runs.first[hit]
                text = np.searchsorted(runs.ends, start, side="right")
                segments = [data[s:e] for s, e in zip(start.tolist(), (start + runs.n[hit] + depth - 1).tolist())]
                size += sum(map(len, segments))
                out["segment"] += segments
                out["anchor"].append(runs.anchor[hit])
                out["digest"].append(k + text)
                out["start"].append(start - np.append(0, runs.ends)[text])
                out["own"].append(runs.own[hit])
                if size > CHUNK_BYTES:
                    yield segment_rows(batch, out)
                    out, size = {c: [] for c in out}, 0
            yield segment_rows(batch, out)

    return cut


def segment_rows(batch: pa.RecordBatch, out: dict[str, list]) -> pa.RecordBatch:
    column = {c: np.concatenate([np.zeros(0, np.int64), *out[c]]).astype(np.int64) for c in ("anchor", "digest", "start", "own")}
    return pa.RecordBatch.from_arrays([pa.array(column["anchor"]), batch.column(0).take(pa.array(column["digest"])), pa.array(column["start"]), pa.array(column["own"] > 0), pa.array(out["segment"], pa.binary())], schema=SEGMENT_TYPE)


SEGMENT_TYPE = pa.schema([("anchor", pa.int64()), ("digest", pa.binary()), ("start", pa.int64()), ("own", pa.bool_()), ("segment", pa.binary())])
SPAN_TYPE = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
SPANS = "array<struct<low: long, high: long>>"
SEGMENT = "segment_id binary, segment binary, anchor long"


def spans(starts: np.ndarray, depth: int) -> list[dict]:
    """Windows' starts, in order -> the byte ranges that they cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > depth) + 1
    low, high = starts[np.append(0, cut)], starts[np.append(cut, len(starts)) - 1] + depth
    return [{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist())]


def shard_sorted(depth: int, memory: int):
    """The function for mapInArrow over one shard (segment_id, at, segment): each segment's repeated byte ranges, ``at`` added."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ats, sizes, symbols = [], [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            ats += batch.column(1).to_pylist()
            for value in batch.column(2):
                data = np.frombuffer(value.as_buffer(), np.uint8)
                symbols += [data.astype(np.int16) + FIRST, np.array([BREAK], np.int16)]
                sizes.append(len(data))
        if not ids:
            return
        text = np.concatenate([*symbols, np.array([END], np.int16)])
        symbols.clear()
        marks, place = repeated(text, depth, memory), 0
        out: dict[str, list] = {"segment_id": ids, "spans": []}
        for at, size in zip(ats, sizes):
            # a window never reaches the break after its segment
            out["spans"].append(spans(at + np.flatnonzero(marks[place : place + size - depth + 1]), depth))
            place += size + 1
        yield pa.RecordBatch.from_pydict(out, pa.schema([("segment_id", pa.binary()), ("spans", SPAN_TYPE)]))

    return sort


def sorted_shards(segments: DataFrame, key: str, total: int, depth: int, shard_bytes: int, memory: int) -> DataFrame:
    """segments (segment_id, at, segment, key), of total bytes, dealt by key to shards of about shard_bytes and sorted."""
    dealt = segments.repartition(max(1, int(total // shard_bytes) + 1), key).select("segment_id", "at", "segment")
    return dealt.mapInArrow(shard_sorted(depth, memory), f"segment_id binary, spans {SPANS}")


def with_anchor(bits: np.ndarray, wanted: bool = True):
    """The function for mapInArrow that keeps the rows whose anchor, the third column, the filter may hold (or can't)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(bits, batch.column(2).to_numpy().view(np.uint64)) == wanted))

    return keep


def end_keys(data: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the first and last GRAM bytes of each window."""
    h = grams(data).view(np.uint64)
    n = len(data) - depth + 1
    return mix(h[:n] * ODD + h[depth - GRAM : depth - GRAM + n])


def keyed(depth: int):
    """The function for mapInArrow: segment -> key, places of its windows' ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [end_keys(np.frombuffer(v.as_buffer(), np.uint8), depth) for v in batch.column(0)]
            key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "places": np.minimum(2, n)})

    return count


def windows_of(bits: np.ndarray, depth: int):
    """The function for mapInArrow over (segment_id, segment): the windows whose ends the filter may hold.

    A window that the task has seen is repeated: its place goes out as known. The first one of its kind goes to a shard.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = end_keys(np.frombuffer(value, np.uint8), depth)
                out, again = [], []
                for k in np.flatnonzero(in_filter(bits, keys)).tolist():
                    window = value[k : k + depth]
                    first = seen.get(window)
                    if first is None:
                        seen[window] = (name, k)
                        out.append((name, None, k, int(keys[k].view(np.int64)), window))
                    else:
                        again.append(k)
                        if first:
                            out.append((first[0], spans(np.array(first[1:]), depth), None, None, None))
                            seen[window] = ()
                out.append((name, spans(np.array(again, np.int64), depth), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), WINDOW_TYPE.types)], schema=WINDOW_TYPE)
                if len(seen) > SEEN:
                    seen.clear()

    return split


SEEN = 20_000
WINDOW_TYPE = pa.schema([("segment_id", pa.binary()), ("spans", SPAN_TYPE), ("at", pa.int64()), ("key", pa.int64()), ("segment", pa.binary())])


def crowd_spans(crowd: DataFrame, depth: int, shard_bytes: int, memory: int) -> DataFrame:
    """crowd (segment_id, segment), of anchors with too many bytes for a shard: their windows are dealt by both their ends."""
    keys = crowd.select("segment").mapInArrow(keyed(depth), "key long, places long").groupBy("key").agg(F.sum("places").alias("places"))
    bits = build_filter(materialise(keys.filter("places > 1").select("key"), "window-ends"))
    windows = materialise(crowd.select("segment_id", "segment").mapInArrow(windows_of(bits, depth), f"segment_id binary, spans {SPANS}, at long, key long, segment binary"), "windows")
    sent = windows.filter("segment IS NOT NULL")
    return windows.filter("spans IS NOT NULL").select("segment_id", "spans").unionByName(sorted_shards(sent, "key", sent.count() * depth, depth, shard_bytes, memory))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, list of lists of byte ranges) -> digest and its ranges, joined and in order."""
    for batch in batches:
        out = []
        for ranges in batch.column(1).to_pylist():
            joined: list[dict] = []
            for r in sorted(ranges, key=lambda r: r["low"]):
                if joined and r["low"] <= joined[-1]["high"]:
                    joined[-1]["high"] = max(joined[-1]["high"], r["high"])
                else:
                    joined.append(dict(r))
            out.append(joined)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPAN_TYPE)], names=["digest", "spans"])


def repeated_spans(texts: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, memory: int = 128 << 20) -> DataFrame:
    """texts (digest, data) -> digest, spans: the byte ranges that go from each text, for texts that lose any."""
    counted = texts.select("data").mapInArrow(anchored(depth), "anchor long, places long")
    shared = materialise(counted.groupBy("anchor").agg(F.sum("places").alias("places")).filter("places > 1").select("anchor"), "anchors")
    segments = texts.mapInArrow(segmented(build_filter(shared), depth), "anchor long, digest binary, start long, own boolean, segment binary")
    segments = materialise(segments.withColumn("segment_id", F.unhex(F.md5("segment"))), "segments")
    distinct = segments.groupBy("anchor", "segment_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    distinct = materialise(distinct, "segments-distinct")
    per_anchor = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.length("segment").cast("long")).alias("bytes"), F.max("own").alias("own"))
    per_anchor = materialise(per_anchor.filter("kinds > 1 OR own"), "anchors-kinds")
    fits = F.col("bytes") <= shard_bytes
    crowded, total = per_anchor.agg(F.sum((~fits).cast("long")), F.sum(F.when(fits, F.col("bytes")))).first()
    copies = distinct.filter("n > 1").select("segment_id", F.array(F.struct(F.lit(0).cast("long").alias("low"), F.length("segment").cast("long").alias("high"))).alias("spans"))
    # a filter lets a few lone segments through, or a few more anchors into the crowd: all segments of an anchor go one way
    todo = distinct.select("segment_id", "segment", "anchor").mapInArrow(with_anchor(build_filter(per_anchor.select("anchor"))), SEGMENT)
    alone = todo
    if crowded:
        bits = build_filter(per_anchor.filter(~fits).select("anchor"))
        alone = todo.mapInArrow(with_anchor(bits, False), SEGMENT)
        copies = copies.unionByName(crowd_spans(todo.mapInArrow(with_anchor(bits), SEGMENT), depth, shard_bytes, memory))
    found = copies.unionByName(sorted_shards(alone.withColumn("at", F.lit(0).cast("long")), "anchor", total or 0, depth, shard_bytes, memory))
    found = materialise(found.filter(F.size("spans") > 0), "segment-spans")
    return materialise(placed_spans(segments, distinct, found).mapInArrow(merged, f"digest binary, spans {SPANS}"), "removed-spans")


def placed_spans(segments: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """digest, spans: of each text, all found ranges of its segments.

    The ranges of segments with over 1/HOT of all places, fewer than HOT, are broadcast; the rest meet in a shuffle join.
    """
    most = (distinct.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = found.join(F.broadcast(distinct.filter(F.col("n") > most).select("segment_id")), "segment_id", "left_semi")
    hot = hot.groupBy("segment_id").agg(F.flatten(F.collect_list("spans")).alias("hot_spans"))
    rows = segments.select("digest", "start", "segment_id").distinct().join(F.broadcast(hot), "segment_id", "left")
    # a hot place has its answer: a key of its own, longer than any segment_id, keeps it from meeting its like in one task
    rows = rows.withColumn("segment_id", F.when(F.col("hot_spans").isNull(), F.col("segment_id")).otherwise(F.encode(F.concat(F.hex("digest"), F.col("start").cast("string")), "UTF-8")))
    rows = rows.join(found.hint("merge"), "segment_id", "left").withColumn("spans", F.coalesce("hot_spans", "spans")).filter("spans IS NOT NULL")
    moved = F.transform("spans", lambda s: F.struct((s["low"] + F.col("start")).alias("low"), (s["high"] + F.col("start")).alias("high")))
    return rows.select("digest", moved.alias("spans")).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # of one text


def kept_bytes(data: bytes, ranges) -> bytes:
    if ranges is None or not len(ranges):
        return data
    out, at = [], 0
    for r in ranges:
        out.append(data[at : r["low"]])
        at = r["high"]
    return b"".join([*out, data[at:]])


def cut_out(data: pd.Series, ranges: pd.Series) -> pd.Series:
    return pd.Series([kept_bytes(d, r) for d, r in zip(data, ranges)], dtype=object)


def with_spans(docs: DataFrame, text_col: str, carried: list[str], **options) -> DataFrame:
    """row, data and spans (null where nothing goes)."""
    rows = docs.select(F.struct(*carried).alias("row"), utf8(F.col(text_col)).alias("data"))
    rows = rows.withColumn("digest", F.unhex(F.md5("data")))
    removed = repeated_spans(rows.select("digest", "data"), **options)
    counts = rows.select("digest", "row").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.filter("n > 1"), "text-counts")
    # a text that over 1/HOT of the rows share: fewer than HOT texts, each of which goes whole or not at all
    most = docs.count() / HOT
    hot = counts.filter(F.col("n") > most).select("digest").join(removed, "digest", "left").select("digest", F.col("spans").alias("hot_spans"), F.lit(True).alias("hot"))
    found = rows.join(F.broadcast(hot), "digest", "left")
    found = found.withColumn("at", F.when(F.col("hot").isNull(), F.concat(F.lit("d"), F.hex("digest"))).otherwise(F.concat(F.lit("h"), F.monotonically_increasing_id().cast("string"))))
    cold = removed.select(F.concat(F.lit("d"), F.hex("digest")).alias("at"), "spans")
    return found.join(cold.hint("merge"), "at", "left").select("row", "data", F.coalesce("hot_spans", "spans").alias("spans"))


def cut_udf():
    return F.pandas_udf(cut_out, T.BinaryType())


def remove_repeats(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with its text cut; bytes of a character that is cut in part stay as they are."""
    found = with_spans(docs, text_col, docs.columns, **options)
    return found.select(*[cut_udf()("data", "spans").cast("string").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def measure(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """docs (or the columns of ``carry``) with n_bytes, n_removed, n_spans and kept_sha256."""
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    found = with_spans(docs, text_col, carried, **options).withColumn("kept", cut_udf()("data", "spans"))
    n_spans = F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans"))
    return found.select("row.*", F.length("data").cast("long").alias("n_bytes"), (F.length("data") - F.length("kept")).cast("long").alias("n_removed"), n_spans.cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), carry=["doc_id"])

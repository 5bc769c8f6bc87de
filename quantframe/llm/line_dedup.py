"""Line deduplication: repeated lines are found in arrays behind a sharded minimal perfect hash, not by joining lines.

A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at least ``least`` code
points that stand in at least ``min_docs`` documents lose all their lines, except in the document with the largest id
that holds them.

1. Count: each document gives each of its long keys once, as 128 hash bits; one aggregate (combined before its exchange)
   counts documents and takes the largest id per key.
2. Index: the hashes counted often enough are dealt by their leading bits to shards of about ``shard_keys``, and one
   task a shard builds a minimal perfect hash: levels of bits, in each of which a key owns a bit that no other key of that
   level hit, those that clash trying the next level. A key's slot is the number of bits set before its own. Three arrays
   are kept by slot: the other 64 hash bits as the fingerprint, the count, and the id that keeps its lines.
3. Probe: documents look up their lines' slots and compare fingerprints. The keys of most documents, as many as
   ``broadcast_bytes`` hold, are broadcast. Keys beyond that, each of which then has a share of all lines below that of
   any in the broadcast, stay in their shards: the hashes of lines are dealt to the shards as they were, probe there, and
   the hits go back to their documents.

Two keys are taken for one only if 128 hash bits agree; a key that isn't indexed passes for one with odds of 2^-64.

Defined cases: a null or empty text is one empty line; a null id counts as a document, below any other id; rows that repeat
are documents of their own, and all rows with the largest id keep their lines; repeats of a line within its keeping
document stay; an empty table gives an empty result; other columns pass through, and one named like a result is replaced
by it. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.bloom import ODD, mix
from quantframe.llm.common import materialise, sliced, utf8

RESULTS = ("n_lines", "n_dropped", "kept_text", "kept_sha256")
BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of UTF-8 that begin no code point.
INNER = bytes(range(0x80, 0xC0))
NO_ID = -(2**63)
#: Bits of a level for each key that reaches it.
GAMMA = 2
#: Of the three arrays and the hash, for each key.
KEY_BYTES = 28
INDEX = "shard int, keys long, bits binary, sizes array<long>, prints binary, counts binary, keepers binary"


def long_keys(text: bytes, least: int) -> tuple[list[bytes], list[int], bytes]:
    """A text's lines, the places of those with a key of ``least`` code points, and 16 hash bytes of each of these keys."""
    lines, places, hashes = text.split(b"\n"), [], []
    for i, line in enumerate(lines):
        if len(line) >= least:
            key = line.strip(BLANK).lower()
            if len(key) >= least and len(key.translate(None, INNER)) >= least:
                places.append(i)
                hashes.append(xxhash.xxh3_128_digest(key))
    return lines, places, b"".join(hashes)


def halves(hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(hashes, "<u8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * int(ODD) & 0xFFFFFFFFFFFFFFFF)
    return (mix(high ^ mix(low + salt)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers the distinct 128-bit keys it was built from 0 to n - 1."""

    def __init__(self, words: np.ndarray, sizes: list[int]):
        self.words, self.sizes = words, sizes
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels, sizes = [], []
        while len(high):
            size = -(-GAMMA * len(high) // 64) * 64
            at = place(high, low, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            high, low = high[~alone], low[~alone]
        return cls(np.concatenate(levels) if levels else np.zeros(0, "<u8"), sizes)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each key; of one that wasn't put in, any slot or -1."""
        out = np.full(len(high), -1, np.int64)
        left, first = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            at = place(high[left], low[left], level, size) + first
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left, first = left[~hit], first + size
        return out


class Shard:
    """A shard of the index: slots, and fingerprint, count and keeping id by slot."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(np.frombuffer(row["bits"], "<u8"), row["sizes"])
        self.prints = np.frombuffer(row["prints"], "<u8")
        self.counts = np.frombuffer(row["counts"], f"<u{len(row['counts']) // max(1, row['keys'])}")
        self.keepers = np.frombuffer(row["keepers"], "<i8")

    def look_up(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold each key (0: not in the index), and the id that keeps its lines."""
        slot = self.hash.slots(high, low)
        hit = (slot >= 0) & (self.prints[slot] == low)
        return np.where(hit, self.counts[slot], 0), self.keepers[slot]


def shard_of(high: np.ndarray, bits: int) -> np.ndarray:
    return (high >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), np.int64)


class Index:
    """Shards by the leading bits of the hash, all in memory."""

    def __init__(self, rows: list[dict], bits: int):
        self.bits, self.shards = bits, {r["shard"]: Shard(r) for r in rows}

    def look_up(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, keepers, of = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64), shard_of(high, self.bits)
        for k in np.unique(of).tolist():
            if k in self.shards:
                at = np.flatnonzero(of == k)
                counts[at], keepers[at] = self.shards[k].look_up(high[at], low[at])
        return counts, keepers


def counted(least: int):
    """The function for mapInArrow: (id, text) -> high, low, id: a document's distinct long keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced(batch, "text"):
                found, numbers = [], []
                for id_, text in zip(some.column("id").to_pylist(), some.column("text")):
                    hashes = long_keys(text.as_py(), least)[2]
                    own = {hashes[i : i + 16] for i in range(0, len(hashes), 16)}
                    found += own
                    numbers.append((id_, len(own)))
                high, low = halves(b"".join(found))
                ids = np.repeat(np.array([i for i, _ in numbers], np.int64), [n for _, n in numbers])
                yield pa.RecordBatch.from_pydict({"high": high.view(np.int64), "low": low.view(np.int64), "id": ids})

    return count


def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function for mapInArrow over (shard, high, low, n, keeper) sorted by shard: one row of the index for each."""
    held: list[pa.RecordBatch] = []

    def built():
        t = pa.Table.from_batches(held)
        high, low, n, keeper = (t.column(c).to_numpy() for c in ("high", "low", "n", "keeper"))
        high, low = high.view(np.uint64), low.view(np.uint64)
        mph = PerfectHash.of(high, low)
        order = np.argsort(mph.slots(high, low))
        width = np.min_scalar_type(int(n.max())).itemsize
        row = {"shard": t.column("shard")[0].as_py(), "keys": len(n), "bits": mph.words.tobytes(), "sizes": mph.sizes, "prints": low[order].tobytes(), "counts": n[order].astype(f"<u{width}").tobytes(), "keepers": keeper[order].astype("<i8").tobytes()}
        held.clear()
        return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("keys", pa.int64()), ("bits", pa.binary()), ("sizes", pa.list_(pa.int64())), ("prints", pa.binary()), ("counts", pa.binary()), ("keepers", pa.binary())]))

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                if held and held[0].column("shard")[0].as_py() != shards[a]:
                    yield built()
                held.append(batch.slice(a, b - a))
    if held:
        yield built()


def build_index(repeated: DataFrame, shard_keys: int) -> tuple[DataFrame, int]:
    """repeated (high, low, n, keeper), read from a table -> the index, a row per shard, and the number of bits that tell the shard."""
    bits = max(0, (repeated.count() // shard_keys).bit_length())
    shard = F.shiftrightunsigned("high", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = repeated.select(shard.alias("shard"), "high", "low", "n", "keeper").repartition(2**bits, "shard").sortWithinPartitions("shard")
    return materialise(dealt.mapInArrow(indexed, INDEX), "line-index"), bits


def probed(index, least: int, min_docs: int, with_text: bool):
    """The function for mapInArrow: (row, id, text, more: hashes that other shards found) -> row and the results."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            for some in sliced(batch, "text"):
                found = [long_keys(t.as_py(), least) for t in some.column("text")]
                counts, keepers = own.look_up(*halves(b"".join(h for _, _, h in found)))
                drop = counts >= min_docs
                more = some.column("more").to_pylist() if "more" in some.schema.names else [None] * some.num_rows
                total, dropped, digests, texts, first = [], [], [], [], 0
                for id_, (lines, places, hashes), beyond in zip(some.column("id").to_pylist(), found, more):
                    last = first + len(places)
                    gone = {places[i] for i in np.flatnonzero(drop[first:last] & (keepers[first:last] != id_)).tolist()}
                    if beyond:
                        beyond = set(beyond)
                        gone |= {p for i, p in enumerate(places) if hashes[16 * i : 16 * i + 16] in beyond}
                    first = last
                    kept = b"\n".join([x for i, x in enumerate(lines) if i not in gone] if gone else lines)
                    total.append(len(lines))
                    dropped.append(len(gone))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept)
                out = [some.column("row"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())]
                names = ["row", "n_lines", "n_dropped", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(texts, pa.binary())] if with_text else out, names=[*names, "kept_text"] if with_text else names)

    return probe


def asked(index, least: int):
    """The function for mapInArrow: (id, digest, text) -> high, low, id, digest: the lines that the broadcast index doesn't hold."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            for some in sliced(batch, "text"):
                hashes = [long_keys(t.as_py(), least)[2] for t in some.column("text")]
                high, low = halves(b"".join(hashes))
                left = np.flatnonzero(own.look_up(high, low)[0] == 0)
                row = np.repeat(np.arange(some.num_rows), [len(h) // 16 for h in hashes])[left]
                yield pa.RecordBatch.from_arrays([pa.array(high[left].view(np.int64)), pa.array(low[left].view(np.int64)), some.column("id").take(pa.array(row)), some.column("digest").take(pa.array(row))], names=["high", "low", "id", "digest"])

    return ask


def answered(min_docs: int):
    """The function for mapInArrow over a shard's index row and then its questions: (id, digest, hash) of lines to drop."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            of = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                some = batch.slice(a, b - a)
                if b > a and of[a] != now:
                    now, row = int(of[a]), some.slice(0, 1).to_pylist()[0]
                    shard = Shard(row) if row["bits"] is not None else None
                    some = some.slice(1) if shard else some
                if shard is None or not some.num_rows:
                    continue
                high, low, ids = (some.column(c).to_numpy() for c in ("high", "low", "id"))
                counts, keepers = shard.look_up(high.view(np.uint64), low.view(np.uint64))
                drop = np.flatnonzero((counts >= min_docs) & (keepers != ids))
                hashes = np.stack([high[drop], low[drop]], 1).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids[drop]), some.column("digest").take(pa.array(drop)), pa.array([hashes[i : i + 16] for i in range(0, len(hashes), 16)], pa.binary())], names=["id", "digest", "hash"])

    return answer


def from_shards(rows: DataFrame, hot, index: DataFrame, bits: int, least: int, min_docs: int) -> DataFrame:
    """id, digest, more: the hashes to drop that the index beyond the broadcast holds, for documents with any."""
    digest = F.sha2("text", 256).alias("digest")
    asks = rows.select("id", digest, "text").mapInArrow(asked(hot, least), "high long, low long, id long, digest string").distinct()
    shard = F.shiftrightunsigned("high", 64 - bits).cast("int") if bits else F.lit(0)
    none = {f.name: F.lit(None).cast(f.dataType) for f in index.schema.fields if f.name != "shard"}
    asks = asks.select(shard.alias("shard"), F.lit(1).alias("turn"), *[v.alias(k) for k, v in none.items()], "high", "low", "id", "digest")
    first = index.select("shard", F.lit(0).alias("turn"), *none, F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("id"), F.lit("").alias("digest"))
    dealt = first.unionByName(asks).repartition(2**bits, "shard").sortWithinPartitions("shard", "turn")
    hits = dealt.mapInArrow(answered(min_docs), "id long, digest string, hash binary")
    return hits.groupBy("id", "digest").agg(F.collect_list("hash").alias("more"))  # one text's lines at most: equal rows ask once


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, min_docs: int = 3, with_text: bool = True, broadcast_bytes: int = 64 << 20, shard_keys: int = 1 << 19) -> DataFrame:
    """docs with n_lines, n_dropped, kept_sha256 and (with_text) kept_text; see the module for the method and the defined cases."""
    carried = [c for c in docs.columns if c.lower() not in RESULTS]
    # copies of the inputs' fields: Arrow functions see the id as a long and the text as bytes, whatever columns are carried
    rows = docs.select(F.struct(*carried).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), utf8(F.col(text_col)).alias("text"))
    lines = rows.select("id", "text").mapInArrow(counted(least), "high long, low long, id long")
    repeated = materialise(lines.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs), "repeated-lines")
    scales = sorted(repeated.groupBy(F.floor(F.log2("n")).alias("scale")).agg(F.count(F.lit(1)).alias("keys")).collect(), reverse=True)  # a row per power of two
    room, least_hot = broadcast_bytes // KEY_BYTES, 2**63 - 1
    for r in scales:
        room -= r["keys"]
        if room < 0:
            break
        least_hot = 2 ** r["scale"]
    whole = room >= 0
    hot_index, hot_bits = build_index(repeated if whole else repeated.filter(F.col("n") >= least_hot), shard_keys)
    hot = docs.sparkSession.sparkContext.broadcast(Index([r.asDict() for r in hot_index.collect()], hot_bits))  # broadcast_bytes at most
    schema = [rows.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if not whole:
        index, bits = build_index(repeated.filter(F.col("n") < least_hot), shard_keys)
        more = materialise(from_shards(rows, hot, index, bits, least, min_docs), "line-hits")
        rows = rows.withColumn("digest", F.sha2("text", 256)).join(more, ["id", "digest"], "left").select("row", "id", "text", "more")
    out = rows.mapInArrow(probed(hot, least, min_docs, with_text), T.StructType([*schema, T.StructField("kept_text", T.BinaryType())] if with_text else schema))
    kept = [F.decode("kept_text", "UTF-8").alias("kept_text")] if with_text else []
    return out.select("row.*", "n_lines", "n_dropped", "kept_sha256", *kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_text=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line, len(x) AS n_lines FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN g USING (key) GROUP BY doc_id
"""

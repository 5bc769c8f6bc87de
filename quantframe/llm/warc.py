"""WARC archives with a two-level capture index.

Writing: each task writes its records, one gzip member each, to archive files in a shared folder. Of records with equal
payloads the one with the largest id is the response; the others are revisits that refer to it and carry no payload.

Index: captures are sorted by key (the URL with its host reversed, then the capture id) over all archives. Each task
writes a contiguous range of keys as a shard: lines in compressed blocks of ``block_lines``, and beside them the shard's
directory with the first key, place and length of each block. The driver keeps the first key of each shard only.

Lookup: wanted keys are dealt and sorted by the same ranges. A task binary-searches the shards for its key, then the
shard's directory, reads that one block by range, and binary-searches it for the capture; the capture's line names the
archive, place and length of the record, which is read by range and checked against its digest.

Files carry the attempt that wrote them, and only the files of finished tasks are named in the tables that follow, so a
task that runs again can't mix its output with that of a lost one. Files are written and read through pyarrow's file
systems, so the shared folder may be of any kind that it knows.

Defined cases: null html is an empty payload, null url an empty key; ids may be null or repeat (each row is a record of
its own, and a lookup of a key gives all its captures); of equal payloads whose largest id repeats, all rows with that
id are responses; an empty table gives an empty archive; columns other than id, url and html aren't archived.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.common import materialise, shared_path, utf8

CAPTURE = "key string, archive string, place long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
CRLF = b"\r\n"


def url_key(url: str | None) -> str:
    """http://www.example.com/a?b -> com,example,www)/a?b; scheme, case of the host, and fragment don't count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    at = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return ",".join(reversed(host.split("."))) + at + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sorts by url key, then id; ids in a fixed width keep the order of strings that of numbers."""
    name = url_key(url).encode("unicode_escape").decode("ascii").replace(" ", "%20")
    return f"{name} " + ("-" if page_id is None else f"{page_id + 2**63:020d}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, size: int, revisit: bool) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP header, and so the length of the payload, only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode('ascii')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF, 3, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's gzip member -> its WARC header, HTTP header and payload."""
    head, _, rest = zlib.decompress(data, 31).partition(CRLF + CRLF)
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def new_name(folder: str, kind: str) -> str:
    task = TaskContext.get()
    return f"{folder}/{kind}-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def written(folder: str, most_bytes: int):
    """The function for mapInArrow over (page_id, url, payload, sha1, keep, n) that writes archives and gives captures."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        out, name, place = None, "", 0
        try:
            for batch in batches:
                rows: dict[str, list] = {"key": [], "archive": [], "place": [], "length": []}
                for page_id, url, payload, sha1, keep in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or place >= most_bytes:
                        if out:
                            out.close()
                        name, place = new_name("", "archive")[1:] + ".warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(page_id, url, payload, sha1, keep, len(payload), page_id != keep)
                    out.write(data)
                    for k, v in zip(rows, (capture_key(url, page_id), name, place, len(data))):
                        rows[k].append(v)
                    place += len(data)
                yield pa.RecordBatch.from_pydict(rows)
        finally:
            if out:
                out.close()

    return write


def with_responses(pages: DataFrame, id_col: str, url_col: str, html_col: str, salts: int = 32) -> DataFrame:
    """page_id, url, payload, sha1 and keep: the largest id with that payload.

    Equal payloads meet by (digest, salt) first, then by digest. Digests with over 1/1000 of the rows are fewer than 1000
    and looked up by broadcast, the others by a shuffle join, in which each key has 1/1000 of the rows at most.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), utf8(F.col(html_col)).alias("payload"))
    keyed = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    salted = keyed.groupBy("sha1", F.pmod(F.xxhash64("page_id"), F.lit(salts)).alias("salt")).agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    groups = materialise(salted.groupBy("sha1").agg(F.max("keep").alias("keep"), F.sum("n").alias("n")).filter("n > 1"), "warc-groups")
    hot_size = pages.count() / 1000
    hot = groups.filter(F.col("n") > hot_size).select("sha1", F.col("keep").alias("hot_keep"), F.lit(True).alias("hot"))
    cold = groups.filter(F.col("n") <= hot_size).select(F.concat(F.lit("d"), F.hex("sha1")).alias("at"), F.col("keep").alias("cold_keep"))
    found = keyed.join(F.broadcast(hot), "sha1", "left")
    found = found.withColumn("at", F.when(F.col("hot").isNull(), F.concat(F.lit("d"), F.hex("sha1"))).otherwise(F.concat(F.lit("h"), F.xxhash64("page_id", "url").cast("string"))))
    return found.join(cold, "at", "left").select("page_id", "url", "payload", "sha1", F.coalesce("hot_keep", "cold_keep", "page_id").alias("keep"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_bytes: int = 1 << 30) -> DataFrame:
    """Write all pages; gives the captures (key, archive, place, length), as a table."""
    return materialise(with_responses(pages, id_col, url_col, html_col).mapInArrow(written(folder, most_bytes), CAPTURE), "captures")


def sharded(folder: str, block_lines: int):
    """The function for mapInArrow over sorted captures that writes one index shard and gives its first key and name."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        name, out, lines, directory, place = "", None, [], [], 0

        def flush() -> None:
            nonlocal place
            data = gzip.compress("".join(lines).encode(), 6, mtime=0)
            out.write(data)
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{place}\t{len(data)}\n")
            place += len(data)
            lines.clear()

        for batch in batches:
            for key, archive, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = new_name("", "index")[1:]
                    out = system.open_output_stream(f"{root}/{name}.gz", compression=None)
                lines.append(f"{key}\t{archive}\t{at}\t{length}\n")
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with system.open_output_stream(f"{root}/{name}.dir") as d:
            d.write("".join(directory).encode())
        yield pa.RecordBatch.from_pydict({"first": [directory[0].split("\t")[0]], "shard": [name]})

    return shard


def build_index(captures: DataFrame, folder: str, block_lines: int = 512, shards: int | None = None) -> list[tuple[str, str]]:
    """Sort all captures into shards; gives (first key, name) of each, in order of keys."""
    shards = shards or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = captures.select("key", "archive", "place", "length").repartitionByRange(shards, "key", "archive", "place").sortWithinPartitions("key", "archive", "place")
    rows = materialise(parts.mapInArrow(sharded(folder, block_lines), "first string, shard string"), "index-shards").collect()  # a row per shard
    return sorted((r["first"], r["shard"]) for r in rows)


class Index:
    """One task's view of the index: it holds the shards' first keys, one shard's directory and one block."""

    def __init__(self, folder: str, tops: list[tuple[str, str]]):
        self.system, self.root = opened(folder)
        self.tops, self.firsts, self.shard, self.block = tops, [t[0] for t in tops], None, None
        self.files: dict[str, object] = {}

    def range(self, name: str, place: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) > 64:
                for f in self.files.values():
                    f.close()
                self.files.clear()
            self.files[name] = self.system.open_input_file(f"{self.root}/{name}")
        return self.files[name].read_at(length, place)

    def load(self, shard: int) -> None:
        if self.shard != shard:
            with self.system.open_input_stream(f"{self.root}/{self.tops[shard][1]}.dir", compression=None) as d:
                self.directory = [x.split("\t") for x in d.read().decode().splitlines()]
            self.starts, self.shard, self.block = [d[0] for d in self.directory], shard, None

    def lines(self, block: int) -> list[list[str]]:
        if self.block != block:
            _, place, length = self.directory[block]
            text = zlib.decompress(self.range(f"{self.tops[self.shard][1]}.gz", int(place), int(length)), 31).decode()
            self.entries, self.block = [x.split("\t") for x in text.splitlines()], block
            self.keys = [e[0] for e in self.entries]
        return self.entries

    def find(self, key: str) -> list[list[str]]:
        """All captures of the key: of the block before the first that starts at or after it, and on while they match."""
        found: list[list[str]] = []
        shard = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while shard < len(self.tops) and self.firsts[shard] <= key:
            self.load(shard)
            block = max(0, bisect.bisect_left(self.starts, key) - 1)
            while block < len(self.starts) and self.starts[block] <= key:
                entries = self.lines(block)
                i = bisect.bisect_left(self.keys, key)
                while i < len(entries) and self.keys[i] == key:
                    found.append(entries[i])
                    i += 1
                block += 1
            shard += 1
        return found


def looked_up(folder: str, tops: list[tuple[str, str]]):
    """The function for mapInArrow over sorted keys that reads each capture's record."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, tops)
        for batch in batches:
            found = [e for key in batch.column(0).to_pylist() for e in index.find(key)]
            rows = [None] * len(found)
            for i in sorted(range(len(found)), key=lambda i: (found[i][1], int(found[i][2]))):  # archives from front to back
                _, archive, place, length = found[i]
                warc, http, payload = parse(index.range(archive, int(place), int(length)))
                sha1, revisit = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"] == "revisit"
                if not revisit and (digest(payload) != sha1 or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"{archive} at {place}: the payload isn't what was written")
                page_id, refers = (warc.get(k, "<urn:page:>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
                rows[i] = (int(page_id) if page_id else None, int(http["Content-Length"]), sha1, warc["WARC-Type"], int(refers) if refers else None)
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return look_up


def lookup(keys: DataFrame, folder: str, tops: list[tuple[str, str]]) -> DataFrame:
    """Records of the wanted captures; keys: one column of capture keys."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = keys.select(F.col(keys.columns[0]).alias("key")).distinct().repartitionByRange(parts, "key").sortWithinPartitions("key")
    return wanted.mapInArrow(looked_up(folder, tops), RECORD)


def keys_of(urls: pd.Series, ids: pd.Series) -> pd.Series:
    return pd.Series([capture_key(u, None if i is None else int(i)) for u, i in zip(urls, ids)])


def capture_keys(url: str, page_id: str) -> Column:
    """The capture key of each row; ids travel as strings, since nulls would turn them into floats."""
    return F.pandas_udf(keys_of, T.StringType())(F.col(url), F.col(page_id).cast("string"))


def archive_and_index(pages: DataFrame, folder: str, block_lines: int = 512, **columns) -> list[tuple[str, str]]:
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    return build_index(write_archives(pages, folder, **columns), folder, block_lines)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_path(spark, "warc")
    tops = archive_and_index(pages, folder)
    return lookup(pages.select(capture_keys("url", "page_id")), folder, tops)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keep FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    ((instr('0123456789abcdef', substr(hex, 1 + (5 * i) // 4, 1)) - 1) * 16 + (CASE WHEN (5 * i) // 4 = 39 THEN 0 ELSE instr('0123456789abcdef', substr(hex, 2 + (5 * i) // 4, 1)) - 1 END))
    // (1 << (3 - (5 * i) % 4))) % 32)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM g
"""

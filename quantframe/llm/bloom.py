"""A Bloom filter of 64-bit hashes, built by Spark, for tasks that drop most rows early; an exact join follows its use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ODD = np.uint64(0x9E3779B97F4A7C15)
HASHES, LONGS = 4, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(h: np.ndarray, j: int, longs: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(h + np.uint64((j + 1) * int(ODD) & 0xFFFFFFFFFFFFFFFF))
    return ((x >> np.uint64(6)) % np.uint64(longs)).astype(np.int64), x & np.uint64(63)


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may have been put in: all that were, and a few others."""
    hit = np.ones(len(h), bool)
    for j in range(HASHES):
        place, bit = places(h, j, len(bits))
        hit &= (bits[place] >> bit) & np.uint64(1) == 1
    return hit


def build_filter(hashes: DataFrame, longs: int = LONGS) -> np.ndarray:
    """Filter of a column of 64-bit hashes; 8 MB at most, whatever their number (a fuller one only lets more rows pass)."""
    longs = min(longs, max(64, 1 << (hashes.count() // 4).bit_length()))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            found = [places(h, j, longs) for j in range(HASHES)]
            bit = np.uint64(1) << np.concatenate([f[1] for f in found])
            yield pa.RecordBatch.from_pydict({"place": np.concatenate([f[0] for f in found]), "bit": bit.view(np.int64)})

    told = hashes.mapInArrow(set_bits, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most ``longs`` rows
    bits = np.zeros(longs, np.uint64)
    bits[told["place"].to_numpy()] = told["bits"].to_numpy().view(np.uint64)
    return bits

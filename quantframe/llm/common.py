"""What the text operators share: tables between steps, text expressions, bounded parts of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.sources.shared import materialise, shared_path, shared_root  # noqa: F401  the text operators take them from here

#: ASCII white space of the contracts: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def utf8(text: Column) -> Column:
    return or_empty(text).cast("binary")


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.regexp_count(or_empty(text), F.lit(WORD)).cast("long")


def sliced(batch: pa.RecordBatch, text: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text, or one row."""
    lengths = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Recent(dict):
    """A cache of about ``most`` entries at most: those that weren't asked for while half as many others came in go, the others stay."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.before = most // 2, {}

    def __missing__(self, key):
        self[key] = value = self.before[key]
        return value

    def trim(self) -> None:
        """To be called where entries of before need not be in the newer half, such as between texts."""
        if len(self) > self.half:
            self.before = self.copy()
            self.clear()


def place_ranges(numbered: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of ``place``, which monotonically_increasing_id() gave the rows of a written table, with at most ``most`` rows each."""
    counts = sorted(numbered.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    ranges, low, room, last = [], None, most, 0
    for part, n in counts:
        at, last = part << 33, (part << 33) + n
        while at < last:
            low = at if low is None else low
            step = min(room, last - at)
            at, room = at + step, room - step
            if not room:
                ranges.append((low, at - 1))
                low, room = None, most
    return ranges if low is None else [*ranges, (low, last - 1)]

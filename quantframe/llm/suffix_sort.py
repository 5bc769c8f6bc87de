"""Induced suffix sorting of one shard in bulk steps, with common-prefix values carried along.

``repeated(text, depth)`` marks the positions whose next ``depth`` symbols also start somewhere else in the text. It
sorts suffixes to that depth:

1. suffixes are of type S (smaller than the next one) or L; an S after an L is a left-most S (LMS);
2. the LMS substrings are sorted by induction and named; the reduced string of names is sorted by rank doubling, as far
   as the depth needs;
3. the sorted LMS suffixes induce the L suffixes, from left to right, and those induce all S suffixes, from right to left.

Suffixes wait in one queue per first symbol: a priority queue whose smallest (or largest) symbol is taken as a whole, as
arrays. A queue entry is (position, common prefix with the entry before it). When the entries in memory exceed
``memory`` bytes, they move to a file per symbol, so the queues may be far larger than memory. The common prefix of two
induced neighbours is one more than the least common prefix between the suffixes that induced them.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

END, BREAK, FIRST = 0, 1, 2  # the last symbol, the one between segments, and that of byte 0
SYMBOLS = 258
PIECE = 1 << 18
SPAN = 7  # symbols in a packed number
PLACES = 1 << np.arange(9, 9 * SPAN, 9, dtype=np.int64)


class Queues:
    """First in, first out, for each symbol; entries move to disk beyond ``memory`` bytes."""

    ENTRY = np.dtype([("at", "<i8"), ("lcp", "<i2")])

    def __init__(self, memory: int):
        self.parts, self.held, self.memory, self.folder = [[] for _ in range(SYMBOLS)], 0, memory, None

    def put(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[symbol].append((at, lcp))
        self.held += len(at) * self.ENTRY.itemsize
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffix-queues-")
        for symbol, parts in enumerate(self.parts):
            if parts:
                with open(os.path.join(self.folder.name, str(symbol)), "ab") as out:
                    for at, lcp in parts:
                        entries = np.empty(len(at), self.ENTRY)
                        entries["at"], entries["lcp"] = at, lcp
                        entries.tofile(out)
                parts.clear()
        self.held = 0

    def take(self, symbol: int):
        """What the queue holds now, in order, in pieces of bounded size."""
        path = os.path.join(self.folder.name, str(symbol)) if self.folder else ""
        parts, self.parts[symbol] = self.parts[symbol], []
        self.held -= sum(len(p[0]) for p in parts) * self.ENTRY.itemsize
        if path and os.path.exists(path):
            os.rename(path, path + "-now")
            with open(path + "-now", "rb") as file:
                while len(entries := np.fromfile(file, self.ENTRY, PIECE)):
                    yield entries["at"].astype(np.int64), entries["lcp"].astype(np.int16)
            os.remove(path + "-now")
        if parts:
            at, lcp = (np.concatenate(x) for x in zip(*parts))
            for k in range(0, len(at), PIECE):
                yield at[k : k + PIECE], lcp[k : k + PIECE]

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low : high + 1]) for each pair, by a table of minima over powers of two."""
    table, span = [values], 1
    longest = int((high - low).max()) + 1 if len(low) else 1
    while 2 * span <= longest:
        table.append(np.minimum(table[-1][:-span], table[-1][span:]))
        span *= 2
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in np.unique(level):
        mine = level == k
        out[mine] = np.minimum(table[k][low[mine]], table[k][high[mine] - (1 << k) + 1])
    return out


class Induction:
    """One pass over the suffixes in order (or in reverse), in which each suffix induces the one before it in the text."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, depth: int, memory: int, into_s: bool, carry: bool):
        self.text, self.is_s, self.depth, self.into_s, self.carry = text, is_s, depth, into_s, carry
        self.queues, self.since = Queues(memory), np.full(SYMBOLS, depth, np.int16)

    def scan(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """at: the next suffixes in the order of the pass; lcp: of each with the one scanned before it."""
        source = np.flatnonzero(at > 0)
        before = at[source] - 1
        fits = self.is_s[before] == self.into_s
        source, before = source[fits], before[fits]
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        source, before, symbol = source[order], before[order], symbol[order]
        if self.carry and len(at):
            first = np.append(True, symbol[1:] != symbol[:-1])[: len(symbol)]
            low = np.where(first, 0, np.append(0, source[:-1] + 1)[: len(source)])
            common = range_minima(lcp, low, source)
            common[first] = np.minimum(common[first], self.since[symbol[first]])
            common = np.minimum(common + 1, self.depth).astype(np.int16)
            # for each symbol, the least common prefix after its last entry
            tail = np.minimum.accumulate(np.append(lcp, np.int16(self.depth))[::-1])[::-1]
            self.since = np.minimum(self.since, tail[0])
            last = np.append(first[1:], True)[: len(first)]
            self.since[symbol[last]] = tail[source[last] + 1]
        else:
            common = np.zeros(len(before), np.int16)
        for k, j in zip(*edges(symbol)):
            self.queues.put(int(symbol[k]), before[k:j], common[k:j])

    def drain(self, symbol: int):
        """Take the suffixes of this symbol's queue, which may grow while it is scanned."""
        first = True
        while True:
            some = False
            for at, lcp in self.queues.take(symbol):
                some = True
                if first:
                    lcp[0], first = 0, False
                self.scan(at, lcp)
                yield at, lcp
            if not some:
                return


def edges(symbol: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    return (np.append(0, cut).tolist(), np.append(cut, len(symbol)).tolist()) if len(symbol) else ([], [])


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last is."""
    step = np.append(np.sign(np.diff(text)), text.dtype.type(1))
    place = np.arange(len(text), dtype=np.int32)
    place[step == 0] = len(text) - 1
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def run_lengths(text: np.ndarray, depth: int) -> np.ndarray:
    place = np.arange(len(text), dtype=np.int32)
    ends = place.copy()
    ends[:-1][text[1:] == text[:-1]] = len(text)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    return np.minimum(ends - place + 1, depth).astype(np.int16)


def packed(text: np.ndarray) -> np.ndarray:
    """The SPAN symbols from each place, in order, in one number (9 bits each; zeros beyond the end)."""
    words = np.zeros(len(text), np.int64)
    for k in range(SPAN):
        words <<= 9
        words[: max(0, len(text) - k)] |= text[k:]
    return words


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, known: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of suffixes a[k] and b[k], depth at most; ``known`` symbols of it are known to agree."""
    out = np.zeros(len(a), np.int64) if known is None else known
    live = np.flatnonzero(out < depth)
    while len(live):
        differ = words[a[live] + out[live]] ^ words[b[live] + out[live]]
        whole = differ == 0
        out[live] += np.where(whole, SPAN, SPAN - 1 - np.searchsorted(PLACES, differ, side="right"))
        live = live[whole]
        live = live[out[live] < depth]
    return np.minimum(out, depth).astype(np.int16)


def alike(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the first size[k] symbols of a[k] and b[k] agree."""
    out, live, at = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        shift = 9 * (SPAN - np.minimum(SPAN, size[live] - at))
        same = words[a[live] + at] >> shift == words[b[live] + at] >> shift
        out[live] = same
        at += SPAN
        live = live[same & (size[live] > at)]
    return out


def induce(text, is_s, runs, lms, lcp, depth, memory, carry):
    """lms: LMS suffixes in order (or grouped by first symbol); gives (lms in order, marks of repeated positions)."""
    found, marks = [], np.zeros(len(text), bool) if carry else None

    def mark(at, common, last):
        if carry:
            hit = common >= depth
            marks[at[hit]] = True
            marks[np.append(last, at[:-1])[hit]] = True

    by = dict(zip(text[lms][edges(text[lms])[0]].tolist(), zip(*edges(text[lms]))))
    left = Induction(text, is_s, depth, memory, False, carry)
    large: dict[int, list] = {}
    stored = Queues(memory)
    for symbol in range(SYMBOLS):
        last = -1
        for at, common in left.drain(symbol):
            mark(at, common, last)
            stored.put(symbol, at, common)
            last = int(at[-1])
        if symbol in by:
            k, j = by[symbol]
            common = lcp[k:j].copy()
            common[0] = min(runs[last], runs[lms[k]]) if last >= 0 else 0
            for i in range(k, j, PIECE):
                left.scan(lms[i : min(j, i + PIECE)], common[i - k : i - k + PIECE])
    left.queues.close()
    right = Induction(text, is_s, depth, memory, True, carry)
    for symbol in range(SYMBOLS - 1, -1, -1):
        last = -1
        for at, common in right.drain(symbol):
            mark(at, common, last)
            last = int(at[-1])
            if not carry:
                found.append(at[(at > 0) & ~is_s[at - 1]])
        # the L suffixes of this symbol, from the largest: each one's common prefix is that with the next larger one
        parts = list(stored.take(symbol))
        beyond = None
        for at, common in reversed(parts):
            at, common = at[::-1], common[::-1]
            shifted = np.append(np.int16(0), common[:-1])
            if beyond is None:
                shifted[0] = min(runs[last], runs[at[0]]) if last >= 0 else 0
                if carry and last >= 0 and shifted[0] >= depth:
                    marks[last] = marks[at[0]] = True
            else:
                shifted[0] = beyond
            beyond = common[-1]
            right.scan(at, shifted)
    right.queues.close()
    stored.close()
    return (np.concatenate(found)[::-1] if found else None), marks


def ranked(words: np.ndarray, lms: np.ndarray, ordered: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The LMS suffixes in order, from their substrings in order, and each one's common prefix with the one before it.

    The reduced string of names is sorted by rank doubling. The ranks of all rounds stay: the common prefix of two suffixes
    is found by jumping from the longest spans of equal names down to single ones, and then within one LMS substring.
    """
    count = len(lms)
    number = np.zeros(int(lms[-1]) + 1, np.int32)
    number[lms] = np.arange(count, dtype=np.int32)
    order = number[ordered]
    size = np.minimum(np.append(np.diff(lms) + 1, 1), depth)[order]
    same = size[1:] == size[:-1]
    same[same] = alike(words, ordered[1:][same], ordered[:-1][same], size[1:][same])
    rank = np.empty(count, np.int32)
    rank[order] = np.append(0, np.cumsum(~same))
    levels, span, bits = [rank], 1, count.bit_length()
    ends = np.append(lms, np.full(depth, lms[-1] + depth))
    while True:
        tied = order[1:][same]
        if not len(tied) or (ends[np.minimum(tied + span, len(ends) - 1)] - lms[tied]).min() >= depth:
            break
        ahead = np.append(rank[span:] + 1, np.zeros(min(span, count), np.int32))[:count].astype(np.int64)
        key = rank.astype(np.int64) << bits | ahead
        if 3 * bits <= 63:
            key = np.sort(key << bits | np.arange(count))
            order, key = key & ((1 << bits) - 1), key >> bits
        else:
            order = np.argsort(key)
            key = key[order]
        same, span = key[1:] == key[:-1], 2 * span
        rank = np.empty(count, np.int32)
        rank[order] = np.append(0, np.cumsum(~same))
        levels.append(rank)
    x, y = order[1:].astype(np.int64), order[:-1].astype(np.int64)
    common = np.zeros(count - 1, np.int64)
    for level in reversed(range(len(levels))):
        equal = (levels[level][x] == levels[level][y]) & (common < depth)
        step = np.where(equal, 1 << level, 0)
        ahead = np.minimum(x + step, count - 1)
        common += lms[ahead] - lms[x]
        x, y = ahead, np.minimum(y + step, count - 1)
    common = np.minimum(common, depth)
    place = lms[order]
    return place, np.append(np.int16(0), common_prefixes(words, place[1:], place[:-1], depth, common)).astype(np.int16)


def repeated(text: np.ndarray, depth: int, memory: int = 256 << 20) -> np.ndarray:
    """text: symbols (0 at the end and only there); True where text[i : i + depth] also starts at another place."""
    is_s, runs = types(text), run_lengths(text, depth)
    lms = np.flatnonzero(is_s & np.append(False, ~is_s[:-1]))
    if len(lms) == 0:
        lms = np.array([len(text) - 1])
    grouped = lms[np.argsort(text[lms], kind="stable")]
    none = np.zeros(len(lms), np.int16)
    order, _ = induce(text, is_s, runs, grouped, none, depth, memory, False)
    end = np.array([len(text) - 1])
    order = end if order is None else np.append(end, order[order != len(text) - 1])
    order, lcp = ranked(packed(text), lms, order, depth)
    return induce(text, is_s, runs, order, lcp, depth, memory, True)[1]

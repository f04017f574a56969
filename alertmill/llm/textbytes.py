"""Vectorized work on the UTF-8 bytes of whole text columns.

Texts of an Arrow batch lie one after another in one byte array. Everything here works on that array at once:
words, hashes of any byte or word range from running sums, and anchors that depend on the content around them only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # bytes of text worked on at once; a longer text is a slice of its own
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE, _BASE2 = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WORD_BY_SPACE = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]
WORD_BY_SPACE[[9, 10, 11, 12, 13, 32]] = False

WORD_ALNUM = np.zeros(256, dtype=bool)  # digits, lower-case letters and everything outside ASCII
WORD_ALNUM[48:58] = True
WORD_ALNUM[97:123] = True
WORD_ALNUM[128:] = True


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); a null text is empty."""
    texts = batch.column(column)
    texts = (texts if texts.null_count == 0 else texts.fill_null("")).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except (OSError, TypeError):
        return None


def give_back() -> None:
    """Return the memory that this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which the worker gives back what it has freed: workers outlive tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


_known_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # the longest asked for so far, of each base


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2^64, and of its inverse."""
    if base not in _known_powers or len(_known_powers[base][0]) < n:
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            out = np.full(n + n // 8 + 16, factor, dtype=np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            both.append(out)
        _known_powers[base] = (both[0], both[1])
    up, down = _known_powers[base]
    return up[:n], down[:n]


@lru_cache(maxsize=2)
def byte_codes(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


class Sums:
    """Running sums of coded units (bytes or word hashes), from which any range gets its hash."""

    def __init__(self, codes: np.ndarray, base: int = _BASE):
        up, self.down = powers(len(codes) + 1, base)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all ranges of that length."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the number of the first word (one entry more than rows)."""
    inside = word_bytes[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(len(data) + 1, dtype=bool)
    after[-1] = False
    after[:-1] = inside
    before[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Sums(byte_codes()[data]).hashes(starts, ends)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every run of ``width`` keys."""
    least, span = keys, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


_PLACE = (1 << 22) - 1  # windows that are looked at together


def _anchors(core_hash: np.ndarray, spread: int) -> np.ndarray:
    """The anchor of every window: place of the least of its ``spread`` core hashes, the last of equal ones."""
    out = []
    for at in range(0, len(core_hash) - spread + 1, _PLACE + 2 - spread):
        part = core_hash[at : at + _PLACE + 1]
        place = np.uint64(_PLACE) - np.arange(len(part), dtype=np.uint64)
        least = sliding_least((part & ~np.uint64(_PLACE)) | place, spread)
        out.append(at + _PLACE - (least & np.uint64(_PLACE)).astype(np.int64))
    return np.concatenate(out)


def windows_by_anchor(sums: Sums, bounds: np.ndarray, length: int, spread: int):
    """All windows of ``length`` units inside the rows, in runs that share an anchor.

    The anchor of a window is, among its first ``spread`` units, the one from which the next
    ``length - spread + 1`` units (the core) hash least, the last of equal ones: equal windows have equal anchors.
    Returns (row, first start, last start, anchor, hash of the core) of each run.
    """
    core = length - spread + 1
    core_hash = sums.every(core)
    none = np.zeros(0, np.int64)
    if len(core_hash) < spread:
        return none, none, none, none, np.zeros(0, np.uint64)
    anchor = _anchors(core_hash, spread)
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.arange(len(anchor))
    inside = start + length <= bounds[1:][row_of[: len(anchor)]]
    start = start[inside]
    if not len(start):
        return none, none, none, none, np.zeros(0, np.uint64)
    anchor, row = anchor[start], row_of[start]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[first[1:], len(start)] - 1
    return row[first], start[first], start[last], anchor[first], core_hash[anchor[first]]


def joined_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching [start, end) ranges."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return start[first], end[np.r_[first[1:], len(start)] - 1]

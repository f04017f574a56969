"""What every match of a pattern holds: literals, and the grams of several widths by which texts are looked up.

Works on rewritten patterns (see :mod:`alertmill.functions.regex`). Letters count without case, so a gram of a
pattern that folds case is a gram of its texts as well. A literal is cut into grams of the greatest width it has room
for, and the one that is rarest in the list of patterns stands for it: what all patterns share tells none of them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from alertmill.functions.loops import OTHER, Node, read

GRAM = 4
MAX_STRINGS, MAX_LENGTH = 16, 64  # of a part that is followed exactly
MAX_CHOICES = 64  # literals one of which every match holds
WIDTHS = (4, 8, 16, 32)  # bytes of a gram
LEAST_BITS, MOST_BITS = 16, 27  # of the bitmap of grams, as a power of two
BITS_PER_GRAM = 16
BLOCK_BITS = 15  # of the bitmap as it is put together (Spark's bitmap functions)
SKETCH_BITS, SKETCH_BLOCK = 18, 1 << 12  # counters of the grams of a list
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Letters by how common they are in texts; a gram of rarer ones has fewer texts.
_RANK = np.full(256, 30, dtype=np.int64)
_RANK[np.frombuffer(b" etaoinsrhldcumfpgwybvkxjqz", dtype=np.uint8)] = np.arange(27)

Exact = frozenset[bytes]


@lru_cache(maxsize=4096)
def _characters(mask: int, text: str) -> Exact | None:
    """The few characters of a set, lower-case; None if they are many or not known."""
    if mask & OTHER:
        # one character outside ASCII by itself, written as it is
        return frozenset([text.encode()]) if mask == OTHER and len(text) == 1 else None
    found = {bytes([_LOWER[c]]) for c in range(128) if mask >> c & 1}
    return frozenset(found) if 0 < len(found) <= 4 else None


def _worth(choices: Exact | None) -> tuple[int, int]:
    return (0, 0) if not choices else (min(map(len, choices)), -len(choices))


def _usable(choices: Exact | None) -> Exact | None:
    return choices if choices and min(map(len, choices)) >= GRAM and len(choices) <= MAX_CHOICES else None


def _times(one: Exact, other: Exact) -> Exact | None:
    if len(one) * len(other) > MAX_STRINGS:
        return None
    if len(one) == 1 and len(other) == 1:
        (a,), (b,) = one, other
        return frozenset([a + b]) if len(a) + len(b) <= MAX_LENGTH else None
    out = frozenset(a + b for a in one for b in other)
    return out if max(map(len, out)) <= MAX_LENGTH else None


def _look(node: Node) -> tuple[Exact | None, Exact | None]:
    """All words, if they are few, and strings one of which is in every word, if there are any long enough."""
    nothing: Exact = frozenset([b""])
    if node.kind == "set":
        own = _characters(node.mask, node.text)
        return own, _usable(own)
    if node.kind == "group":
        return _look(node.parts[0])
    if node.kind == "alt":
        words, held = zip(*map(_look, node.parts), strict=True)
        every = None if None in words else frozenset().union(*words)
        either = [h or _usable(w) for w, h in zip(words, held, strict=True)]
        some = None if None in either else frozenset().union(*either)
        return every if every is not None and len(every) <= MAX_STRINGS else None, _usable(some)
    if node.kind == "loop":
        words, held = _look(node.parts[0])
        if node.low == 0:
            return (words | nothing if words is not None and node.high == 1 and len(words) < MAX_STRINGS else None), None
        return (words if (node.low, node.high) == (1, 1) else None), held or _usable(words)
    if node.kind != "cat":
        return nothing, None  # has no width
    best: Exact | None = None
    run: Exact | None = nothing
    whole = True
    for part in node.parts:
        words, held = _look(part)
        longer = _times(run, words) if words is not None else None
        if longer is None:
            best, whole = max(best, _usable(run), held, key=_worth), False
            run = words if words is not None else nothing
        else:
            run = longer
    return (run if whole else None), max(best, _usable(run), key=_worth)


def required_literals(java: str) -> Exact | None:
    """Lower-case strings of at least ``GRAM`` bytes, one of which every matching text holds; None if none are known."""
    words, held = _look(read(java))
    return max(_usable(words), held, key=_worth)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_codes(data: np.ndarray, widths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """Each width with the codes of the grams of that width at every place; the two low bits tell the widths apart."""
    low = _LOWER[data]
    code = np.zeros(max(0, len(low) - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        code |= low[k : k + len(code)].astype(np.uint64) << np.uint64(8 * k)
    code = _mixed(code)
    for k, width in enumerate(WIDTHS):
        if k:
            half = WIDTHS[k - 1]
            n = max(0, len(code) - half)
            code = _mixed(code[:n] * np.uint64(0xD6E8FEB86659FD93) + code[half : half + n])
        if width in widths:
            yield width, (code & ~np.uint64(3)) | np.uint64(k)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])


def _literal_grams(literals: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Literal, code and commonness of the letters of every gram of the literals, each of the greatest width it has."""
    data, offsets = _joined(literals)
    common = np.r_[0, np.cumsum(_RANK[_LOWER[data]])]
    owner = np.repeat(np.arange(len(literals)), np.diff(offsets))
    own = np.array([max(w for w in WIDTHS if w <= len(x)) for x in literals], dtype=np.int64)
    found = []
    for width, codes in gram_codes(data, WIDTHS):
        at = np.flatnonzero((own[owner[: len(codes)]] == width) & (owner[: len(codes)] == owner[width - 1 :]))
        # rare letters have high ranks; per byte, so that widths compare
        found.append((owner[at], codes[at], (common[at + width] - common[at])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sketch_blocks(batches: Iterator[list[list[bytes]]]) -> Iterator[tuple[int, np.ndarray]]:
    """How often the grams of the literals occur, by hash: the blocks of the counters that are not all zero."""
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for literals in batches:
        if flat := [x for own in literals for x in own]:
            counts += np.bincount((_literal_grams(flat)[1] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
    for block, part in enumerate(counts.reshape(-1, SKETCH_BLOCK)):
        if part.any():
            yield block, part


def chosen_grams(literals: list[list[bytes]], counts: np.ndarray) -> list[list[int]]:
    """For each list of literals a gram of each of them: the rarest in the list of patterns, of those the one with the rarest letters."""
    flat = [x for own in literals for x in own]
    if not flat:
        return [[] for _ in literals]
    owner, codes, rank = _literal_grams(flat)
    often = np.log2(counts[(codes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] + 1).astype(np.int64)
    order = np.lexsort((codes, -rank, often, owner))
    first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
    best = codes[first].view(np.int64).tolist()
    ends = np.cumsum([0, *map(len, literals)]).tolist()
    return [sorted(set(best[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]


@dataclass
class Wanted:
    """The grams of a list as a bitmap with two bits for each, and the widths that occur."""

    bits: np.ndarray  # packed, the lowest bit first
    widths: tuple[int, ...]

    def has(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes that the bitmap has."""
        size = int(np.log2(len(self.bits))) + 3
        at = np.arange(len(codes))
        for slot in (codes >> np.uint64(64 - size), (codes >> np.uint64(2)) & np.uint64((1 << size) - 1)):
            slot = slot[at]
            at = at[(self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return at


def bitmap_size(n_grams: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (BITS_PER_GRAM * n_grams).bit_length()))


def gram_slots(gram: Column, size: int) -> Column:
    """The two places of a code in a bitmap of ``2**size`` bits."""
    return F.array(F.shiftrightunsigned(gram, 64 - size), F.shiftrightunsigned(gram, 2).bitwiseAND(F.lit((1 << size) - 1)))


def text_grams(texts: pa.Array, wanted: Wanted) -> pa.Array:
    """Distinct grams of every text that the bitmap has, as lists of integers; null texts have none."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    counts, found, row = np.zeros(len(texts), np.int64), [], 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        ends = offsets[row + 1 : stop + 1] - offsets[row]
        owners, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for width, codes in gram_codes(data[offsets[row] : offsets[stop]], wanted.widths):
            at = wanted.has(codes)
            owner = np.searchsorted(ends, at, side="right")
            inside = at + width <= ends[owner]
            owners.append(owner[inside])
            grams.append(codes[at[inside]])
        owner, code = np.concatenate(owners), np.concatenate(grams)
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        once = np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])] if len(code) else np.zeros(0, bool)
        counts[row:stop] = np.bincount(owner[once], minlength=stop - row)
        found.append(code[once].view(np.int64))
        row = stop
    values = np.concatenate(found) if found else np.zeros(0, np.int64)
    bounds = np.r_[0, np.cumsum(counts)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int64()))


def grams_of(spark: SparkSession, text: Column, wanted: Wanted) -> Column:
    """The wanted grams of a text. The bitmap that is sent has a greatest size, however long the list of patterns."""
    sent = spark.sparkContext.broadcast(wanted)

    @F.arrow_udf("array<bigint>")
    def grams(texts: pa.Array) -> pa.Array:
        return text_grams(texts, sent.value)

    return grams(text)

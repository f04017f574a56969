"""Is a short text within an edit distance of one of several others: bit-parallel, for many pairs at once.

The columns of the distance table are kept as differences in machine words (Myers, in blocks of 64 rows as by Hyyrö),
and every operation runs over all pairs of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARACTERS = 256  # of a text that is compared here
ROWS, PAIRS = 4096, 8192  # worked on at once
ROUNDS = (1, 3, 8)  # samples tried in the first rounds, the newest first; the last round takes the rest
_ONE = np.uint64(1)


def _cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of the texts, and which of them are ASCII (a null is not)."""
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    wide = np.flatnonzero(data >= 128)
    plain = np.searchsorted(wide, offsets[1:]) == np.searchsorted(wide, offsets[:-1])
    return data, offsets[:-1], np.diff(offsets), known & plain


def _padded(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A row per place and a column per text."""
    place = np.arange(length.max(initial=0))[:, None]
    return np.where(place < length, data[np.minimum(start + place, max(0, len(data) - 1))], 0) if len(data) else np.zeros((0, len(start)), np.uint8)


def _tables(chars: np.ndarray, length: np.ndarray, words: int) -> np.ndarray:
    """For each text, character and word: the bits of the places that have the character."""
    table = np.zeros((len(length), 128, words), dtype=np.uint64)
    row = np.arange(len(length))
    for i, column in enumerate(chars):
        held = row[: len(row)] if i < length.min() else np.flatnonzero(i < length)
        table[held, column[held], i >> 6] |= np.uint64(1 << (i & 63))
    return table


def _bounds(a: np.ndarray, a_start: np.ndarray, m: np.ndarray, b: np.ndarray, b_start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A distance that is never too small: the pairs are laid side by side from the left up to a place, from the right after it."""
    both = np.minimum(m, n)
    left = _padded(a, a_start, both) != _padded(b, b_start, both)
    right = _padded(a, a_start + m - both, both) != _padded(b, b_start + n - both, both)
    gain = np.cumsum(left.astype(np.int8) - right.astype(np.int8), axis=0, dtype=np.int16)
    return np.abs(m - n) + right.sum(axis=0) + np.minimum(0, gain.min(axis=0, initial=0))


def _distances(table: np.ndarray, row: np.ndarray, m: np.ndarray, chars: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distance of each pair: text ``row`` of the table with ``m`` characters, and a column of ``chars`` with ``n``.

    Pairs come by falling ``n``, so that those still at work are the first ones.
    """
    words = table.shape[2]
    up = np.full((words, len(row)), ~np.uint64(0))  # rows of the column that are one more than the row before
    down = np.zeros((words, len(row)), dtype=np.uint64)  # or one less
    score, last = m.astype(np.int64), ((m - 1) & 63).astype(np.uint64)
    for j in range(len(chars)):
        on = int(np.searchsorted(-n, -j, side="left"))  # pairs with more than j characters
        equal = table[row[:on], chars[j, :on]]
        more, less = _ONE, np.uint64(0)  # what comes in from the row above
        for w in range(words):
            pv, mv, eq = up[w, :on], down[w, :on], equal[:, w]
            xv = eq | mv
            eq = eq | less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if w == words - 1:
                score[:on] += ((ph >> last[:on]) & _ONE).astype(np.int64) - ((mh >> last[:on]) & _ONE).astype(np.int64)
            high, low = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = (ph << _ONE) | more, (mh << _ONE) | less
            up[w, :on], down[w, :on] = mh | ~(xv | ph), ph & xv
            more, less = high, low
    return score


def near_any(texts: pa.Array, rings: pa.ListArray, limit: int) -> pa.Array:
    """Is any text of the ring at most ``limit`` edits away; null where characters outside ASCII or nulls leave it open."""
    data, start, length, plain = _cells(texts)
    ends = np.r_[0, np.cumsum(np.nan_to_num(np.asarray(rings.value_lengths().fill_null(0)), nan=0))].astype(np.int64)
    r_data, r_start, r_length, r_plain = _cells(rings.flatten())
    open_ = ~plain | ~rings.is_valid().to_numpy(zero_copy_only=False)
    near = np.zeros(len(texts), dtype=bool)
    count = np.diff(ends)
    done = 0
    for take in (*ROUNDS, int(count.max(initial=0))):
        for words in range(1 + MAX_CHARACTERS // 64 + 1):
            own = np.flatnonzero(plain & ~near & (count > done) & ((length + 63) // 64 == words))
            for k in range(0, len(own), ROWS):
                rows = own[k : k + ROWS]
                tried = np.minimum(count[rows] - done, take)
                of = np.repeat(np.arange(len(rows)), tried)
                back = np.arange(len(of)) - np.repeat(np.cumsum(tried) - tried, tried)
                pair = ends[rows + 1][of] - 1 - done - back  # the newest come last
                open_[rows[of[~r_plain[pair]]]] = True
                apart = np.abs(r_length[pair] - length[rows][of]) > limit
                of, pair = of[r_plain[pair] & ~apart], pair[r_plain[pair] & ~apart]
                if not words:
                    near[rows[of]] = True  # an empty text is as far as the other is long
                    continue
                for a in range(0, len(of), PAIRS):
                    o, p = of[a : a + PAIRS], pair[a : a + PAIRS]
                    most = _bounds(data, start[rows][o], length[rows][o], r_data, r_start[p], r_length[p])
                    near[rows[o[most <= limit]]] = True
                left = ~near[rows[of]]
                if not left.any():
                    continue
                kept, of = np.unique(of[left], return_inverse=True)
                rows, pair = rows[kept], pair[left]
                table = _tables(_padded(data, start[rows], length[rows]), length[rows], words)
                order = np.argsort(-r_length[pair], kind="stable")
                of, pair = of[order], pair[order]
                for a in range(0, len(of), PAIRS):
                    o, p = of[a : a + PAIRS], pair[a : a + PAIRS]
                    found = _distances(table, o, length[rows][o], _padded(r_data, r_start[p], r_length[p]), r_length[p])
                    near[rows[o[found <= limit]]] = True
        done += take
    return pa.array(near, mask=open_ & ~near)


def similar_to_any(text: Column, ring: Column, limit: int) -> Column:
    """True when a text of the ring is at most ``limit`` edits away from ``text``.

    Long texts, and those with characters outside ASCII, are compared by Spark's own distance.
    """
    # The bounded distance is -1 beyond the bound and stops early. The newest
    # sample is the likeliest to be similar and comes first.
    one_by_one = F.exists(F.reverse(ring), lambda r: F.levenshtein(r, text, limit) >= 0)
    if limit < 0:
        return one_by_one

    @F.arrow_udf("boolean")
    def near(texts: pa.Array, rings: pa.Array) -> pa.Array:
        return near_any(texts, rings, limit)

    # Texts whose lengths differ by more are further away and stay where they are.
    close = F.filter(ring, lambda r: r.isNull() | (F.abs(F.length(r) - F.length(text)) <= limit))
    short = F.length(text) <= MAX_CHARACTERS
    return F.coalesce(near(F.when(short, text), F.when(short, close)), one_by_one)

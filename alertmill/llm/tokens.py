"""Token ids of whole texts, by a vocabulary file whose path is a parameter."""

from __future__ import annotations

import os
from functools import cached_property, lru_cache

import numpy as np

from alertmill.llm.textbytes import word_hashes

# Words and word parts whose ids a worker keeps; a store is emptied when it is full.
KEPT_WORDS, KEPT_PARTS = 1_000_000, 250_000
# Newly learnt words are kept apart until there are so many, or an eighth of all words.
RECENT_WORDS = 20_000
# The usual pattern of byte-level vocabularies, which splits a text into the parts that are encoded one by one.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below this character all versions of the Unicode tables agree on letters and digits.
SETTLED = "ɐ"


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a text may be cut: at its start, and before a single space between two plain characters.

    Plain are the printable characters of ASCII and those of U+00C0 to U+03FF. White space beside a space is not,
    so such places stay within one word.
    """
    graphic = (data > 32) & (data < 127)
    lead = (data >= 0xC3) & (data <= 0xCF)
    ends = graphic.copy()
    ends[1:] |= lead[:-1] & (data[1:] >= 0x80)
    cut = np.zeros(len(data), dtype=bool)
    cut[1:-1] = (data[1:-1] == 32) & ends[:-2] & (graphic | lead)[2:]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


# The classes by which the pattern splits plain words: 1 letters, 2 digits, 0 other characters, 3 not plain. Plain are
# the printable characters of ASCII but the apostrophe, and the letters U+00C0 to U+023F, whose bytes count as letters.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[33:127] = 0
_CLASS[48:58] = 2
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = 1
_CLASS[39] = 3


def _parts(data: np.ndarray, start: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the parts of plain words and of all other words, and whether each is one of the others.

    A plain word is split where the class changes; the space before it belongs to its first part.
    """
    kind = classes[data]
    kind[:-1][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = 3  # the signs among the letters
    spaced = start[data[start] == 32]
    kind[spaced] = 0
    other = np.repeat(np.logical_or.reduceat(kind == 3, start), np.diff(start, append=len(data)))
    begins = np.empty(len(data), dtype=bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[spaced[spaced + 1 < len(data)] + 1] = False
    begins &= ~other
    begins[start] = True
    start = np.flatnonzero(begins)
    return start, other[start]


def _joined(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The ranges of ``data`` one after another, each with a line break after it."""
    ends = np.cumsum(size + 1)
    at = np.repeat(start - (ends - size - 1), size + 1) + np.arange(ends[-1])
    out = data[np.minimum(at, len(data) - 1)]
    out[ends - 1] = 10
    return out.tobytes()


class Encoder:
    """Ids of texts by the tokenizers library, with every repeated word encoded once.

    A byte-level vocabulary splits a text before any single space between two other characters, whatever stands
    around it, so a text cut there has the ids of its words one after another. Words are told apart by 64-bit
    hashes of their bytes. Plain words are split into parts right away, in all texts at once; other new words are cut
    into parts by the pattern. All new parts go to the library in one call; words with characters past ``SETTLED``, and
    those that hold the string of an added token (an end mark in the text, say), go to it as they are, so they have the
    ids that the library gives them in the whole text.

    Known words are found in two sorted lists, all and recent ones, so that learning a few costs no pass over all.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.path = path
        self.parts = Tokenizer.from_file(path)
        self.parts.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        vocabulary = self.parts.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, code in vocabulary.items():
            self.width[code] = len(token)
        self.letters = byte_letters()
        self.spelling = {b: c for b, c in self.letters.items() if b != 10}  # line breaks stay: they part what is joined
        self.cut = regex.compile(PARTS).findall
        # Tokens that the library looks for in a text before it splits it.
        added = [t.content for t in self.parts.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added))).search if added else None
        self.spaced = any(c.isspace() or t.lstrip or t.rstrip for t in self.parts.get_added_tokens_decoder().values() for c in t.content)
        self.classes = _CLASS.copy()  # no word with a byte that may begin an added token is plain
        self.classes[[t.encode()[0] for t in added if t]] = 3
        self.of_part: dict[str, bytes] = {}
        self._forget()

    @cached_property
    def whole(self):
        """The library's own way from text to ids; loaded when a word first asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.all = self.recent = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))  # hashes ascending, numbers of the words
        self.words = self.used = 0
        self.begin = np.zeros(1, dtype=np.int64)  # where the ids of each word start, and where those of the last one end
        self.codes = np.zeros(0, dtype="<u4")

    def _keep(self, hashes: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> None:
        """Keep the ids of new words."""
        if self.used + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes[: self.used], codes, np.zeros(len(self.codes) // 2, dtype="<u4")])
        else:
            self.codes[self.used : self.used + len(codes)] = codes
        if self.words + len(hashes) >= len(self.begin):
            self.begin = np.concatenate([self.begin[: self.words + 1], np.zeros(len(hashes) + len(self.begin) // 2, dtype=np.int64)])
        self.begin[self.words + 1 : self.words + len(hashes) + 1] = self.used + np.cumsum(counts)
        self.recent = self._merged(self.recent, (hashes, np.arange(self.words, self.words + len(hashes), dtype=np.int32)))
        self.words, self.used = self.words + len(hashes), self.used + len(codes)
        if len(self.recent[0]) > max(RECENT_WORDS, self.words // 8):
            self.all, self.recent = self._merged(self.all, self.recent), (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))

    @staticmethod
    def _merged(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.concatenate([one[0], other[0]])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], np.concatenate([one[1], other[1]])[order]

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the word with each hash, -1 where it is not known."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for known, number in (self.all, self.recent):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                found = known[at] == hashes
                out[found] = number[at[found]]
        return out

    def _direct(self, text: str) -> bytes:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _ids_of_joined(self, spelled: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spelled parts that line breaks part, and how many ids the parts have up to each."""
        codes = np.array(self.parts.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype="<u4")
        return codes, np.searchsorted(np.cumsum(self.width[codes]), np.cumsum(sizes)) + 1

    def _learn_parts(self, parts: list[str]) -> None:
        spelled = [p.encode().decode("latin-1").translate(self.letters) for p in parts]
        codes, last = self._ids_of_joined("\n".join(spelled), np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled)))
        raw, at = codes.tobytes(), 0
        for part, end in zip(parts, (last * 4).tolist(), strict=True):
            self.of_part[part] = raw[at:end]
            at = end

    def _learn(self, words: list[str]) -> list[bytes]:
        if len(self.of_part) > KEPT_PARTS:
            self.of_part.clear()
        cuts = [self.cut(w) if (w.isascii() or max(w) < SETTLED) and not (self.added and self.added(w)) else None for w in words]
        known = self.of_part
        if new := {p for parts in cuts if parts for p in parts if p not in known}:
            self._learn_parts(list(new))
        return [self._direct(w) if c is None else known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for w, c in zip(words, cuts, strict=True)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the offsets of the rows in them."""
        if self.spaced and self.added(data.tobytes().decode(errors="replace")):
            # an added token that takes in white space could be cut: rows go to the library whole
            raw = data.tobytes()
            rows = [np.frombuffer(self._direct(raw[a:b].decode()), dtype="<u4") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        start = _cuts(data, offsets)
        if not len(start):
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets), dtype=np.int64)
        start, other = _parts(data, start, self.classes)
        size = np.diff(start, append=len(data))
        distinct, first, which = np.unique(word_hashes(data, start, start + size) ^ size.astype(np.uint64), return_index=True, return_inverse=True)
        if self.words > KEPT_WORDS or self.used > 8 * KEPT_WORDS:
            self._forget()
        number = self._numbers(distinct)
        new = np.flatnonzero(number < 0)
        if len(new):
            plain, rest = new[~other[first[new]]], new[other[first[new]]]
            codes, last = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
            if len(plain):
                sizes = size[first[plain]]
                codes, last = self._ids_of_joined(_joined(data, start[first[plain]], sizes).decode("latin-1").translate(self.spelling), sizes)
            found = self._learn([data[a : a + n].tobytes().decode() for a, n in zip(start[first[rest]].tolist(), size[first[rest]].tolist(), strict=True)])
            counts = np.concatenate([np.diff(last, prepend=0), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4])
            learnt = np.concatenate([plain, rest])
            number[learnt] = self.words + np.arange(len(learnt))
            self._keep(distinct[learnt], counts, np.concatenate([codes, np.frombuffer(b"".join(found), dtype="<u4")]))
        number = number[which]
        begin = self.begin[number]
        count = self.begin[number + 1] - begin
        ends = np.cumsum(count)
        ids = self.codes[np.repeat(begin - (ends - count), count) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(start, offsets)]

    def ids(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        return self.encode(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def forget_encoders() -> None:
    """Give up the encoders of this worker process, when it goes on with work of another kind."""
    encoder.cache_clear()

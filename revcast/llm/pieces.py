"""Known pieces of text and their tokens, as arrays.

Texts are cut where white space follows anything else and where an ASCII
letter is followed by ASCII punctuation; no word of the vocabulary's pattern
crosses such a place, so a text's ids are those of its pieces. A worker looks the pieces of a whole batch up at once, by a
64-bit tabulation hash, and encodes only the pieces it has not met. The table is bounded; when it is full it begins anew.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pieces that a worker remembers (about 30 bytes each); longer pieces than LONGEST are always encoded.
KNOWN_PIECES = 2_000_000
LONGEST = 64
_EMPTY = np.uint64(0)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def steps(text: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A string column in steps of about ``most`` bytes (a longer text is a step
    of its own): first and last row, the bytes, where each text ends in them."""
    raw = text.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.zeros(0, np.uint8) if raw.buffers()[2] is None else np.frombuffer(raw.buffers()[2], np.uint8)
    k = 0
    while k < len(raw):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1)
        yield k, stop, data[at[k] : at[stop]], at[k + 1 : stop + 1] - at[k]
        k = stop


def _ends_in_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each position is one of Unicode's white
    space beyond ASCII: U+0085 U+00A0 U+1680 U+2000-200A U+2028 U+2029 U+202F U+205F U+3000."""
    z = data[at - 1].astype(np.int64)
    y = np.where(at > 1, data[at - 2], 0)
    x = np.where(at > 2, data[at - 3], 0)
    two = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
    general = (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    rest = ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    return two | general | rest


def piece_starts(data: np.ndarray, doc_starts: np.ndarray, marks: np.ndarray = _MARK) -> np.ndarray:
    """Where pieces begin: at each document, at white space after anything else, at one of ``marks`` after a letter."""
    space = _SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
    if len(at):
        cut[at[_ends_in_wide_space(data, at)]] = False
    cut[1:] |= _LETTER[data[:-1]] & marks[data[1:]]
    cut[doc_starts] = True
    return np.flatnonzero(cut)


class _Pool:
    """Values of known pieces, one after the other."""

    def __init__(self, dtype):
        self.dtype = np.dtype(dtype)
        self.data = np.zeros(1 << 14, dtype)
        self.first = np.zeros(1 << 12, np.uint32)
        self.size = np.zeros(1 << 12, np.uint16)
        self.used = 0

    def add(self, count: int, data: np.ndarray, sizes: np.ndarray) -> None:
        """Values of the pieces numbered from ``count`` on."""
        n, used = count + len(sizes), self.used + len(data)
        if n > len(self.first):
            self.first = np.resize(self.first, 2 * n)
            self.size = np.resize(self.size, 2 * n)
        if used > len(self.data):
            self.data = np.resize(self.data, 2 * used)
        self.data[self.used : used] = data
        self.first[count:n] = self.used + np.cumsum(sizes) - sizes
        self.size[count:n] = sizes
        self.used = used


class PieceTable:
    """Values of pieces; a subclass says how to compute them and gives their ``dtypes``."""

    def __init__(self, dtypes: list, specials: list[str], known: int = KNOWN_PIECES):
        self.dtypes, self.most = dtypes, known
        bits = max(16, (2 * known - 1).bit_length())
        self.slots, self.shift = 1 << bits, np.uint64(64 - bits)  # the shift leaves the number of a slot
        self.marks = _MARK.copy()  # special tokens are found first, so nothing is cut inside them
        for token in specials:
            self.marks[list(token.encode())] = False
        self.tab = np.random.default_rng(7).integers(1, 1 << 63, (LONGEST, 256), dtype=np.uint64).ravel()
        self._clear()

    def compute(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each dtype: the values of the pieces, one after the other, and how many each has."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.value = np.zeros(self.slots, np.uint32)
        self.count = 0
        self.pools = [_Pool(d) for d in self.dtypes]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each known piece, -1 for others."""
        out = np.full(len(keys), -1, np.int64)
        slot = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            same = there == keys[left]
            out[left[same]] = self.value[slot[same]]
            on = ~same & (there != _EMPTY)
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """``keys`` are distinct and new."""
        slot = (keys >> self.shift).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == _EMPTY)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]] = keys[put]
            self.value[slot[put]] = numbers[put]
            on = np.ones(len(keys), bool)
            on[put] = False
            keys, numbers, slot = keys[on], numbers[on], (slot[on] + 1) & (self.slots - 1)

    def lookup(self, data: np.ndarray, doc_ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each dtype: the values of all documents of a UTF-8 buffer, and how many each document has."""
        doc_starts = np.concatenate([[0], doc_ends[:-1]]).astype(np.int64)
        if not len(data):
            return [(np.zeros(0, d), np.zeros(len(doc_ends), np.int64)) for d in self.dtypes]
        starts = piece_starts(data, doc_starts[doc_starts < doc_ends], self.marks)
        sizes = np.diff(np.append(starts, len(data)))
        within = np.arange(len(data)) - np.repeat(starts, sizes)
        np.minimum(within, LONGEST - 1, out=within)
        keys = np.add.reduceat(self.tab[(within << 8) + data], starts) | np.uint64(1)
        text = lambda k: data[starts[k] : starts[k] + sizes[k]].tobytes().decode()
        if self.count > self.most:
            self._clear()
        number = self._find(keys)
        long = np.flatnonzero(sizes > LONGEST)
        number[long] = -2
        new = np.flatnonzero(number == -1)
        if len(new):
            fresh, first, where = np.unique(keys[new], return_index=True, return_inverse=True)
            for pool, (values, n) in zip(self.pools, self.compute([text(k) for k in new[first]]), strict=True):
                pool.add(self.count, values, n)
            self._insert(fresh, np.arange(self.count, self.count + len(fresh)))
            number[new] = self.count + where
            self.count += len(fresh)
        extra = self.compute([text(k) for k in long]) if len(long) else None
        known = number >= 0
        at_doc = np.searchsorted(starts, doc_ends, "left")
        out = []
        for p, pool in enumerate(self.pools):
            n = np.zeros(len(starts), np.int64)
            begin = np.zeros(len(starts), np.int64)
            n[known] = pool.size[number[known]]
            begin[known] = pool.first[number[known]]
            values = pool.data
            if extra is not None:
                more, lengths = extra[p]
                n[long] = lengths
                begin[long] = pool.used + np.cumsum(lengths) - lengths
                values = np.concatenate([values[: pool.used], more])
            ends = np.cumsum(n)
            flat = values[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]))]
            out.append((flat, np.diff(np.concatenate([[0], np.concatenate([[0], ends])[at_doc]]))))
        return out


class PieceEncoder(PieceTable):
    """Ids by the ``tokenizers`` library, for a byte-level vocabulary whose word pattern may begin with a blank."""

    def __init__(self, path: str, known: int = KNOWN_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokenizer, self.by_blank = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.by_blank):
            t.no_truncation()
            t.no_padding()
        #: For pieces that are one word of the pattern: cut at blanks only.
        self.by_blank.pre_tokenizer = Sequence([Split(" ", "merged_with_next"), ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.begins = np.zeros(size, bool)  # tokens that begin with a blank
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token.startswith("Ġ")
        super().__init__([self.dtype], [t.content for t in self.tokenizer.get_added_tokens_decoder().values()], known)

    def compute(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        # a blank and ASCII letters are one word of the pattern: all of them go in one text
        mark = np.array([p[0] == " " and p[1:].isalpha() and p.isascii() for p in pieces], bool)
        joined = [p for p, t in zip(pieces, mark, strict=True) if t]
        ids = np.zeros(0, self.dtype)
        sizes = np.zeros(len(pieces), np.int64)
        if joined:
            ids = np.array(self.by_blank.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.begins[ids])  # each begins with the only blank it has
            sizes[mark] = np.diff(np.append(at, len(ids)))
        others = self.tokenizer.encode_batch_fast([p for p, t in zip(pieces, mark, strict=True) if not t], add_special_tokens=False)
        others = [e.ids for e in others]
        sizes[~mark] = [len(i) for i in others]
        out = np.zeros(int(sizes.sum()), self.dtype)
        of = np.repeat(mark, sizes)
        out[of] = ids
        out[~of] = np.array([i for e in others for i in e], self.dtype)
        return [(out, sizes)]

    def encode(self, data: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a UTF-8 buffer, and how many each document has."""
        return self.lookup(data, doc_ends)[0]

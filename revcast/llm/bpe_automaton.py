"""BPE encoding and decoding with a tokenization automaton.

``MergeGadgets`` builds, merge by merge, the deterministic automaton whose
accepted paths are exactly the correct tokenizations: its states are "the last
token was t", its arcs are labelled with tokens. It begins with one looping
arc for each base symbol. The gadget of a merge (u, v) -> uv takes the state
that u leads to, splits off a copy from which v is no longer allowed, and
adds the arc uv wherever the path u, v was there; its target is the target v
had at that moment.

``TokenAutomaton`` is the compiled form, in arrays:

* transitions (node, symbol) -> node of the labels' prefix tree, whose nodes
  know the token they spell;
* for each state the arcs that it has lost: (state, token) -> the first merge
  that took it away. An arc ``t`` is closed if it, or a token that it was merged
  from on its left before that merge could see it, stands there; those tokens
  are a short row of a matrix.

Words are encoded left to right, all words of a batch in step: from every
position that an accepted path reaches, the transitions spell the tokens that
begin there, and every open arc reaches its end. No merge is replayed, nothing
is taken back: a position has at most one accepted path, so its last token is
written once, and the word's tokens are read off from its end. Decoding emits
the labels of the arcs.

``WordBpe`` reads the vocabulary file (normaliser NFC, white space, lower
case; words by pattern; byte symbols; word ends). ``StringTable`` keeps the
results of known pieces in a bounded table, which changes speed only.

Defined results: null and empty texts have no tokens and decode to '';
repeated rows are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .pieces import PieceTable, steps

#: Known pieces of a worker (about 60 bytes each).
CACHE = 400_000
#: Symbols from which on a word is encoded by itself: it would hold up a batch of short ones.
LONG_WORD = 200
#: Bytes of text whose results are handed on together.
OUTPUT_STEP = 1 << 20
_FOREVER = 1 << 60


class MergeGadgets:
    """The automaton of a merge list while it is built; tokens are strings of base symbols."""

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]]):
        #: token -> (left part, right part, rank of its merge); None for base symbols.
        self.parts: dict[str, tuple[str, str, int] | None] = dict.fromkeys(symbols)
        #: state -> {token: rank of the merge that removed its arc}
        self.removed: dict[str, dict[str, int]] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(u, v, rank)

    def _gadget(self, u: str, v: str, rank: int) -> None:
        if u not in self.parts or v not in self.parts or u + v in self.parts:
            return  # a part that no text can hold, or a second spelling of a token
        if not self._allowed(u, v):
            return  # earlier merges have taken the path u, v away: the merge never happens
        self.parts[u + v] = (u, v, rank)
        self.removed.setdefault(u, {})[v] = rank
        if u == v:  # runs pair up from the left: after a lone u no uu begins
            self.removed[u][u + v] = rank

    def chain(self, token: str, side: int) -> list[tuple[str, int]]:
        """The token and the parts it ends (side 1) or begins (side 0) with, each with the rank at which it was taken in."""
        out, until = [(token, _FOREVER)], _FOREVER
        while (p := self.parts[token]) is not None:
            token, until = p[side], p[2]
            out.append((token, until))
        return out

    def _allowed(self, last: str, token: str) -> bool:
        begins = self.chain(token, 0)
        for end, ended in self.chain(last, 1):
            removed = self.removed.get(end)
            if removed and any((r := removed.get(b)) is not None and r < ended and r < begun for b, begun in begins):
                return False
        return True


class _Pairs:
    """(64-bit key) -> value, in two arrays; -1 for keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << bits, -1, np.int32)
        slot, free = self._slot(keys), np.uint64(0xFFFFFFFFFFFFFFFF)
        while len(keys):
            at = np.flatnonzero(self.keys[slot] == free)
            put = at[np.unique(slot[at], return_index=True)[1]]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            on = np.ones(len(keys), bool)
            on[put] = False
            keys, values, slot = keys[on], values[on], (slot[on] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = self.values[slot]
        wrong = np.flatnonzero((found != keys) & (out >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            found = self.keys[slot[wrong]]
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(found != keys[wrong]) & (out[wrong] >= 0)]
        return out

    def one(self, key: int) -> int:
        slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while True:
            value = int(self.values[slot])
            if value < 0 or int(self.keys[slot]) == key:
                return value
            slot = (slot + 1) & self.mask


class TokenAutomaton:
    """The compiled automaton of a merge list. Tokens have numbers in the order
    of ``labels``; base symbols come first and are their own codes."""

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]]):
        made = MergeGadgets(symbols, merges)
        self.labels = list(made.parts)
        number = {t: k for k, t in enumerate(self.labels)}
        self.code = {t: number[t] for t in made.parts if made.parts[t] is None}
        # the labels' prefix tree
        spelt: list[tuple[int, ...]] = []
        for token, part in made.parts.items():  # parts come before what is made of them
            spelt.append((number[token],) if part is None else spelt[number[part[0]]] + spelt[number[part[1]]])
        arcs: dict[tuple[int, int], int] = {}
        token_of = [-1]
        for k, codes in enumerate(spelt):
            node = 0
            for c in codes:
                after = arcs.get((node, c))
                if after is None:
                    after = arcs[node, c] = len(token_of)
                    token_of.append(-1)
                node = after
            token_of[node] = k
        self.token_of = np.array(token_of, np.int32)
        pairs = np.array(list(arcs), np.uint64).reshape(-1, 2)
        self.arcs = _Pairs(pairs[:, 0] << np.uint64(32) | pairs[:, 1], np.array(list(arcs.values()), np.int32))
        self.size = np.array([len(c) for c in spelt], np.int32)
        # for each state the tokens it has lost, by the first merge that took them away
        lost: dict[int, int] = {}
        for token in self.labels:
            high = number[token] << 32
            for end, ended in made.chain(token, 1):
                for gone, rank in made.removed.get(end, {}).items():
                    if rank < ended:
                        key = high | number[gone]
                        lost[key] = min(rank, lost.get(key, rank))
        self.lost = _Pairs(np.fromiter(lost.keys(), np.uint64, len(lost)), np.fromiter(lost.values(), np.int32, len(lost)))
        # what a token was merged from on its left, and when that was taken in
        chains = [made.chain(t, 0) for t in self.labels]
        deep = max(map(len, chains), default=1)
        self.begins = np.full((len(chains), deep), -1, np.int32)
        self.begun = np.full((len(chains), deep), -1, np.int32)
        for k, chain in enumerate(chains):
            self.begins[k, : len(chain)] = [number[t] for t, _ in chain]
            self.begun[k, : len(chain)] = [min(r, (1 << 31) - 1) for _, r in chain]

    def _open(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the states have the arcs."""
        out = np.ones(len(state), bool)
        high = state.astype(np.uint64) << np.uint64(32)
        for d in range(self.begins.shape[1]):
            begin = self.begins[token, d]
            some = np.flatnonzero(begin >= 0)
            if not len(some):
                break
            rank = self.lost.get(high[some] | begin[some].astype(np.uint64))
            out[some[(rank >= 0) & (rank < self.begun[token[some], d])]] = False
        return out

    def _reach(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The last token of the accepted path to each position (in the place of the symbol before it; -1: none)."""
        last = np.full(len(codes), -1, np.int32)
        longest = int((end - begin).max(initial=0))
        at = begin.copy()
        for i in range(longest):
            more = at < end
            at, end = at[more], end[more]
            pos, stop = at, end
            if i:
                reached = last[at - 1] >= 0
                pos, stop = at[reached], end[reached]
                state = last[pos - 1]
            node = np.zeros(len(pos), np.int32)
            while len(pos):
                node = self.arcs.get(node.astype(np.uint64) << np.uint64(32) | codes[pos].astype(np.uint64))
                on = node >= 0
                node, pos, stop = node[on], pos[on], stop[on]
                if i:
                    state = state[on]
                token = self.token_of[node]
                there = np.flatnonzero(token >= 0)
                if i and len(there):
                    there = there[self._open(state[there], token[there])]
                last[pos[there]] = token[there]
                pos = pos + 1
                on = pos < stop
                node, pos, stop = node[on], pos[on], stop[on]
                if i:
                    state = state[on]
            at = at + 1
        return last

    def _reach_one(self, codes: list[int]) -> list[int]:
        """The same for one word, symbol by symbol."""
        n, last = len(codes), [-1] * len(codes)
        begins, begun = self.begins, self.begun
        for i in range(n):
            if i and last[i - 1] < 0:
                continue
            node, high = 0, last[i - 1] << 32
            for j in range(i, n):
                node = self.arcs.one(node << 32 | codes[j])
                if node < 0:
                    break
                token = int(self.token_of[node])
                if token < 0:
                    continue
                if i and any(0 <= self.lost.one(high | int(b)) < r for b, r in zip(begins[token], begun[token], strict=True) if b >= 0):
                    continue
                last[j] = token
        return last

    def encode_words(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of words, given as symbol codes one after the other, and how many each has."""
        begin = np.append(0, ends[:-1])
        long = ends - begin >= LONG_WORD
        last = self._reach(codes, begin[~long], ends[~long])
        for a, b in zip(begin[long].tolist(), ends[long].tolist(), strict=True):
            last[a:b] = self._reach_one(codes[a:b].tolist())
        # read every word from its end: mark where its tokens end
        mark = np.zeros(len(codes), bool)
        at, first = ends[ends > begin] - 1, begin[ends > begin]
        while len(at):
            mark[at] = True
            at = at - self.size[last[at]]
            on = at >= first
            at, first = at[on], first[on]
        found = np.flatnonzero(mark)
        return last[found], np.diff(np.append(0, np.searchsorted(found, ends)))

    def encode(self, whole: str, n: int) -> list[str]:
        """The tokens of one word of ``n`` base symbols; all but the last are one character."""
        codes = np.array([self.code[c] for c in [*whole[: n - 1], whole[n - 1 :]]], np.int32)
        return [self.labels[t] for t in self.encode_words(codes, np.array([n]))[0]]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    stands for itself, the others for the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordBpe:
    """The tokenizer of a vocabulary file with word ends."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern, regex.V0)
        self.byte_of = byte_symbols()
        base = [t for t in self.ids if len(t.removesuffix(self.suffix) or t) == 1]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = TokenAutomaton(base, merges)
        give_back()  # what the gadgets took
        code = self.automaton.code
        #: Symbol codes of the bytes of a word: inside it, and at its end.
        self.inside = np.array([code[c] for c in self.byte_of], np.int32)
        self.at_end = np.array([code[c + self.suffix] for c in self.byte_of], np.int32)
        self.id_of_token = np.array([self.ids[t] for t in self.automaton.labels], np.int32)

    def encode_pieces(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of pieces, given as words, one after the other; how many each piece has."""
        raw = [w.encode() for piece in words for w in piece]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        codes = self.inside[data]
        codes[ends - 1] = self.at_end[data[ends - 1]]
        tokens, sizes = self.automaton.encode_words(codes, ends)
        at = np.cumsum([0, *map(len, words)])
        return tokens, np.diff(np.append(0, np.cumsum(sizes))[at])

    def _words(self, chunk: str) -> list[str]:
        """Words of a text without special tokens."""
        chunk = chunk.lstrip(" \n")
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = self._lower(chunk)
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and not (chunk[-1].isalnum() or chunk[-1].isspace()):
            return [chunk[:-1], chunk[-1]]
        return self.words.findall(chunk)

    @staticmethod
    def _lower(text: str) -> str:
        # character by character: str.lower() has a rule for a final sigma
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def tokens(self, text: str) -> list[str]:
        """Tokens of any text; special tokens in it stand for themselves."""
        out: list[str] = []
        for part in self.split_special.split(text) if "<|" in text else [text]:
            if part in self.specials:
                out.append(part)
            elif words := self._words(part):
                out += [self.automaton.labels[t] for t in self.encode_pieces([words])[0]]
        return out

    def id_of(self, token: str) -> int:
        known = self.ids.get(token)
        return self.specials[token] if known is None else known

    def encode(self, text: str) -> list[int]:
        return [self.id_of(t) for t in self.tokens(text)]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined as the library does without a decoder."""
        return " ".join([self.names[i] for i in ids])


#: The compiled automaton of each file, once in a worker process.
_MADE: dict[str, WordBpe] = {}


class StringTable(PieceTable):
    """Of each piece: its ids in decimal and its labels, a blank before each."""

    def __init__(self, path: str):
        if path not in _MADE:
            _MADE[path] = WordBpe(path)
        self.bpe = _MADE[path]
        super().__init__([np.uint8, np.uint8], list(self.bpe.specials), CACHE)
        self.shown = []  # bytes of every token, in the order of their numbers, and where each begins
        for texts in (map(str, self.bpe.id_of_token.tolist()), self.bpe.automaton.labels):
            raw = [f" {t}".encode() for t in texts]
            self.shown.append((np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))

    def close(self) -> None:
        """Give the known pieces' memory back; the compiled automaton stays."""
        self.keys, self.value, self.pools, self.shown = self.keys[:0].copy(), self.value[:0].copy(), [], []
        give_back()

    def compute(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        special = [k for k, p in enumerate(pieces) if "<|" in p]
        tokens, sizes = self.bpe.encode_pieces([[] if "<|" in p else self.bpe._words(p) for p in pieces])
        out, piece = [], np.repeat(np.arange(len(pieces)), sizes)
        by_hand = {k: self.bpe.tokens(pieces[k]) for k in special}
        for which, (flat, at) in enumerate(self.shown):
            n = at[tokens + 1] - at[tokens]
            values = flat[np.repeat(at[tokens] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            lengths = np.bincount(piece, weights=n, minlength=len(pieces)).astype(np.int64)
            if by_hand:  # few pieces hold what may be a special token
                cut = np.cumsum(lengths)[:-1]
                parts = np.split(values, cut)
                for k, found in by_hand.items():
                    parts[k] = np.frombuffer("".join(f" {t if which else self.bpe.id_of(t)}" for t in found).encode(), np.uint8)
                    lengths[k] = len(parts[k])
                values = np.concatenate(parts)
            out.append((values, lengths))
        return out

    def texts(self, column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """Of each text: the ids in decimal and the labels, each joined by one blank."""
        for _, _, data, ends in steps(column):
            both = []
            for flat, sizes in self.lookup(data, ends):
                raw, at = flat.tobytes(), np.append(0, np.cumsum(sizes)).tolist()
                both.append([raw[a + 1 : b] for a, b in zip(at, at[1:], strict=False)])
            yield from zip(*both, strict=True)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The file of the installed package of public vocabularies, on whichever machine this runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``docs`` with ``__ids`` (array of token ids) and ``__decoded``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = StringTable(os.path.abspath(vocabulary) if os.sep in vocabulary else vocabulary_path(vocabulary))
        for batch in batches:
            coded = [list(map(int, ids.split())) for ids, _ in table.texts(batch.column(text_col))]
            back = [table.bpe.decode(ids) for ids in coded]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(coded, pa.list_(pa.int32())), pa.array(back, pa.large_string())],
                [*batch.schema.names, "__ids", "__decoded"])
        table.close()

    return docs.mapInArrow(run, f"{fields}, __ids array<int>, __decoded string")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  vocabulary: str = "word_bpe_49k.json", keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, sha256 of the decimal ids joined by a space, sha256
    of the decoded text and, if wanted, the ids as they were hashed."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = StringTable(os.path.abspath(vocabulary) if os.sep in vocabulary else vocabulary_path(vocabulary))
        sha = hashlib.sha256
        for batch in batches:
            for k, stop, _, _ in steps(batch.column("__text"), OUTPUT_STEP):
                n, ids, texts, shown = [], [], [], []
                for a, b in table.texts(batch.column("__text").slice(k, stop - k)):
                    if keep_ids:
                        shown.append(a)
                    n.append(a.count(b" ") + 1 if a else 0)
                    ids.append(sha(a).hexdigest())
                    texts.append(sha(b).hexdigest())
                columns = [batch.column(id_col).slice(k, stop - k), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
                if keep_ids:
                    columns.append(pa.array(shown, pa.large_binary()).cast(pa.large_string()))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
        table.close()

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(
        run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids string" if keep_ids else ""))

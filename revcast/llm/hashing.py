"""Words of whole text columns as 64-bit hashes, in arrays."""

from __future__ import annotations

import numpy as np

from .common import _ALNUM

#: Bytes beyond this place in a word are hashed one word at a time.
_PLACES = 64
_TAB = np.random.default_rng(20240607).integers(1, 1 << 63, (_PLACES, 256), dtype=np.uint64).ravel()

#: byte -> byte of the normalised word, 0 between words
ALNUM = np.frombuffer(_ALNUM, np.uint8).copy()
ALNUM[ALNUM == 32] = 0
SPACE = np.frombuffer(bytes(range(256)).lower(), np.uint8).copy()
SPACE[[9, 10, 11, 12, 13, 32]] = 0
SPACE[0] = 255  # a zero byte is part of a word; 255 is no byte of UTF-8


def hash_words(data: np.ndarray, doc_ends: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all documents of a UTF-8 buffer as tabulation hashes, and how many each document has."""
    hashes, counts, _, _ = word_spans(data, doc_ends, rule)
    return hashes, counts


def word_spans(data: np.ndarray, doc_ends: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``hash_words``, and where each word begins in the buffer and how many bytes it has."""
    mapped = rule[data]
    inside = mapped > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_docs = np.concatenate([[0], doc_ends[:-1]]).astype(np.int64)
    starts_of_docs = starts_of_docs[starts_of_docs < len(data)]
    first[starts_of_docs] = inside[starts_of_docs]
    starts = np.flatnonzero(first)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, doc_ends, "left")]))
    if not len(starts):
        return np.zeros(0, np.uint64), counts, starts, starts
    word_bytes = mapped[inside]
    at = np.flatnonzero(first[inside])  # where words begin among the words' bytes
    sizes = np.diff(np.append(at, len(word_bytes)))
    place = np.arange(len(word_bytes)) - np.repeat(at, sizes)
    np.minimum(place, _PLACES - 1, out=place)
    hashes = np.add.reduceat(_TAB[(place << 8) + word_bytes], at)
    long = np.flatnonzero(sizes > _PLACES)
    if len(long):
        import xxhash

        for k in long:
            hashes[k] = xxhash.xxh3_64_intdigest(word_bytes[at[k] : at[k] + sizes[k]].tobytes())
    return hashes, counts, starts, sizes

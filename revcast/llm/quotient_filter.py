"""Counting quotient filters of n-grams of word ids, built whole and merged in order.

An n-gram of ids below 2^bits is packed into one key of n * bits bits. An
invertible permutation spreads the keys evenly; the upper bits of the permuted
key are its quotient, all other bits its remainder. A filter keeps its entries
in the order of the permuted key:

* ``occupied``: a bit for each quotient, set where it has entries;
* ``run ends``: a bit for each entry, set at the last one of its quotient;
* the remainders, whole bytes each;
* the counters: a bit for "more than one", then a byte for each of those, and
  eight bytes where a byte is not enough.

The remainder is kept in full and the permutation can be undone, so nothing is
approximate: a filter gives back exactly the n-grams and counts that went in.
Filters over the same keys are merged by their common order, whatever their
numbers of quotients. Where n * bits passes 64 the last id (``low``) stays
beside the permuted upper ids and is mixed into them, so that the quotients of
a frequent pair of words are spread too.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd factors of the permutation and of the spread of a last id kept apart.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPREAD = _U(0x165667B19E3779F9)


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


class Packing:
    """n-grams of ids below 2^bits as keys: (upper, low); low has no bits where one integer holds all ids."""

    def __init__(self, n: int, bits: int):
        if bits > 32:
            raise ValueError("word ids of more than 32 bits")
        self.n, self.bits = n, bits
        self.low_bits = bits if n * bits > 64 else 0
        self.upper_bits = n * bits - self.low_bits

    def keys(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
        """Permuted keys of n-grams, given as n arrays of ids."""
        upper = np.zeros(len(ids[0]), _U)
        for part in ids[: self.n - bool(self.low_bits)]:
            upper = (upper << _U(self.bits)) | part.astype(_U)
        low = ids[-1].astype(_U) if self.low_bits else None
        return self._permute(upper, low), low

    def ids(self, upper: np.ndarray, low: np.ndarray | None) -> list[np.ndarray]:
        """The n-grams of permuted keys."""
        upper, out = self._restore(upper, low), []
        for k in range(self.n - bool(self.low_bits)):
            shift = self.bits * (self.n - bool(self.low_bits) - 1 - k)
            out.append(((upper >> _U(shift)) & _mask(self.bits)).astype(np.int64))
        return out if low is None else [*out, low.astype(np.int64)]

    def _permute(self, x: np.ndarray, low: np.ndarray | None) -> np.ndarray:
        mask, half = _mask(self.upper_bits), _U((self.upper_bits + 1) // 2)
        for factor in _FACTORS:
            x = (x * _U(factor)) & mask
            x = x ^ (x >> half)
        return x if low is None else (x + (low * _SPREAD ^ (low * _SPREAD >> _U(29)))) & mask

    def _restore(self, x: np.ndarray, low: np.ndarray | None) -> np.ndarray:
        mask, half = _mask(self.upper_bits), _U((self.upper_bits + 1) // 2)
        if low is not None:
            x = (x - (low * _SPREAD ^ (low * _SPREAD >> _U(29)))) & mask
        for factor in reversed(_FACTORS):
            x = x ^ (x >> half)  # half of the bits at least, so it is its own inverse
            x = (x * _U(pow(factor, -1, 1 << self.upper_bits))) & mask
        return x

    def shard(self, upper: np.ndarray, shard_bits: int) -> np.ndarray:
        """The upper bits of permuted keys: which shard holds them."""
        bits = min(shard_bits, self.upper_bits)
        return (upper >> _U(self.upper_bits - bits)).astype(np.int64) if bits else np.zeros(len(upper), np.int64)

    # ---- filters

    def count(self, upper: np.ndarray, low: np.ndarray | None, counts: np.ndarray | None = None):
        """Distinct keys in order, with their counts added up."""
        if low is None and counts is None:
            upper, counts = np.unique(upper, return_counts=True)
            return upper, None, counts.astype(_U)
        order = np.argsort(upper, kind="stable") if low is None else np.lexsort((low, upper))
        upper, low = upper[order], None if low is None else low[order]
        counts = np.ones(len(upper), _U) if counts is None else counts[order]
        new = np.ones(len(upper), bool)
        new[1:] = upper[1:] != upper[:-1]
        if low is not None:
            new[1:] |= low[1:] != low[:-1]
        at = np.flatnonzero(new)
        return upper[at], None if low is None else low[at], np.add.reduceat(counts, at) if len(at) else counts

    def build(self, upper: np.ndarray, low: np.ndarray | None, counts: np.ndarray, shard_bits: int = 0) -> bytes:
        """The filter of distinct keys in order, all of one shard."""
        n, bits = len(upper), self.upper_bits - min(shard_bits, self.upper_bits)
        shard = int(upper[0] >> _U(bits)) if n and bits < 64 else 0
        key = upper & _mask(bits)
        wide = max(0, -(-(bits - n.bit_length() - 2) // 8))  # bytes of a remainder; at most eight quotients an entry
        rest = min(bits, 8 * wide)
        quotient = (key >> _U(rest)).astype(np.int64) if rest < 64 else np.zeros(n, np.int64)
        occupied = np.zeros(1 << (bits - rest), bool)
        occupied[quotient] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        many = counts > 1
        small = np.minimum(counts[many], 255).astype(np.uint8)
        big = counts[counts >= 255]
        parts = [np.array([n, bits, rest, wide, shard, len(small), len(big)], "<u8").view(np.uint8), np.packbits(occupied), np.packbits(ends),
                 _bytes(key & _mask(rest), wide), np.packbits(many), small, big.astype("<u8").view(np.uint8)]
        if low is not None:
            parts.append(_bytes(low, -(-self.low_bits // 8)))
        return b"".join(p.tobytes() for p in parts)

    def read(self, raw: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Permuted keys in order and their counts."""
        data, at = np.frombuffer(raw, np.uint8), 56
        n, bits, rest, wide, shard, n_small, n_big = (int(x) for x in data[:56].view("<u8"))

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return data[at - size : at]

        slots = 1 << (bits - rest)
        occupied = np.flatnonzero(np.unpackbits(take(-(-slots // 8)), count=slots))
        ends = np.unpackbits(take(-(-n // 8)), count=n)
        run = np.cumsum(ends) - ends
        key = _ints(take(n * wide), n, wide)
        many = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
        small = take(n_small).astype(_U)
        small[small == 255] = take(8 * n_big).view("<u8") if n_big else 0
        counts = np.ones(n, _U)
        counts[many] = small
        if rest < 64:
            key = key | (occupied[run].astype(_U) << _U(rest))
        if bits < 64:
            key = key | (_U(shard) << _U(bits))
        low = _ints(take(n * -(-self.low_bits // 8)), n, -(-self.low_bits // 8)) if self.low_bits else None
        return key, low, counts

    def merge(self, filters: list[bytes]):
        """Distinct keys in order and their counts over all filters."""
        read = [self.read(f) for f in filters]
        low = np.concatenate([r[1] for r in read]) if self.low_bits else None
        return self.count(np.concatenate([r[0] for r in read]), low, np.concatenate([r[2] for r in read]))


def _bytes(values: np.ndarray, wide: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).ravel()


def _ints(raw: np.ndarray, n: int, wide: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = raw.reshape(n, wide)
    return out.view("<u8").ravel()

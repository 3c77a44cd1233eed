"""Counting quotient filters: exact, compact, mergeable counters of fixed-width keys.

A key of ``bits`` bits (up to 128) is permuted invertibly, so that any set of keys spreads
evenly; the upper bits of the permuted key are its quotient, the rest its remainder, which is
stored in full.  So nothing is lost: a filter gives back its keys.  Entries are held in order
of (quotient, remainder); ``occupied`` has a bit per quotient, ``run_end`` a bit per entry,
set at the last entry of each quotient, and rank and select on the two find the run of a
quotient.  Most counters are 1 and take one bit; the others are listed.  Filters of one
layout merge in order, as sorted runs do.

Permuted keys are pairs of arrays ``(top, low)``: the upper 64 bits (or all, if there are
fewer) and the rest.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

from lexiflow.llm.common import mix64

ROUNDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
MAX_BITS = 128

U = np.uint64


def _mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


def _left(x: np.ndarray, n: int) -> np.ndarray:
    return x << U(n) if n < 64 else np.zeros_like(x)


def _right(x: np.ndarray, n: int) -> np.ndarray:
    return x >> U(n) if n < 64 else np.zeros_like(x)


def pack(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) 64 bits of keys made of ``width``-bit ids, the first id uppermost."""
    lo = np.zeros(len(ids[0]), U)
    hi = np.zeros(len(ids[0]), U)
    for x in ids:
        hi = _left(hi, width) | _right(lo, 64 - width)
        lo = _left(lo, width) | x.astype(U)
    return hi, lo


def unpack(hi: np.ndarray, lo: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    out = []
    for _ in range(n):
        out.append((lo & _mask(width)).astype(np.int64))
        lo = _right(lo, width) | _left(hi, 64 - width)
        hi = _right(hi, width)
    return out[::-1]


def _round(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(x + U(key)) >> U(64 - bits)


def permute(hi: np.ndarray, lo: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Four Feistel rounds over the halves of ``bits``-bit keys; (top, low) of the result."""
    if not 2 <= bits <= MAX_BITS:
        raise ValueError(f"keys of {bits} bits; 2 to {MAX_BITS} are possible")
    b = bits // 2
    a = bits - b
    left = (_left(hi, 64 - b) | _right(lo, b)) & _mask(a)
    right = lo & _mask(b)
    for i, key in enumerate(ROUNDS):
        if i % 2:
            right = right ^ _round(left, key, b)
        else:
            left = left ^ _round(right, key, a)
    if bits <= 64:
        return _left(left, b) | right, np.zeros(len(left), U)
    rest = bits - 64
    return _left(left, 64 - a) | _right(right, rest), right & _mask(rest)


def restore(top: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The (high, low) keys that ``permute`` took."""
    b = bits // 2
    a = bits - b
    if bits <= 64:
        left, right = _right(top, b), top & _mask(b)
    else:
        left = _right(top, 64 - a)
        right = _left(top & _mask(64 - a), bits - 64) | low
    for i, key in reversed(list(enumerate(ROUNDS))):
        if i % 2:
            right = right ^ _round(left, key, b)
        else:
            left = left ^ _round(right, key, a)
    return _right(left, 64 - b), _left(left, b) | right


def counted(top: np.ndarray, low: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (top, low) in order with their summed counts (of 1 each by default)."""
    if n is None and not low.any():
        top, total = np.unique(top, return_counts=True)
        return top, np.zeros(len(top), U), total.astype(np.int64)
    # sorted filters one after another are merged run by run
    order = np.argsort(top, kind="quicksort" if n is None else "stable")
    top, low = top[order], low[order]
    same = top[1:] == top[:-1]
    if len(low) and (same & (low[1:] < low[:-1])).any():
        tied = np.zeros(len(top), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        inner = np.lexsort((low[at], top[at]))
        low[at], order[at] = low[at[inner]], order[at[inner]]
    new = np.ones(len(top), bool)
    new[1:] = ~same | (low[1:] != low[:-1])
    lead = np.flatnonzero(new)
    if n is None:
        total = np.diff(np.append(lead, len(top)))
    else:
        total = np.add.reduceat(n[order], lead) if len(lead) else np.zeros(0, np.int64)
    return top[lead], low[lead], total.astype(np.int64)


class Filter:
    """Counters of permuted keys that share their first ``prefix`` bits."""

    def __init__(self, bits: int, prefix: int, top: np.ndarray, low: np.ndarray, n: np.ndarray):
        """From distinct keys in order."""
        self.bits, self.prefix, self.size = bits, prefix, len(top)
        self.head = int(_right(top[:1], self._top_bits - prefix)[0]) if len(top) and prefix else 0
        self.q = self._quotient_bits(len(top))
        rest = self._top_bits - prefix - self.q
        body = top & _mask(self._top_bits - prefix)
        quotient = _right(body, rest).astype(np.int64)
        self.occupied = np.zeros(1 << self.q, bool)
        self.occupied[quotient] = True
        self.run_end = np.ones(len(top), bool)
        self.run_end[:-1] = quotient[1:] != quotient[:-1]
        body = body & _mask(rest)
        self.rem_hi = _right(body, 64 - self._low_bits) if self._low_bits else np.zeros(len(top), U)
        self.rem_lo = _left(body, self._low_bits) | low
        self.n = n.astype(np.int64)

    @property
    def _top_bits(self) -> int:
        return min(self.bits, 64)

    @property
    def _low_bits(self) -> int:
        return self.bits - self._top_bits

    def _quotient_bits(self, n: int) -> int:
        """About one entry per quotient, and whole bytes of remainder."""
        free = self._top_bits - self.prefix
        most = min(free, max(0, n.bit_length() - 1) + 1)
        for q in range(most, max(-1, most - 8), -1):
            if (self.bits - self.prefix - q) % 8 == 0:
                return q
        return most

    @property
    def remainder_bytes(self) -> int:
        return -(-(self.bits - self.prefix - self.q) // 8)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(top, low, count) in order."""
        rest = self._top_bits - self.prefix - self.q
        runs = np.concatenate([[0], np.cumsum(self.run_end)[:-1]]) if self.size else np.zeros(0, np.int64)
        quotient = np.flatnonzero(self.occupied)[runs.astype(np.int64)].astype(U)
        low_bits = self._low_bits
        body = _right(self.rem_lo, low_bits) | (_left(self.rem_hi, 64 - low_bits) if low_bits else U(0))
        top = _left(np.full(self.size, self.head, U), self._top_bits - self.prefix) | _left(quotient, rest) | body
        return top, self.rem_lo & _mask(low_bits), self.n

    def counts(self, top: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Counts of permuted keys (0 for others), by rank and select."""
        rest = self._top_bits - self.prefix - self.q
        body = top & _mask(self._top_bits - self.prefix)
        quotient = _right(body, rest).astype(np.int64)
        here = self.occupied[quotient]
        if self.prefix:
            here &= _right(top, self._top_bits - self.prefix) == U(self.head)
        body = body & _mask(rest)
        lo = _left(body, self._low_bits) | low
        hi = _right(body, 64 - self._low_bits) if self._low_bits else np.zeros(len(top), U)
        rank = np.cumsum(self.occupied)[quotient]  # of the run, from 1
        select = np.flatnonzero(self.run_end)
        out = np.zeros(len(top), np.int64)
        for i in np.flatnonzero(here):
            a = int(select[rank[i] - 2]) + 1 if rank[i] > 1 else 0
            b = int(select[rank[i] - 1]) + 1
            hit = np.flatnonzero((self.rem_lo[a:b] == lo[i]) & (self.rem_hi[a:b] == hi[i]))
            out[i] = self.n[a + hit[0]] if len(hit) else 0
        return out

    def to_bytes(self) -> bytes:
        planes = np.stack([self.rem_lo, self.rem_hi], 1).astype("<u8").view(np.uint8).reshape(self.size, 16)
        many = self.n > 1
        body = [
            struct.pack("<HHQQ", self.bits, self.prefix, self.size, self.head),
            np.packbits(self.occupied).tobytes(),
            np.packbits(self.run_end).tobytes(),
            np.ascontiguousarray(planes[:, : self.remainder_bytes].T).tobytes(),
            np.packbits(many).tobytes(),
            np.ascontiguousarray(self.n[many].astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(),
        ]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Filter:
        raw = zstandard.ZstdDecompressor().decompress(data)
        out = cls.__new__(cls)
        out.bits, out.prefix, out.size, out.head = struct.unpack_from("<HHQQ", raw)
        out.q, n, at = out._quotient_bits(out.size), out.size, struct.calcsize("<HHQQ")

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(raw, np.uint8, size, at - size)

        out.occupied = np.unpackbits(take(-(-(1 << out.q) // 8)), count=1 << out.q).astype(bool)
        out.run_end = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
        planes = np.zeros((n, 16), np.uint8)
        planes[:, : out.remainder_bytes] = take(n * out.remainder_bytes).reshape(-1, n).T
        words = planes.view("<u8")
        out.rem_lo, out.rem_hi = words[:, 0].astype(U), words[:, 1].astype(U)
        many = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
        out.n = np.ones(n, np.int64)
        left = int(many.sum())
        out.n[many] = np.ascontiguousarray(take(8 * left).reshape(8, left).T).view("<u8").ravel().astype(np.int64)
        return out


def merge(filters: list[Filter]) -> Filter:
    """One filter with the sums of all (of equal layout: bits and prefix)."""
    parts = [f.entries() for f in filters]
    top, low, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Filter(filters[0].bits, filters[0].prefix, *counted(top, low, n))


def by_prefix(bits: int, prefix: int, top: np.ndarray, low: np.ndarray, n: np.ndarray):
    """(prefix value, filter) for each range of leading bits that keys in order touch."""
    value = _right(top, min(bits, 64) - prefix).astype(np.int64) if prefix else np.zeros(len(top), np.int64)
    if not len(top):
        return
    cut = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    for a, b in zip(cut, [*cut[1:], len(top)], strict=True):
        yield int(value[a]), Filter(bits, prefix, top[a:b], low[a:b], n[a:b])

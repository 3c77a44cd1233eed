"""Pre-tokenisation and exact merging for BPE vocabularies with word ends.

Texts are cut on raw bytes into pieces (runs of letters, single digits, runs of other
signs), lower-cased; equal pieces of a slice are resolved to ids once.  The fast path
covers ASCII and the letters of Latin-1.  A chunk between ASCII white space with any other
byte, an apostrophe or ``<|`` (contractions, special tokens) stays whole and raw, and is
normalised and cut by the tokenizer file's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa

from lexiflow.llm import common as C

_KIND = np.full(256, 3, np.int8)  # 0 white space, 1 letter, 2 digit, 3 other
_KIND[C.WS] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[0x80:0xC0] = _KIND[0xC3] = 1
_KIND[48:58] = 2
_ODD = np.zeros(256, bool)
_ODD[0x27] = True
_ODD[0xC0:] = True
_ODD[0xC3] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _each(raw: bytes, table: np.ndarray) -> np.ndarray:
    """``table[raw]``; bytes are translated several times as fast as NumPy indexes."""
    return np.frombuffer(raw.translate(table.tobytes()), table.dtype)


def cut(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, index of each document's first piece and one for the end)."""
    buf, off = C.bounds(text)
    n = len(buf)
    if n == 0:
        return pa.array([], pa.binary()), np.zeros(len(off), np.int64)
    raw = buf.tobytes()
    kind = _each(raw, _KIND)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge = edge[:n]
    prev = np.empty_like(kind)
    prev[0], prev[1:] = 0, kind[:-1]
    prev[edge] = 0
    solid = kind != 0
    chunk = solid & (prev == 0)
    odd = _each(raw, _ODD).copy()
    nxt = np.zeros(n, np.uint8)
    nxt[:-1] = buf[1:]
    odd |= (buf == 0x3C) & (nxt == 0x7C)
    odd |= (buf == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7))
    tail = (buf & 0xC0) == 0x80
    before = np.zeros(n, np.uint8)
    before[1:] = buf[:-1]
    odd |= tail & (before != 0xC3)
    low = _each(raw, _LOW).copy()
    high = tail & (before == 0xC3) & (buf <= 0x9E)
    low[high] += 0x20
    start = chunk | (solid & ((kind != prev) | (kind == 2)))
    strange = np.flatnonzero(odd & solid)
    if len(strange):
        begins = np.append(np.flatnonzero(chunk), n)
        whole = np.unique(np.searchsorted(begins, strange, "right")) - 1
        mark = np.zeros(n + 1, np.int8)
        mark[begins[whole]] = 1
        mark[begins[whole + 1]] -= 1
        inside = np.cumsum(mark[:n], dtype=np.int8).view(bool) & solid
        start &= ~inside | chunk
        low = np.where(inside, buf, low)
    data = low[solid]
    at = np.flatnonzero(start[solid])
    offs = np.append(at, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(data)])
    return pieces, np.searchsorted(np.flatnonzero(start), off)


_PLAIN = re.compile(rb"(?:[\x00-\x26\x28-\x7f]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*\Z")


def is_odd(piece: bytes) -> bool:
    """Whether ``cut`` kept this piece whole and raw."""
    return _PLAIN.match(piece) is None or b"<|" in piece


def odd(pieces: pa.Array) -> np.ndarray:
    """``is_odd`` of every piece of an array."""
    buf, off = C.bounds(pieces)
    if len(buf) == 0:
        return np.zeros(len(pieces), bool)
    nxt, before = np.append(buf[1:], np.uint8(0)), np.append(np.uint8(0), buf[:-1])
    inner = off[(off > 0) & (off < len(buf))]
    nxt[inner - 1] = before[inner] = 0
    tail = (buf & 0xC0) == 0x80
    bad = _ODD[buf] | (tail & ((before != 0xC3) | (buf == 0x97) | (buf == 0xB7))) | ((buf == 0xC3) & ((nxt & 0xC0) != 0x80))
    return C.per_doc(bad | ((buf == 0x3C) & (nxt == 0x7C)), off) > 0


def gather(code: np.ndarray, first: np.ndarray, start: np.ndarray, length: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, offsets) from the codes of their pieces."""
    n = length[code]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    ids = pool[np.repeat(start[code] - (ends - n), n) + np.arange(total)] if total else pool[:0]
    return ids, np.concatenate([[0], ends])[first]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in out]
    out.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [out[b] for b in range(256)]


class Vocabulary:
    """Token strings and merges of a tokenizer file, as arrays."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        chars = byte_alphabet()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.end] for c in chars], np.int32)
        self.byte_of = {c: b for b, c in enumerate(chars)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank_of = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.none = np.int32(len(pairs))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; ``none`` where there is no merge (or no symbol)."""
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank_of[at], self.none)

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): every word merged by rank, leftmost first, until no pair merges."""
        buf, off = C.bounds(words)
        size = np.diff(off)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in (6, 12, 24):
            at = np.flatnonzero((size > low) & (size <= width))
            low = width
            for a in range(0, len(at), 1 << 15):
                w = at[a : a + (1 << 15)]
                m = self._merge_grid(buf, off[w], size[w], width)
                parts.append((w, m, m >= 0))
        out_len = np.zeros(len(size), np.int64)
        for w, _, keep in parts:
            out_len[w] = keep.sum(1)
        long = {int(w): self._merge_one(buf[off[w] : off[w + 1]]) for w in np.flatnonzero(size > low)}
        for w, ids in long.items():
            out_len[w] = len(ids)
        ends = np.concatenate([[0], np.cumsum(out_len)])
        out = np.zeros(int(ends[-1]), np.int32)
        for w, m, keep in parts:
            n = out_len[w]
            out[np.repeat(ends[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = m[keep]
        for w, ids in long.items():
            out[ends[w] : ends[w + 1]] = ids
        return out, ends

    def _merge_grid(self, buf, off, size, width) -> np.ndarray:
        cols = np.arange(width)
        b = buf[np.minimum(off[:, None] + cols, len(buf) - 1)]
        m = np.where(cols < size[:, None] - 1, self.inner[b], self.last[b])
        m[cols >= size[:, None]] = -1
        if width == 1:
            return m
        ranks = np.full(m.shape, self.none, np.int32)
        ranks[:, :-1] = self.rank(m[:, :-1], m[:, 1:])
        active = np.arange(len(m))
        while len(active):
            r = ranks[active]
            j = r.argmin(1)
            best = r[np.arange(len(r)), j]
            live = best < self.none
            active, r, j, best = active[live], r[live], j[live], best[live]
            if not len(active):
                break
            row = np.arange(len(active))
            take = np.minimum(cols + (cols > j[:, None]), width - 1)
            x = np.take_along_axis(m[active], take, 1)
            x[:, -1] = np.where(j < width - 1, -1, x[:, -1])
            x[row, j] = self.merged[best]
            r = np.take_along_axis(r, take, 1)
            r[:, -1] = self.none
            nxt = np.where(j + 1 < width, x[row, np.minimum(j + 1, width - 1)], -1)
            r[row, j] = self.rank(x[row, j], nxt)
            back = np.flatnonzero(j > 0)
            r[back, j[back] - 1] = self.rank(x[back, j[back] - 1], x[back, j[back]])
            m[active], ranks[active] = x, r
        return m

    def _merge_one(self, word: np.ndarray) -> list[int]:
        """The same for one long word, with a heap over a linked list."""
        ids = [*self.inner[word[:-1]].tolist(), int(self.last[word[-1]])]
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks = self.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < self.none]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = nxt[i]
            if ids[i] != a or k < 0 or ids[k] != b:
                continue
            ids[i], ids[k] = int(self.merged[r]), -1
            nxt[i] = nxt[k]
            if nxt[k] >= 0:
                prv[nxt[k]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0:
                    rr = int(self.rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if rr < self.none:
                        heapq.heappush(heap, (rr, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


class OddChunks:
    """Ids of chunks outside the fast path: special tokens first, then the file's own
    normaliser and pre-tokeniser, then exact merges.  Keeps a bounded memo."""

    def __init__(self, file: str, vocab: Vocabulary):
        self.file, self.vocab, self.memo = file, vocab, {}
        names = sorted(vocab.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    @cached_property
    def tok(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.file)  # only if a task meets such a chunk

    def ids(self, chunk: bytes) -> list[int]:
        got = self.memo.get(chunk)
        if got is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            got = self.memo[chunk] = self._ids(chunk.decode("utf-8"))
        return got

    def _ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for part in self.split.split(chunk) if self.split else [chunk]:
            if part in self.vocab.special:
                out.append(self.vocab.special[part])
                continue
            text = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
            pieces = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]
            raw = [bytes(self.vocab.byte_of[c] for c in p) for p in pieces if p]
            out.extend(self.vocab.merge(pa.array(raw, pa.binary()))[0].tolist())
        return out

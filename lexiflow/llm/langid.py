"""Language ID: bit-sliced Bloom filters over character n-grams.

One table of slots serves all languages: bit ``l`` of a slot belongs to the Bloom filter
of language ``l``, so the AND of the slots of an n-gram is the set of all languages that
contain it.  The popcount of each language over the n-grams of a text, corrected for
that filter's false positives, decides.

Learning counts the n-grams of every training text per language (whole table, by Spark).
A language contains an n-gram when its rate there is at least ``MIN_RATE`` and at least
``SHARE`` of its highest rate in any language; the rate floor bounds the n-grams of one
language by ``1 / MIN_RATE`` at every input size, hence the size of the table too.

Defined results: null texts and texts without a letter are ``und`` with score 0; letters
without any n-gram (single letters of unknown words) or without a known one get the most
frequent learned language with score 0; ties go to the smaller language code.  With
nothing learned every text is ``und``.  Code points are folded to 16 bits.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import common as C

ORDERS = (3, 4)
MIN_RATE = 1e-5
SHARE = 0.2
HASHES = 3
BITS_PER_GRAM = 16
MIN_SCORE = 0.2  # the pipeline rejects texts less than this share of whose n-grams are known
MAX_LANGUAGES = 4096

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

_LOWER: np.ndarray | None = None


def lower_letters() -> np.ndarray:
    """Per code point: 0 for a non-letter, else its lower case folded to 16 bits (never 0)."""
    global _LOWER
    if _LOWER is None:
        table = np.zeros(sys.maxunicode + 1, np.uint16)
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                table[cp] = (ord(low[0]) & 0xFFFF) or 1
        _LOWER = table
    return _LOWER


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the document offsets in code points."""
    lead = (buf & 0xC0) != 0x80
    n = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=n[1:])
    return np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), n[off]


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-grams, their documents, letters per document).  A run of letters is a
    word; its n-grams may reach one place beyond either end."""
    buf, off = C.bounds(text)
    cps, off = code_points(buf, off)
    c = lower_letters()[cps]
    letters = C.per_doc(c != 0, off)
    # one empty place between documents, so that no n-gram spans two of them
    wide = np.zeros(len(c) + len(off), np.uint64)
    shift = np.repeat(np.arange(1, len(off)), np.diff(off))
    wide[np.arange(len(c)) + shift] = c
    doc = np.zeros(len(wide), np.int32)
    doc[np.arange(len(c)) + shift] = shift - 1
    keys, docs = [], []
    for n in ORDERS:
        if len(wide) < n:
            continue
        key = wide[: len(wide) - n + 1].copy()
        ok = np.ones(len(key), bool)
        for k in range(1, n):
            nxt = wide[k : len(wide) - n + 1 + k]
            key = (key << np.uint64(16)) | nxt
            if k < n - 1:
                ok &= nxt != 0
        at = np.flatnonzero(ok)
        keys.append(C.mix64(key[at] ^ np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1))))
        docs.append(doc[at + 1])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), letters
    return np.concatenate(keys), np.concatenate(docs), letters


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all rows; each task merges its own counts before the shuffle."""

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, text in C.slices(batch, 0):
                lang, names = C.codes(part.column(1))
                g, d, _ = grams(text)
                for i, name in enumerate(names.to_pylist()):
                    u, n = np.unique(g[lang[d] == i], return_counts=True)
                    if name in held:
                        a, b = held[name]
                        u, inv = np.unique(np.concatenate([a, u]), return_inverse=True)
                        n = np.bincount(inv, np.concatenate([b, n]), len(u)).astype(np.int64)
                    if len(u) > 300_000:  # bounded memory: pass on what is held
                        yield from out(name, u, n)
                        u, n = u[:0], n[:0]
                    held[name] = (u, n)
        for name, (u, n) in held.items():
            yield from out(name, u, n)

    def out(name, u, n):
        for a in range(0, len(u), 100_000):
            part = u[a : a + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(n[a : a + 100_000])], names=["lang", "gram", "n"]
            )

    src = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    return src.mapInArrow(C.task(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilters:
    """Slots of language masks.  ``words`` holds ceil(languages / 64) words per slot."""

    def __init__(self, langs: list[str], words: np.ndarray, wrong: np.ndarray, common: int):
        self.langs, self.words, self.wrong, self.common = langs, words, wrong, common

    @classmethod
    def build(cls, langs: list[str], lang_of: np.ndarray, gram: np.ndarray, common: int) -> LanguageFilters:
        most = int(np.bincount(lang_of, minlength=max(len(langs), 1)).max()) if len(lang_of) else 0
        size = 1 << max(10, int(np.ceil(np.log2(max(most, 1) * BITS_PER_GRAM))))
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(langs) <= np.iinfo(k).bits), np.uint64)
        per = np.iinfo(kind).bits
        words = np.zeros((max(1, -(-len(langs) // per)), size), kind)
        for h in slots(gram, size):
            for i in range(len(langs)):
                at = h[lang_of == i]
                words[i // per, at] |= kind(1 << (i % per))
        fill = np.array([((words[i // per] >> kind(i % per)) & kind(1)).mean() for i in range(len(langs))])
        return cls(langs, words, fill**HASHES, common)

    def contain(self, gram: np.ndarray) -> list[np.ndarray]:
        """Language masks of n-grams: one array per word of 8 to 64 languages."""
        hs = list(slots(gram, self.words.shape[1]))
        out = []
        for row in self.words:
            m = row[hs[0]]
            for h in hs[1:]:
                m &= row[h]
            out.append(m)
        return out

    def popcounts(self, gram: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """(documents x languages) n-grams of each document that each language contains."""
        per = self.words.dtype.itemsize * 8
        masks = self.contain(gram)
        out = np.zeros((n_docs, len(self.langs)), np.int64)
        for i in range(len(self.langs)):
            bit = (masks[i // per] >> self.words.dtype.type(i % per)) & self.words.dtype.type(1)
            out[:, i] = np.bincount(doc[bit.astype(bool)], minlength=n_docs)
        return out


def slots(gram: np.ndarray, size: int):
    step = (gram >> np.uint64(33)) | np.uint64(1)
    at = gram.copy()
    for _ in range(HASHES):
        yield (at & np.uint64(size - 1)).astype(np.int64)
        with np.errstate(over="ignore"):
            at = at + step


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """Filters of all languages of ``docs``; rows with a null text or language teach nothing.

    The driver gets the n-grams above the rate floor only: at most
    ``len(ORDERS) / MIN_RATE`` of each language.
    """
    counts = C.stored(gram_counts(docs, text_col, lang_col), "langid-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = {r["lang"]: r["total"] for r in totals.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return LanguageFilters([], np.zeros((1, 1024), np.uint8), np.zeros(0), 0)
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    floor = rated.where(F.col("rate") >= MIN_RATE)
    top = floor.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = floor.join(top, "gram").where(F.col("rate") >= SHARE * F.col("top")).select("lang", "gram").toArrow()
    langs = sorted(sizes)
    place = {x: i for i, x in enumerate(langs)}
    lang_of = np.array([place[x] for x in kept["lang"].to_pylist()], np.int64)
    common = max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i))
    return LanguageFilters.build(langs, lang_of, kept["gram"].to_numpy().view(np.uint64), common)


def predict(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", into: str = "_lang") -> DataFrame:
    """All columns of ``docs`` and the struct ``into`` (lang_pred, score).

    The score is the corrected share of the n-grams that the language contains.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.langs, filters.words, filters.wrong, filters.common))

    def make():
        f = LanguageFilters(*shared.value)

        def kernel(text):
            g, d, letters = grams(text)
            n_docs = len(letters)
            if not f.langs:
                return [pa.array(["und"] * n_docs, pa.string()), np.zeros(n_docs)]
            n = np.bincount(d, minlength=n_docs)[:, None]
            true = np.clip((f.popcounts(g, d, n_docs) - n * f.wrong) / (1 - np.minimum(f.wrong, 0.99)), 0, None)
            best = true.argmax(1)
            score = np.clip(true.max(1) / np.maximum(n[:, 0], 1), 0, 1)
            best = np.where(score > 0, best, f.common)
            names = np.where(letters > 0, best, len(f.langs))
            return [pc.take(pa.array([*f.langs, "und"], pa.string()), pa.array(names)), np.where(letters > 0, score, 0.0)]

        return kernel

    return C.annotate(docs, text_col, make, FIELDS, into)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((C.fold("doc_id", 3) != 1) & F.col("lang").isNotNull())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; texts without letters or in none of the learned
    languages (score under MIN_SCORE) go."""
    C.prepare(spark)
    into = C.fresh(docs, "_lang")
    out = predict(docs, learn(training_rows(docs)), into=into)
    return out.where((F.col(into)["lang_pred"] != "und") & (F.col(into)["score"] >= MIN_SCORE)).drop(into)


def query(spark, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.source_table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), learn(training_rows(docs)))
    return out.select("doc_id", F.coalesce(C.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "_lang.*")

"""Phrase collocations: n-gram counts in counting quotient filters, scored by association.

Texts (A-Z lower-cased) are cut at sentence signs and line ends into pieces, and pieces into
words.  Per language, a phrase of 2 to ``MAX_WORDS`` words that occurs ``MIN_COUNT`` times or
more is a candidate; its score is the lowest ``floor(1000 a n / (l r))`` over all cuts into a
first part and a rest, with ``a``, ``l``, ``r`` their counts and ``n`` all words.  Candidates
inside a longer one that is as frequent are dropped.

1. Words are counted per (language, word); the frequent ones get dense ids.  A phrase with
   another word can't be a candidate, so ids exist for these words only.
2. A task turns its texts into ids, packs the ids of each n-gram into one integer, permutes it
   invertibly, and keeps the counts as sorted runs; they are sent on as counting quotient
   filters (:mod:`lexiflow.llm.cqf`), cut by leading quotient bits.
3. The filters of a range of quotients are merged in order; counts of ``MIN_COUNT`` or more
   are unpacked into word ids.  The permutation spreads any n-grams evenly over the ranges, a
   hot n-gram is one entry per task, and the number of ranges follows the corpus.
4. Word pairs are counted first.  The quotients that frequent pairs occupy make a bit vector of
   ``PAIR_BITS`` at most, whatever the corpus; a longer phrase is counted only if all its
   pairs' quotients are occupied.  No frequent phrase is lost: each of its pairs is as frequent.
5. Scores, containment and ranking are joins and aggregations over the candidates.

The word table is broadcast up to ``MAX_BROADCAST`` words (counted first); beyond it is joined
to the distinct words of each document by shuffle, with the same result.  A key has 128 bits,
so up to 2^25 frequent words are possible with phrases of five; more raise an error.

Defined results: a null text is empty, a null language is ``und`` (as a language of that name),
repeated rows count as often as they occur, an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm import common as C
from lexiflow.llm import cqf
from lexiflow.operators.features import dense_ids

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
SHARE = 100  # a phrase goes if a longer one has this many hundredths of its count
MAX_BROADCAST = 1 << 22  # words
BUCKET_ENTRIES = 1 << 20  # n-grams of one length and range of quotients, on average
HELD = 1 << 19  # words, or n-grams of one length, that a task holds before it sends them on
TEXT_SLICE = 1 << 20
GROUP_ROWS = 50_000  # candidates ranked by one task
PAIR_BITS = 29  # log2 of the longest bit vector of pair quotients (64 MB)
BLOCK_BITS = 19  # log2 of the part of it that one group makes

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


class Words:
    """Words of a slice: ``code`` per place, the distinct words, the document of each place, and
    ``linked[i]`` if place ``i + 1`` follows in the same piece."""

    def __init__(self, text: pa.Array):
        buf, off = C.bounds(text)
        buf = _LOW[buf]
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        solid = ~_GAP[buf]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        at = np.searchsorted(starts, off)
        self.n = np.diff(at)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.code, self.distinct = C.codes(C.pick(buf, starts, ends))
        breaks = np.cumsum(_BREAK[buf])[starts] if n else np.zeros(0, np.int64)
        self.linked = (breaks[1:] == breaks[:-1]) & (self.doc[1:] == self.doc[:-1])


def _by_language(w: Words, lang: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Codes of the distinct (language, word) pairs per place, and the two columns of the pairs."""
    lcode, langs = C.codes(lang)
    k = max(1, len(w.distinct))
    pair, code = np.unique(lcode[w.doc] * k + w.code, return_inverse=True)
    return code, langs.take(pa.array(pair // k)), w.distinct.take(pa.array(pair % k)).cast(pa.string())


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of documents (lang, text); the row with a null word has the language's total."""

    def run(batches):
        held: list[pa.Table] = []
        size = 0

        def merged():
            return pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])

        for batch in batches:
            for part, text in C.slices(batch, 1, TEXT_SLICE):
                w = Words(text)
                code, langs, words = _by_language(w, part.column(0))
                n = np.bincount(code, minlength=len(words)).astype(np.int64)
                held.append(pa.table({"lang": langs, "word": words, "n": n}))
                total = pa.table({"lang": langs, "n": n}).group_by("lang").aggregate([("n", "sum")])
                held.append(pa.table({"lang": total["lang"], "word": pa.nulls(len(total), pa.string()), "n": total["n_sum"]}))
                size += len(words)
                if size > HELD:
                    one = merged()
                    held, size = [one], len(one)
                    if size > HELD // 2:
                        yield from one.to_batches(max_chunksize=100_000)
                        held, size = [], 0
        if held:
            yield from merged().to_batches(max_chunksize=100_000)

    rows = docs.select("lang", "text").mapInArrow(C.task(run), "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ word ids


def _hashes(langs: pa.Array, words: pa.Array, seed: int) -> np.ndarray:
    pairs = pc.binary_join_element_wise(words, langs, "\t").to_pylist()  # no word holds a tab
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in pairs), np.uint64, len(pairs))


class Lexicon:
    """Ids of (language, word) pairs: found by hash, and kept only if both strings are equal."""

    def __init__(self, table: pa.Table):
        langs, words = (table[c].combine_chunks() for c in ("lang", "word"))
        self.seed = 0
        while True:
            h = _hashes(langs, words, self.seed)
            if len(np.unique(h)) == len(h):
                break
            self.seed += 1
        order = np.argsort(h)
        self.hash, self.id = h[order], table["id"].to_numpy()[order]
        self.langs, self.words = langs.take(pa.array(order)), words.take(pa.array(order))

    def ids(self, langs: pa.Array, words: pa.Array) -> np.ndarray:
        """Id of each pair, -1 for others."""
        if not len(self.hash) or not len(words):
            return np.full(len(words), -1, np.int64)
        h = _hashes(langs, words, self.seed)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        some = np.flatnonzero(self.hash[at] == h)
        i, j = pa.array(at[some]), pa.array(some)
        equal = pc.and_(pc.equal(self.words.take(i), words.take(j)), pc.equal(self.langs.take(i), langs.take(j)))
        some = some[equal.to_numpy(zero_copy_only=False)]
        out = np.full(len(words), -1, np.int64)
        out[some] = self.id[at[some]]
        return out


def _with_own_ids(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lang, text, words, ids): the frequent words of each document, joined by shuffle."""
    rows = C.stored(docs.select("lang", "text").withColumn("row", F.monotonically_increasing_id()), "collocation-docs")

    def run(batches):
        for batch in batches:
            for part, text in C.slices(batch, 1, TEXT_SLICE):
                w = Words(text)
                k = max(1, len(w.distinct))
                own = np.unique(w.doc * k + w.code)
                doc, words = pa.array(own // k), w.distinct.take(pa.array(own % k)).cast(pa.string())
                table = pa.table({"row": part.column(2).take(doc), "lang": part.column(0).take(doc), "word": words})
                yield from table.to_batches(max_chunksize=50_000)

    own = rows.mapInArrow(C.task(run), "row long, lang string, word string").join(vocab, ["lang", "word"])
    lists = own.groupBy("row").agg(F.collect_list(F.struct("word", "id")).alias("s"))
    lists = lists.select("row", F.col("s.word").alias("words"), F.col("s.id").alias("ids"))
    return rows.join(lists, "row", "left").select("lang", "text", "words", "ids")


def _place_ids(w: Words, part: pa.RecordBatch, lexicon: Lexicon | None) -> np.ndarray:
    """Word id of every place, -1 for words that are not frequent."""
    if lexicon is not None:
        code, langs, words = _by_language(w, part.column(0))
        return lexicon.ids(langs, words)[code]
    out = np.full(len(w.code), -1, np.int64)
    first = np.concatenate([[0], np.cumsum(w.n)])
    distinct = w.distinct.cast(pa.string())
    for d, (words, ids) in enumerate(zip(part.column(2), part.column(3), strict=True)):
        if words.values is not None and len(words.values):
            a, b = first[d], first[d + 1]
            at = pc.index_in(distinct.take(pa.array(w.code[a:b])), words.values).to_numpy(zero_copy_only=False)
            known = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
            out[a:b][known] = ids.values.to_numpy()[at[known].astype(np.int64)]
    return out


# ------------------------------------------------------------------ n-gram counts


def _filters(m: int, bits: int, prefix: int, run: tuple):
    rows = [(value, f.size, f.to_bytes()) for value, f in cqf.by_prefix(bits, prefix, *run)]
    for a in range(0, len(rows), 16):
        bucket, size, blob = (list(x) for x in zip(*rows[a : a + 16], strict=True))
        cols = [pa.array([m] * len(bucket), pa.int32()), pa.array(bucket, pa.int64()), pa.array(size, pa.int64()), pa.array(blob, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["words", "bucket", "size", "filter"])


def gram_filters(docs: DataFrame, lexicon, width: int, lengths: range, buckets: int, pairs=None, held_entries: int | None = None) -> DataFrame:
    """(words, bucket, size, filter): n-grams of each task as counting quotient filters.

    ``lexicon``: a broadcast :class:`Lexicon`, or None if the rows carry their own ids;
    ``pairs``: broadcast bits of the pair quotients that all pairs of an n-gram must occupy.
    """
    most = held_entries or HELD

    def run(batches):
        lex = lexicon.value if lexicon is not None else None
        held: dict[int, list[tuple]] = {m: [] for m in lengths}
        size = dict.fromkeys(held, 0)

        def merged(m):
            top, low, n = (np.concatenate(x) for x in zip(*held[m], strict=True))
            return cqf.counted(top, low, n)

        for batch in batches:
            for part, text in C.slices(batch, 1, TEXT_SLICE):
                w = Words(text)
                ids = _place_ids(w, part, lex)
                known = ids >= 0
                link = known[1:] & known[:-1] & w.linked
                if pairs is not None:
                    link = link & _occupied(*pairs.value, ids, link, width)
                ok = link
                for m in range(2, lengths.stop):
                    if m > 2:
                        ok = ok[:-1] & link[m - 2 :]
                    at = np.flatnonzero(ok)
                    if not len(at):
                        break
                    if m not in held:
                        continue
                    key = cqf.pack([ids[at + j] for j in range(m)], width)
                    held[m].append(cqf.counted(*cqf.permute(*key, m * width)))
                    size[m] += len(held[m][-1][0])
                    if size[m] > most:
                        one = merged(m)
                        held[m], size[m] = [one], len(one[0])
                        if size[m] > most // 2:
                            yield from _filters(m, m * width, min(buckets, m * width), one)
                            held[m], size[m] = [], 0
        for m in held:
            if held[m]:
                yield from _filters(m, m * width, min(buckets, m * width), merged(m))

    return docs.mapInArrow(C.task(run), "words int, bucket long, size long, filter binary")


def _quotients(first: np.ndarray, second: np.ndarray, width: int, bits: int) -> np.ndarray:
    top, _ = cqf.permute(*cqf.pack([first, second], width), 2 * width)
    return (top >> np.uint64(min(2 * width, 64) - bits)).astype(np.int64)


def _occupied(bits: int, vector: np.ndarray, ids: np.ndarray, link: np.ndarray, width: int) -> np.ndarray:
    """For every place whether the pair that begins there has an occupied quotient."""
    out = np.zeros(len(link), bool)
    at = np.flatnonzero(link)
    q = _quotients(ids[at], ids[at + 1], width, bits)
    out[at] = (vector[q >> 3] >> (q & 7).astype(np.uint8)) & 1
    return out


def pair_vector(pairs: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """(bits, vector): bits of the quotients that frequent pairs (ids, a) occupy: at least 16 per pair, up to
    ``PAIR_BITS``.  Groups make parts of it, so the driver gets no more than the vector."""
    bits = min(PAIR_BITS, 2 * width, int(16 * max(1, pairs.count())).bit_length())

    def place(batches):
        for b in batches:
            flat = b.column(0).flatten().to_numpy().reshape(-1, 2)
            q = _quotients(flat[:, 0], flat[:, 1], width, bits)
            yield pa.RecordBatch.from_arrays([pa.array(q >> BLOCK_BITS), pa.array(q & ((1 << BLOCK_BITS) - 1))], names=["block", "bit"])

    def block(t: pa.Table) -> pa.Table:
        own = np.zeros(1 << min(BLOCK_BITS, bits), bool)
        own[t["bit"].to_numpy()] = True
        return pa.table({"block": t["block"].slice(0, 1), "vector": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    placed = pairs.select("ids").mapInArrow(place, "block long, bit long").distinct()
    got = placed.groupBy("block").applyInArrow(block, "block long, vector binary").toArrow()
    size = max(1, 1 << min(BLOCK_BITS, bits) >> 3)
    out = np.zeros(max(1, 1 << bits >> 3), np.uint8)
    for i, v in zip(got["block"].to_pylist(), got["vector"], strict=True):
        out[i * size : (i + 1) * size] = np.frombuffer(v.as_buffer(), np.uint8)
    return bits, out


def merge_filters(filters: DataFrame, width: int, min_count: int) -> DataFrame:
    """(ids, a): n-grams with ``min_count`` occurrences or more, from the merged filters."""

    def run(t: pa.Table) -> pa.Table:
        m = t["words"][0].as_py()
        whole = None
        parts = []
        held = 0
        for size, blob in zip(t["size"].to_pylist(), t["filter"], strict=True):
            parts.append(cqf.Filter.from_bytes(blob.as_buffer()).entries())
            held += size
            if held > BUCKET_ENTRIES:  # equal n-grams of the parts so far become one
                whole = cqf.counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts, held = [whole], len(whole[0]) // 2
        top, low, n = cqf.counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        some = n >= min_count
        words = cqf.unpack(*cqf.restore(top[some], low[some], m * width), m, width)
        flat = np.stack(words, 1).ravel() if some.any() else np.zeros(0, np.int64)
        off = np.arange(int(some.sum()) + 1, dtype=np.int32) * m
        out = pa.table({"ids": pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int64())), "a": n[some]})
        C.release()
        return out

    return filters.groupBy("words", "bucket").applyInArrow(run, "ids array<long>, a long")


# ------------------------------------------------------------------ scores


def _phrases(grams: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lang, words, a): the word ids of each n-gram as words, by joining the word table."""
    at = grams.withColumn("gram", F.monotonically_increasing_id())
    at = C.stored(at, "collocation-grams")
    each = at.select("gram", "a", F.posexplode("ids").alias("place", "id")).join(vocab, "id")
    rows = each.groupBy("gram").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("s"))
    return rows.select("lang", F.transform("s", lambda x: x["word"]).alias("words"), "a")


def candidates(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, max_broadcast: int = MAX_BROADCAST, bucket_entries: int = BUCKET_ENTRIES, held_entries: int | None = None):
    """(phrases, words, totals): (lang, words array, a) with ``min_count`` occurrences or more,
    the frequent words (lang, word, n), and (lang, n) of all words."""
    spark = docs.sparkSession
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have 2 words or more, and occur at least once")
    counts = C.stored(count_words(docs).where(f"word is null or n >= {int(min_count)}"), "collocation-words")
    totals = counts.where("word is null").select("lang", "n")
    vocab = dense_ids(counts.where("word is not null"), [F.asc("lang"), F.asc("word")], "id").select("lang", "word", "n", "id")
    size = vocab.count()
    width = max(1, int(size - 1).bit_length())
    if width * max_words > cqf.MAX_BITS:
        raise ValueError(f"{size} frequent words: an n-gram of {max_words} does not fit {cqf.MAX_BITS} bits; raise min_count")
    places = int(totals.agg(F.sum("n").alias("n")).first()["n"] or 0)
    buckets = max(0, math.ceil(math.log2(max(1, places) / bucket_entries)))
    if size <= max_broadcast:
        lexicon = spark.sparkContext.broadcast(Lexicon(vocab.select("lang", "word", "id").toArrow()))
        source = docs.select("lang", "text")
    else:
        lexicon, source = None, _with_own_ids(docs, vocab.select("lang", "word", "id"))
    count = lambda lengths, pairs: merge_filters(gram_filters(source, lexicon, width, lengths, buckets, pairs, held_entries), width, min_count)
    grams = C.stored(count(range(2, 3), None), "collocation-pairs")
    if max_words > 2:
        occupied = spark.sparkContext.broadcast(pair_vector(grams, width))
        grams = grams.unionByName(count(range(3, max_words + 1), occupied))
    return C.stored(_phrases(grams, vocab.select("id", "lang", "word")), "collocation-candidates"), vocab.select("lang", "word", "n"), totals


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one replaces."""
    joined = F.concat_ws(" ", "words")
    counts = words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(phrases.select("lang", joined.alias("part"), F.col("a").alias("f")))
    size = F.size("words")
    cut = phrases.select("lang", joined.alias("phrase"), "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k",
        F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("one"),
        F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.size("words"))).alias("two"),
    )
    left = counts.select("lang", F.col("part").alias("one"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("part").alias("two"), F.col("f").alias("r"))
    few = totals.count() <= 100_000  # languages
    cut = cut.join(left, ["lang", "one"]).join(right, ["lang", "two"]).join(F.broadcast(totals) if few else totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above = (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(19,0)") * wide("n")
    cut = cut.withColumn("score", F.call_function("div", above, wide("l") * wide("r")))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    # pieces of longer candidates, dropped or not
    longer = phrases.where(size > 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    longer = longer.select("lang", "words", "a", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("i"))
    inside = longer.groupBy("lang", F.concat_ws(" ", F.slice("words", F.col("i"), F.col("m"))).alias("phrase")).agg(F.max("a").alias("held"))
    out = best.join(inside, ["lang", "phrase"], "left").where(f"held is null or held * 100 < b.a * {int(share)}")
    return out.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` rows, with their rank; a language's rows are ranked in
    groups of bounded size first, and the groups' winners again, in a tree."""
    rows = C.stored(rows, "collocation-scores")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = max(1, math.ceil(rows.count() / GROUP_ROWS))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    while True:
        rank = F.row_number().over(Window.partitionBy("lang", "grp").orderBy(*order))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= top)
        if groups == 1:
            return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        groups = math.ceil(groups / 16)
        rows = rows.withColumn("grp", F.pmod(F.col("grp"), F.lit(groups)))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, share: int = SHARE, **sizes) -> DataFrame:
    """Each language's ``top`` collocations: (lang, rank, phrase, a, l, r, n, score)."""
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    phrases, words, totals = candidates(src, min_count, max_words, **sizes)
    return ranked(scored(phrases, words, totals, share), top)


def query(spark, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return mine(C.source_table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents
), p AS (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws, i, unnest(range(1, least({MAX_WORDS}, len(ws) - i + 1) + 1)) AS m FROM i),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
k AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * k.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM k JOIN n ON n.lang = k.lang
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:], ' ')
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM s),
h AS (
  SELECT b.lang, b.phrase FROM b WHERE c = 1 AND NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = b.lang AND f.m > len(string_split(b.phrase, ' ')) AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')
    AND 100 * f.f >= {SHARE} * b.a)
), z AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank, b.phrase, b.a, b.l, b.r, b.n, b.score
  FROM b JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE b.c = 1
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z WHERE rank <= {TOP}
"""

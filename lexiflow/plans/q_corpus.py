"""Corpus shaping, dictionary, lookup, aggregation and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow import constants as K
from lexiflow.functions import text as T
from lexiflow.operators import corpus as C
from lexiflow.operators import dictionary as D
from lexiflow.operators import sampling as SM
from lexiflow.operators import features as FE
from lexiflow.operators import stored_dictionary as SD
from lexiflow.plans import sqlfrag as S
from lexiflow.plans.registry import DRIVER_PREFIXES, register
from lexiflow.session import scratch_path
from lexiflow.sources import tables as TB

VARIANT_LABELS = ["de", "es", "fr"]  # role of the variant classes on the driver data
_VARIANTS_SQL = ", ".join(S.sq(x) for x in VARIANT_LABELS)


# ============================================================================ filters (FLT-*)


def _na(x: str) -> str:
    toks = ", ".join(S.sq(t) for t in K.NA_TOKENS)
    return f"(CASE WHEN {x} IN ({toks}) THEN NULL ELSE {x} END)"


@register(
    "dropna_subset",
    f"SELECT doc_id AS id FROM documents WHERE {_na('text')} IS NOT NULL AND {_na('lang')} IS NOT NULL AND {_na('source')} IS NOT NULL",
)
def q_dropna_subset(spark, sf):
    c = C.with_na_nulls(TB.corpus(spark, sf), ["text", "label", "standard"])
    return c.dropna(subset=["text", "label", "standard"]).select("id")


@register("nonempty_clean", f"SELECT doc_id AS id FROM documents WHERE {S.clean('text')} <> ''")
def q_nonempty_clean(spark, sf):
    return TB.corpus(spark, sf).where(T.clean_text("text") != F.lit("")).select("id")


@register("label_filter", f"SELECT doc_id AS id, lang AS label FROM documents WHERE lang IN ({_VARIANTS_SQL})")
def q_label_filter(spark, sf):
    return C.label_filter(TB.corpus(spark, sf), VARIANT_LABELS).select("id", "label")


@register(
    "length_filter",
    f"SELECT doc_id AS id FROM documents WHERE {S.ntok('text')} BETWEEN 1 AND 256 AND {S.ntok('source')} BETWEEN 1 AND 256",
)
def q_length_filter(spark, sf):
    return C.length_filter(TB.corpus(spark, sf)).select("id")


@register("blank_guard", f"SELECT conv_id, turn FROM conversations WHERE {S.strip('text')} <> ''")
def q_blank_guard(spark, sf):
    return TB.table(spark, sf, "conversations").where(T.strip_ws("text") != F.lit("")).select("conv_id", "turn")


# ============================================================================ dictionary + lookup (AGG-6, JN-1/2)


def corpus_dictionary(spark, sf, key_fn=T.normalize_text):
    return D.build_dictionary(TB.corpus(spark, sf), key_fn)


@register("dict_last_wins", S.corpus_dictionary(S.normalize))
def q_dict_last_wins(spark, sf):
    return corpus_dictionary(spark, sf)


@register("dict_size", f"SELECT count(DISTINCT {S.normalize('text')}) AS dict_size FROM documents")
def q_dict_size(spark, sf):
    return D.dictionary_size(corpus_dictionary(spark, sf))


_LOOKUP_SQL = f"""
WITH d AS ({S.corpus_dictionary(S.normalize)}), i AS ({S.route_input()})
SELECT i.id, d.standard AS translation, d.pos AS lookup_pos FROM i LEFT JOIN d ON {S.normalize('i.text')} = d.key
"""


@register("dict_lookup", _LOOKUP_SQL)
def q_dict_lookup(spark, sf):
    out = D.lookup(TB.route_input(spark, sf), corpus_dictionary(spark, sf), T.normalize_text, "text", "translation")
    return out.select("id", "translation", F.col("translation_pos").alias("lookup_pos"))


@register("dict_stored_lookup", _LOOKUP_SQL)
def q_dict_stored_lookup(spark, sf):
    """The same from a stored dictionary, bucketed by key: only the queries are shuffled."""
    stored = SD.StoredDictionary.create(spark, scratch_path(spark, "dictionary"), TB.corpus(spark, sf))
    out = stored.lookup(TB.route_input(spark, sf), out_col="translation")
    return out.select("id", "translation", F.col("translation_pos").alias("lookup_pos"))


_MERGED_SQL = """SELECT text, source AS standard, doc_id AS pos FROM documents
UNION ALL SELECT text, role AS standard, 10000000000 + conv_id * 1000 + turn AS pos FROM conversations"""


@register(
    "dict_merge",
    f"""WITH c AS ({_MERGED_SQL}), k AS (SELECT {S.normalize('text')} AS key, {S.strip('standard')} AS standard, pos FROM c WHERE text IS NOT NULL)
SELECT key, standard, first_pos AS pos FROM (SELECT key, standard, min(pos) OVER (PARTITION BY key) AS first_pos,
  row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS rn FROM k) WHERE rn = 1""",
)
def q_dict_merge(spark, sf):
    """A stored dictionary of the documents, into which the conversations are merged as a new
    corpus part; equal to one dictionary of both."""
    stored = SD.StoredDictionary.create(spark, scratch_path(spark, "dictionary"), TB.corpus(spark, sf))
    turns = TB.table(spark, sf, "conversations")
    part = turns.select("text", F.col("role").alias("standard"), (F.lit(10_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return stored.merge(part).dictionary()


@register(
    "lookup_hits",
    f"WITH d AS ({S.corpus_dictionary(S.normalize)}), i AS ({S.route_input()}) "
    f"SELECT id FROM i WHERE {S.normalize('text')} IN (SELECT key FROM d)",
)
def q_lookup_hits(spark, sf):
    hits, _ = D.lookup_split(TB.route_input(spark, sf), corpus_dictionary(spark, sf))
    return hits.select("id")


@register(
    "lookup_misses",
    f"WITH d AS ({S.corpus_dictionary(S.normalize)}), i AS ({S.route_input()}) "
    f"SELECT id FROM i WHERE {S.normalize('text')} IS NULL OR {S.normalize('text')} NOT IN (SELECT key FROM d)",
)
def q_lookup_misses(spark, sf):
    _, misses = D.lookup_split(TB.route_input(spark, sf), corpus_dictionary(spark, sf))
    return misses.select("id")


@register(
    "hit_at_1",
    f"""WITH d AS ({S.corpus_dictionary(S.normalize)}),
r AS (SELECT doc_id, {S.lookup_key('source')} = {S.lookup_key('d.standard')} AS hit FROM documents LEFT JOIN d ON {S.normalize('text')} = d.key)
SELECT count(*) AS n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits,
round(100.0 * sum(CASE WHEN hit THEN 1 ELSE 0 END) / count(*), 6) AS hit_at_1 FROM r""",
)
def q_hit_at_1(spark, sf):
    """Dictionary self-test on every corpus row: last-wins conflicts miss."""
    corpus = TB.corpus(spark, sf)
    looked = D.lookup(corpus, corpus_dictionary(spark, sf), T.normalize_text, "text", "pred")
    return C.hit_rate(looked.withColumn("hit", F.coalesce(T.loose_equal("standard", "pred"), F.lit(False))))


# ============================================================================ aggregations (AGG-1..5)


@register("label_counts", "SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def q_label_counts(spark, sf):
    return C.label_counts(TB.corpus(spark, sf))


@register("distinct_labels", "SELECT DISTINCT lang AS label FROM documents")
def q_distinct_labels(spark, sf):
    return TB.corpus(spark, sf).select("label").distinct()


@register("source_counts", "SELECT source, count(*) AS n, grouping(source) = 1 AS is_total FROM documents GROUP BY ROLLUP (source)")
def q_source_counts(spark, sf):
    return C.source_counts(TB.table(spark, sf, "documents"), "source")


_LINES_SQL = """lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS before FROM (
    SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) END AS parts
    FROM documents)),
clean AS (SELECT doc_id, line_no, before, """ + S.collapse("replace(before, '.', '')") + """ AS after FROM lines)"""


@register(
    "line_cleanup_report",
    f"WITH {_LINES_SQL} SELECT count(*) AS n_lines, CAST(sum(CASE WHEN before IS DISTINCT FROM after THEN 1 ELSE 0 END) AS BIGINT) AS n_changed FROM clean",
)
def q_line_cleanup_report(spark, sf):
    lines = C.lines_of(TB.table(spark, sf, "documents"), "doc_id", "text")
    return C.line_cleanup_report(C.line_cleanup(lines))


@register(
    "change_preview",
    f"WITH {_LINES_SQL} SELECT doc_id, line_no, before, after FROM clean WHERE line_no < 10 AND before IS DISTINCT FROM after",
)
def q_change_preview(spark, sf):
    lines = C.lines_of(TB.table(spark, sf, "documents"), "doc_id", "text")
    return C.change_preview(C.line_cleanup(lines)).select("doc_id", "line_no", "before", "after")


# ============================================================================ ordering, sampling, split (WIN-*)


@register("head_n", "SELECT doc_id AS id, lang AS label, source AS standard FROM documents ORDER BY doc_id LIMIT 5")
def q_head_n(spark, sf):
    return SM.head_n(TB.corpus(spark, sf), 5).select("id", "label", "standard")


@register("hash_sample", f"SELECT doc_id AS id FROM documents ORDER BY {S.md5key('doc_id')}, doc_id LIMIT 15")
def q_hash_sample(spark, sf):
    return SM.hash_sample(TB.corpus(spark, sf), 15).select("id")


def _split_sql(frac_num: int, frac_den: int, names=("train", "test"), label_sql="lang", where="", select=None) -> str:
    """Reference split: quota by largest remainder, rows ranked by md5 inside each class."""
    cond = f"{label_sql} IS NOT NULL" + (f" AND {where}" if where else "")
    select = select or "r.id, r.label, CASE WHEN r.rn <= q.quota THEN '{test}' ELSE '{train}' END AS split"
    select = select.format(test=names[1], train=names[0])
    return f"""WITH base AS (SELECT doc_id, {label_sql} AS label, text, source FROM documents WHERE {cond}),
c AS (SELECT label, count(*) AS n_c FROM base GROUP BY label),
t AS (SELECT label, n_c, sum(n_c) OVER () AS n_all FROM c),
t2 AS (SELECT *, (n_all * {frac_num} + {frac_den} - 1) // {frac_den} AS n_test FROM t),
t3 AS (SELECT *, (n_test * n_c) // n_all AS base, (n_test * n_c) % n_all AS rem FROM t2),
t4 AS (SELECT *, n_test - sum(base) OVER () AS short, row_number() OVER (ORDER BY rem DESC, label) AS rk FROM t3),
q AS (SELECT label, base + CASE WHEN rk <= short THEN 1 ELSE 0 END AS quota FROM t4),
r AS (SELECT doc_id AS id, label, text, source,
      row_number() OVER (PARTITION BY label ORDER BY {S.md5key('doc_id')}, doc_id) AS rn FROM base)
SELECT {select} FROM r JOIN q USING (label)"""


@register("stratified_split_80_20", _split_sql(1, 5))
def q_split_80_20(spark, sf):
    return SM.stratified_split(TB.corpus(spark, sf), "label", "id", 0.2).select("id", "label", "split")


@register("stratified_split_90_10", _split_sql(1, 10, ("train", "validation")))
def q_split_90_10(spark, sf):
    return SM.stratified_split(TB.corpus(spark, sf), "label", "id", 0.1, names=("train", "validation")).select(
        "id", "label", "split"
    )


@register(
    "class_weights",
    "SELECT lang AS label, count(*) AS n_c, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight "
    "FROM documents WHERE lang IS NOT NULL GROUP BY lang",
)
def q_class_weights(spark, sf):
    w = FE.class_weights(TB.corpus(spark, sf), "label")
    return w.select("label", "n_c", F.round("weight", 6).alias("weight"))


# ============================================================================ set operations (SET-*)


_UNION_SQL = """SELECT 'documents' AS corpus, doc_id AS id, lang AS label, source AS standard, length(text) AS n_chars FROM documents
UNION ALL SELECT 'benchmark' AS corpus, item_id AS id, NULL AS label, NULL AS standard, length(text) AS n_chars FROM benchmark"""


@register("corpus_union", _UNION_SQL)
def q_corpus_union(spark, sf):
    u = C.union_corpora(
        [("documents", TB.corpus(spark, sf)), ("benchmark", TB.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.col("item_id").alias("pos")))]
    )
    return u.select("corpus", "id", "label", "standard", F.length("text").alias("n_chars"))


@register(
    "merge_corpora",
    f"SELECT label, count(*) AS n FROM ({_UNION_SQL}) WHERE label IS NOT NULL AND standard IS NOT NULL GROUP BY label",
)
def q_merge_corpora(spark, sf):
    u = C.union_corpora(
        [("documents", TB.corpus(spark, sf)), ("benchmark", TB.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.col("item_id").alias("pos")))]
    )
    merged = u.dropna(subset=["text", "label", "standard"])
    return C.label_counts(merged)


_SEQ_LABELS = ["de", "en", "es", "fr"]
_PREFIX_CASE = " ".join(f"WHEN {S.sq(k)} THEN {S.sq(v)}" for k, v in DRIVER_PREFIXES.items())


@register(
    "seq2seq_trainset",
    _split_sql(
        1, 10, ("train", "validation"),
        label_sql=S.norm_label("lang"),
        where=f"{S.norm_label('lang')} IN ({', '.join(S.sq(x) for x in _SEQ_LABELS)}) "
        f"AND {S.ntok('text')} BETWEEN 1 AND 256 AND {S.ntok('source')} BETWEEN 1 AND 256",
        select="r.id, CASE WHEN r.rn <= q.quota THEN '{test}' ELSE '{train}' END AS split, "
        f"coalesce(CASE r.label {_PREFIX_CASE} END, '') || coalesce(r.text, '') AS input, r.source AS target",
    ),
)
def q_seq2seq_trainset(spark, sf):
    return C.seq2seq_trainset(TB.corpus(spark, sf), labels=_SEQ_LABELS, prefixes=DRIVER_PREFIXES).select(
        "id", "split", "input", "target"
    )

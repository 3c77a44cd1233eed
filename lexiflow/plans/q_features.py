"""Feature extraction, vocabulary / sequence and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow import constants as K
from lexiflow.functions import seq as SEQ
from lexiflow.functions import text as T
from lexiflow.operators import features as FE
from lexiflow.operators import memory as MEM
from lexiflow.operators import report as RP
from lexiflow.operators import sampling as SM
from lexiflow.operators import similarity as SIM
from lexiflow.operators.route import lang_rule
from lexiflow.plans import sqlfrag as S
from lexiflow.plans.registry import register
from lexiflow.sources import tables as TB


def _docs(spark, sf):
    return TB.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


# ============================================================================ word features (FE-1, FE-2, AGG-7)


@register("word_tokens", f"SELECT doc_id, {S.words('text')} AS tokens FROM documents")
def q_word_tokens(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", T.word_features("text").alias("tokens"))


_WORD_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.words('text')}) AS term FROM documents) GROUP BY ALL)"


@register("term_df", f"WITH {_WORD_TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def q_term_df(spark, sf):
    return FE.term_df(_docs(spark, sf))


_TFIDF_WORDS = f"""WITH {_WORD_TF},
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n),
w AS (SELECT doc_id, term, tf, tf * idf AS w FROM tf JOIN idf USING (term))
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w"""


@register("tfidf_words", _TFIDF_WORDS)
def q_tfidf_words(spark, sf):
    _, long_form = FE.fit_transform_tfidf(_docs(spark, sf))
    return long_form.select(F.col("id").alias("doc_id"), "term", "tf", F.round("tfidf", 6).alias("tfidf"))


_HOLDOUT_SQL = f"""WITH
c AS (SELECT lang AS label, count(*) AS n_c FROM documents WHERE lang IS NOT NULL GROUP BY lang),
t AS (SELECT label, n_c, sum(n_c) OVER () AS n_all FROM c),
t2 AS (SELECT *, (n_all * 1 + 5 - 1) // 5 AS n_test FROM t),
t3 AS (SELECT *, (n_test * n_c) // n_all AS base, (n_test * n_c) % n_all AS rem FROM t2),
t4 AS (SELECT *, n_test - sum(base) OVER () AS short, row_number() OVER (ORDER BY rem DESC, label) AS rk FROM t3),
qq AS (SELECT label, base + CASE WHEN rk <= short THEN 1 ELSE 0 END AS quota FROM t4),
r AS (SELECT doc_id, lang AS label, text, row_number() OVER (PARTITION BY lang ORDER BY {S.md5key('doc_id')}, doc_id) AS rn
      FROM documents WHERE lang IS NOT NULL),
sp AS (SELECT r.doc_id, r.text, r.rn <= qq.quota AS is_test FROM r JOIN qq USING (label)),
tf_all AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.words('text')}) AS term FROM sp) GROUP BY ALL),
train_tf AS (SELECT * FROM tf_all WHERE doc_id IN (SELECT doc_id FROM sp WHERE NOT is_test)),
n AS (SELECT count(*) AS n FROM sp WHERE NOT is_test),
idf AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM train_tf, n GROUP BY term, n),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf_all JOIN idf USING (term) WHERE doc_id IN (SELECT doc_id FROM sp WHERE is_test))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w"""


@register("tfidf_holdout", _HOLDOUT_SQL)
def q_tfidf_holdout(spark, sf):
    """IDF fitted on the 80 % train side only; hold-out rows transformed (unseen terms dropped)."""
    split = SM.stratified_split(TB.corpus(spark, sf), "label", "id", 0.2)
    train = split.where(F.col("split") == "train").select("id", "text")
    test = split.where(F.col("split") == "test").select("id", "text")
    _, long_form = FE.fit_transform_tfidf(train, test)
    return long_form.select(F.col("id").alias("doc_id"), "term", F.round("tfidf", 6).alias("tfidf"))


# ============================================================================ char n-grams (FE-3)


def _cwb_sql() -> str:
    w = S.tokens("lower(text)")
    return f"""words AS (SELECT doc_id, ' ' || unnest({w}) || ' ' AS w FROM documents),
grams AS (
  SELECT doc_id, substr(w, i, n) AS gram FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, greatest(length(w) - n + 1, 1))) AS i
    FROM words, (SELECT unnest([3, 4, 5]) AS n) ns WHERE n = 3 OR length(w) > n - 1)),
ctf AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY ALL)"""


@register(
    "char_ngrams",
    f"WITH {_cwb_sql()} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n_grams, count(*) AS n_distinct FROM ctf GROUP BY doc_id",
)
def q_char_ngrams(spark, sf):
    counts = FE.term_profile(_docs(spark, sf), T.char_wb_ngrams)
    return counts.select(F.col("id").alias("doc_id"), F.col("n").alias("n_grams"), "n_distinct")


@register("char_df3", f"WITH {_cwb_sql()} SELECT gram, count(*) AS df FROM ctf GROUP BY gram HAVING count(*) >= 3")
def q_char_df3(spark, sf):
    return FE.gram_df(_docs(spark, sf), T.char_wb_ngrams, min_df=3).select(F.col("term").alias("gram"), "df")


@register(
    "tfidf_chars",
    f"""WITH {_cwb_sql()},
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT gram, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM ctf, n GROUP BY gram, n HAVING count(*) >= 3),
w AS (SELECT doc_id, gram, tf * idf AS w FROM ctf JOIN idf USING (gram)),
nw AS (SELECT doc_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM w)
SELECT doc_id, count(*) AS n_features, round(sum(v), 6) AS l1, round(max(v), 6) AS max_w FROM nw GROUP BY doc_id""",
)
def q_tfidf_chars(spark, sf):
    """Char 3-5 gram TF-IDF (min_df 3), summarised per document."""
    _, per_doc = FE.fit_transform_tfidf(_docs(spark, sf), analyzer=T.char_wb_ngrams, min_df=3, summary=True)
    return per_doc.select(F.col("id").alias("doc_id"), "n_features", F.round("l1", 6).alias("l1"), F.round("max_w", 6).alias("max_w"))


# ============================================================================ vocabulary and sequences (SEQ-*)

_VOCAB_SQL = f"""vtok AS (SELECT doc_id, generate_subscripts(t, 1) AS p, unnest(t) AS term FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)),
vocab AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS tid FROM vtok GROUP BY term),
enc AS (SELECT d.doc_id, coalesce(list(v.tid ORDER BY t.p) FILTER (WHERE v.tid IS NOT NULL), []::BIGINT[]) AS ids
        FROM documents d LEFT JOIN vtok t ON t.doc_id = d.doc_id LEFT JOIN vocab v USING (term) GROUP BY d.doc_id)"""


def _encoded(spark, sf):
    d = _docs(spark, sf)
    vocab = FE.build_vocabulary(d, start=1)
    return FE.encode(d, vocab)


@register("vocab_encode", f"WITH {_VOCAB_SQL} SELECT doc_id, ids FROM enc")
def q_vocab_encode(spark, sf):
    return _encoded(spark, sf).select(F.col("id").alias("doc_id"), "ids")


@register(
    "seq_truncate",
    f"WITH {_VOCAB_SQL} SELECT doc_id, ids[1:{K.MAX_TRAIN_TOKENS}] AS ids FROM enc",
)
def q_seq_truncate(spark, sf):
    return _encoded(spark, sf).select(F.col("id").alias("doc_id"), SEQ.truncate("ids", K.MAX_TRAIN_TOKENS).alias("ids"))


_PAD_SQL = f"""WITH {_VOCAB_SQL},
tr AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 2 AS batch, ids[1:{K.MAX_TRAIN_TOKENS}] AS ids FROM enc),
bl AS (SELECT *, ((max(len(ids)) OVER (PARTITION BY batch) + 7) // 8) * 8 AS target FROM tr)"""


@register(
    "seq_pad8",
    _PAD_SQL
    + f" SELECT doc_id, batch, list_concat(ids, list_transform(range(target - len(ids)), lambda x: {K.PAD_ID}::BIGINT)) AS input_ids, "
    "list_concat(list_transform(ids, lambda x: 1), list_transform(range(target - len(ids)), lambda x: 0)) AS attention_mask FROM bl",
)
def q_seq_pad8(spark, sf):
    padded = SEQ.pad_batches(_encoded(spark, sf).select(F.col("id").alias("doc_id"), SEQ.truncate("ids", K.MAX_TRAIN_TOKENS).alias("ids")), "doc_id", 2)
    return padded.select("doc_id", "batch", "input_ids", "attention_mask")


@register(
    "seq_mask_pad",
    _PAD_SQL
    + f" SELECT doc_id, list_transform(list_concat(ids, list_transform(range(target - len(ids)), lambda x: {K.PAD_ID}::BIGINT)), "
    f"lambda x: CASE WHEN x = {K.PAD_ID} THEN {K.LABEL_IGNORE_ID} ELSE x END) AS labels FROM bl",
)
def q_seq_mask_pad(spark, sf):
    padded = SEQ.pad_batches(_encoded(spark, sf).select(F.col("id").alias("doc_id"), SEQ.truncate("ids", K.MAX_TRAIN_TOKENS).alias("ids")), "doc_id", 2)
    return padded.select("doc_id", SEQ.mask_pad("input_ids").alias("labels"))


# ============================================================================ cosine (FE-6, JN-3, FLT-7, ML-5)

_VEC = "CAST(embedding AS DOUBLE[])"


@register(
    "cosine_pairs",
    f"""SELECT a.vec_id, b.vec_id AS next_id,
 round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) /
   (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def q_cosine_pairs(spark, sf):
    e = TB.table(spark, sf, "embeddings")
    a, b = e.alias("a"), e.alias("b")
    j = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return j.select(
        F.col("a.vec_id").alias("vec_id"),
        F.col("b.vec_id").alias("next_id"),
        F.round(SIM.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"),
    )


def _loo_sql(threshold: float | None) -> str:
    match = "m_id" if threshold is None else f"CASE WHEN score >= {threshold} THEN m_id END"
    return f"""WITH v AS (SELECT vec_id, {_VEC} AS e, sqrt(list_dot_product({_VEC}, {_VEC})) AS nrm FROM embeddings),
p AS (SELECT a.vec_id AS q_id, b.vec_id AS m_id, list_dot_product(a.e, b.e) / (a.nrm * b.nrm) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.nrm > 0 AND b.nrm > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 12) DESC, m_id) AS rn FROM p)
SELECT q_id AS vec_id, {match} AS match_id, round(score, 6) AS score FROM r WHERE rn = 1"""


def _loo(spark, sf, force=None):
    mem = MEM.VectorMemory(TB.vectors(spark, sf), force=force)
    return mem.match(TB.vectors(spark, sf), exclude_self=True)


@register("cosine_top1", _loo_sql(None))
def q_cosine_top1(spark, sf):
    """Leave-one-out nearest neighbour of every vector in the vector memory."""
    best = _loo(spark, sf)
    return best.select(F.col("qid").cast("long").alias("vec_id"), "match_id", F.round("score", 6).alias("score"))


THRESHOLD_DRIVER = 0.35  # driver vectors peak at 0.29-0.49 cosine, so the defaults match nothing


@register("cosine_threshold", _loo_sql(THRESHOLD_DRIVER))
def q_cosine_threshold(spark, sf):
    best = _loo(spark, sf)
    return best.select(
        F.col("qid").cast("long").alias("vec_id"),
        F.when(F.col("score") >= THRESHOLD_DRIVER, F.col("match_id")).alias("match_id"),
        F.round("score", 6).alias("score"),
    )


@register(
    "cosine_top1_sharded",
    _loo_sql(None),
)
def q_cosine_top1_sharded(spark, sf):
    """Same answer through the sharded (cogroup) strategy used for memories too big to broadcast."""
    mem = MEM.VectorMemory(TB.vectors(spark, sf), force="sharded")
    best = mem.match(TB.vectors(spark, sf), exclude_self=True)
    return best.select(F.col("qid").cast("long").alias("vec_id"), "match_id", F.round("score", 6).alias("score"))


@register("cosine_top1_pruned", _loo_sql(None))
def q_cosine_top1_pruned(spark, sf):
    """Same answer from a memory cut into rings around pivots: a query visits only rings that
    can beat its best."""
    mem = MEM.VectorMemory(TB.vectors(spark, sf), force="pruned")
    best = mem.match(TB.vectors(spark, sf), exclude_self=True)
    return best.select(F.col("qid").cast("long").alias("vec_id"), "match_id", F.round("score", 6).alias("score"))


@register(
    "memory_selftest",
    _loo_sql(None).replace(
        "SELECT q_id AS vec_id, m_id AS match_id, round(score, 6) AS score FROM r WHERE rn = 1",
        """, lab AS (SELECT vec_id, label FROM embeddings),
h AS (SELECT r.q_id, ql.label = ml.label AS hit FROM r JOIN lab ql ON ql.vec_id = r.q_id JOIN lab ml ON ml.vec_id = r.m_id WHERE rn = 1)
SELECT (SELECT count(*) FROM embeddings) AS n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits,
 round(100.0 * sum(CASE WHEN hit THEN 1 ELSE 0 END) / (SELECT count(*) FROM embeddings), 6) AS hit_at_1 FROM h""",
    ),
)
def q_memory_selftest(spark, sf):
    """Hit@1 of the vector memory on its own rows (label equality, leave-one-out)."""
    v = TB.vectors(spark, sf)
    best = _loo(spark, sf)
    lab = v.select(F.col("id").alias("match_id"), F.col("label").alias("match_label"))
    q = v.select(F.col("id").cast("string").alias("qid"), "label")
    j = q.join(best, "qid", "left").join(lab, "match_id", "left")
    hits = F.sum(F.when(F.col("label") == F.col("match_label"), 1).otherwise(0))
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        hits.cast("long").alias("hits"),
        F.round(F.lit(100.0) * hits / F.count(F.lit(1)), 6).alias("hit_at_1"),
    )


# ============================================================================ text memory (JN-4)


def doc_queries_sql() -> str:
    return "SELECT doc_id AS qid, text FROM documents"


@register(
    "tfidf_top1",
    f"WITH {S.text_memory_ctes(doc_queries_sql())} SELECT q.qid AS doc_id, b.mem_id, round(b.mem_score, 6) AS score "
    "FROM q LEFT JOIN best b USING (qid)",
)
def q_tfidf_top1(spark, sf):
    """Closest benchmark item of every document (word TF-IDF cosine, exact)."""
    mem = MEM.TextMemory(TB.memory_texts(spark, sf))
    out = mem.match(TB.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "mem_id", F.round("mem_score", 6).alias("score"))


@register(
    "tfidf_top1_sharded",
    f"WITH {S.text_memory_ctes(doc_queries_sql())} SELECT q.qid AS doc_id, b.mem_id, round(b.mem_score, 6) AS score "
    "FROM q LEFT JOIN best b USING (qid)",
)
def q_tfidf_top1_sharded(spark, sf):
    """The same answer from a memory cut into shards and queries cut into blocks."""
    mem = MEM.TextMemory(TB.memory_texts(spark, sf), force="sharded")
    mem.prepared().n_shards = 3
    out = mem.match(TB.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "mem_id", F.round("mem_score", 6).alias("score"))


def _above_sql(threshold: float) -> str:
    hit = f"b.mem_score >= {threshold}"
    return (
        f"WITH {S.text_memory_ctes(doc_queries_sql())} SELECT q.qid AS doc_id, CASE WHEN {hit} THEN b.mem_id END AS mem_id, "
        f"CASE WHEN {hit} THEN round(b.mem_score, 6) END AS score FROM q LEFT JOIN best b USING (qid)"
    )


@register("tfidf_top1_above", _above_sql(K.MEMORY_THRESHOLD))
def q_tfidf_top1_above(spark, sf):
    """Closest benchmark item of every document at the memory threshold or above, by prefix
    filtering: documents meet items by rare terms only."""
    mem = MEM.TextMemory(TB.memory_texts(spark, sf), force="sharded")
    out = mem.match_above(TB.table(spark, sf, "documents").select("doc_id", "text"), K.MEMORY_THRESHOLD, "doc_id", "text")
    return out.select("doc_id", "mem_id", F.round("mem_score", 6).alias("score"))


# ============================================================================ evaluation (AGG-9)

_GOLD_PRED = f"SELECT lang AS gold, {S.lang_rule('text')} AS predicted FROM documents"


@register("confusion_matrix", f"SELECT gold, predicted, count(*) AS n FROM ({_GOLD_PRED}) GROUP BY ALL")
def q_confusion_matrix(spark, sf):
    d = TB.table(spark, sf, "documents").select(F.col("lang").alias("gold"), lang_rule("text").alias("predicted"))
    return RP.confusion(d, "gold", "predicted")


_REPORT_SQL = f"""WITH gp AS ({_GOLD_PRED}),
labs AS (SELECT gold AS label FROM gp UNION SELECT predicted FROM gp),
per AS (SELECT l.label,
  CAST(sum(CASE WHEN gp.gold = l.label AND gp.predicted = l.label THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
  CAST(sum(CASE WHEN gp.gold = l.label THEN 1 ELSE 0 END) AS BIGINT) AS support,
  CAST(sum(CASE WHEN gp.predicted = l.label THEN 1 ELSE 0 END) AS DOUBLE) AS npred
  FROM labs l, gp GROUP BY l.label),
m AS (SELECT label, support, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS p,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m),
tot AS (SELECT sum(support) AS n FROM f),
acc AS (SELECT sum(CASE WHEN gold = predicted THEN 1 ELSE 0 END) * 1.0 / count(*) AS a FROM gp)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT a FROM acc), 6), (SELECT CAST(n AS BIGINT) FROM tot)
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f"""


@register("classification_report", _REPORT_SQL)
def q_classification_report(spark, sf):
    d = TB.table(spark, sf, "documents").select(F.col("lang").alias("gold"), lang_rule("text").alias("predicted"))
    return RP.classification_report(d, "gold", "predicted")

"""Routing cascade queries (RT-*): every incoming text of the driver data.

Roles: memory = benchmark items (word TF-IDF, fitted on the memory), lookup
dictionary = the documents corpus (last wins), classifier = the deterministic
letter rule (so the oracle can reproduce it), no generator model (placeholder).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow import constants as K
from lexiflow.functions import text as T
from lexiflow.operators import dictionary as D
from lexiflow.operators import memory as MEM
from lexiflow.operators import route as R
from lexiflow.operators.hooks import ModelHook
from lexiflow.plans import sqlfrag as S
from lexiflow.plans.q_corpus import VARIANT_LABELS
from lexiflow.plans.registry import register
from lexiflow.sources import tables as TB

ROUTE_COLS = ["id", "predicted", "label", "translation", "origin", "score", "message"]
_VAR = ", ".join(S.sq(x) for x in VARIANT_LABELS)
_VAR_LOWER = ", ".join(S.sq(x.lower()) for x in VARIANT_LABELS)
_PH = S.sq(K.PLACEHOLDER_PREFIX)
_NOMOD = S.sq(K.NO_MODULE)


def _memory(spark, sf, with_label=False):
    entries = TB.memory_texts(spark, sf)
    if with_label:
        entries = entries.withColumn("label", R.lang_rule("text"))
    return MEM.TextMemory(entries, with_label=with_label)


def _dictionary(spark, sf, key_fn):
    return D.build_dictionary(TB.corpus(spark, sf), key_fn)


def _inp_sql(where: str = "") -> str:
    return f"SELECT id AS qid, text, requested_label AS label FROM ({S.route_input()})" + (f" WHERE {where}" if where else "")


# ----------------------------------------------------------------------------- RT-1

_RT1_SQL = f"""WITH {S.text_memory_ctes(_inp_sql(f"{S.lookup_key('text')} IS DISTINCT FROM 'q'"))},
x AS (SELECT q.qid AS id, q.text, b.mem_standard, b.mem_score, coalesce(b.mem_score >= {K.MEMORY_THRESHOLD}, false) AS hit
      FROM q LEFT JOIN best b USING (qid)),
y AS (SELECT *, CASE WHEN NOT hit THEN {S.lang_rule('text')} END AS predicted FROM x)
SELECT id, predicted, CASE WHEN hit THEN {S.sq(K.LABEL_IDIOM)} ELSE predicted END AS label,
  CASE WHEN hit THEN mem_standard WHEN predicted IN ({_VAR}) THEN {_PH} || text ELSE {_NOMOD} END AS translation,
  CASE WHEN hit THEN 'memory' WHEN predicted IN ({_VAR}) THEN 'placeholder' ELSE 'none' END AS origin,
  round(mem_score, 6) AS score, CAST(NULL AS VARCHAR) AS message FROM y"""


@register("route_idiom_first", _RT1_SQL)
def q_route_idiom_first(spark, sf):
    out = R.route_idiom_first(TB.route_input(spark, sf), _memory(spark, sf), generator_labels=VARIANT_LABELS)
    return out.select(*ROUTE_COLS)


# ----------------------------------------------------------------------------- RT-2

_RT2_SQL = f"""WITH {S.text_memory_ctes(_inp_sql(f"{S.lookup_key('text')} IS DISTINCT FROM 'q'"))},
d AS ({S.corpus_dictionary(S.normalize)}),
x AS (SELECT q.qid AS id, q.text, b.mem_standard, b.mem_score, coalesce(b.mem_score >= {K.MEMORY_THRESHOLD}, false) AS hit
      FROM q LEFT JOIN best b USING (qid)),
y AS (SELECT x.*, CASE WHEN NOT hit THEN {S.lang_rule('text')} END AS predicted, d.standard AS lk, d.pos AS lk_pos
      FROM x LEFT JOIN d ON {S.normalize('x.text')} = d.key),
z AS (SELECT *, coalesce(lower(predicted) IN ({_VAR_LOWER}), false) AS gen_ok FROM y)
SELECT id, predicted, CASE WHEN hit THEN {S.sq(K.LABEL_IDIOM)} ELSE predicted END AS label,
  CASE WHEN hit THEN mem_standard WHEN gen_ok AND lk_pos IS NOT NULL THEN lk WHEN gen_ok THEN {_PH} || text ELSE {_NOMOD} END AS translation,
  CASE WHEN hit THEN 'memory' WHEN gen_ok AND lk_pos IS NOT NULL THEN 'lookup' WHEN gen_ok THEN 'placeholder' ELSE 'none' END AS origin,
  round(mem_score, 6) AS score, CAST(NULL AS VARCHAR) AS message FROM z"""


_GEN = "'gen ' || length(text) || ': ' || text"


def echo_generator():
    """A stand-in model for the generator hook, simple enough for SQL to repeat."""
    return lambda texts: [f"gen {len(t)}: {t}" for t in texts]


@register("route_generator_hook", _RT2_SQL.replace(f"{_PH} || text", _GEN).replace("THEN 'placeholder'", "THEN 'generator'"))
def q_route_generator_hook(spark, sf):
    """Memory -> classifier -> lookup -> a generator hook, which is loaded once per process and
    sees the unanswered rows only."""
    out = R.route_idiom_first(
        TB.route_input(spark, sf), _memory(spark, sf), generator_labels=VARIANT_LABELS, generator=ModelHook(echo_generator),
        lookup=_dictionary(spark, sf, T.normalize_text), case_sensitive=False,
    )
    return out.select(*ROUTE_COLS)


def route_idiom_lookup_df(spark, sf, inp=None, memory=None, lookup=None):
    inp = TB.route_input(spark, sf) if inp is None else inp
    return R.route_idiom_first(
        inp,
        memory if memory is not None else _memory(spark, sf),
        generator_labels=VARIANT_LABELS,
        lookup=lookup if lookup is not None else _dictionary(spark, sf, T.normalize_text),
        case_sensitive=False,
    )


@register("route_idiom_lookup", _RT2_SQL)
def q_route_idiom_lookup(spark, sf):
    return route_idiom_lookup_df(spark, sf).select(*ROUTE_COLS)


# ----------------------------------------------------------------------------- RT-3

_WARN_SQL = (
    f"CASE WHEN {S.lookup_key('predicted')} IS DISTINCT FROM {S.lookup_key('label')} "
    f"THEN [{S.sq(K.MISMATCH_WARNING.split('{label}')[0])} || predicted || {S.sq(K.MISMATCH_WARNING.split('{label}')[1])}] "
    "ELSE []::VARCHAR[] END"
)

_RT3_SQL = f"""WITH {S.text_memory_ctes(_inp_sql(), with_label=True)},
d AS ({S.corpus_dictionary(S.lookup_key)}),
x AS (SELECT q.qid AS id, q.text, q.label, b.mem_standard, b.mem_score, coalesce(b.mem_score >= {K.HYBRID_THRESHOLD}, false) AS hit,
        {S.lang_rule('q.text')} AS predicted FROM q LEFT JOIN best b USING (qid)),
y AS (SELECT x.*, d.standard AS lk, d.pos AS lk_pos FROM x LEFT JOIN d ON {S.lookup_key('x.text')} = d.key)
SELECT id, predicted, label,
  CASE WHEN lk_pos IS NOT NULL THEN lk WHEN hit THEN mem_standard ELSE {_PH} || text END AS translation,
  CASE WHEN lk_pos IS NOT NULL THEN 'lookup' WHEN hit THEN 'memory' ELSE 'placeholder' END AS origin,
  round(mem_score, 6) AS score, CAST(NULL AS VARCHAR) AS message, {_WARN_SQL} AS warnings FROM y"""


def route_hybrid_df(spark, sf):
    return R.route_hybrid(TB.route_input(spark, sf), _memory(spark, sf, with_label=True), _dictionary(spark, sf, T.lookup_key))


@register("route_hybrid", _RT3_SQL)
def q_route_hybrid(spark, sf):
    return route_hybrid_df(spark, sf).select(*ROUTE_COLS, "warnings")


# ----------------------------------------------------------------------------- SNK-4 / TXT-14

_PLACEHOLDER_SQL = f"""WITH i AS ({S.route_input()}), d AS ({S.corpus_dictionary(S.lookup_key)})
SELECT i.id, CASE WHEN d.pos IS NOT NULL THEN d.standard ELSE {_PH} || i.text END AS translation,
  CASE WHEN d.pos IS NOT NULL THEN 'lookup' ELSE 'placeholder' END AS origin
FROM i LEFT JOIN d ON {S.lookup_key('i.text')} = d.key"""


@register("cascade_placeholder", _PLACEHOLDER_SQL)
def q_cascade_placeholder(spark, sf):
    """Missing memory and generator artefacts: those stages are planned out."""
    out = R.route_hybrid(TB.route_input(spark, sf), None, _dictionary(spark, sf, T.lookup_key))
    return out.select("id", "translation", "origin")


# ----------------------------------------------------------------------------- RT-4

_RT4_SQL = f"""WITH i AS (SELECT * FROM ({S.route_input()}) WHERE {S.strip('text')} <> ''),
d AS ({S.corpus_dictionary(S.lookup_key)}),
x AS (SELECT i.*, {S.lang_rule('i.text')} AS predicted, d.standard AS lk, d.pos AS lk_pos FROM i LEFT JOIN d ON {S.lookup_key('i.text')} = d.key),
y AS (SELECT *, {S.lookup_key('predicted')} IS NOT DISTINCT FROM {S.lookup_key('requested_label')} AS ok FROM x)
SELECT id, predicted, predicted AS label,
  CASE WHEN NOT ok THEN NULL WHEN lk_pos IS NOT NULL THEN lk ELSE {_PH} || text END AS translation,
  CASE WHEN NOT ok THEN 'rejected' WHEN lk_pos IS NOT NULL THEN 'lookup' ELSE 'placeholder' END AS origin,
  CAST(NULL AS DOUBLE) AS score, CASE WHEN NOT ok THEN predicted END AS message FROM y"""


@register("route_gated", _RT4_SQL)
def q_route_gated(spark, sf):
    out = R.route_gated(TB.route_input(spark, sf), _dictionary(spark, sf, T.lookup_key))
    return out.withColumn("score", F.col("score").cast("double")).select(*ROUTE_COLS)


# ----------------------------------------------------------------------------- RT-5

_RT5_SQL = f"""WITH {S.text_memory_ctes(_inp_sql(f"{S.strip('text')} <> ''"))},
x AS (SELECT q.qid AS id, {S.alphabet_gate('q.text')} AS gate, b.mem_standard, b.mem_score,
        coalesce(b.mem_score >= {K.MEMORY_THRESHOLD}, false) AS hit FROM q LEFT JOIN best b USING (qid))
SELECT id, CAST(NULL AS VARCHAR) AS predicted,
  CASE WHEN gate AND hit THEN {S.sq(K.LABEL_IDIOM)} END AS label,
  CASE WHEN gate AND hit THEN mem_standard END AS translation,
  CASE WHEN NOT gate THEN 'rejected' WHEN hit THEN 'memory' ELSE 'none' END AS origin,
  CASE WHEN gate THEN round(mem_score, 6) END AS score,
  CASE WHEN NOT gate THEN {S.sq(K.NOT_ENGLISH)} WHEN NOT hit THEN {S.sq(K.NOT_IDIOM)} END AS message FROM x"""


@register("route_idiom_gate", _RT5_SQL)
def q_route_idiom_gate(spark, sf):
    out = R.route_idiom_gate(TB.route_input(spark, sf), _memory(spark, sf))
    return out.withColumn("score", F.col("score").cast("double")).select(*ROUTE_COLS)


# ----------------------------------------------------------------------------- RT-6


@register(
    "mismatch_warnings",
    f"""SELECT id, requested_label, predicted,
  {S.sq(K.MISMATCH_WARNING.split('{label}')[0])} || predicted || {S.sq(K.MISMATCH_WARNING.split('{label}')[1])} AS warning
FROM (SELECT *, {S.lang_rule('text')} AS predicted FROM ({S.route_input()}))
WHERE {S.lookup_key('predicted')} IS DISTINCT FROM {S.lookup_key('requested_label')}""",
)
def q_mismatch_warnings(spark, sf):
    return R.mismatch_warnings(TB.route_input(spark, sf))

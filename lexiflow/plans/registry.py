"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None).

Every query reads whole driver tables (or data Spark derives from them).
Computed columns carry the same alias in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow import constants as K
from lexiflow.functions import text as T
from lexiflow.plans import sqlfrag as S
from lexiflow.sources import tables as TB

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def docs(spark, sf):
    return TB.table(spark, sf, "documents")


# ============================================================================ text scalars (TXT-*)


@register("clean_text", f"SELECT doc_id, {S.clean('text')} AS clean FROM documents")
def q_clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.clean_text("text").alias("clean"))


@register("normalize_text", f"SELECT doc_id, {S.normalize('text')} AS normalized FROM documents")
def q_normalize_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_text("text").alias("normalized"))


@register("lookup_key", f"SELECT doc_id, {S.lookup_key('text')} AS key FROM documents")
def q_lookup_key(spark, sf):
    return docs(spark, sf).select("doc_id", T.lookup_key("text").alias("key"))


@register("strip_ws", f"SELECT doc_id, {S.strip('text')} AS stripped FROM documents")
def q_strip_ws(spark, sf):
    return docs(spark, sf).select("doc_id", T.strip_ws("text").alias("stripped"))


@register("remove_dots", "SELECT doc_id, replace(text, '.', '') AS no_dots FROM documents")
def q_remove_dots(spark, sf):
    return docs(spark, sf).select("doc_id", T.remove_dots("text").alias("no_dots"))


@register("collapse_ws", f"SELECT doc_id, {S.collapse('text')} AS collapsed FROM documents")
def q_collapse_ws(spark, sf):
    return docs(spark, sf).select("doc_id", T.collapse_ws("text").alias("collapsed"))


@register(
    "norm_label",
    f"SELECT doc_id, {S.norm_label('lang')} AS label_lang, {S.norm_label('source')} AS label_source FROM documents",
)
def q_norm_label(spark, sf):
    return docs(spark, sf).select("doc_id", T.norm_label("lang").alias("label_lang"), T.norm_label("source").alias("label_source"))


@register("label_lower", f"SELECT conv_id, turn, {S.lookup_key('role')} AS label FROM conversations")
def q_label_lower(spark, sf):
    return TB.table(spark, sf, "conversations").select("conv_id", "turn", T.label_lower("role").alias("label"))


@register("token_count", f"SELECT doc_id, {S.ntok('text')} AS n_tokens FROM documents")
def q_token_count(spark, sf):
    return docs(spark, sf).select("doc_id", T.token_count("text").alias("n_tokens"))


# prefix map for the driver roles (labels are languages); a parameter, not a fixed value
DRIVER_PREFIXES = {"de": "translate german to en: ", "es": "translate spanish to en: ", "fr": "translate french to en: "}


def _prefix_sql(label_sql: str) -> str:
    cases = " ".join(f"WHEN {S.sq(k)} THEN {S.sq(v)}" for k, v in DRIVER_PREFIXES.items())
    return f"coalesce(CASE {label_sql} {cases} END, '')"


@register(
    "prompt_prefix",
    f"SELECT doc_id, {_prefix_sql(S.norm_label('lang'))} || coalesce(text, '') AS input, source AS target FROM documents",
)
def q_prompt_prefix(spark, sf):
    d = docs(spark, sf)
    return d.select(
        "doc_id",
        T.prompt_input("text", T.norm_label("lang"), DRIVER_PREFIXES).alias("input"),
        F.col("source").alias("target"),
    )


@register(
    "infer_prompt",
    f"SELECT conv_id, turn, {S.sq(K.INFERENCE_PREFIX)} || text AS prompt FROM conversations WHERE role = 'user'",
)
def q_infer_prompt(spark, sf):
    return TB.user_turns(spark, sf).select("conv_id", "turn", T.infer_prompt("text").alias("prompt"))


@register("quote_repair", f"SELECT conv_id, turn, {S.quote_repair('text')} AS repaired FROM conversations")
def q_quote_repair(spark, sf):
    return TB.table(spark, sf, "conversations").select("conv_id", "turn", T.quote_repair("text").alias("repaired"))


@register("alphabet_gate", f"SELECT doc_id, {S.alphabet_gate('text')} AS passes FROM documents")
def q_alphabet_gate(spark, sf):
    return docs(spark, sf).select("doc_id", T.alphabet_gate("text").alias("passes"))


def _na_sql(x: str) -> str:
    toks = ", ".join(S.sq(t) for t in K.NA_TOKENS)
    return f"CASE WHEN {x} IN ({toks}) THEN NULL ELSE {x} END"


@register(
    "na_tokens",
    f"SELECT doc_id, ({_na_sql('text')}) IS NULL AS text_is_null, {_na_sql('lang')} AS lang, {_na_sql('source')} AS source FROM documents",
)
def q_na_tokens(spark, sf):
    d = docs(spark, sf)
    return d.select(
        "doc_id",
        T.na_to_null("text").isNull().alias("text_is_null"),
        T.na_to_null("lang").alias("lang"),
        T.na_to_null("source").alias("source"),
    )

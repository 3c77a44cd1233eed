"""Corpus shaping: NA handling, filters, profiles, unions, line cleanup, training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow import constants as K
from lexiflow.functions import text as T
from lexiflow.operators import sampling as SM


def with_na_nulls(df: DataFrame, cols: list[str], tokens: list[str] | None = None) -> DataFrame:
    return df.select(*[T.na_to_null(c, tokens).alias(c) if c in cols else F.col(c) for c in df.columns])


def label_filter(df: DataFrame, labels: list[str], label_col: str = "label") -> DataFrame:
    return df.where(F.col(label_col).isin(list(labels)))


def length_filter(
    df: DataFrame, cols: tuple[str, ...] = ("text", "standard"), lo: int = K.MIN_KEEP_TOKENS, hi: int = K.MAX_KEEP_TOKENS
) -> DataFrame:
    """Keep rows whose columns all have lo..hi whitespace tokens (null fails)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & T.token_count(c).between(lo, hi)
    return df.where(F.coalesce(cond, F.lit(False)))


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Label distribution, most frequent first (nulls dropped)."""
    return (
        df.where(F.col(label_col).isNotNull())
        .groupBy(label_col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(label_col))
    )


def source_counts(df: DataFrame, source_col: str = "source") -> DataFrame:
    """Rows per source plus the total: ``is_total`` tells the rollup row from a null source."""
    return df.rollup(source_col).agg(F.count(F.lit(1)).alias("n"), (F.grouping(source_col) == 1).alias("is_total"))


def hit_rate(df: DataFrame, hit_col: str = "hit") -> DataFrame:
    hits = F.sum(F.when(F.col(hit_col), 1).otherwise(0))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        hits.cast("long").alias("hits"),
        F.round(F.lit(100.0) * hits / F.count(F.lit(1)), 6).alias("hit_at_1"),
    )


def union_corpora(named: list[tuple[str, DataFrame]]) -> DataFrame:
    """UNION ALL by column name, missing columns -> null, with the corpus name and rank."""
    out = None
    for rank, (name, df) in enumerate(named):
        part = df.withColumn("corpus", F.lit(name)).withColumn("corpus_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------------------------- line files


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Split each text into its lines (``readlines`` + ``rstrip('\\n')``): (id, line_no, before)."""
    body = F.regexp_replace(F.col(text_col), "\n\\z", "")
    parts = F.when(F.col(text_col) == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(body, "\n"))
    return df.select(id_col, F.posexplode(parts).alias("line_no", "before"))


def line_cleanup(lines: DataFrame, col: str = "before") -> DataFrame:
    """Remove dots, collapse white space, strip; flag changed lines."""
    after = T.collapse_ws(T.remove_dots(col))
    return lines.withColumn("after", after).withColumn("changed", T.changed(col, "after"))


def line_cleanup_report(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("changed"), 1).otherwise(0)).cast("long").alias("n_changed"),
    )


def change_preview(cleaned: DataFrame, first_lines: int = 10) -> DataFrame:
    """Changed lines among the first ``first_lines`` lines of each file."""
    return cleaned.where(F.col("changed") & (F.col("line_no") < first_lines))


# ------------------------------------------------------------------------------------- training set


def seq2seq_trainset(
    corpus: DataFrame,
    labels: list[str] = (K.LABEL_OTTOMAN, K.LABEL_DIALECT),
    prefixes: dict | None = None,
    valid_size: float = 0.1,
    seed: int = K.SEED,
) -> DataFrame:
    """Canonical labels -> label filter -> 1..256 tokens -> stratified 90/10 ->
    (id, split, input, target); write with ``partitionBy('split')``."""
    x = corpus.withColumn("label", T.norm_label("label"))
    x = label_filter(x, list(labels))
    x = length_filter(x)
    x = SM.stratified_split(x, "label", "id", valid_size, seed, names=("train", "validation"))
    return x.select(
        "id",
        "split",
        T.prompt_input("text", "label", prefixes).alias("input"),
        F.col("standard").cast("string").alias("target"),
        "label",
    )

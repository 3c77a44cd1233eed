"""Routing cascades: memory / lookup / classifier / generator with provenance.

Every policy returns ``(id, text, requested_label, predicted, label,
translation, origin, score, message)`` plus ``warnings`` for the hybrid policy.
``origin`` is one of ``memory, lookup, generator, placeholder, none, rejected``.

Cheap stages run first and the expensive generator hook runs on the rows
still unanswered only: the input is split into answered / unanswered with
filters and the generator output is unioned back (a Python hook inside
``coalesce`` would run on every row).
"""

from __future__ import annotations

from typing import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexiflow import constants as K
from lexiflow.functions import text as T
from lexiflow.operators import dictionary as D
from lexiflow.operators.hooks import ModelHook
from lexiflow.session import scratch_path

Classifier = Callable[[Column], Column]
# a hook that is loaded once per process, or a function over batches of rows
Generator = ModelHook | Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]]

OUT_COLS = ["id", "text", "requested_label", "predicted", "label", "translation", "origin", "score", "message"]


def lang_rule(col) -> Column:
    """Deterministic stand-in classifier for the driver data: language by letters."""
    c = F.col(col) if isinstance(col, str) else col
    return (
        F.when(c.rlike("[éèêçàùâîôëïœ]"), F.lit("fr"))
        .when(c.rlike("[äöüß]"), F.lit("de"))
        .when(c.rlike("[ñáíóú¿¡]"), F.lit("es"))
        .otherwise(F.lit("en"))
    )


def classify(x: DataFrame, classifier) -> DataFrame:
    """Adds ``predicted``: a column rule (JVM-side), a model hook or a fitted model."""
    if _fitted(classifier):
        from lexiflow.operators.classify import predict

        return predict(classifier, x)
    return x.withColumn("predicted", classifier(F.col("text")))


def _fitted(classifier) -> bool:
    """Whether this is a fitted model, which transforms rows, and not a column function."""
    return hasattr(classifier, "transform")


def classify_rest(x: DataFrame, classifier, done: str) -> DataFrame:
    """``predicted`` for the rows without ``done``, null for the others.

    A column rule is evaluated inside the condition, so never on finished rows.  A fitted
    model or a hook is applied to the unfinished rows alone; the scored input is written once, so
    that the two branches do not score it twice.
    """
    if not _fitted(classifier) and not isinstance(classifier, ModelHook):
        return x.withColumn("predicted", F.when(~F.col(done), classifier(F.col("text"))))
    x = _once(x)
    rest = classify(x.where(~F.col(done)), classifier)
    return rest.unionByName(x.where(F.col(done)).withColumn("predicted", F.lit(None).cast("string")))


def _once(x: DataFrame) -> DataFrame:
    """Write a scored input to the shared folder and read it back: several branches use it,
    and no cached table outlives them."""
    spark = x.sparkSession
    path = scratch_path(spark, "route-scored")
    x.write.parquet(path)
    return spark.read.schema(x.schema).parquet(path)


def _score(col: str = "mem_score") -> Column:
    return F.round(F.col(col), 6)


def _no_memory(df: DataFrame) -> DataFrame:
    return df.withColumn("mem_standard", F.lit(None).cast("string")).withColumn("mem_score", F.lit(None).cast("double"))


def _resolve(
    x: DataFrame,
    chain: list[tuple[Column, Column, str]],
    gen_cond: Column | None,
    generator: Generator | None,
    fallback: tuple[Column, str] | None = None,
    repair_quotes: bool = False,
) -> DataFrame:
    """Pick ``translation``/``origin`` from the first matching rule of ``chain``;
    rows matching ``gen_cond`` (and no earlier rule) go to the generator.

    Without a generator hook everything is one projection.  With a hook the
    scored input is written once and the hook runs on the unanswered rows only.
    """

    def pick(rules):
        tr, og = None, None
        for cond, value, origin in rules:
            tr = F.when(cond, value) if tr is None else tr.when(cond, value)
            og = F.when(cond, F.lit(origin)) if og is None else og.when(cond, F.lit(origin))
        return tr, og

    rules = list(chain)
    if gen_cond is not None and generator is None:
        rules.append((gen_cond, T.placeholder("text"), "placeholder"))
    if fallback is not None:
        rules.append((F.lit(True), fallback[0], fallback[1]))
    if gen_cond is None or generator is None:
        tr, og = pick(rules)
        return x.withColumn("translation", tr).withColumn("origin", og)
    answered = F.lit(False)
    for cond, _, _ in chain:
        answered = answered | F.coalesce(cond, F.lit(False))
    to_gen = ~answered & F.coalesce(gen_cond, F.lit(False))
    x = _once(x.withColumn("_to_gen", to_gen))
    tr, og = pick(rules)
    rest = x.where(~F.col("_to_gen")).withColumn("translation", tr).withColumn("origin", og)
    todo = x.where(F.col("_to_gen"))
    if isinstance(generator, ModelHook):
        gen = todo.withColumn("generated", generator("text"))
    else:
        schema = StructType([*todo.schema.fields, StructField("generated", StringType(), True)])

        def hook(batches):
            yield from generator(batches)

        gen = todo.mapInPandas(hook, schema)
    out = T.quote_repair("generated") if repair_quotes else F.col("generated")
    gen = gen.withColumn("translation", out).withColumn("origin", F.lit("generator")).drop("generated")
    return rest.unionByName(gen).drop("_to_gen")


def _finish(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    cols = OUT_COLS + (extra or [])
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(*cols)


def route_idiom_first(
    inp: DataFrame,
    memory,
    classifier: Classifier = lang_rule,
    generator_labels: list[str] = (K.LABEL_OTTOMAN, K.LABEL_DIALECT),
    generator: Generator | None = None,
    threshold: float = K.MEMORY_THRESHOLD,
    memory_label: str = K.LABEL_IDIOM,
    lookup: DataFrame | None = None,
    case_sensitive: bool = True,
) -> DataFrame:
    """Memory first; else classify; variant labels go to (lookup, then) generator.

    ``lookup=None`` with ``case_sensitive=True`` is the first CLI loop; a
    normalise-keyed dictionary with a lower-cased label test is the second.
    """
    x = inp.where(~(T.lookup_key("text") == F.lit(K.STOP_MARKER)) | F.col("text").isNull())
    x = memory.match(x, "id", "text") if memory is not None else _no_memory(x)
    hit = F.coalesce(F.col("mem_score") >= F.lit(threshold), F.lit(False))
    x = classify_rest(x.withColumn("_hit", hit), classifier, "_hit")
    if case_sensitive:
        gen_ok = F.col("predicted").isin(list(generator_labels))
    else:
        gen_ok = F.lower(F.col("predicted")).isin([g.lower() for g in generator_labels])
    x = x.withColumn("_gen", F.coalesce(gen_ok, F.lit(False)))
    x = x.withColumn("label", F.when(F.col("_hit"), F.lit(memory_label)).otherwise(F.col("predicted")))
    x = x.withColumn("score", _score())
    chain = [(F.col("_hit"), F.col("mem_standard"), "memory")]
    if lookup is not None:
        x = D.lookup(x, lookup, T.normalize_text, "text", "lk", only=F.col("_gen"))
        chain.append((F.col("_gen") & F.col("lk_pos").isNotNull(), F.col("lk"), "lookup"))
    out = _resolve(x, chain, F.col("_gen"), generator, (F.lit(K.NO_MODULE), "none"))
    return _finish(out)


def route_hybrid(
    inp: DataFrame,
    memory,
    lookup: DataFrame | None,
    classifier: Classifier = lang_rule,
    generator: Generator | None = None,
    threshold: float = K.HYBRID_THRESHOLD,
) -> DataFrame:
    """Memory chosen by the requested label (>= threshold), then the shared lookup
    overrides it, then generator / placeholder.  A classifier disagreement only
    adds a warning."""
    x = memory.match(inp, "id", "text", label_col="requested_label") if memory is not None else _no_memory(inp)
    hit = F.coalesce(F.col("mem_score") >= F.lit(threshold), F.lit(False))
    x = x.withColumn("_hit", hit).withColumn("score", _score())
    chain = []
    if lookup is not None:
        x = D.lookup(x, lookup, T.lookup_key, "text", "lk")
        chain.append((F.col("lk_pos").isNotNull(), F.col("lk"), "lookup"))
    chain.append((F.col("_hit"), F.col("mem_standard"), "memory"))
    x = classify(x, classifier)
    warn = F.when(
        ~T.label_lower("predicted").eqNullSafe(T.label_lower("requested_label")),
        F.format_string(K.MISMATCH_WARNING.replace("{label}", "%s"), F.col("predicted")),
    )
    x = x.withColumn("warnings", F.array_compact(F.array(warn))).withColumn("label", F.col("requested_label"))
    out = _resolve(x, chain, F.lit(True), generator)
    return _finish(out, ["warnings"])


def route_gated(
    inp: DataFrame,
    lookup: DataFrame | None,
    classifier: Classifier = lang_rule,
    generator: Generator | None = None,
) -> DataFrame:
    """Blank input skipped; predicted != requested -> rejected with a hint; else
    lookup, then generator (quote repair on generated text), then placeholder."""
    x = classify(inp.where(T.strip_ws("text") != F.lit("")), classifier)
    ok = T.label_lower("predicted").eqNullSafe(T.label_lower("requested_label"))
    x = x.withColumn("_ok", ok).withColumn("label", F.col("predicted"))
    x = x.withColumn("message", F.when(~F.col("_ok"), F.col("predicted")))
    chain = [(~F.col("_ok"), F.lit(None).cast("string"), "rejected")]
    if lookup is not None:
        x = D.lookup(x, lookup, T.lookup_key, "text", "lk", only=F.col("_ok"))  # rejected rows are not looked up
        chain.append((F.col("lk_pos").isNotNull(), F.col("lk"), "lookup"))
    out = _resolve(x, chain, F.lit(True), generator, repair_quotes=True)
    return _finish(out)


def route_idiom_gate(inp: DataFrame, memory, threshold: float = K.MEMORY_THRESHOLD, memory_label: str = K.LABEL_IDIOM) -> DataFrame:
    """Alphabet gate -> memory >= threshold -> idiom translation, else 'not an idiom'.

    The memory is consulted for gated rows only (the filter runs before scoring)."""
    x = inp.where(T.strip_ws("text") != F.lit(""))
    x = x.withColumn("_gate", T.alphabet_gate("text"))
    rejected = x.where(~F.col("_gate")).withColumn("origin", F.lit("rejected")).withColumn("message", F.lit(K.NOT_ENGLISH))
    cand = x.where("_gate")
    cand = memory.match(cand, "id", "text") if memory is not None else _no_memory(cand)
    hit = F.coalesce(F.col("mem_score") >= F.lit(threshold), F.lit(False))
    cand = cand.withColumn("score", _score()).withColumn("_hit", hit)
    cand = cand.withColumn("translation", F.when(F.col("_hit"), F.col("mem_standard")))
    cand = cand.withColumn("origin", F.when(F.col("_hit"), F.lit("memory")).otherwise(F.lit("none")))
    cand = cand.withColumn("label", F.when(F.col("_hit"), F.lit(memory_label)))
    cand = cand.withColumn("message", F.when(~F.col("_hit"), F.lit(K.NOT_IDIOM)))
    return _finish(rejected.unionByName(cand, allowMissingColumns=True))


def mismatch_warnings(inp: DataFrame, classifier: Classifier = lang_rule) -> DataFrame:
    x = classify(inp, classifier)
    return x.where(~T.label_lower("predicted").eqNullSafe(T.label_lower("requested_label"))).select(
        "id",
        "requested_label",
        "predicted",
        F.format_string(K.MISMATCH_WARNING.replace("{label}", "%s"), F.col("predicted")).alias("warning"),
    )

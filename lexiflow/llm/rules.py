"""Quality classifier: a sparse ensemble of rules over document statistics.

Statistics of every whole text are made in one pass and stored.  Shallow trees (Spark ML
random forest) are grown on the labelled training rows; every path from a root is a
conjunction of thresholds, a rule.  A lasso logistic regression weighs the rules, and the
rules with a weight become one Spark column expression that scores all rows.

Defined results: a null or empty text has zero statistics and is scored like any other
row; a repeated id has the larger of its labels; repeated rows get equal scores; without
training rows of both classes the score is the share of good training rows (0.5 if none).
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import common as C
from lexiflow.llm.linecrf import repeat_cover

TREES = 10
DEPTH = 3
LASSO = 0.001
MAX_ITER = 1000  # passes of the lasso at most; a fit that needs more warns
TOLERANCE = 1e-5
THRESHOLD = 0.3
SEED = 42
PARTITION_ROWS = 100_000  # training rows of a partition

STATS = (
    "n_words", "mean_word", "longest_word", "symbol_share", "upper_share", "digit_share", "letter_share",
    "shouts_per_word", "pipes_per_word", "repeat_share", "distinct_share", "dup_line_share", "words_per_line", "stops_per_word",
)
FIELDS = T.StructType([T.StructField(s, T.DoubleType(), False) for s in STATS])


class NotConverged(UserWarning):
    pass


Condition = tuple[int, bool, float]  # statistic, at most the threshold, threshold


def _flags(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


SYMBOLS = _flags(*b"#*$%&|<>@^~_=+\\{}[]")
STOPS = _flags(*b".,;:?")


def statistics(text) -> list[np.ndarray]:
    """The statistics of the texts of a slice, in the order of STATS."""
    buf, off = C.bounds(text)
    starts, ends, first = C.word_bounds(buf, off)
    n_words = np.diff(first)
    words = np.maximum(n_words, 1)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    solid = ((buf & 0xC0) != 0x80) & ~C.WS[buf]
    chars = C.per_doc(solid, off)
    some = np.maximum(chars, 1)
    cum = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(solid, out=cum[1:])
    size = cum[ends] - cum[starts]
    longest = np.zeros(len(n_words))
    np.maximum.at(longest, doc, size)
    high = np.zeros(len(buf), bool)
    high[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    upper = ((buf >= 65) & (buf <= 90)) | high
    letters = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 0xC0)
    code, _ = C.codes(C.pick(buf, starts, ends))
    cover = C.per_doc(repeat_cover(code, doc), first)
    pairs = np.unique(doc * (int(code.max()) + 1) + code) if len(code) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs // (int(code.max()) + 1), minlength=len(n_words)) if len(code) else np.zeros(len(n_words))
    # lines with a word, by their hashed words
    cuts = np.unique(np.concatenate([off[:-1], np.flatnonzero(buf == 0x0A) + 1]))
    line = np.searchsorted(cuts, starts, "right") - 1
    lead = np.flatnonzero(np.diff(line, prepend=-1) != 0)
    n_lines = np.bincount(doc[lead], minlength=len(n_words)) if len(lead) else np.zeros(len(n_words))
    if len(lead):
        with np.errstate(over="ignore"):
            mixed = C.mix64(code.astype(np.uint64) + C.mix64((np.arange(len(code)) - np.repeat(lead, np.diff(np.append(lead, len(code))))).astype(np.uint64)))
            sums = np.add.reduceat(mixed, lead)
        keys = np.unique(np.column_stack([doc[lead].astype(np.uint64), sums]), axis=0)
        dup = n_lines - np.bincount(keys[:, 0].astype(np.int64), minlength=len(n_words))
    else:
        dup = np.zeros(len(n_words))
    count = lambda flags: C.per_doc(flags, off)
    out = [
        n_words, chars / words, longest, count(SYMBOLS[buf]) / some, count(upper) / np.maximum(count(letters), 1),
        count((buf >= 48) & (buf <= 57)) / some, count(letters) / some, count(buf == 33) / words, count(buf == 124) / words,
        cover / words, distinct / words, dup / np.maximum(n_lines, 1), n_words / np.maximum(n_lines, 1), count(STOPS[buf]) / words,
    ]
    return [np.asarray(x, np.float64) for x in out]


def with_statistics(docs: DataFrame, text_col: str = "text", into: str = "_stats") -> DataFrame:
    """All columns of ``docs`` and the struct ``into`` with the statistics."""
    return C.annotate(docs, text_col, lambda: statistics, FIELDS, into)


# ------------------------------------------------------------------ rules


def paths(tree) -> list[tuple[Condition, ...]]:
    """The conjunction of every node below the root of a fitted tree."""
    out: list[tuple[Condition, ...]] = []

    def walk(node, so_far: tuple[Condition, ...]) -> None:
        if so_far:
            out.append(simplified(so_far))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            f, t = int(split.featureIndex()), float(split.threshold())
            walk(node.leftChild(), (*so_far, (f, True, t)))
            walk(node.rightChild(), (*so_far, (f, False, t)))

    walk(tree._call_java("rootNode"), ())
    return out


def simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The tightest threshold of each statistic and side, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for f, most, t in rule:
        if (f, most) in tight:
            t = min(t, tight[f, most]) if most else max(t, tight[f, most])
        tight[f, most] = t
    return tuple((f, most, t) for (f, most), t in sorted(tight.items()))


def holds(rule: tuple[Condition, ...], stats: str) -> Column:
    """A rule as a boolean column over the struct ``stats``."""
    cond = F.lit(True)
    for f, most, t in rule:
        x = F.col(f"{stats}.{STATS[f]}")
        cond = cond & ((x <= t) if most else (x > t))
    return cond


class RuleEnsemble:
    def __init__(self, rules: list[tuple[tuple[Condition, ...], float]], bias: float):
        self.rules, self.bias = rules, bias

    def score(self, stats: str) -> Column:
        """Probability of a good document, as one column expression."""
        z = F.lit(self.bias)
        for rule, w in self.rules:
            z = z + F.when(holds(rule, stats), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        text = lambda r: " and ".join(f"{STATS[f]} {'<=' if m else '>'} {t:.4g}" for f, m, t in r)
        return [f"{w:+.3f} if {text(r)}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit(train: DataFrame, stats: str = "_stats", label: str = "y") -> RuleEnsemble:
    """Grow trees, take their rules, weigh them by lasso; all rows of ``train`` take part."""
    share = train.agg(F.avg(label), F.count(label)).first()
    if not share[1] or share[0] in (0.0, 1.0):
        p = share[0] if share[1] else 0.5
        return RuleEnsemble([], float(np.log((p + 1e-9) / (1 - p + 1e-9))))
    values = array_to_vector(F.array(*[F.col(f"{stats}.{s}") for s in STATS]))
    # narrow rows that every iteration passes over: partitions by their number, not by the
    # shuffle's
    parts = max(4, -(-int(share[1]) // PARTITION_ROWS))
    data = train.select(values.alias("features"), F.col(label).cast("double").alias("label"), F.col(stats)).repartition(parts).persist()
    try:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", seed=SEED).fit(data)
        rules = sorted({r for tree in forest.trees for r in paths(tree)})
        if not rules:
            return RuleEnsemble([], float(np.log(share[0] / (1 - share[0]))))
        flags = F.array(*[F.when(holds(r, stats), 1.0).otherwise(0.0) for r in rules])
        held = data.select(array_to_vector(flags).alias("features"), "label")
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=MAX_ITER, tol=TOLERANCE).fit(held)
        if lasso.summary.totalIterations >= MAX_ITER:
            warnings.warn(f"the lasso stopped after {MAX_ITER} passes", NotConverged, stacklevel=2)
    finally:
        data.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6], float(lasso.intercept))


def query(spark, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.source_table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = C.stored(with_statistics(docs).select("doc_id", "_stats"), "rules-stats")
    labels = C.source_table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null")
    labels = labels.where(C.fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    model = fit(stats.join(labels, "doc_id"))
    scored = stats.withColumn("score", model.score("_stats"))
    return scored.select(
        "doc_id",
        F.coalesce(C.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )

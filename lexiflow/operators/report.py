"""Confusion matrix and per-class precision / recall / F1 report.

Everything is derived from the confusion table ``groupBy(gold, predicted)``,
whose size is bounded by the square of the (closed) label vocabulary; the
aggregation combines map-side, so a dominant class costs nothing extra.
The report is one pass over that table, without a cache.  Zero division gives 0.0; labels are the union of gold and predicted values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, gold: str = "gold", predicted: str = "predicted", digits: int = 6) -> DataFrame:
    conf = confusion(df, gold, predicted)
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("gold").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("npred")),
        F.struct(F.col("predicted").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("npred")),
    )
    per = conf.select(F.inline(sides)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "npred")])
    p = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("p", p).withColumn("r", r)
    f = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    per = per.withColumn("f", f)

    def line(label, a, b, c, support):
        return F.struct(
            label.cast("string").alias("label"), F.round(a.cast("double"), digits).alias("precision"), F.round(b.cast("double"), digits).alias("recall"),
            F.round(c.cast("double"), digits).alias("f1"), support.cast("long").alias("support"),
        )

    none = F.lit(None).cast("double")
    n = F.sum("support")
    mean = lambda c: F.avg(c)
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / n
    # the label vocabulary is closed: its rows fit one row
    whole = per.agg(
        F.collect_list(line(F.col("label"), F.col("p"), F.col("r"), F.col("f"), F.col("support"))).alias("rows"),
        line(F.lit("accuracy"), none, none, F.sum("tp") / n, n).alias("acc"),
        line(F.lit("macro avg"), mean("p"), mean("r"), mean("f"), n).alias("macro"),
        line(F.lit("weighted avg"), weighted("p"), weighted("r"), weighted("f"), n).alias("weighted"),
    )
    return whole.select(F.inline(F.concat("rows", F.array("acc", "macro", "weighted"))))

"""Classification metrics over rows with ``y`` and ``pred``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as G


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """(y, pred, n), dense over all classes seen."""
    counts = rows.groupBy("y", "pred").agg(F.count("*").alias("n"))
    classes = rows.select(F.explode(F.array("y", "pred")).alias("c")).distinct()
    grid = classes.select(F.col("c").alias("y")).join(classes.select(F.col("c").alias("pred")))  # the result itself has classes x classes rows
    return grid.join(counts, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_report(rows: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support); undefined ratios are 0."""
    hits = rows.groupBy("y", "pred").agg(F.count("*").alias("n"))
    each = hits.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")),
                F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")),
            )
        ).alias("e")
    ).select("e.*")
    sums = each.groupBy(F.col("c").alias("class")).agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        "class",
        ratio(F.col("tp"), F.col("said")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"),
        "support",
    )


def accuracy_f1(rows: DataFrame) -> DataFrame:
    """One row: accuracy, macro and micro F1 (0 without rows)."""
    macro = class_report(rows).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1_macro"))
    acc = rows.agg(F.coalesce(F.avg((F.col("y") == F.col("pred")).cast("double")), F.lit(0.0)).alias("accuracy"))
    return acc.join(F.broadcast(macro)).select("accuracy", "f1_macro", F.col("accuracy").alias("f1_micro"))


def metric_bundle(rows: DataFrame, mask: str | None = None) -> DataFrame:
    """One row: loss (mean cross-entropy of ``logits``), accuracy, macro and micro F1
    and the number of rows; with ``mask`` only rows where that column is true count."""
    own = rows if mask is None else rows.where(F.col(mask))
    loss = own.agg(F.coalesce(F.avg(-F.get(G.log_softmax(F.col("logits")), F.col("y"))), F.lit(0.0)).alias("loss"), F.count("*").alias("n"))
    return accuracy_f1(own).join(F.broadcast(loss)).select("loss", "accuracy", "f1_macro", "f1_micro", "n")  # one row each

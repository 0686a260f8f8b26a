"""Quality of predictions, computed from counted (label, prediction) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import ref


def _ratio(a, b):
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def confusion_pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``label, prediction, rows_count`` of the pairs that occur."""
    return df.groupBy(
        ref(label).cast("string").alias("label"), ref(prediction).cast("string").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("rows_count"))


def full_matrix(pairs: DataFrame, labels: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """All pairs of the given labels, or of the labels seen on either side, with 0 where none occurs.

    A view for reading, classes x classes rows; metrics don't need it.
    """
    names = pairs.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    if isinstance(labels, DataFrame):
        names = labels.toDF("c")
    elif labels is not None:
        names = pairs.sparkSession.createDataFrame([(c,) for c in labels], "c string")
    grid = names.select(F.col("c").alias("label")).crossJoin(names.select(F.col("c").alias("prediction")))
    return grid.join(pairs, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("rows_count", F.lit(0)).alias("rows_count")
    )


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, labels: Sequence[str] | None = None
) -> DataFrame:
    return full_matrix(confusion_pairs(df, label, prediction), labels)


def per_class_metrics(confusion: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support``; an empty class scores 0.  Takes pairs or the full matrix."""
    hit = F.col("label") == F.col("prediction")
    true_side = confusion.groupBy("label").agg(
        F.sum("rows_count").alias("support"), F.sum(F.when(hit, F.col("rows_count")).otherwise(0)).alias("hits")
    )
    predicted = confusion.groupBy(F.col("prediction").alias("label")).agg(F.sum("rows_count").alias("predicted"))
    zero = F.lit(0).cast("bigint")
    both = true_side.join(predicted, "label", "full").withColumns(
        {c: F.coalesce(c, zero) for c in ("support", "hits", "predicted")}
    )
    scored = both.select(
        "label", "support", "hits", "predicted",
        _ratio("hits", "predicted").alias("precision"), _ratio("hits", "support").alias("recall"),
    )
    f1 = F.coalesce(
        F.try_divide(2 * F.col("hits").cast("double"), (F.col("support") + F.col("predicted")).cast("double")),
        F.lit(0.0),
    )
    return scored.withColumn("f1", f1)


def classification_report(confusion: DataFrame) -> DataFrame:
    """Per class rows followed by the macro and weighted averages."""
    classes = per_class_metrics(confusion).where("support > 0 or predicted > 0")
    w = F.col("support").cast("double")
    rows = classes.select("label", "precision", "recall", "f1", "support")
    macro = rows.agg(
        F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").alias("support"),
    )
    weighted = rows.agg(
        F.lit("weighted avg").alias("label"),
        *[F.coalesce(F.try_divide(F.sum(F.col(m) * w), F.sum(w)), F.lit(0.0)).alias(m)
          for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )
    return rows.unionByName(macro).unionByName(weighted)


def classification_metrics(confusion: DataFrame) -> DataFrame:
    """One row with accuracy, balanced accuracy and the averaged scores."""
    classes = per_class_metrics(confusion)
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    w = F.col("support").cast("double")
    zero = F.lit(0.0)
    return classes.where(seen).agg(
        F.coalesce(F.try_divide(F.sum("hits").cast("double"), F.sum("support").cast("double")), zero).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * w), F.sum(w)), zero).alias("f1_weighted"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row ``mae, rmse, r2``."""
    y, error = ref(label).cast("double"), ref(label).cast("double") - ref(prediction).cast("double")
    sums = df.agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("spread")
    )
    r2 = F.coalesce(
        1 - F.try_divide(F.col("mse"), F.col("spread")), F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select("mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def rollup_importance(importances: DataFrame, sources: DataFrame, k: int = 10) -> DataFrame:
    """Importance per source column; ``importances`` is (feature, importance),
    ``sources`` is (feature, source)."""
    joined = importances.join(sources, "feature", "left")
    name = F.coalesce("source", "feature").alias("feature")
    return (
        joined.groupBy(name).agg(F.sum("importance").alias("importance"))
        .orderBy(F.desc("importance"), "feature").limit(k)
    )

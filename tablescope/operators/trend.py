"""Simple regression and grouped or binned trends."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.columns import require_column
from tablescope.functions.stats import fit_quality, number_label
from tablescope.operators.corr import numeric_pair
from tablescope.operators.ranks import exact_quantiles

TREND_POINTS = 12
LABEL_PRECISION = 3


def linear_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``slope, intercept, r2, rows_used`` of y on x.

    A constant x gives slope 0 and the mean of y, as a least-squares solver
    would report.
    """
    if x == y:
        raise ValueError("Choose two different columns")
    require_column(df, x, numeric=True)
    require_column(df, y, numeric=True)
    c = F.col
    fit = numeric_pair(df, x, y).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.avg("y").alias("mean_y"),
        (F.min("x") < F.max("x")).alias("x_varies"),
        (F.min("y") < F.max("y")).alias("y_varies"),
    )
    row = fit.first()
    if row["n"] < 2:
        raise ValueError("Not enough numeric rows for analysis")
    if row["x_varies"] and row["y_varies"]:
        values = (row["slope"], row["intercept"], row["r2"])
    else:
        values = (0.0, row["mean_y"], 0.0 if row["y_varies"] else 1.0)
    local = df.sparkSession.createDataFrame(
        [(*map(float, values), row["n"])], "slope double, intercept double, r2 double, rows_used bigint"
    )
    return local.select(
        "slope", "intercept", "r2", "rows_used",
        F.when(c("slope") > 0, "rises").otherwise("falls").alias("direction"),
        fit_quality(c("r2")).alias("fit"),
    )


def _rounded_edges(edges: list[float], precision: int = LABEL_PRECISION) -> list[float]:
    """Edges as they appear in labels; more digits only if they would collide."""
    for digits in range(precision, 20):
        shown = [_round_part(e, digits) for e in edges]
        if len(set(shown)) == len(shown):
            break
    else:
        digits = precision
        shown = [_round_part(e, digits) for e in edges]
    # the lowest value belongs to the first interval, so its edge is lowered
    return [shown[0] - 10.0**-digits, *shown[1:]]


def _round_part(value: float, digits: int) -> float:
    """Round the fraction; below one the digits count from the first non-zero."""
    if not math.isfinite(value) or value == 0:
        return value
    fraction, whole = math.modf(value)
    if whole == 0 and fraction != 0:
        digits = -math.floor(math.log10(abs(fraction))) - 1 + digits
    return round(value, digits)


def trend(df: DataFrame, x: str, y: str, limit: int = TREND_POINTS) -> DataFrame:
    """Mean of y along x: rows ``kind, point, label, x, y, rows_count``.

    Up to ``limit`` different x values form one group each; otherwise x is cut
    into right-closed quantile bins.
    """
    pair = numeric_pair(df, x, y)
    n = pair.count()
    if n < 2:
        raise ValueError("Not enough numeric rows for analysis")
    few = pair.select("x").distinct().limit(limit + 1).count() <= limit
    if few:
        grouped = pair.groupBy("x").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("rows_count"))
        # at most ``limit`` groups
        order = Window.orderBy("x")
        return grouped.select(
            F.lit("grouped").alias("kind"), F.row_number().over(order).alias("point"),
            number_label(F.col("x")).alias("label"), "x", "y", "rows_count",
        )
    bins = min(limit, max(4, int(math.sqrt(n))))
    cuts = exact_quantiles(pair, {"x": [i / bins for i in range(bins + 1)]})["x"]
    edges = sorted(set(cuts))
    shown = _rounded_edges(edges)
    place = F.lit(0)
    for edge in edges[1:-1]:
        place = place + F.when(F.col("x") > F.lit(edge), 1).otherwise(0)
    labels = F.array(*[F.lit(f"{a:.2f} - {b:.2f}") for a, b in zip(shown, shown[1:])])
    grouped = pair.groupBy(place.alias("bin")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("rows_count")
    )
    # at most ``limit`` bins
    order = Window.orderBy("bin")
    return grouped.select(
        F.lit("binned").alias("kind"), F.row_number().over(order).alias("point"),
        labels[F.col("bin")].alias("label"), "x", "y", "rows_count",
    )


def trend_extremes(points: DataFrame) -> DataFrame:
    """Labels of the points with the lowest and highest mean, first on ties."""
    return points.agg(
        F.min(F.struct("y", "point", "label")).alias("lo"),
        F.min(F.struct((-F.col("y")).alias("k"), "point", "label", "y")).alias("hi"),
    ).select(
        F.col("lo.label").alias("lowest_label"), F.col("lo.y").alias("lowest_y"),
        F.col("hi.label").alias("highest_label"), F.col("hi.y").alias("highest_y"),
    )


def fitted_trend(points: DataFrame, regression: DataFrame) -> DataFrame:
    """Value of the regression line at every trend point."""
    line = regression.first()
    return points.withColumn("fitted", F.lit(line["slope"]) * F.col("x") + F.lit(line["intercept"]))

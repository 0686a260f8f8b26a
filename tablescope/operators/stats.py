"""Descriptive statistics, histograms and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import (
    as_double,
    column_aggregates,
    flat_columns,
    is_numeric,
    per_column,
    ref,
    require_column,
)
from tablescope.operators.quality import top_values
from tablescope.operators.ranks import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)
NUMERIC_STATS = (
    "column_name string, values_count bigint, mean double, std double, min double, "
    "q25 double, median double, q75 double, max double"
)
TEXT_STATS = "column_name string, values_count bigint, unique_count bigint, top string, freq bigint"
OUTLIER_VALUES = 100


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles."""
    names = [c for c in (columns or df.columns) if is_numeric(df.schema[c].dataType)]
    if not names:
        return df.sparkSession.createDataFrame([], NUMERIC_STATS)

    values = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    facts = column_aggregates(
        values,
        values.columns,
        lambda _, v: {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "lo": F.min(v), "hi": F.max(v)},
    )
    cuts = exact_quantiles(df, {c: QUARTILES for c in names})
    rows = [(c, facts[i]["n"], facts[i]["mean"], facts[i]["std"], facts[i]["lo"], *cuts[c], facts[i]["hi"])
            for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, NUMERIC_STATS)


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct values, most frequent value and its frequency."""
    wanted = columns or flat_columns(df)
    names = [c for c in wanted if not is_numeric(df.schema[c].dataType)]
    if not names:
        return df.sparkSession.createDataFrame([], TEXT_STATS)

    def branch(i: int, name: str) -> DataFrame:
        counted = (
            df.select(ref(name).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        )
        return counted.agg(
            F.lit(i).alias("i"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("u"),
            F.min(F.struct((-F.col("n")).alias("k"), F.col("v").cast("string").alias("v"))).alias("best"),
        )

    rows = []
    for r in sorted(per_column(names, branch), key=lambda r: r["i"]):
        best = r["best"]
        rows.append((names[r["i"]], r["n"], r["u"], best["v"] if best else None, -best["k"] if best else None))
    return df.sparkSession.createDataFrame(rows, TEXT_STATS)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All statistics in long form: ``column_name, metric, value``."""
    parts = []
    for frame in (describe_numeric(df, columns), describe_categorical(df, columns)):
        metrics = [c for c in frame.columns if c != "column_name"]
        parts.append(
            frame.select(
                "column_name",
                F.explode(
                    F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value"))
                              for m in metrics])
                ).alias("m"),
            ).select("column_name", "m.*")
        )
    return parts[0].unionByName(parts[1])


def _histogram_edges(lo: float, hi: float, bins: int) -> list[float]:
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    return [lo + step * i for i in range(bins)] + [hi]


def histogram_numeric(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the value range, last bin closed, empty bins kept."""
    _check_bins(bins)
    require_column(df, column, numeric=True)
    values = df.select(as_double(df, column).alias("v")).where("v is not null")
    span = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if span["lo"] is None:
        raise ValueError("Column has no numeric values")
    edges = _histogram_edges(span["lo"], span["hi"], bins)
    width = (edges[-1] - edges[0]) / bins
    guess = F.least(F.floor((F.col("v") - edges[0]) / F.lit(width)), F.lit(bins - 1))
    guess = F.greatest(guess, F.lit(0))
    # a value next to an edge is settled by the edge itself
    limits = F.array(*[F.lit(e) for e in edges])
    left = F.element_at(limits, (guess + 1).cast("int"))
    right = F.element_at(limits, (guess + 2).cast("int"))
    place = (
        F.when((F.col("v") < left) & (guess > 0), guess - 1)
        .when((F.col("v") >= right) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    counted = values.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, bin_left double, bin_right double"
    )
    return frame.join(counted, "bin", "left").select(
        "bin", "bin_left", "bin_right", F.coalesce("n", F.lit(0)).alias("rows_count")
    )


def histogram_categorical(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """The most frequent values of a column with their counts."""
    _check_bins(bins)
    require_column(df, column)
    return top_values(df, column, bins).select(
        F.col("position").alias("bin"), F.col("value").alias("label"), F.col("value_count").alias("rows_count")
    )


def _check_bins(bins: int) -> None:
    if isinstance(bins, bool) or not isinstance(bins, int) or bins < 2:
        raise ValueError("Histogram needs at least 2 bins")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    require_column(df, column)
    data_type = df.schema[column].dataType
    if is_numeric(data_type) or isinstance(data_type, T.BooleanType):
        return histogram_numeric(df, column, bins)
    return histogram_categorical(df, column, bins)


def outlier_summary(df: DataFrame, column: str) -> DataFrame:
    """Extremes, quartiles and the 1.5 IQR fences; one row."""
    require_column(df, column, numeric=True)
    low, q1, mid, q3, high = exact_quantiles(df, {column: [0.0, *QUARTILES, 1.0]})[column]
    if low is None:
        raise ValueError("Column has no numeric values")
    reach = 1.5 * (q3 - q1)
    return df.sparkSession.createDataFrame(
        [(low, q1, mid, q3, high, q1 - reach, q3 + reach)],
        "min double, q1 double, median double, q3 double, max double, iqr_lower double, iqr_upper double",
    )


def _z_filter(df: DataFrame, column: str, threshold: float) -> Column:
    """Condition on ``column``: population z-score beyond the threshold."""
    if not threshold > 0:
        raise ValueError("Threshold must be greater than 0")
    require_column(df, column, numeric=True)
    v = as_double(df, column)
    facts = df.agg(
        F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi")
    ).first()
    if facts["lo"] is None:
        raise ValueError("Column has no numeric values")
    if facts["lo"] == facts["hi"] or not facts["s"]:
        return F.lit(False)
    return F.abs((v - F.lit(facts["m"])) / F.lit(facts["s"])) > F.lit(float(threshold))


def outlier_rows(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """All rows whose value lies beyond the threshold."""
    return df.where(_z_filter(df, column, threshold))


def outliers(
    df: DataFrame,
    column: str,
    threshold: float = 3.0,
    order_by: Sequence[str] | None = None,
    k: int = OUTLIER_VALUES,
) -> tuple[DataFrame, DataFrame]:
    """(count, first ``k`` outlying values in the given order)."""
    found = outlier_rows(df, column, threshold)
    order = [ref(c) for c in (order_by or [column])]
    counted = found.agg(F.count(F.lit(1)).alias("outliers_count"))
    keep = list(dict.fromkeys([*(order_by or []), column]))
    listed = found.orderBy(*order).limit(k).select(*[ref(c) for c in keep])
    return counted, listed

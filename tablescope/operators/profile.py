"""Column profile, quality totals and target profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import (
    comparable,
    FRACTIONAL,
    column_aggregates,
    flat_columns,
    is_numeric,
    nan_to_null,
    per_column,
    percent,
    ref,
    settled,
)
from tablescope.functions.session import columnar

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("is_numeric", T.BooleanType()),
        T.StructField("rows_count", T.LongType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("distinct_count", T.LongType()),
        T.StructField("zero_count", T.LongType()),
        T.StructField("whole", T.BooleanType()),
        T.StructField("zero_one", T.BooleanType()),
    ]
)

#: Fixed role thresholds.
BINARY_DISTINCT = 2
ENCODED_DISTINCT = 15
CATEGORICAL_DISTINCT = 20
CATEGORICAL_SHARE = 0.05
HIGH_CARDINALITY_DISTINCT = 50
HIGH_CARDINALITY_SHARE = 0.2
#: Distinct counts at which a role rule switches.
ROLE_EDGES = (1, 2, 5, 15, 20, 50)
#: Fixed limits of the target rules.
TARGET_CLASSES = 20
TARGET_VALUES = 20
PROFILED_TARGETS = 10

#: Candidate duplicate groups that may be broadcast.
DUPLICATE_GROUPS = 1_000_000


def _whole(df: DataFrame, name: str, v: Column) -> tuple[Column, Column, Column]:
    """(is a whole number, is 0 or 1, is zero) for values ``v`` of a column."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, FRACTIONAL):
        return (v == F.rint(v)) & (F.abs(v) < float("inf")), v.isin(0.0, 1.0), v == 0
    if isinstance(data_type, T.DecimalType):
        return v == F.floor(v), v.isin(0, 1), v == 0
    if is_numeric(data_type):
        return F.lit(True), v.isin(0, 1), v == 0
    return F.lit(False), F.lit(False), F.lit(False)


def _exact_facts(df: DataFrame, names: Sequence[str]):
    """Every fact of a column from one pass over its counted values."""

    def branch(i: int, name: str) -> DataFrame:
        whole, zero_one, zero = _whole(df, name, F.col("v"))
        counted = df.select(ref(name).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        return counted.agg(
            F.lit(i).alias("ordinal"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_count"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
            F.count("v").alias("distinct_count"),
            F.coalesce(F.sum(F.when(zero, F.col("n"))), F.lit(0)).alias("zero_count"),
            F.coalesce(F.bool_and(F.when(F.col("v").isNotNull(), whole)), F.lit(False)).alias("whole"),
            F.coalesce(F.bool_and(F.when(F.col("v").isNotNull(), zero_one)), F.lit(False)).alias("zero_one"),
        )

    return [r.asDict() for r in per_column(names, branch)]


def _sketched_facts(df: DataFrame, names: Sequence[str]):
    """As above without any shuffle of values: distinct counts are estimates."""

    def make(name: str, v: Column) -> dict[str, Column]:
        whole, zero_one, zero = _whole(df, name, v)
        return {
            "rows_count": F.count(F.lit(1)),
            "missing_count": F.count_if(v.isNull()),
            # 4096 registers, 1.6 % standard error; a byte-array buffer of 4 KB per column
            "distinct_count": F.coalesce(
                F.hll_sketch_estimate(F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), 12)), F.lit(0)
            ),
            "zero_count": F.count_if(zero),
            "whole": F.coalesce(F.bool_and(F.when(v.isNotNull(), whole)), F.lit(False)),
            "zero_one": F.coalesce(F.bool_and(F.when(v.isNotNull(), zero_one)), F.lit(False)),
        }

    return [{"ordinal": i, **r} for i, r in enumerate(column_aggregates(df, names, make))]


def _near_an_edge(row, rows_count: int) -> bool:
    edges = [*ROLE_EDGES, rows_count * CATEGORICAL_SHARE, rows_count * HIGH_CARDINALITY_SHARE]
    return any(abs(row["distinct_count"] - e) <= max(2, 0.08 * e) for e in edges)


def column_profile(df: DataFrame, *, exact: bool = True) -> DataFrame:
    """One row per flat column: type, role, missing and distinct counts.

    The result is computed once and handed back as a small local frame, since
    all quality and modelling rules read it several times.  ``exact=False``
    estimates distinct counts and repeats exactly only the columns whose role
    could change.
    """
    frame = nan_to_null(df)
    names = flat_columns(frame)
    if not names:
        raise ValueError("The table has no columns to profile")
    with columnar(frame.select(*[ref(c) for c in names])) as held:
        facts = {r["ordinal"]: r for r in (_exact_facts if exact else _sketched_facts)(held, names)}
        if not exact:
            close = [names[o] for o, r in facts.items() if _near_an_edge(r, r["rows_count"])]
            for row in _exact_facts(held, close):
                ordinal = names.index(close[row["ordinal"]])
                facts[ordinal] = {**row, "ordinal": ordinal}
    rows = []
    for ordinal, name in enumerate(names):
        data_type = frame.schema[name].dataType
        f = facts[ordinal]
        rows.append(
            (ordinal, name, data_type.simpleString(), is_numeric(data_type), f["rows_count"],
             f["missing_count"], f["distinct_count"], f["zero_count"], f["whole"], f["zero_one"])
        )
    local = df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)
    # projections of a local frame need no job
    return local.select(
        "ordinal", "column_name", "dtype", "is_numeric", role().alias("role"), "rows_count",
        "missing_count", percent(F.col("missing_count"), F.col("rows_count")).alias("missing_percent"),
        "distinct_count", "zero_count",
    )


def role() -> Column:
    """Role of a column from its facts; the first matching rule wins."""
    distinct, rows = F.col("distinct_count"), F.col("rows_count")
    few = distinct <= F.greatest(F.lit(CATEGORICAL_DISTINCT), F.floor(rows * CATEGORICAL_SHARE))
    return (
        F.when(distinct <= 1, "constant")
        .when(F.col("is_numeric") & (distinct <= BINARY_DISTINCT) & F.col("zero_one"), "binary")
        .when(F.col("is_numeric") & (distinct <= ENCODED_DISTINCT) & F.col("whole"), "categorical_encoded")
        .when(F.col("is_numeric"), "continuous")
        .when(few, "categorical")
        .otherwise("text")
    )


def is_high_cardinality() -> Column:
    """Text column with too many different values to be a category."""
    limit = F.greatest(F.lit(float(HIGH_CARDINALITY_DISTINCT)), F.col("rows_count") * HIGH_CARDINALITY_SHARE)
    return (F.col("role") == "text") & (F.col("distinct_count") > limit)


def high_cardinality_text(profile: DataFrame) -> DataFrame:
    return profile.where(is_high_cardinality()).select("column_name", "distinct_count").orderBy("ordinal")


def names_where(profile: DataFrame, condition: Column) -> list[str]:
    """Column names of a profile subset, in table order."""
    rows = profile.where(condition).select("ordinal", "column_name").collect()
    return [r["column_name"] for r in sorted(rows)]


def duplicate_count(df: DataFrame, *, broadcast_groups: int = DUPLICATE_GROUPS) -> int:
    """Number of rows that repeat an earlier row in every column.

    Only a 64-bit digest per row is shuffled at first.  Rows whose digest is
    unique are certainly unique; the others are compared in full, by semi-join
    when the candidate digests are few enough to broadcast.
    """
    repeated = repeated_digests(df).persist()
    try:
        return count_copies(df, repeated, repeated.count(), broadcast_groups=broadcast_groups)
    finally:
        repeated.unpersist()


def row_digest(df: DataFrame) -> Column:
    """64-bit digest of a row without NaN; equal rows have equal digests."""
    return F.xxhash64(*comparable(df))


def repeated_digests(df: DataFrame) -> DataFrame:
    """Digests that more than one row has."""
    frame = nan_to_null(df)
    counted = frame.select(row_digest(frame).alias("_row_digest")).groupBy("_row_digest").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").select("_row_digest")


def count_copies(df: DataFrame, repeated: DataFrame, groups: int, *, broadcast_groups: int = DUPLICATE_GROUPS) -> int:
    """Rows that repeat an earlier one, from rows with a repeated digest compared in full."""
    if groups == 0:
        return 0
    frame = nan_to_null(df)
    if groups <= broadcast_groups:
        frame = frame.join(F.broadcast(repeated), row_digest(frame) == F.col("_row_digest"), "left_semi")
    copies = frame.select(*comparable(frame)).groupBy(*[ref(n) for n in frame.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("d")).first()["d"]


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(duplicate_count(df),)], "duplicate_rows bigint")


def quality_totals(df: DataFrame, profile: DataFrame, *, duplicates: int | None = None) -> DataFrame:
    """One row: missing cells and duplicate rows with their shares."""
    found = duplicate_count(df) if duplicates is None else duplicates
    base = profile.agg(
        F.max("rows_count").alias("rows_count"),
        F.count(F.lit(1)).alias("columns_count"),
        F.sum("missing_count").alias("missing_total"),
    )
    return settled(
        base.select(
            "rows_count",
            "columns_count",
            "missing_total",
            percent(F.col("missing_total"), F.col("rows_count") * F.col("columns_count")).alias("missing_percent"),
            F.lit(found).cast("bigint").alias("duplicate_rows"),
            percent(F.lit(found), F.col("rows_count")).alias("duplicate_percent"),
        )
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Missing cells per column, most affected first; one scan, no shuffle of rows."""
    frame = nan_to_null(df)
    names = frame.columns

    facts = column_aggregates(
        frame, names, lambda _, v: {"m": F.count_if(v.isNull()), "n": F.count(F.lit(1))}
    )
    rows = [(i, names[i], r["m"], r["n"]) for i, r in enumerate(facts)]
    local = df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, missing_count bigint, n bigint")
    return local.select(
        "ordinal", "column_name", "missing_count", percent(F.col("missing_count"), F.col("n")).alias("missing_percent")
    ).orderBy(F.desc("missing_count"), "ordinal")


def top_missing(missing: DataFrame, n: int = 12) -> DataFrame:
    return missing.where("missing_count > 0").orderBy(F.desc("missing_count"), "ordinal").limit(n)


def target_suggestions(profile: DataFrame) -> DataFrame:
    """Likely class targets: binary columns first, then fewest classes."""
    limit = F.least(F.lit(TARGET_CLASSES), F.greatest(F.lit(3), F.floor(F.col("rows_count") / 5)))
    usable = F.col("role").isin("binary", "categorical_encoded", "categorical")
    found = profile.where(usable & F.col("distinct_count").between(2, limit)).collect()
    found.sort(
        key=lambda r: (r["role"] != "binary", r["distinct_count"], r["column_name"].lower(), r["ordinal"])
    )
    rows = [(i + 1, r["column_name"], r["role"], r["distinct_count"]) for i, r in enumerate(found)]
    schema = "position int, column_name string, role string, distinct_count bigint"
    return profile.sparkSession.createDataFrame(rows, schema)


def suggested_targets(profile: DataFrame) -> list[str]:
    return [r["column_name"] for r in sorted(target_suggestions(profile).collect())]


def target_profiles(
    df: DataFrame, profile: DataFrame, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(summary, values) of the suggested targets or of the given columns."""
    spark = df.sparkSession
    names = list(columns) if columns is not None else suggested_targets(profile)[:PROFILED_TARGETS]
    frame = nan_to_null(df)

    def branch(i: int, name: str) -> DataFrame:
        counted = (
            frame.select(ref(name).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        )
        top = counted.orderBy(F.desc("n"), "v").limit(TARGET_VALUES)
        return top.select(F.lit(i).alias("i"), F.col("v").cast("string").alias("value"), "n")

    rows = [(names[r["i"]], r["i"] + 1, r["value"], r["n"]) for r in per_column(names, branch)] if names else []
    schema = "column_name string, position int, value string, value_count bigint"
    facts = profile.select(
        "column_name",
        "rows_count",
        (F.col("rows_count") - F.col("missing_count")).alias("non_missing_rows"),
        F.col("distinct_count").alias("classes_count"),
    )
    counted = spark.createDataFrame(rows, schema).join(facts, "column_name")
    values = counted.select(
        "column_name", "position", "value", "value_count",
        percent(F.col("value_count"), F.col("non_missing_rows")).alias("percent"),
    )
    summary = counted.groupBy("column_name", "position").agg(
        F.first("non_missing_rows").alias("non_missing_rows"),
        F.first("classes_count").alias("classes_count"),
        F.coalesce(F.round(F.try_divide(F.max("value_count"), F.min("value_count")), 4), F.lit(0.0)).alias(
            "imbalance_ratio"
        ),
        percent(F.first("non_missing_rows"), F.first("rows_count")).alias("coverage_percent"),
    )
    return settled(summary), values

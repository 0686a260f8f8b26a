"""Quality warnings, cleaning recommendations and the cleaning plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.columns import nan_to_null, per_column, percent, ref
from tablescope.functions.session import columnar
from tablescope.operators.profile import (
    column_profile,
    high_cardinality_text,
    is_high_cardinality,
    names_where,
    quality_totals,
    suggested_targets,
    target_profiles,
)
from tablescope.operators.ranks import exact_quantiles

#: Fixed thresholds of the warning rules.
MISSING_WARNING_PERCENT = 5
DUPLICATE_WARNING_PERCENT = 2
IMBALANCE_RATIO = 5
LISTED_COLUMNS = 10
#: Fixed limits of the class-source lists.
CLASS_SOURCE_DISTINCT = 5
CLASS_SOURCE_VALUES = 12

MESSAGES = {
    "missing_values": "Cells are missing; check why before modelling.",
    "duplicate_rows": "Complete copies of rows can distort statistics and training.",
    "constant_columns": "Columns with a single value carry no information.",
    "encoded_categories": "Numeric codes may stand for classes; describe them in the dictionary.",
    "high_cardinality_text": "Mostly unique text, often an identifier; set its role or leave it out.",
    "no_target": "No obvious class column was found; choose a target by hand.",
    "class_imbalance": "One class dominates; prefer balanced accuracy and macro F1.",
    "zero_values": "Zeros may be real values or hidden gaps; decide per column.",
    "ok": "No critical quality problem was found.",
}


def _first_names(condition: Column, order: str = "ordinal") -> Column:
    """Comma-joined names of the first rows meeting a condition."""
    listed = F.sort_array(F.collect_list(F.when(condition, F.struct(order, "column_name"))))
    return F.array_join(F.slice(listed, 1, LISTED_COLUMNS)["column_name"], ",")


def _rule(code: str, level: Column, holds: Column, columns=None, affected=None, share=None) -> Column:
    return F.when(
        holds,
        F.struct(
            F.lit(code).alias("code"),
            level.alias("level"),
            (F.lit("") if columns is None else columns).alias("columns"),
            (F.lit(0) if affected is None else affected).cast("bigint").alias("affected"),
            (F.lit(0.0) if share is None else share).cast("double").alias("percent"),
            F.lit(MESSAGES[code]).alias("message"),
        ),
    )


def _fired(facts: DataFrame, rules: list[Column]) -> DataFrame:
    """Rules that hold, in rule order; a single ``ok`` row when none does."""
    fired = F.filter(F.array(*rules), lambda r: r.isNotNull())
    fallback = F.array(_rule("ok", F.lit("ok"), F.lit(True)))
    return facts.select(
        F.posexplode(F.when(F.size(fired) > 0, fired).otherwise(fallback)).alias("position", "rule")
    ).select((F.col("position") + 1).alias("position"), "rule.*")


def _facts(profile: DataFrame, totals: DataFrame, targets: int, imbalanced: list[str], zeros: list[str]) -> DataFrame:
    constant, encoded = F.col("role") == "constant", F.col("role") == "categorical_encoded"
    t = totals.first()
    return profile.agg(
        _first_names(constant).alias("constant_columns"),
        F.count_if(constant).alias("constant_count"),
        _first_names(encoded).alias("encoded_columns"),
        F.count_if(encoded).alias("encoded_count"),
        _first_names(is_high_cardinality()).alias("wide_text_columns"),
        F.count_if(is_high_cardinality()).alias("wide_text_count"),
    ).withColumns(
        {
            "missing_total": F.lit(t["missing_total"]),
            "missing_percent": F.lit(t["missing_percent"]),
            "duplicate_rows": F.lit(t["duplicate_rows"]),
            "duplicate_percent": F.lit(t["duplicate_percent"]),
            "targets": F.lit(targets),
            "imbalanced_columns": F.lit(",".join(imbalanced[:LISTED_COLUMNS])),
            "imbalanced_count": F.lit(len(imbalanced)),
            "zero_columns": F.lit(",".join(zeros[:LISTED_COLUMNS])),
            "zero_column_count": F.lit(len(zeros)),
        }
    )


def quality_warnings(profile: DataFrame, totals: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows ``position, code, level, columns, affected, percent, message``.

    ``targets`` is the summary frame of the profiled targets.
    """
    skewed = targets.where((F.col("classes_count") > 1) & (F.col("imbalance_ratio") >= IMBALANCE_RATIO))
    imbalanced = [r["column_name"] for r in sorted(skewed.collect(), key=lambda r: r["position"])]
    facts = _facts(profile, totals, len(suggested_targets(profile)), imbalanced, [])
    warn, info = F.lit("warning"), F.lit("info")
    missing_level = F.when(F.col("missing_percent") >= MISSING_WARNING_PERCENT, warn).otherwise(info)
    copies_level = F.when(F.col("duplicate_percent") >= DUPLICATE_WARNING_PERCENT, warn).otherwise(info)
    c = F.col
    return _fired(
        facts,
        [
            _rule("missing_values", missing_level, c("missing_total") > 0,
                  affected=c("missing_total"), share=c("missing_percent")),
            _rule("duplicate_rows", copies_level, c("duplicate_rows") > 0,
                  affected=c("duplicate_rows"), share=c("duplicate_percent")),
            _rule("constant_columns", warn, c("constant_count") > 0, c("constant_columns"), c("constant_count")),
            _rule("encoded_categories", info, c("encoded_count") > 0, c("encoded_columns"), c("encoded_count")),
            _rule("high_cardinality_text", info, c("wide_text_count") > 0, c("wide_text_columns"),
                  c("wide_text_count")),
            _rule("no_target", warn, c("targets") == 0),
            _rule("class_imbalance", warn, c("imbalanced_count") > 0, c("imbalanced_columns"),
                  c("imbalanced_count")),
        ],
    )


def zero_candidates(profile: DataFrame) -> DataFrame:
    """Non-binary numeric columns that hold zeros, most zeros first."""
    found = F.col("is_numeric") & (F.col("role") != "binary") & (F.col("zero_count") > 0)
    return (
        profile.where(found)
        .select("ordinal", "column_name", "zero_count",
                percent(F.col("zero_count"), F.col("rows_count")).alias("zero_percent"))
        .orderBy(F.desc("zero_count"), "ordinal")
    )


def zero_columns(profile: DataFrame) -> list[str]:
    found = F.col("is_numeric") & (F.col("role") != "binary") & (F.col("zero_count") > 0)
    rows = profile.where(found).collect()
    return [r["column_name"] for r in sorted(rows, key=lambda r: (-r["zero_count"], r["ordinal"]))]


def cleaning_recommendations(profile: DataFrame, totals: DataFrame) -> DataFrame:
    zeros = zero_columns(profile)
    facts = _facts(profile, totals, len(suggested_targets(profile)), [], zeros)
    warn, info, c = F.lit("warning"), F.lit("info"), F.col
    return _fired(
        facts,
        [
            _rule("missing_values", warn, c("missing_total") > 0,
                  affected=c("missing_total"), share=c("missing_percent")),
            _rule("duplicate_rows", warn, c("duplicate_rows") > 0,
                  affected=c("duplicate_rows"), share=c("duplicate_percent")),
            _rule("constant_columns", warn, c("constant_count") > 0, c("constant_columns"), c("constant_count")),
            _rule("high_cardinality_text", info, c("wide_text_count") > 0, c("wide_text_columns"),
                  c("wide_text_count")),
            _rule("zero_values", info, c("zero_column_count") > 0, c("zero_columns"), c("zero_column_count")),
            _rule("no_target", warn, c("targets") == 0),
        ],
    )


def numeric_class_sources(profile: DataFrame) -> DataFrame:
    """Numeric columns with enough different values to be cut into classes."""
    enough = F.col("is_numeric") & (F.col("distinct_count") >= CLASS_SOURCE_DISTINCT)
    return profile.where(enough).select("column_name", "distinct_count").orderBy("ordinal")


def class_sources(df: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, values): what a person needs to write class rules by hand.

    ``columns`` has the range and quartiles of numeric columns, ``values`` the
    most frequent values of every column with at least two of them.
    """
    spark = df.sparkSession
    frame = nan_to_null(df)
    usable = profile.where("distinct_count >= 2")
    rows = sorted(usable.collect())
    names = [r["column_name"] for r in rows]
    numeric = [r["column_name"] for r in rows if r["is_numeric"]]
    cuts = exact_quantiles(frame, {c: [0.0, 0.25, 0.5, 0.75, 1.0] for c in numeric})
    ranges = [(c, *cuts[c]) for c in numeric]
    schema = "column_name string, min double, q25 double, median double, q75 double, max double"
    columns = usable.drop("zero_count", "rows_count", "missing_percent").join(
        spark.createDataFrame(ranges, schema), "column_name", "left"
    )

    def branch(i: int, name: str) -> DataFrame:
        best = top_counts(frame, name, CLASS_SOURCE_VALUES)
        # at most CLASS_SOURCE_VALUES rows per column
        listed = F.sort_array(F.collect_list(F.struct((-F.col("value_count")).alias("k"), "v", "value")))
        pairs = F.transform(listed, lambda r: F.struct(r["value"].alias("value"), (-r["k"]).alias("n")))
        return best.agg(F.lit(i).alias("i"), pairs.alias("best"))

    found = [
        (names[r["i"]], position + 1, pair["value"], pair["n"])
        for r in per_column(names, branch)
        for position, pair in enumerate(r["best"])
    ]
    values = spark.createDataFrame(found, "column_name string, position int, value string, value_count bigint")
    return columns, values


def top_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """``v, value, value_count`` of the most frequent values, in no set order."""
    counted = (
        nan_to_null(df).select(ref(column).alias("v")).where("v is not null")
        .groupBy("v").agg(F.count(F.lit(1)).alias("value_count"))
    )
    return counted.orderBy(F.desc("value_count"), "v").limit(k).withColumn("value", F.col("v").cast("string"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent values of a column as text; among equals the smaller first."""
    # at most k rows are ranked here
    order = Window.orderBy(F.desc("value_count"), "v")
    return top_counts(df, column, k).select(F.row_number().over(order).alias("position"), "value", "value_count")


def drop_reasons(profile: DataFrame) -> DataFrame:
    """Why a column might be left out; its role when nothing speaks against it."""
    # fixed name pattern of service columns
    service = F.lower("column_name").rlike("id|identifier|street|address|url|email")
    reason = (
        F.when(F.col("role") == "constant", "constant")
        .when((F.col("role") == "text") & (F.col("distinct_count") > HIGH_CARDINALITY_TEXT_HINT), "many_text_values")
        .when(service, "looks_like_identifier")
        .otherwise(F.concat(F.lit("role:"), F.col("role")))
    )
    return profile.select("column_name", reason.alias("reason"))


#: Distinct text values from which the drop hint applies.
HIGH_CARDINALITY_TEXT_HINT = 50


def plan_summary(profile: DataFrame, totals: DataFrame) -> DataFrame:
    """One row counting the issues of each kind."""
    t = totals.first()
    zero = F.col("is_numeric") & (F.col("role") != "binary") & (F.col("zero_count") > 0)
    return profile.agg(
        F.max("rows_count").alias("rows_count"),
        F.count(F.lit(1)).alias("columns_count"),
        F.sum("missing_count").alias("missing_total"),
        F.lit(t["duplicate_rows"]).alias("duplicate_rows"),
        F.count_if(F.col("role") == "constant").alias("constant_columns"),
        F.count_if(is_high_cardinality()).alias("high_cardinality_columns"),
        F.count_if(zero).alias("zero_columns"),
    )


def cleaning_plan(df: DataFrame, profile: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything needed to decide how to clean a table."""
    with columnar(df) as held:
        found = column_profile(held) if profile is None else profile
        totals = quality_totals(held, found)
        columns, values = class_sources(held, found)
    return {
        "profile": found,
        "totals": totals,
        "summary": plan_summary(found, totals),
        "recommendations": cleaning_recommendations(found, totals),
        "zero_candidates": zero_candidates(found),
        "high_cardinality_text": high_cardinality_text(found),
        "constant_columns": found.where("role = 'constant'").select("column_name"),
        "numeric_class_sources": numeric_class_sources(found),
        "class_sources": columns,
        "class_source_values": values,
    }


def dataset_profile(df: DataFrame, *, exact: bool = True) -> dict[str, DataFrame]:
    """Column profile, totals, target profiles and warnings of one table."""
    with columnar(df) as held:
        profile = column_profile(held, exact=exact)
        totals = quality_totals(held, profile)
        summary, values = target_profiles(held, profile)
    return {
        "columns": profile,
        "totals": totals,
        "targets": summary,
        "target_values": values,
        "warnings": quality_warnings(profile, totals, summary),
    }


def constant_columns(profile: DataFrame) -> list[str]:
    return names_where(profile, F.col("role") == "constant")



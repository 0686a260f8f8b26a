"""Workflow status, recommended actions and the summary report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.catalog import dictionary_coverage
from tablescope.operators.features import profile_with_dictionary
from tablescope.operators.profile import suggested_targets
from tablescope.operators.quality import dataset_profile

#: Fixed action names found in the history.
QUALITY_ACTIONS = ("cleaning-plan", "cleaning-apply", "class-create")
EXPLORATION_ACTIONS = (
    "statistics",
    "histogram",
    "correlation",
    "correlation-matrix",
    "regression",
    "outliers",
    "target-correlation",
)
#: Fixed state keys.
STATE_KEYS = ("analysis/latest", "risk/latest", "modeling/latest", "report/latest")
LOW_COVERAGE_PERCENT = 30
REPORTED_TARGETS = 5


def workflow_status(profile: DataFrame, dictionary: DataFrame, history: DataFrame, states: DataFrame) -> DataFrame:
    """Seven rows ``step, name, status`` for the current dataset.

    ``history`` and ``states`` hold the current dataset's rows; each is reduced
    to one row of flags before anything is combined.
    """

    def did(*actions: str) -> Column:
        return F.coalesce(F.bool_or(F.col("action").isin(*actions)), F.lit(False))

    def has(*keys: str) -> Column:
        return F.coalesce(F.bool_or(F.col("state_key").isin(*keys)), F.lit(False))

    done = history.agg(
        did(*QUALITY_ACTIONS).alias("quality"),
        did(*EXPLORATION_ACTIONS).alias("explored"),
        did("modeling-compare").alias("modelled"),
        did("summary-report").alias("reported"),
    ).first()
    saved = states.agg(
        has("analysis/latest", "risk/latest").alias("explored"),
        has("risk/latest", "modeling/latest").alias("targeted"),
        has("modeling/latest").alias("modelled"),
        has("report/latest").alias("reported"),
    ).first()
    both = profile_with_dictionary(profile, dictionary)
    documented = dictionary_coverage(profile, dictionary).first()["documented_columns"]
    target = both.agg(F.coalesce(F.bool_or(F.col("semantic_role") == "target"), F.lit(False)).alias("t")).first()["t"]
    steps = [
        ("dataset_loaded", True),
        ("quality_checked", done["quality"]),
        ("columns_described", bool(documented)),
        ("patterns_explored", done["explored"] or saved["explored"]),
        ("target_defined", target or saved["targeted"]),
        ("models_compared", done["modelled"] or saved["modelled"]),
        ("report_written", done["reported"] or saved["reported"]),
    ]
    rows = [(i + 1, name, "done" if ok else "pending") for i, (name, ok) in enumerate(steps)]
    return profile.sparkSession.createDataFrame(rows, "step int, name string, status string")


def recommended_actions(profile: DataFrame, warnings: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rows ``position, code, subject``."""
    facts = profile.agg(F.coalesce(F.bool_or(F.col("role") == "categorical_encoded"), F.lit(False)).alias("e")).first()
    alarmed = not warnings.where("level = 'warning'").isEmpty()
    targets = suggested_targets(profile)
    rows = []
    if alarmed:
        rows.append(("review_warnings", ""))
    rows.append(("start_with_target", targets[0]) if targets else ("define_target", ""))
    if coverage.first()["percent"] < LOW_COVERAGE_PERCENT:
        rows.append(("describe_columns", ""))
    if facts["e"]:
        rows.append(("check_encoded_categories", ""))
    rows += [("compare_pearson_and_spearman", ""), ("compare_models", "")]
    local = [(i + 1, *r) for i, r in enumerate(rows)]
    return profile.sparkSession.createDataFrame(local, "position int, code string, subject string")


def target_summaries(summary: DataFrame, values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Class values of the first targets with the descriptions given to them."""
    first = summary.where(F.col("position") <= REPORTED_TARGETS).select("column_name", "position")
    # one row per described class of the reported targets
    mine = dictionary.join(first.select("column_name"), "column_name", "left_semi")
    texts = mine.select("column_name", F.explode("class_descriptions").alias("value", "class_description"))
    about = mine.select("column_name", "description")
    return (
        values.join(first.select("column_name"), "column_name", "left_semi")
        .join(texts, ["column_name", "value"], "left")
        .join(about, "column_name", "left")
        .select(
            "column_name", "position", "value", "value_count", "percent",
            F.coalesce("class_description", F.lit("")).alias("class_description"),
            F.coalesce("description", F.lit("")).alias("description"),
        )
    )


def report_overview(profile: DataFrame, coverage: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """One row with the headline numbers of a report."""
    percent = coverage.first()["percent"]
    overview = profile.agg(
        F.max("rows_count").alias("rows_count"),
        F.count(F.lit(1)).alias("columns_count"),
        F.count_if("is_numeric").alias("numeric_columns"),
        F.count_if(F.col("role").isin("categorical", "categorical_encoded")).alias("categorical_columns"),
    ).withColumn("coverage_percent", F.lit(percent))
    if sample is None:
        return overview
    s = sample.first()
    return overview.withColumns(
        {"mode": F.lit(s["mode"]), "source_rows": F.lit(s["source_rows"]), "sample_percent": F.lit(s["percent"])}
    )


def summary_report(
    df: DataFrame,
    dictionary: DataFrame,
    history: DataFrame,
    states: DataFrame,
    *,
    sample: DataFrame | None = None,
    latest_model: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All report sections; the table is profiled once."""
    found = dataset_profile(df)
    coverage = dictionary_coverage(found["columns"], dictionary)
    report = {
        "overview": report_overview(found["columns"], coverage, sample),
        "workflow": workflow_status(found["columns"], dictionary, history, states),
        "quality_warnings": found["warnings"],
        "recommended_actions": recommended_actions(found["columns"], found["warnings"], coverage),
        "target_summaries": target_summaries(found["targets"], found["target_values"], dictionary),
        "coverage": coverage,
    }
    if sample is not None:
        report["sample"] = sample
    if latest_model is not None:
        report["latest_model"] = latest_model
    return report

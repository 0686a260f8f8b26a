"""Column dictionary, action history and saved states as DataFrames.

Dictionary columns: ``username, column_name, description, semantic_role,
class_descriptions MAP<STRING,STRING>, source_column, updated_at``.
History columns: ``username, action, payload (JSON), created_at``.
State columns: ``username, state_key, payload (JSON), updated_at``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import percent, ref, stripped, top_n_per_group
from tablescope.operators.features import profile_with_dictionary

#: Fixed list of roles a user may give to a column.
SEMANTIC_ROLES = ("unspecified", "feature", "target", "identifier", "ignore", "sensitive", "group")
#: Fixed text limits, in characters.
DESCRIPTION_LENGTH = 1500
CLASS_KEY_LENGTH = 120
CLASS_TEXT_LENGTH = 500
HISTORY_ITEMS = 100

DICTIONARY_SCHEMA = (
    "username string, column_name string, description string, semantic_role string, "
    "class_descriptions map<string,string>, source_column string, updated_at timestamp"
)


def _cut(text: Column, length: int) -> Column:
    return F.substring(stripped(text), 1, length)


def normalise_dictionary(entries: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) entries: trimmed, shortened and checked.

    ``rejected`` keeps the entry and adds the first ``reason``.
    """
    classes = F.coalesce("class_descriptions", F.create_map().cast("map<string,string>"))
    pairs = F.transform(
        F.map_entries(classes),
        lambda e: F.struct(_cut(e["key"], CLASS_KEY_LENGTH).alias("key"), _cut(e["value"], CLASS_TEXT_LENGTH).alias("value")),
    )
    kept = F.filter(pairs, lambda e: (e["key"] != "") & (F.coalesce(e["value"], F.lit("")) != ""))
    # keys that become equal after trimming keep the last text
    unique = F.aggregate(
        kept, F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])),
    )
    tidy = entries.withColumns(
        {
            "column_name": stripped(F.col("column_name")),
            "description": _cut(F.coalesce("description", F.lit("")), DESCRIPTION_LENGTH),
            "semantic_role": F.lower(stripped(F.coalesce("semantic_role", F.lit("unspecified")))),
            "source_column": stripped(F.coalesce("source_column", F.lit(""))),
            "class_descriptions": unique,
        }
    )
    known = list(columns)
    reason = (
        F.when(~F.col("column_name").isin(known), "unknown_column")
        .when(~F.col("semantic_role").isin(*SEMANTIC_ROLES), "unknown_role")
        .when((F.col("source_column") != "") & ~F.col("source_column").isin(known), "unknown_source_column")
        .when(F.col("source_column") == F.col("column_name"), "source_is_the_column_itself")
    )
    checked = tidy.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last written row of every key; an aggregate, so hot keys fold early."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*[ref(c) for c in rest]), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def upsert_dictionary(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("username", "column_name")) -> DataFrame:
    """Entries of ``new`` replace older ones of the same column."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(both, list(keys), [F.col("_new"), F.col("updated_at")]).drop("_new")


def prune_dictionary(dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without entries for columns the table no longer has."""
    names = dictionary.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return dictionary.join(names, "column_name", "left_semi")


def dictionary_coverage(profile: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row: how many columns have any description."""
    described = (
        (F.col("description") != "")
        | ~F.col("semantic_role").isin("", "unspecified")
        | (F.col("classes_described") > 0)
    )
    counted = profile_with_dictionary(profile, dictionary).agg(
        F.count_if(described).alias("documented_columns"), F.count(F.lit(1)).alias("columns_count")
    )
    return counted.withColumn("percent", percent(F.col("documented_columns"), F.col("columns_count")))


def payload_dataset(payload: Column, path: str = "$.dataset_id") -> Column:
    return F.get_json_object(payload, path)


def latest_history(
    history: DataFrame, n: int = HISTORY_ITEMS, *, user: str = "username", order: Sequence[str] = ("created_at",)
) -> DataFrame:
    """Newest ``n`` rows of every user with their ``position``."""
    return top_n_per_group(history, [user], [ref(c).desc() for c in order], n)


def current_history(
    history: DataFrame, dataset_id: str, n: int = HISTORY_ITEMS, *, payload: str = "payload",
    path: str = "$.dataset_id", **options,
) -> DataFrame:
    """Newest ``n`` rows first, then only those of the current dataset."""
    newest = latest_history(history, n, **options)
    return newest.where(payload_dataset(ref(payload), path) == dataset_id)


def latest_states(
    states: DataFrame, keys: Sequence[str] = ("username", "state_key"), order: Sequence[str] = ("updated_at",)
) -> DataFrame:
    return latest_per_key(states, list(keys), [ref(c) for c in order])


def current_states(
    states: DataFrame, dataset_id: str, *, payload: str = "payload", path: str = "$.dataset_id", **options
) -> DataFrame:
    """Latest state per key, hidden when it belongs to another dataset."""
    return latest_states(states, **options).where(payload_dataset(ref(payload), path) == dataset_id)

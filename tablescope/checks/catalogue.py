"""Queries over the column dictionary, the action log, states and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.checks import inputs as inp
from tablescope.checks.inputs import (
    DICTIONARY,
    DIRTY_COLUMNS,
    DIRTY_PROFILE,
    HIGH_CARDINALITY,
    HISTORY,
    STATES,
    SUGGESTED,
    TOTALS,
    dirty,
    table,
)
from tablescope.functions.columns import union_all
from tablescope.checks.profiling import WARNING_RULES, target_values_sql
from tablescope.checks.registry import query
from tablescope.operators import catalog, features, profile, quality
from tablescope.operators.profile import column_profile
from tablescope.plans import report
from tablescope.sources.rows import limit_rows, sample_info

# -- dictionary -----------------------------------------------------------------


@query(
    "profile_with_dictionary",
    f"""WITH {DIRTY_PROFILE}, {DICTIONARY}
SELECT column_name, role, distinct_count::BIGINT AS distinct_count, description, semantic_role, source_column,
  classes_described::BIGINT AS classes_described FROM described""",
)
def _profile_with_dictionary(spark, sf):
    joined = features.profile_with_dictionary(column_profile(dirty(spark, sf)), inp.dictionary(spark))
    return joined.select(
        "column_name", "role", "distinct_count", "description", "semantic_role", "source_column", "classes_described"
    )


@query(
    "metadata_coverage",
    f"""WITH {DIRTY_PROFILE}, {DICTIONARY}, c AS (
  SELECT count(*) FILTER (description <> '' OR semantic_role NOT IN ('', 'unspecified') OR classes_described > 0) AS d,
         count(*) AS n FROM described)
SELECT d::BIGINT AS documented_columns, n::BIGINT AS columns_count, round(d::DOUBLE / n * 100, 4) AS percent FROM c""",
)
def _metadata_coverage(spark, sf):
    return catalog.dictionary_coverage(column_profile(dirty(spark, sf)), inp.dictionary(spark))


NAMES = ["l_tax", "l_discount", "l_quantity"]
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def _entries(spark, sf):
    """Dictionary entries written from documents, some of them invalid."""
    c = F.col
    pick = F.array(F.lit("l_tax"), F.lit(" l_discount "), F.lit("l_quantity"), F.lit("l_gone"))
    roles = F.array(F.lit("Feature"), F.lit("target "), F.lit("nonsense"), F.lit(None), F.lit("group"))
    sources = F.array(F.lit(""), F.lit("l_tax"), F.lit("l_lost"))
    at = lambda values, n: values[(c("doc_id") % n).cast("int")]
    return table(spark, sf, "documents").select(
        "doc_id", F.lit("ann").alias("username"), at(pick, 4).alias("column_name"),
        F.concat(F.lit("  \n"), c("text"), F.lit(" ")).alias("description"), at(roles, 5).alias("semantic_role"),
        F.create_map(F.concat(F.lit(" "), c("lang")), c("text"), F.lit("x"), F.lit("  "), F.lit("y"), c("source"))
        .alias("class_descriptions"),
        at(sources, 3).alias("source_column"), F.timestamp_seconds("doc_id").alias("updated_at"),
    )


ENTRIES = f"""raw AS (
  SELECT doc_id, trim((['l_tax', ' l_discount ', 'l_quantity', 'l_gone'])[doc_id % 4 + 1]) AS column_name,
    substring(trim('  ' || chr(10) || text || ' ', {BLANKS}), 1, 1500) AS description,
    coalesce(lower(trim((['Feature', 'target ', 'nonsense', NULL, 'group'])[doc_id % 5 + 1])), 'unspecified') AS semantic_role,
    (['', 'l_tax', 'l_lost'])[doc_id % 3 + 1] AS source_column,
    lang, substring(trim(text, {BLANKS}), 1, 500) AS lang_text, source FROM documents),
checked AS (
  SELECT *, CASE WHEN column_name NOT IN ('l_tax', 'l_discount', 'l_quantity') THEN 'unknown_column'
    WHEN semantic_role NOT IN ('unspecified', 'feature', 'target', 'identifier', 'ignore', 'sensitive', 'group') THEN 'unknown_role'
    WHEN source_column NOT IN ('', 'l_tax', 'l_discount', 'l_quantity') THEN 'unknown_source_column'
    WHEN source_column = column_name THEN 'source_is_the_column_itself' END AS reason FROM raw)"""


@query(
    "dictionary_normalise",
    f"""WITH {ENTRIES}
SELECT doc_id, column_name, md5(description) AS description, semantic_role, source_column,
  CASE WHEN lang_text <> '' THEN 2 ELSE 1 END::BIGINT AS classes, md5(nullif(lang_text, '')) AS lang_text,
  source AS y_text FROM checked WHERE reason IS NULL""",
)
def _dictionary_normalise(spark, sf):
    accepted, _ = catalog.normalise_dictionary(_entries(spark, sf), NAMES)
    texts = F.col("class_descriptions")
    lang = F.filter(F.map_keys(texts), lambda k: k != "y")
    return accepted.select(
        "doc_id", "column_name", F.md5("description").alias("description"), "semantic_role", "source_column",
        F.size(texts).alias("classes"), F.md5(F.try_element_at(texts, F.get(lang, 0))).alias("lang_text"),
        F.try_element_at(texts, F.lit("y")).alias("y_text"),
    )


@query("dictionary_rejected", f"WITH {ENTRIES} SELECT doc_id, reason FROM checked WHERE reason IS NOT NULL")
def _dictionary_rejected(spark, sf):
    return catalog.normalise_dictionary(_entries(spark, sf), NAMES)[1].select("doc_id", "reason")


@query(
    "dictionary_upsert",
    """SELECT username, column_name, doc_id FROM (
  SELECT source AS username, lang AS column_name, doc_id,
    row_number() OVER (PARTITION BY source, lang ORDER BY doc_id % 2 DESC, doc_id DESC) AS rn FROM documents) WHERE rn = 1""",
)
def _dictionary_upsert(spark, sf):
    entries = table(spark, sf, "documents").select(
        F.col("source").alias("username"), F.col("lang").alias("column_name"), "doc_id",
        F.timestamp_seconds("doc_id").alias("updated_at"),
    )
    old, new = entries.where("doc_id % 2 = 0"), entries.where("doc_id % 2 = 1")
    return catalog.upsert_dictionary(old, new).select("username", "column_name", "doc_id")


@query(
    "dictionary_prune",
    "SELECT p_partkey, p_brand AS column_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#7', 'Brand#25')",
)
def _dictionary_prune(spark, sf):
    entries = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("column_name"))
    pruned = catalog.prune_dictionary(entries, ["Brand#1", "Brand#7", "Brand#25", "Brand#999"])
    return pruned.select("p_partkey", "column_name")


@query(
    "target_summaries",
    f"""WITH {DIRTY_PROFILE}, {DICTIONARY}, {SUGGESTED}, {target_values_sql([c for c, _ in DIRTY_COLUMNS])}
SELECT v.column_name, v.value, v.value_count::BIGINT AS value_count, v.percent::DOUBLE AS percent,
  coalesce(t.class_description, '') AS class_description, coalesce(d.description, '') AS description
FROM target_values v JOIN suggested s ON v.column_name = s.column_name AND s.position <= 5
LEFT JOIN class_texts t ON t.column_name = v.column_name AND t.value = v.value
LEFT JOIN dictionary d ON d.column_name = v.column_name""",
)
def _target_summaries(spark, sf):
    df = dirty(spark, sf)
    summary, values = profile.target_profiles(df, column_profile(df))
    return report.target_summaries(summary, values, inp.dictionary(spark)).drop("position")


# -- history and states ---------------------------------------------------------


@query(
    "history_latest",
    f"""WITH {HISTORY} SELECT * FROM (SELECT event_id, username, action, row_number() OVER (
  PARTITION BY username ORDER BY created_at DESC, event_id DESC)::BIGINT AS position FROM history) WHERE position <= 100""",
)
def _history_latest(spark, sf):
    newest = catalog.latest_history(inp.history(spark, sf), order=["created_at", "event_id"])
    return newest.select("event_id", "username", "action", "position")


@query(
    "history_current_dataset",
    f"""WITH {HISTORY} SELECT event_id, username, position FROM (SELECT event_id, username, payload, row_number() OVER (
  PARTITION BY username ORDER BY created_at DESC, event_id DESC)::BIGINT AS position FROM history)
WHERE position <= 40 AND json_extract_string(payload, '$.k') = '9'""",
)
def _history_current_dataset(spark, sf):
    found = catalog.current_history(inp.history(spark, sf), "9", 40, path="$.k", order=["created_at", "event_id"])
    return found.select("event_id", "username", "position")


LATEST = f"""{STATES}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY username, state_key ORDER BY updated_at DESC, event_id DESC) AS rn FROM states) WHERE rn = 1)"""


@query("state_latest", f"WITH {LATEST} SELECT username, state_key, event_id, payload FROM latest")
def _state_latest(spark, sf):
    found = catalog.latest_states(inp.states(spark, sf), order=["updated_at", "event_id"])
    return found.select("username", "state_key", "event_id", "payload")


@query(
    "state_invalidation",
    f"""WITH {LATEST} SELECT username, state_key, event_id FROM latest
WHERE json_extract_string(payload, '$.k') IN ('9', '1', '4')""",
)
def _state_invalidation(spark, sf):
    states = inp.states(spark, sf)
    found = None
    for dataset in ("9", "1", "4"):
        part = catalog.current_states(states, dataset, path="$.k", order=["updated_at", "event_id"])
        part = part.select("username", "state_key", "event_id")
        found = part if found is None else found.unionByName(part)
    return found


@query("payload_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _payload_json(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", catalog.payload_dataset(F.col("props"), "$.k").alias("k"))


# -- report ---------------------------------------------------------------------

CURRENT = f"""{HISTORY}, {LATEST}, recent AS (SELECT action FROM (SELECT *, row_number() OVER (
  PARTITION BY username ORDER BY created_at DESC, event_id DESC) AS position FROM history)
  WHERE position <= 100 AND json_extract_string(payload, '$.k') = '9'),
saved AS (SELECT state_key FROM latest WHERE json_extract_string(payload, '$.k') = '9')"""


@query(
    "workflow_status",
    f"""WITH {DIRTY_PROFILE}, {DICTIONARY}, {CURRENT}, done(step, name, ok) AS (
  SELECT 1, 'dataset_loaded', true
  UNION ALL SELECT 2, 'quality_checked', EXISTS (FROM recent WHERE action IN ('cleaning-plan', 'cleaning-apply', 'class-create'))
  UNION ALL SELECT 3, 'columns_described', EXISTS (FROM described WHERE description <> '' OR semantic_role <> 'unspecified' OR classes_described > 0)
  UNION ALL SELECT 4, 'patterns_explored', EXISTS (FROM saved WHERE state_key IN ('analysis/latest', 'risk/latest'))
    OR EXISTS (FROM recent WHERE action IN ('statistics', 'histogram', 'correlation', 'correlation-matrix', 'regression', 'outliers', 'target-correlation'))
  UNION ALL SELECT 5, 'target_defined', EXISTS (FROM described WHERE semantic_role = 'target')
    OR EXISTS (FROM saved WHERE state_key IN ('risk/latest', 'modeling/latest'))
  UNION ALL SELECT 6, 'models_compared', EXISTS (FROM saved WHERE state_key = 'modeling/latest') OR EXISTS (FROM recent WHERE action = 'modeling-compare')
  UNION ALL SELECT 7, 'report_written', EXISTS (FROM saved WHERE state_key = 'report/latest') OR EXISTS (FROM recent WHERE action = 'summary-report'))
SELECT step::BIGINT AS step, name, CASE WHEN ok THEN 'done' ELSE 'pending' END AS status FROM done""",
)
def _workflow_status(spark, sf):
    order = ["created_at", "event_id"]
    recent = catalog.current_history(inp.history(spark, sf), "9", path="$.k", order=order)
    saved = catalog.current_states(inp.states(spark, sf), "9", path="$.k", order=["updated_at", "event_id"])
    return report.workflow_status(column_profile(dirty(spark, sf)), inp.dictionary(spark), recent, saved)


@query(
    "recommended_actions",
    f"""WITH {DIRTY_PROFILE}, {DICTIONARY}, {TOTALS}, {SUGGESTED}, {WARNING_RULES}, all_actions(i, code, subject, holds) AS (
  SELECT 1, 'review_warnings', '', EXISTS (FROM rules WHERE holds AND level = 'warning')
  UNION ALL SELECT 2, 'start_with_target', coalesce((SELECT column_name FROM suggested WHERE position = 1), ''), EXISTS (FROM suggested)
  UNION ALL SELECT 3, 'define_target', '', NOT EXISTS (FROM suggested)
  UNION ALL SELECT 4, 'describe_columns', '', (SELECT count(*) FILTER (description <> '' OR semantic_role <> 'unspecified' OR classes_described > 0)
    ::DOUBLE / count(*) * 100 FROM described) < 30
  UNION ALL SELECT 5, 'check_encoded_categories', '', EXISTS (FROM profile WHERE role = 'categorical_encoded')
  UNION ALL SELECT 6, 'compare_pearson_and_spearman', '', true UNION ALL SELECT 7, 'compare_models', '', true)
SELECT row_number() OVER (ORDER BY i)::BIGINT AS position, code, subject FROM all_actions WHERE holds""",
)
def _recommended_actions(spark, sf):
    df = dirty(spark, sf)
    found = quality.dataset_profile(df)
    coverage = catalog.dictionary_coverage(found["columns"], inp.dictionary(spark))
    return report.recommended_actions(found["columns"], found["warnings"], coverage)


@query(
    "report_overview",
    f"""WITH {DIRTY_PROFILE}, {DICTIONARY}, n AS (SELECT count(*) AS source_rows, least(5000, count(*)) AS rows FROM dirty)
SELECT max(rows_count)::BIGINT AS rows_count, count(*)::BIGINT AS columns_count, count(*) FILTER (is_numeric)::BIGINT AS numeric_columns,
  count(*) FILTER (role IN ('categorical', 'categorical_encoded'))::BIGINT AS categorical_columns,
  round(count(*) FILTER (description <> '' OR semantic_role <> 'unspecified' OR classes_described > 0)::DOUBLE / count(*) * 100, 4) AS coverage_percent,
  (SELECT CASE WHEN rows < source_rows THEN 'limited' ELSE 'full' END FROM n) AS mode,
  (SELECT source_rows FROM n)::BIGINT AS source_rows,
  (SELECT round(rows::DOUBLE / source_rows * 100, 4) FROM n) AS sample_percent FROM described""",
)
def _report_overview(spark, sf):
    df = dirty(spark, sf)
    found = column_profile(df)
    limited = limit_rows(df, 5000, ["l_orderkey", "l_linenumber"])
    coverage = catalog.dictionary_coverage(found, inp.dictionary(spark))
    return report.report_overview(found, coverage, sample_info(limited, df, 5000))


@query("summary_report")
def _summary_report(spark, sf):
    """All sections as rows; the sections' own queries have SQL."""
    order = ["created_at", "event_id"]
    recent = catalog.current_history(inp.history(spark, sf), "9", path="$.k", order=order)
    saved = catalog.current_states(inp.states(spark, sf), "9", path="$.k", order=["updated_at", "event_id"])
    sections = report.summary_report(dirty(spark, sf), inp.dictionary(spark), recent, saved)
    parts = [f.select(F.lit(n).alias("section"), F.to_json(F.struct("*")).alias("content")) for n, f in sections.items()]
    return union_all(parts)


# -- modelling choices ----------------------------------------------------------

CLASSES = "(role IN ('binary', 'categorical', 'categorical_encoded') AND distinct_count BETWEEN 2 AND 20)"
NUMBERS = "(role = 'continuous' AND distinct_count >= 5)"
HIDDEN = "(semantic_role IN ('identifier', 'ignore', 'sensitive'))"


@query(
    "task_support",
    f"""WITH {DIRTY_PROFILE} SELECT ordinal::BIGINT AS ordinal, column_name, role, {CLASSES} AS classification,
  {NUMBERS} AS regression FROM profile""",
)
def _task_support(spark, sf):
    return features.task_support(column_profile(dirty(spark, sf)))


OPTIONS = f"""options AS (SELECT ordinal, column_name,
    CASE WHEN {HIDDEN} THEN '' WHEN {CLASSES} THEN 'classification' WHEN {NUMBERS} THEN 'regression' ELSE '' END AS task_types,
    CASE WHEN {HIDDEN} THEN 'dictionary:' || semantic_role WHEN {CLASSES} THEN 'limited_classes'
         WHEN {NUMBERS} THEN 'continuous_values' WHEN role = 'text' THEN 'text_not_a_class'
         WHEN role = 'constant' THEN 'single_value' WHEN role = 'continuous' THEN 'needs_regression_or_classes'
         ELSE 'not_a_target' END AS reason FROM described)"""


@query(
    "target_options",
    f"""WITH {DIRTY_PROFILE}, {DICTIONARY}, {OPTIONS} SELECT ordinal::BIGINT AS ordinal, column_name, task_types,
  task_types <> '' AS recommended, reason FROM options""",
)
def _target_options(spark, sf):
    return features.target_options(column_profile(dirty(spark, sf)), inp.dictionary(spark))


def _feature_sql(target: str, source: str) -> str:
    return f"""chosen AS (SELECT ordinal, column_name, role, semantic_role, column_name = '{target}' AS locked,
    CASE WHEN column_name = '{target}' THEN 'target' WHEN column_name = '{source}' THEN 'source_of_target'
         WHEN {HIDDEN} THEN 'dictionary:' || semantic_role WHEN role = 'constant' THEN 'constant'
         WHEN {HIGH_CARDINALITY} THEN 'high_cardinality_text' ELSE 'used' END AS reason FROM described)"""


FEATURE_SQL = f"WITH {DIRTY_PROFILE}, {DICTIONARY}, {_feature_sql('l_returnflag', 'l_linestatus')}"


@query(
    "feature_options",
    f"""{FEATURE_SQL} SELECT ordinal::BIGINT AS ordinal, column_name, role, semantic_role, locked,
  reason = 'used' AS selected, reason FROM chosen""",
)
def _feature_options(spark, sf):
    return features.feature_options(column_profile(dirty(spark, sf)), inp.dictionary(spark), "l_returnflag")


@query(
    "selected_features",
    f"""{FEATURE_SQL} SELECT 'recommended' AS request, column_name FROM chosen WHERE reason = 'used'
UNION ALL SELECT 'own', column_name FROM chosen WHERE NOT locked AND column_name IN ('l_partkey', 'l_tax')""",
)
def _selected_features(spark, sf):
    found = column_profile(dirty(spark, sf))
    options = features.feature_options(found, inp.dictionary(spark), "l_returnflag")
    own = features.select_features(options, ["l_tax", "l_partkey", "l_returnflag", "nothing", "l_tax"])
    rows = [("recommended", c) for c in features.select_features(options)] + [("own", c) for c in own]
    return spark.createDataFrame(rows, "request string, column_name string")


@query(
    "infer_task",
    f"""WITH {DIRTY_PROFILE} SELECT column_name, CASE WHEN {CLASSES} THEN 'classification' WHEN {NUMBERS} THEN 'regression'
  ELSE 'none' END AS task FROM profile""",
)
def _infer_task(spark, sf):
    found = column_profile(dirty(spark, sf))

    def task(name: str) -> str:
        try:
            return features.infer_task(found, name)
        except ValueError:
            return "none"

    names = profile.names_where(found, F.lit(True))
    return spark.createDataFrame([(c, task(c)) for c in names], "column_name string, task string")


@query(
    "candidate_columns",
    f"""WITH {DIRTY_PROFILE}, {SUGGESTED}
SELECT 'ranking_target' AS purpose, column_name FROM suggested WHERE is_numeric
UNION ALL SELECT 'outliers', column_name FROM profile WHERE role = 'continuous'""",
)
def _candidate_columns(spark, sf):
    found = column_profile(dirty(spark, sf))
    rows = [("ranking_target", c) for c in features.ranking_targets(found)]
    rows += [("outliers", c) for c in features.outlier_columns(found)]
    return spark.createDataFrame(rows, "purpose string, column_name string")

"""Input tables of the registered queries, once for Spark and once as SQL.

The given tables have no missing values and no duplicates, so both engines
derive them from the whole table by the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.operators.catalog import DICTIONARY_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- lineitem with gaps, copies and a constant ----------------------------------

DIRTY_COLUMNS = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipday", "string"), ("constant", "int"),
    ("is_final", "int"),
]

DIRTY = """base AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         nullif(l_tax, 0) AS l_tax,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
         l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipday, 5 AS constant,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_final
  FROM lineitem),
dirty AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_orderkey % 10 = 0)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    base = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        F.when(c("l_tax") != 0, c("l_tax")).alias("l_tax"),
        F.when(c("l_orderkey") % 7 != 0, c("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipday"), F.lit(5).alias("constant"),
        F.when(c("l_linestatus") == "F", 1).otherwise(0).alias("is_final"),
    )
    return base.unionByName(base.where(c("l_orderkey") % 10 == 0))


CUSTOMER_COLUMNS = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
PART_COLUMNS = [
    ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
    ("p_size", "int"), ("p_retailprice", "double"),
]
LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "constant", "is_final",
]

# -- column profile in SQL ------------------------------------------------------


def facts_sql(source: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (name, dtype) in enumerate(columns):
        numeric = dtype != "string"
        zero = f"count(*) FILTER ({name} = 0)" if numeric else "0"
        whole = f"bool_and({name} = floor({name}))" if numeric else "false"
        binary = f"bool_and({name} IN (0, 1))" if numeric else "false"
        parts.append(
            f"SELECT {i} AS ordinal, '{name}' AS column_name, '{dtype}' AS dtype, {str(numeric).lower()} AS is_numeric, "
            f"count(*) AS rows_count, count(*) - count({name}) AS missing_count, "
            f"count(DISTINCT {name}) AS distinct_count, {zero} AS zero_count, {whole} AS whole, {binary} AS zero_one "
            f"FROM {source}"
        )
    return "\n  UNION ALL ".join(parts)


def profile_sql(source: str, columns: list[tuple[str, str]], name: str = "profile") -> str:
    """CTE ``<name>`` with the column profile of ``source``."""
    return f"""{name}_facts AS (
  {facts_sql(source, columns)}),
{name} AS (
  SELECT ordinal, column_name, dtype, is_numeric, rows_count, missing_count, distinct_count, zero_count,
    coalesce(round(missing_count::DOUBLE / nullif(rows_count, 0) * 100, 4), 0.0) AS missing_percent,
    CASE WHEN distinct_count <= 1 THEN 'constant'
         WHEN is_numeric AND distinct_count <= 2 AND zero_one THEN 'binary'
         WHEN is_numeric AND distinct_count <= 15 AND whole THEN 'categorical_encoded'
         WHEN is_numeric THEN 'continuous'
         WHEN distinct_count <= greatest(20, floor(rows_count * 0.05)) THEN 'categorical'
         ELSE 'text' END AS role
  FROM {name}_facts)"""


HIGH_CARDINALITY = "(role = 'text' AND distinct_count > greatest(50.0, rows_count * 0.2))"

DIRTY_PROFILE = DIRTY + ",\n" + profile_sql("dirty", DIRTY_COLUMNS)
CUSTOMER_PROFILE = profile_sql("customer", CUSTOMER_COLUMNS)

TOTALS = """totals AS (
  SELECT (SELECT max(rows_count) FROM profile) AS rows_count, (SELECT count(*) FROM profile) AS columns_count,
         (SELECT sum(missing_count) FROM profile) AS missing_total,
         (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows),
shares AS (
  SELECT *, round(missing_total::DOUBLE / (rows_count * columns_count) * 100, 4) AS missing_percent,
         round(duplicate_rows::DOUBLE / rows_count * 100, 4) AS duplicate_percent FROM totals)"""

SUGGESTED = """suggested AS (
  SELECT row_number() OVER (ORDER BY CASE WHEN role = 'binary' THEN 0 ELSE 1 END, distinct_count,
                            lower(column_name), ordinal) AS position, *
  FROM profile WHERE role IN ('binary', 'categorical_encoded', 'categorical')
    AND distinct_count BETWEEN 2 AND least(20, greatest(3, rows_count // 5)))"""

# -- a small column dictionary --------------------------------------------------

ENTRIES = [
    ("l_returnflag", "Return state", "target", "l_linestatus", {"A": "accepted", "N": "none", "R": "returned"}),
    ("l_orderkey", "", "identifier", "", {}),
    ("l_quantity", "Units sold", "unspecified", "", {}),
    ("l_partkey", "", "ignore", "", {}),
    ("is_final", "", "unspecified", "", {"0": "open", "1": "final"}),
    ("l_comment", "Not a column any more", "feature", "", {}),
]


def dictionary(spark: SparkSession) -> DataFrame:
    rows = [("ann", c, text, role, classes, source, None) for c, text, role, source, classes in ENTRIES]
    return spark.createDataFrame(rows, DICTIONARY_SCHEMA)


DICTIONARY = (
    "dictionary(column_name, description, semantic_role, source_column, classes_described) AS (VALUES "
    + ", ".join(f"('{c}', '{text}', '{role}', '{source}', {len(classes)})" for c, text, role, source, classes in ENTRIES)
    + "),\nclass_texts(column_name, value, class_description) AS (VALUES "
    + ", ".join(f"('{c}', '{k}', '{v}')" for c, _, _, _, classes in ENTRIES for k, v in classes.items())
    + """),
described AS (
  SELECT p.*, coalesce(d.description, '') AS description, coalesce(d.semantic_role, 'unspecified') AS semantic_role,
         coalesce(d.source_column, '') AS source_column, coalesce(d.classes_described, 0) AS classes_described
  FROM profile p LEFT JOIN dictionary d USING (column_name))"""
)


# -- events read as an action log ------------------------------------------------

ACTIONS = {
    "view": "statistics",
    "click": "cleaning-plan",
    "purchase": "modeling-compare",
    "error": "upload",
    "signup": "metadata-column",
}


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = F.create_map(*[F.lit(v) for pair in ACTIONS.items() for v in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("user_id").cast("string").alias("username"),
        actions[F.col("event_type")].alias("action"), F.col("props").alias("payload"), F.col("ts").alias("created_at"),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.when(F.col("event_type") == "view", "analysis/latest").when(
        F.col("event_type") == "click", "risk/latest"
    ).when(F.col("event_type") == "purchase", "modeling/latest").otherwise("report/latest")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("username"), keys.alias("state_key"),
        F.col("props").alias("payload"), F.col("ts").alias("updated_at"),
    )


HISTORY = (
    "history AS (SELECT event_id, user_id::VARCHAR AS username, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())
    + " END AS action, props AS payload, ts AS created_at FROM events)"
)
STATES = """states AS (
  SELECT event_id, user_id::VARCHAR AS username,
    CASE event_type WHEN 'view' THEN 'analysis/latest' WHEN 'click' THEN 'risk/latest'
                    WHEN 'purchase' THEN 'modeling/latest' ELSE 'report/latest' END AS state_key,
    props AS payload, ts AS updated_at FROM events)"""

"""Queries over profiles, quality rules and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.checks.inputs import (
    CUSTOMER_PROFILE,
    DIRTY,
    DIRTY_COLUMNS,
    DIRTY_PROFILE,
    HIGH_CARDINALITY,
    SUGGESTED,
    TOTALS,
    dirty,
    table,
)
from tablescope.checks.registry import query, rounded
from tablescope.functions.columns import union_all
from tablescope.operators import classes, clean, profile, quality
from tablescope.operators.profile import column_profile

PROFILE_OUT = (
    "ordinal::BIGINT AS ordinal, column_name, dtype, is_numeric, role, rows_count::BIGINT AS rows_count, "
    "missing_count::BIGINT AS missing_count, missing_percent::DOUBLE AS missing_percent, "
    "distinct_count::BIGINT AS distinct_count, zero_count::BIGINT AS zero_count"
)


@query("column_profile", f"WITH {DIRTY_PROFILE} SELECT {PROFILE_OUT} FROM profile")
def _column_profile(spark, sf):
    return column_profile(dirty(spark, sf))


@query("column_profile_customer", f"WITH {CUSTOMER_PROFILE} SELECT {PROFILE_OUT} FROM profile")
def _column_profile_customer(spark, sf):
    return column_profile(table(spark, sf, "customer"))


@query(
    "column_roles_estimated",
    f"WITH {DIRTY_PROFILE} SELECT column_name, role, missing_count::BIGINT AS missing_count FROM profile",
)
def _column_roles_estimated(spark, sf):
    return column_profile(dirty(spark, sf), exact=False).select("column_name", "role", "missing_count")


@query(
    "quality_totals",
    f"""WITH {DIRTY_PROFILE}, {TOTALS}
SELECT rows_count::BIGINT AS rows_count, columns_count::BIGINT AS columns_count,
  missing_total::BIGINT AS missing_total, missing_percent::DOUBLE AS missing_percent,
  duplicate_rows::BIGINT AS duplicate_rows, duplicate_percent::DOUBLE AS duplicate_percent FROM shares""",
)
def _quality_totals(spark, sf):
    df = dirty(spark, sf)
    return profile.quality_totals(df, column_profile(df))


MISSING = f"""WITH {DIRTY_PROFILE}
SELECT ordinal::BIGINT AS ordinal, column_name, missing_count::BIGINT AS missing_count,
  missing_percent::DOUBLE AS missing_percent FROM profile"""


@query("missing_values", MISSING)
def _missing_values(spark, sf):
    return profile.missing_values(dirty(spark, sf))


@query("missing_top", MISSING + " WHERE missing_count > 0 ORDER BY missing_count DESC, ordinal LIMIT 12")
def _missing_top(spark, sf):
    return profile.top_missing(profile.missing_values(dirty(spark, sf)))


@query(
    "duplicate_rows",
    f"""WITH {DIRTY} SELECT ((SELECT count(*) FROM dirty)
  - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)))::BIGINT AS duplicate_rows""",
)
def _duplicate_rows(spark, sf):
    return profile.duplicate_rows(dirty(spark, sf))


@query(
    "target_suggestions",
    f"""WITH {DIRTY_PROFILE}, {SUGGESTED}
SELECT position::BIGINT AS position, column_name, role, distinct_count::BIGINT AS distinct_count FROM suggested""",
)
def _target_suggestions(spark, sf):
    return profile.target_suggestions(column_profile(dirty(spark, sf)))


TARGET_COLUMNS = ["l_linestatus", "is_final", "l_returnflag", "l_linenumber", "l_discount", "l_tax"]


def target_values_sql(columns: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS value_count, "
        f"row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    ]
    return (
        "target_counts AS (SELECT * FROM ("
        + " UNION ALL ".join(parts)
        + ") WHERE rn <= 20),\n"
        + """target_values AS (
  SELECT t.column_name, t.value, t.value_count,
    round(t.value_count::DOUBLE / (p.rows_count - p.missing_count) * 100, 4) AS percent
  FROM target_counts t JOIN profile p USING (column_name)),
target_summary AS (
  SELECT p.column_name, p.rows_count - p.missing_count AS non_missing_rows, p.distinct_count AS classes_count,
    round(max(t.value_count)::DOUBLE / min(t.value_count), 4) AS imbalance_ratio,
    round((p.rows_count - p.missing_count)::DOUBLE / p.rows_count * 100, 4) AS coverage_percent
  FROM target_counts t JOIN profile p USING (column_name)
  GROUP BY p.column_name, p.rows_count, p.missing_count, p.distinct_count)"""
    )


TARGETS = target_values_sql(TARGET_COLUMNS)


@query(
    "target_profile_values",
    f"""WITH {DIRTY_PROFILE}, {TARGETS}
SELECT column_name, value, value_count::BIGINT AS value_count, percent::DOUBLE AS percent FROM target_values""",
)
def _target_profile_values(spark, sf):
    df = dirty(spark, sf)
    return profile.target_profiles(df, column_profile(df), TARGET_COLUMNS)[1].drop("position")


@query(
    "target_profile_summary",
    f"""WITH {DIRTY_PROFILE}, {TARGETS}
SELECT column_name, non_missing_rows::BIGINT AS non_missing_rows, classes_count::BIGINT AS classes_count,
  imbalance_ratio::DOUBLE AS imbalance_ratio, coverage_percent::DOUBLE AS coverage_percent FROM target_summary""",
)
def _target_profile_summary(spark, sf):
    df = dirty(spark, sf)
    return profile.target_profiles(df, column_profile(df), TARGET_COLUMNS)[0].drop("position")


# -- rules ----------------------------------------------------------------------


def _listed(condition: str, order: str = "ordinal") -> str:
    return (
        f"coalesce((SELECT string_agg(column_name, ',' ORDER BY {order}) FROM (SELECT * FROM profile "
        f"WHERE {condition} ORDER BY {order} LIMIT 10)), '')"
    )


def _counted(condition: str) -> str:
    return f"(SELECT count(*) FROM profile WHERE {condition})"


ZERO = "(is_numeric AND role <> 'binary' AND zero_count > 0)"
RULE_OUT = "SELECT code, level, columns, affected::BIGINT AS affected, percent::DOUBLE AS percent FROM rules WHERE holds"


def _rules(rows: list[tuple[str, str, str, str, str, str]]) -> str:
    return "rules AS (" + " UNION ALL ".join(
        f"SELECT '{code}' AS code, {level} AS level, {cols} AS columns, {affected} AS affected, {share} AS percent, "
        f"{holds} AS holds FROM shares"
        for code, level, holds, cols, affected, share in rows
    ) + ")"


CONSTANT_RULE = ("constant_columns", "'warning'", _counted("role = 'constant'") + " > 0",
                 _listed("role = 'constant'"), _counted("role = 'constant'"), "0.0")
WIDE_RULE = ("high_cardinality_text", "'info'", _counted(HIGH_CARDINALITY) + " > 0",
             _listed(HIGH_CARDINALITY), _counted(HIGH_CARDINALITY), "0.0")
NO_TARGET_RULE = ("no_target", "'warning'", "(SELECT count(*) FROM suggested) = 0", "''", "0", "0.0")

WARNING_RULES = _rules(
    [
        ("missing_values", "CASE WHEN missing_percent >= 5 THEN 'warning' ELSE 'info' END", "missing_total > 0",
         "''", "missing_total", "missing_percent"),
        ("duplicate_rows", "CASE WHEN duplicate_percent >= 2 THEN 'warning' ELSE 'info' END", "duplicate_rows > 0",
         "''", "duplicate_rows", "duplicate_percent"),
        CONSTANT_RULE,
        ("encoded_categories", "'info'", _counted("role = 'categorical_encoded'") + " > 0",
         _listed("role = 'categorical_encoded'"), _counted("role = 'categorical_encoded'"), "0.0"),
        WIDE_RULE,
        NO_TARGET_RULE,
    ]
)


@query("quality_warnings", f"WITH {DIRTY_PROFILE}, {TOTALS}, {SUGGESTED}, {WARNING_RULES} {RULE_OUT}")
def _quality_warnings(spark, sf):
    df = dirty(spark, sf)
    found = column_profile(df)
    summary, _ = profile.target_profiles(df, found)
    warnings = quality.quality_warnings(found, profile.quality_totals(df, found), summary)
    return warnings.select("code", "level", "columns", "affected", "percent")


RECOMMENDATION_RULES = _rules(
    [
        ("missing_values", "'warning'", "missing_total > 0", "''", "missing_total", "missing_percent"),
        ("duplicate_rows", "'warning'", "duplicate_rows > 0", "''", "duplicate_rows", "duplicate_percent"),
        CONSTANT_RULE,
        WIDE_RULE,
        ("zero_values", "'info'", _counted(ZERO) + " > 0", _listed(ZERO, "zero_count DESC, ordinal"),
         _counted(ZERO), "0.0"),
        NO_TARGET_RULE,
    ]
)


@query("cleaning_recommendations", f"WITH {DIRTY_PROFILE}, {TOTALS}, {SUGGESTED}, {RECOMMENDATION_RULES} {RULE_OUT}")
def _cleaning_recommendations(spark, sf):
    df = dirty(spark, sf)
    found = column_profile(df)
    rows = quality.cleaning_recommendations(found, profile.quality_totals(df, found))
    return rows.select("code", "level", "columns", "affected", "percent")


def _single(condition: str, rules: str, source: str, code: str, level: str, columns: str = "") -> str:
    return (
        f"SELECT '{rules}' AS rules, '{source}' AS source, 1::BIGINT AS position, '{code}' AS code, '{level}' AS level, "
        f"'{columns}' AS columns, {int(bool(columns))}::BIGINT AS affected, 0.0::DOUBLE AS percent, "
        f"'{quality.MESSAGES[code]}' AS message FROM facts WHERE {condition}"
    )


RARE_RULES = " UNION ALL ".join(
    [
        _single("even < 5", "warnings", "even", "ok", "ok"),
        _single("numbers > 20", "warnings", "numbers", "no_target", "warning"),
        _single("skewed >= 5", "warnings", "skewed", "class_imbalance", "warning", "kind"),
        _single("even < 5", "recommendations", "even", "ok", "ok"),
        _single("numbers > 20", "recommendations", "numbers", "no_target", "warning"),
        _single("skewed >= 5", "recommendations", "skewed", "ok", "ok"),
    ]
)


@query(
    "rare_rules",
    f"""WITH facts AS (SELECT
  (SELECT max(n)::DOUBLE / min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)) AS even,
  (SELECT count(DISTINCT o_totalprice) FROM orders) AS numbers,
  (SELECT max(n)::DOUBLE / min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey % 10 = 0)) AS skewed)
{RARE_RULES}""",
)
def _rare_rules(spark, sf):
    """Tables on which only class_imbalance, only no_target or no rule at all fires."""
    # keys begin at 0, which would fire the rule for zeros
    orders = table(spark, sf, "orders").withColumn("key", F.col("o_orderkey") + 1)
    kind = F.when(F.col("o_orderkey") % 10 == 0, "rare").otherwise("usual").alias("kind")
    tables = {
        "even": orders.select("key", "o_orderpriority"),
        "numbers": orders.select("key", "o_totalprice"),
        "skewed": orders.select("key", kind),
    }
    parts = []
    for source, df in tables.items():
        found = column_profile(df)
        totals = profile.quality_totals(df, found)
        summary, _ = profile.target_profiles(df, found)
        fired = {
            "warnings": quality.quality_warnings(found, totals, summary),
            "recommendations": quality.cleaning_recommendations(found, totals),
        }
        parts += [rows.select(F.lit(r).alias("rules"), F.lit(source).alias("source"), "*") for r, rows in fired.items()]
    return union_all(parts)


@query(
    "cleaning_plan",
    f"""WITH {DIRTY_PROFILE}, {TOTALS}
SELECT rows_count::BIGINT AS rows_count, columns_count::BIGINT AS columns_count, missing_total::BIGINT AS missing_total,
  duplicate_rows::BIGINT AS duplicate_rows, {_counted("role = 'constant'")}::BIGINT AS constant_columns,
  {_counted(HIGH_CARDINALITY)}::BIGINT AS high_cardinality_columns, {_counted(ZERO)}::BIGINT AS zero_columns
FROM shares""",
)
def _cleaning_plan(spark, sf):
    return quality.cleaning_plan(dirty(spark, sf))["summary"]


@query(
    "zero_candidates",
    f"""WITH {DIRTY_PROFILE}
SELECT ordinal::BIGINT AS ordinal, column_name, zero_count::BIGINT AS zero_count,
  round(zero_count::DOUBLE / rows_count * 100, 4) AS zero_percent FROM profile WHERE {ZERO}""",
)
def _zero_candidates(spark, sf):
    return quality.zero_candidates(column_profile(dirty(spark, sf)))


@query(
    "class_sources_numeric",
    f"""WITH {DIRTY_PROFILE}
SELECT column_name, distinct_count::BIGINT AS distinct_count FROM profile WHERE is_numeric AND distinct_count >= 5""",
)
def _class_sources_numeric(spark, sf):
    return quality.numeric_class_sources(column_profile(dirty(spark, sf)))


def _class_sources_sql() -> str:
    ranges, values = [], []
    for name, dtype in DIRTY_COLUMNS:
        if name == "constant":
            continue
        if dtype != "string":
            ranges.append(
                f"SELECT '{name}' AS column_name, min({name})::DOUBLE AS min, quantile_cont({name}::DOUBLE, 0.25) AS q25, "
                f"quantile_cont({name}::DOUBLE, 0.5) AS median, quantile_cont({name}::DOUBLE, 0.75) AS q75, "
                f"max({name})::DOUBLE AS max FROM dirty"
            )
        values.append(
            f"SELECT '{name}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {name}) AS position, "
            f"{name}::VARCHAR AS value, count(*) AS value_count FROM dirty WHERE {name} IS NOT NULL GROUP BY {name}"
        )
    return (
        f"ranges AS ({' UNION ALL '.join(ranges)}),\n"
        f"top_values AS (SELECT * FROM ({' UNION ALL '.join(values)}) WHERE position <= 12)"
    )


CLASS_SOURCES = _class_sources_sql()


@query(
    "class_sources",
    f"""WITH {DIRTY_PROFILE}, {CLASS_SOURCES}
SELECT column_name, p.ordinal::BIGINT AS ordinal, dtype, is_numeric, role, missing_count::BIGINT AS missing_count,
  distinct_count::BIGINT AS distinct_count, min, q25, median, q75, max
FROM profile p LEFT JOIN ranges USING (column_name) WHERE distinct_count >= 2""",
)
def _class_sources(spark, sf):
    df = dirty(spark, sf)
    return quality.class_sources(df, column_profile(df))[0]


@query(
    "class_source_values",
    f"""WITH {DIRTY_PROFILE}, {CLASS_SOURCES}
SELECT column_name, position::BIGINT AS position, value, value_count::BIGINT AS value_count FROM top_values""",
)
def _class_source_values(spark, sf):
    df = dirty(spark, sf)
    return quality.class_sources(df, column_profile(df))[1]


@query(
    "high_cardinality_text",
    f"""WITH {CUSTOMER_PROFILE}
SELECT column_name, distinct_count::BIGINT AS distinct_count FROM profile WHERE {HIGH_CARDINALITY}""",
)
def _high_cardinality_text(spark, sf):
    return profile.high_cardinality_text(column_profile(table(spark, sf, "customer")))


@query(
    "drop_reasons",
    f"""WITH {CUSTOMER_PROFILE}
SELECT column_name, CASE WHEN role = 'constant' THEN 'constant'
  WHEN role = 'text' AND distinct_count > 50 THEN 'many_text_values'
  WHEN regexp_matches(lower(column_name), 'id|identifier|street|address|url|email') THEN 'looks_like_identifier'
  ELSE 'role:' || role END AS reason FROM profile""",
)
def _drop_reasons(spark, sf):
    return quality.drop_reasons(column_profile(table(spark, sf, "customer")))


# -- cleaning -------------------------------------------------------------------

ALL = [c for c, _ in DIRTY_COLUMNS]


def _columns_sql(names=ALL, **replace) -> str:
    wide = {"l_linenumber", "constant", "is_final"}
    return ", ".join(f"{replace.get(c, c)}{'::BIGINT' if c in wide else ''} AS {c}" for c in names)


@query(
    "clean_drop_columns",
    f"WITH {DIRTY} SELECT {_columns_sql([c for c in ALL if c not in ('l_shipday', 'l_partkey')])} FROM dirty",
)
def _clean_drop_columns(spark, sf):
    return clean.clean(dirty(spark, sf), drop=["l_shipday", "l_partkey", "no_such_column", "l_shipday"])[0]


@query(
    "clean_zero_as_missing",
    f"WITH {DIRTY} SELECT {_columns_sql(l_discount='nullif(l_discount, 0)')} FROM dirty",
)
def _clean_zero_as_missing(spark, sf):
    return clean.clean(dirty(spark, sf), zero_as_missing=["l_discount", "l_linestatus", "nothing"])[0]


@query("clean_drop_rows", f"WITH {DIRTY} SELECT {_columns_sql()} FROM dirty WHERE l_tax IS NOT NULL AND l_returnflag IS NOT NULL")
def _clean_drop_rows(spark, sf):
    return clean.clean(dirty(spark, sf), missing="drop_rows")[0]


@query("clean_drop_duplicates", f"WITH {DIRTY} SELECT DISTINCT {_columns_sql()} FROM dirty")
def _clean_drop_duplicates(spark, sf):
    return clean.clean(dirty(spark, sf), drop_duplicate_rows=True)[0]


@query("clean_drop_constant", f"WITH {DIRTY} SELECT {_columns_sql([c for c in ALL if c != 'constant'])} FROM dirty")
def _clean_drop_constant(spark, sf):
    return clean.clean(dirty(spark, sf), drop_constant=True)[0]


@query("clean_drop_high_cardinality", "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _clean_drop_high_cardinality(spark, sf):
    return clean.clean(table(spark, sf, "customer"), drop_high_cardinality=True)[0]


MODE_FLAG = (
    "(SELECT l_returnflag FROM {t} WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, l_returnflag LIMIT 1)"
)


@query(
    "clean_fill_median",
    f"""WITH {DIRTY} SELECT {_columns_sql(
        l_tax="round(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM dirty)), 6)",
        l_returnflag="coalesce(l_returnflag, " + MODE_FLAG.format(t="dirty") + ")")} FROM dirty""",
)
def _clean_fill_median(spark, sf):
    return rounded(clean.clean(dirty(spark, sf), missing="fill_median")[0], 6, "l_tax")


@query(
    "clean_fill_mean",
    f"""WITH {DIRTY} SELECT {_columns_sql(
        l_tax="round(coalesce(l_tax, (SELECT avg(l_tax) FROM dirty)), 6)",
        l_returnflag="coalesce(l_returnflag, " + MODE_FLAG.format(t="dirty") + ")")} FROM dirty""",
)
def _clean_fill_mean(spark, sf):
    return rounded(clean.clean(dirty(spark, sf), missing="fill_mean")[0], 6, "l_tax")


CLEAN_RULES = dict(
    zero_as_missing=["l_discount"], drop=["l_shipday"], drop_constant=True, drop_duplicate_rows=True,
    missing="smart_fill",
)
KEPT = [c for c in ALL if c not in ("l_shipday", "constant")]
DISTINCT_ROWS = f"""{DIRTY}, zeroed AS (SELECT * REPLACE (nullif(l_discount, 0) AS l_discount) FROM dirty),
unique_rows AS (SELECT DISTINCT {', '.join(KEPT)} FROM zeroed)"""


@query(
    "clean_rules",
    f"""WITH {DISTINCT_ROWS} SELECT {_columns_sql(KEPT,
        l_tax="round(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM unique_rows)), 6)",
        l_discount="round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM unique_rows)), 6)",
        l_returnflag="coalesce(l_returnflag, " + MODE_FLAG.format(t="unique_rows") + ")")} FROM unique_rows""",
)
def _clean_rules(spark, sf):
    return rounded(clean.clean(dirty(spark, sf), **CLEAN_RULES)[0], 6, "l_tax", "l_discount")


def _changes_sql() -> str:
    return """SELECT action, column_name, affected::BIGINT AS affected FROM (
  SELECT 'zero_to_missing' AS action, 'l_discount' AS column_name, count(*) AS affected FROM dirty WHERE l_discount = 0
  UNION ALL SELECT 'drop_column', 'l_shipday', 1 UNION ALL SELECT 'drop_column', 'constant', 1
  UNION ALL SELECT 'drop_duplicate_rows', '', (SELECT count(*) FROM zeroed) - (SELECT count(*) FROM unique_rows)
  UNION ALL SELECT 'fill_missing', 'l_discount', count(*) FROM unique_rows WHERE l_discount IS NULL
  UNION ALL SELECT 'fill_missing', 'l_tax', count(*) FROM unique_rows WHERE l_tax IS NULL
  UNION ALL SELECT 'fill_missing', 'l_returnflag', count(*) FROM unique_rows WHERE l_returnflag IS NULL)
WHERE affected > 0"""


@query("clean_changes", f"WITH {DISTINCT_ROWS} {_changes_sql()}")
def _clean_changes(spark, sf):
    return clean.clean(dirty(spark, sf), **CLEAN_RULES)[1].drop("position")


# -- classes --------------------------------------------------------------------

RANGES = [
    {"code": "low", "max": 1000, "label": "Low balance"},
    {"code": "mid", "min": 1000, "max": 5000},
    {"code": "high", "min": 4000, "max": 8000, "label": "High balance"},
]
RANGE_SQL = """CASE WHEN c_acctbal BETWEEN 4000 AND 8000 THEN 'high' WHEN c_acctbal BETWEEN 1000 AND 5000 THEN 'mid'
  WHEN c_acctbal <= 1000 THEN 'low' END"""
VALUES = [
    {"code": "home", "values": [" HOUSEHOLD ", "FURNITURE"], "label": "For the home"},
    {"code": "work", "values": ["MACHINERY", "BUILDING", ""]},
]


@query("class_ranges", f"SELECT c_custkey, c_acctbal, {RANGE_SQL} AS c_acctbal_class FROM customer")
def _class_ranges(spark, sf):
    made = classes.create_class(table(spark, sf, "customer"), "c_acctbal", RANGES)
    return made.df.select("c_custkey", "c_acctbal", made.column)


@query(
    "class_rejected",
    """SELECT * FROM (VALUES ('no row', 'Class rules did not match any rows'),
  ('one class', 'Class rules must produce at least two classes')) t(rules, error)
WHERE (SELECT count(*) FILTER (c_acctbal > 1000000) = 0 AND count(*) FILTER (c_acctbal <= 1000000) > 0 FROM customer)""",
)
def _class_rejected(spark, sf):
    """Rules that match nothing, or give one class only, counted over all customers."""
    above = [{"code": "a", "min": 1_000_000, "max": 2_000_000}, {"code": "b", "min": 3_000_000}]
    tried = {"no row": above, "one class": [*above, {"code": "c", "max": 1_000_000}]}
    rows = []
    for rules, given in tried.items():
        try:
            classes.create_class(table(spark, sf, "customer"), "c_acctbal", given)
        except ValueError as error:
            rows.append((rules, str(error)))
    return spark.createDataFrame(rows, "rules string, error string")


@query(
    "class_values",
    """SELECT c_custkey, CASE WHEN trim(c_mktsegment) IN ('MACHINERY', 'BUILDING') THEN 'work'
  WHEN trim(c_mktsegment) IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' END AS kind FROM customer""",
)
def _class_values(spark, sf):
    made = classes.create_class(table(spark, sf, "customer"), "c_mktsegment", VALUES, "values", "kind")
    return made.df.select("c_custkey", "kind")


@query(
    "class_descriptions",
    f"""WITH texts(code, description) AS (VALUES ('low', 'Low balance'), ('mid', '1000.0 - 5000.0'), ('high', 'High balance')),
marked AS (SELECT {RANGE_SQL} AS code FROM customer)
SELECT t.code, t.description, count(m.code)::BIGINT AS rows_count FROM texts t LEFT JOIN marked m ON t.code = m.code
GROUP BY t.code, t.description""",
)
def _class_descriptions(spark, sf):
    made = classes.create_class(table(spark, sf, "customer"), "c_acctbal", RANGES)
    counted = made.distribution.withColumnRenamed("label", "code")
    return made.descriptions.join(counted, "code", "left").fillna(0, ["rows_count"])


@query(
    "class_distribution",
    f"""WITH marked AS (SELECT {RANGE_SQL} AS label FROM customer)
SELECT coalesce(label, '(unmatched)') AS label, count(*)::BIGINT AS rows_count FROM marked GROUP BY 1""",
)
def _class_distribution(spark, sf):
    made = classes.create_class(table(spark, sf, "customer"), "c_acctbal", RANGES)
    rest = spark.createDataFrame([("(unmatched)", made.unmatched)], "label string, rows_count bigint")
    return classes.class_distribution(made.df, made.column).unionByName(rest.where("rows_count > 0"))


@query(
    "class_suggest",
    """WITH q AS (SELECT round(min(o_totalprice), 4) AS a, round(quantile_cont(o_totalprice, 0.25), 4) AS b,
    round(quantile_cont(o_totalprice, 0.75), 4) AS c, round(max(o_totalprice), 4) AS d FROM orders),
t AS (SELECT o_orderpriority AS value, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i
  FROM orders GROUP BY 1)
SELECT 'o_totalprice' AS source, '0' AS code, a AS low, b AS high, NULL AS value FROM q
UNION ALL SELECT 'o_totalprice', '1', b, c, NULL FROM q UNION ALL SELECT 'o_totalprice', '2', c, d, NULL FROM q
UNION ALL SELECT 'o_orderpriority', i::VARCHAR, NULL, NULL, value FROM t WHERE i < 6""",
)
def _class_suggest(spark, sf):
    orders = table(spark, sf, "orders")
    rows = [
        (c, r["code"], r.get("min"), r.get("max"), (r.get("values") or [None])[0])
        for c, mode in (("o_totalprice", "ranges"), ("o_orderpriority", "values"))
        for r in classes.suggest_class_rules(orders, c, mode)
    ]
    return spark.createDataFrame(rows, "source string, code string, low double, high double, value string")

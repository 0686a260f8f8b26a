"""Queries over sources, statistics, correlations and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.checks.inputs import DIRTY, DIRTY_COLUMNS, LINEITEM_NUMBERS, dirty, table
from tablescope.checks.registry import query, rounded
from tablescope.functions.session import scratch_path
from tablescope.functions.stats import strength
from tablescope.operators import corr, quality, ranks, stats, trend
from tablescope.plans import insights
from tablescope.sources import csv, rows, sinks

# -- sources and sinks ----------------------------------------------------------


@query(
    "csv_typed_scan",
    """SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS "gap count", o_orderkey % 2 = 0 AS even,
  'say "' || o_orderpriority || '", now' AS note, NULL::DOUBLE AS empty FROM orders""",
)
def _csv_typed_scan(spark, sf):
    c = F.col
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.when(c("o_orderkey") % 5 != 0, c("o_custkey").cast("string")).otherwise("NA").alias("gap count"),
        (c("o_orderkey") % 2 == 0).alias("even"),
        F.concat(F.lit('say "'), c("o_orderpriority"), F.lit('", now')).alias("note"), F.lit("n/a").alias("empty"),
    )
    return csv.read_csv_typed(spark, sinks.save(orders, scratch_path(spark, "typed") + ".csv", "csv"))


@query(
    "csv_encoding_scan",
    "SELECT c_custkey, c_name || ' né à Zürich' AS c_name, c_acctbal FROM customer",
)
def _csv_encoding_scan(spark, sf):
    path = scratch_path(spark, "encoding") + ".csv"
    people = table(spark, sf, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(" né à Zürich")).alias("c_name"), "c_acctbal"
    )
    people.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return csv.read_csv_typed(spark, path)


def _ragged_csv(spark, sf) -> str:
    """Part rows as text lines; every tenth has a field too many."""
    path = scratch_path(spark, "ragged") + ".csv"
    lines = table(spark, sf, "part").select(
        F.concat_ws(
            ",", F.col("p_partkey").cast("string"), "p_brand", F.col("p_size").cast("string"),
            F.when(F.col("p_partkey") % 10 == 0, F.lit('"extra, quoted"')),
        ).alias("value")
    )

    def with_header(batches):
        import pyarrow as pa

        for i, batch in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_pydict({"value": ["p_partkey,p_brand,p_size"]}, schema=batch.schema)
            yield batch

    lines.mapInArrow(with_header, "value string").write.text(path)
    return path


@query(
    "csv_bad_records",
    """SELECT p_partkey::VARCHAR AS p_partkey, p_brand, p_size::VARCHAR AS p_size, 'extra, quoted' AS surplus
FROM part WHERE p_partkey % 10 = 0""",
)
def _csv_bad_records(spark, sf):
    return csv.bad_records(spark, _ragged_csv(spark, sf)).withColumnRenamed(csv.SURPLUS, "surplus")


@query(
    "csv_skip_bad_records",
    "SELECT p_partkey, p_brand, p_size::BIGINT AS p_size FROM part WHERE p_partkey % 10 <> 0",
)
def _csv_skip_bad_records(spark, sf):
    return csv.read_csv_typed(spark, _ragged_csv(spark, sf), on_bad="skip")


def _files_in_order(spark, sf, *columns) -> str:
    """Orders as several CSV files, ordered by key from file to file; cells are texts of the given expressions."""
    path = scratch_path(spark, "ordered") + ".csv"
    orders = table(spark, sf, "orders").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey")
    writer = orders.select("o_orderkey", *columns).write.option("header", True).option("escape", '"')
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(
    "csv_in_file_order",
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey, o_totalprice FROM orders""",
)
def _csv_in_file_order(spark, sf):
    return csv.read_csv_typed(spark, _files_in_order(spark, sf, "o_totalprice"), row_id="place")


@query(
    "csv_first_rows",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) * 2 // 3 FROM orders)""",
)
def _csv_first_rows(spark, sf):
    wanted = table(spark, sf, "orders").count() * 2 // 3
    return csv.read_csv_typed(spark, _files_in_order(spark, sf, "o_totalprice"), limit=wanted)


@query(
    "csv_quoted_breaks",
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey,
  o_orderpriority || chr(10) || '"by" ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN repeat(chr(10) || 'more, ', 5) ELSE '' END AS note,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END AS "left" FROM orders""",
)
def _csv_quoted_breaks(spark, sf):
    key = F.col("o_orderkey")
    more = F.when(key % 3 == 0, F.repeat(F.lit("\nmore, "), 5)).otherwise("")
    note = F.concat("o_orderpriority", F.lit('\n"by" '), key.cast("string"), more).alias("note")
    left = F.when(key % 5 != 0, (key % 7).cast("string")).otherwise("NA").alias("left")
    return csv.read_csv_typed(spark, _files_in_order(spark, sf, note, left), row_id="place")


@query(
    "csv_repaired_header",
    """SELECT p_partkey AS part, p_size::BIGINT AS "part.1", p_brand AS "Unnamed: 2", p_retailprice AS "part.2" FROM part""",
)
def _csv_repaired_header(spark, sf):
    path = scratch_path(spark, "header") + ".csv"
    table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice").coalesce(1).write.csv(path)
    lines = spark.read.text(path)

    def with_header(batches):
        import pyarrow as pa

        for i, batch in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_pydict({"value": ["part,part,,part"]}, schema=batch.schema)
            yield batch

    named = scratch_path(spark, "header") + ".csv"
    lines.mapInArrow(with_header, "value string").write.text(named)
    return csv.read_csv_typed(spark, named)


@query(
    "csv_rejected",
    """SELECT * FROM (VALUES ('no rows', 'Uploaded file is empty'), ('no lines', 'Uploaded file is empty'),
  ('not a csv', 'Only CSV files are supported'),
  ('surplus', (SELECT 'Failed to read CSV: ' || count(*) || ' rows have more than 3 fields' FROM part WHERE p_partkey % 10 = 0))) t(source, error)""",
)
def _csv_rejected(spark, sf):
    parts = table(spark, sf, "part")
    none = scratch_path(spark, "none")
    sources = {
        "no rows": sinks.save(parts.where("p_partkey < 0").select("p_partkey", "p_brand"), none + "-rows.csv", "csv"),
        "no lines": sinks.save(parts.where("p_partkey < 0").select(F.col("p_brand")), none + "-lines.csv", "csv"),
        "not a csv": sinks.save(parts, none + ".parquet"),
        "surplus": _ragged_csv(spark, sf),
    }
    rows = []
    for source, path in sources.items():
        try:
            csv.read_csv_typed(spark, path).count()
        except ValueError as error:
            rows.append((source, str(error)))
    return spark.createDataFrame(rows, "source string, error string")


@query(
    "result_sink_roundtrip",
    """WITH c AS (SELECT o_orderpriority AS value, count(*)::BIGINT AS value_count FROM orders GROUP BY 1),
r AS (SELECT row_number() OVER (ORDER BY value_count DESC, value)::BIGINT AS position, * FROM c)
SELECT f.format, r.* FROM r CROSS JOIN (VALUES ('parquet'), ('json'), ('orc')) f(format)""",
)
def _result_sink_roundtrip(spark, sf):
    result = quality.top_values(table(spark, sf, "orders"), "o_orderpriority", 20)
    read = None
    for fmt in ("parquet", "json", "orc"):
        path = sinks.save(result, scratch_path(spark, "sink"), fmt)
        part = spark.read.schema(result.schema).format(fmt).load(path).select(F.lit(fmt).alias("format"), "*")
        read = part if read is None else read.unionByName(part)
    return read


@query("preview", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def _preview(spark, sf):
    return rows.preview(table(spark, sf, "orders"), order_by=["o_orderkey"]).select(
        "o_orderkey", "o_orderstatus", "o_totalprice"
    )


TIED = """SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders
  ORDER BY o_orderstatus, o_custkey, o_orderkey, o_orderpriority, o_totalprice LIMIT 700)"""


def _tied(spark, sf, top_rows):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return rows.limit_rows(orders, 700, ["o_orderstatus"], top_rows=top_rows)


@query("row_limit_tied", TIED)
def _row_limit_tied(spark, sf):
    return _tied(spark, sf, rows.TOP_ROWS)


@query("row_limit_tied_by_cut", TIED)
def _row_limit_tied_by_cut(spark, sf):
    return _tied(spark, sf, 50)


@query("row_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def _row_limit(spark, sf):
    return rows.limit_rows(table(spark, sf, "orders"), "100", ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    "row_limit_by_cut",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
ORDER BY o_orderstatus, o_orderkey, o_totalprice LIMIT 7000""",
)
def _row_limit_by_cut(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rows.limit_rows(orders, 7000, ["o_orderstatus"], top_rows=100)


@query(
    "sample_info",
    """SELECT CASE WHEN n < total THEN 'limited' ELSE 'full' END AS mode, n < total AS is_limited, 1000::BIGINT AS requested_limit,
  n AS current_rows, total AS source_rows, 6::BIGINT AS columns_count, round(n::DOUBLE / total * 100, 4) AS percent
FROM (SELECT least(1000, count(*))::BIGINT AS n, count(*)::BIGINT AS total FROM orders)""",
)
def _sample_info(spark, sf):
    orders = table(spark, sf, "orders")
    return rows.sample_info(rows.limit_rows(orders, 1000, ["o_orderkey"]), orders, 1000)


# -- descriptive statistics -----------------------------------------------------


def _describe_sql() -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count({c})::BIGINT AS values_count, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS q25, "
        f"quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c})::DOUBLE AS max "
        "FROM dirty"
        for c in LINEITEM_NUMBERS
    ]
    return f"WITH {DIRTY} SELECT column_name, values_count, mean, std, min, round(q25, 6) AS q25, " \
        f"round(median, 6) AS median, round(q75, 6) AS q75, max FROM ({' UNION ALL '.join(parts)})"


def _describe(spark, sf):
    return rounded(rounded(stats.describe_numeric(dirty(spark, sf)), 4, "mean", "std"), 6, "q25", "median", "q75")


query("describe_numeric", _describe_sql())(_describe)


def _text_sql() -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count({c})::BIGINT AS values_count, count(DISTINCT {c})::BIGINT AS unique_count, "
        f"(SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top, "
        f"(SELECT count(*) FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1)::BIGINT AS freq FROM dirty"
        for c, t in DIRTY_COLUMNS if t == "string"
    ]
    return f"WITH {DIRTY} {' UNION ALL '.join(parts)}"


@query("describe_categorical", _text_sql())
def _describe_categorical(spark, sf):
    return stats.describe_categorical(dirty(spark, sf))


@query(
    "quantiles_by_selection",
    f"""WITH {DIRTY}, long AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS column_name, {c}::DOUBLE AS v FROM dirty" for c in LINEITEM_NUMBERS)}),
q AS (SELECT column_name, quantile_cont(v, [0.05, 0.25, 0.5, 0.9]) AS qs FROM long GROUP BY 1)
SELECT column_name, p, round(value, 6) AS value FROM (
  SELECT column_name, unnest([0.05::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS p, unnest(qs) AS value FROM q)""",
)
def _quantiles_by_selection(spark, sf):
    probs = [0.05, 0.25, 0.5, 0.9]
    # a bound of 2000 rows sends every column through bracketing and counting
    found = ranks.exact_quantiles(dirty(spark, sf), {c: probs for c in LINEITEM_NUMBERS}, one_task_rows=2000)
    local = [(c, p, v) for c, values in found.items() for p, v in zip(probs, values)]
    return rounded(spark.createDataFrame(local, "column_name string, p double, value double"), 6, "value")


def _histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""WITH span AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),
bins AS (SELECT i AS bin, lo + (hi - lo) / {bins} * i AS bin_left,
           CASE WHEN i = {bins} - 1 THEN hi ELSE lo + (hi - lo) / {bins} * (i + 1) END AS bin_right
         FROM span, range({bins}) t(i))
SELECT bin::BIGINT AS bin, round(bin_left, 6) AS bin_left, round(bin_right, 6) AS bin_right,
  (SELECT count(*) FROM {source} WHERE {column} >= bin_left AND ({column} < bin_right OR bin = {bins} - 1))::BIGINT AS rows_count
FROM bins"""


@query("histogram_numeric", _histogram_sql("lineitem", "l_extendedprice", 20))
def _histogram_numeric(spark, sf):
    found = stats.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20)
    return rounded(found, 6, "bin_left", "bin_right")


@query("histogram_discrete", _histogram_sql("lineitem", "l_discount", 10))
def _histogram_discrete(spark, sf):
    return rounded(stats.histogram(table(spark, sf, "lineitem"), "l_discount"), 6, "bin_left", "bin_right")


def _top_sql(source: str, column: str, k: int, position: str, value: str, count: str) -> str:
    return f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, {column})::BIGINT AS {position},
  {column}::VARCHAR AS {value}, count(*)::BIGINT AS {count} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column})
WHERE {position} <= {k}"""


@query("histogram_categorical", _top_sql("orders", "o_orderpriority", 3, "bin", "label", "rows_count"))
def _histogram_categorical(spark, sf):
    return stats.histogram(table(spark, sf, "orders"), "o_orderpriority", 3)


@query("top_values", _top_sql("lineitem", "l_partkey", 20, "position", "value", "value_count"))
def _top_values(spark, sf):
    return quality.top_values(table(spark, sf, "lineitem"), "l_partkey", 20)


@query(
    "outlier_summary",
    """WITH q AS (SELECT min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3, max(value) AS max FROM events)
SELECT min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, max,
  round(q1 - 1.5 * (q3 - q1), 6) AS iqr_lower, round(q3 + 1.5 * (q3 - q1), 6) AS iqr_upper FROM q""",
)
def _outlier_summary(spark, sf):
    found = stats.outlier_summary(table(spark, sf, "events"), "value")
    return rounded(found, 6, "q1", "median", "q3", "iqr_lower", "iqr_upper")


Z_ROWS = """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events),
z AS (SELECT e.* FROM events e, s WHERE abs((e.value - s.m) / s.s) > 3)"""


@query("outliers_zscore", f"{Z_ROWS} SELECT event_id, value FROM z ORDER BY event_id LIMIT 100")
def _outliers_zscore(spark, sf):
    return stats.outliers(table(spark, sf, "events"), "value", order_by=["event_id"])[1]


@query("outliers_count", f"{Z_ROWS} SELECT count(*)::BIGINT AS outliers_count FROM z")
def _outliers_count(spark, sf):
    return stats.outliers(table(spark, sf, "events"), "value")[0]


# -- correlation ----------------------------------------------------------------


@query(
    "numeric_pair",
    f"""WITH {DIRTY} SELECT l_extendedprice AS x, l_tax AS y FROM dirty WHERE l_tax IS NOT NULL""",
)
def _numeric_pair(spark, sf):
    return corr.numeric_pair(dirty(spark, sf), "l_extendedprice", "l_tax")


@query(
    "numeric_text",
    """SELECT o_totalprice AS x, CASE o_orderkey % 7 WHEN 4 THEN o_totalprice WHEN 5 THEN 12.5 WHEN 6 THEN 1000.0 END::DOUBLE AS y
FROM orders WHERE o_orderkey % 7 > 3""",
)
def _numeric_text(spark, sf):
    """Texts that some casts would take as numbers are missing."""
    odd = F.array(F.lit("1d"), F.lit("2f"), F.lit("0x1"), F.lit("  "), F.col("o_totalprice").cast("string"), F.lit(" 12.5 "), F.lit("1e3"))
    orders = table(spark, sf, "orders").withColumn("text", F.get(odd, (F.col("o_orderkey") % 7).cast("int")))
    return corr.numeric_pair(orders, "o_totalprice", "text")


def _pearson_sql(x: str, y: str) -> str:
    return (
        f"SELECT '{x}' AS x, '{y}' AS y, corr({y}::DOUBLE, {x}::DOUBLE) AS r, count(*) AS n, "
        f"min({x}) < max({x}) AND min({y}) < max({y}) AS varies "
        f"FROM dirty WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
    )


def _spearman_sql(x: str, y: str) -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return (
        f"SELECT '{x}' AS x, '{y}' AS y, corr(b, a) AS r, count(*) AS n, min(a) < max(a) AND min(b) < max(b) AS varies FROM ("
        f"SELECT ({rank(x)})::DOUBLE AS a, ({rank(y)})::DOUBLE AS b FROM dirty WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    )


def _pairs(pair_sql, left: list[str], right: list[str], source: str = DIRTY) -> str:
    return f"WITH {source}, pairs AS (" + " UNION ALL ".join(pair_sql(a, b) for a in left for b in right) + ")"


MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant", "l_linenumber"]


def _matrix_sql(pair_sql, columns: list[str] = MATRIX, source: str = DIRTY) -> str:
    place = "CASE {} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(columns)) + " END::BIGINT"
    return f"""{_pairs(pair_sql, columns, columns, source)}
SELECT {place.format('x')} AS row_position, x AS row_name, {place.format('y')} AS column_position, y AS column_name,
  round(CASE WHEN varies THEN r ELSE 0.0 END, 4) AS value FROM pairs"""


@query("corr_matrix_pearson", _matrix_sql(_pearson_sql))
def _corr_matrix_pearson(spark, sf):
    return corr.correlation_matrix(dirty(spark, sf), columns=[*MATRIX, "l_linestatus"])


@query("corr_matrix_spearman", _matrix_sql(_spearman_sql))
def _corr_matrix_spearman(spark, sf):
    return corr.correlation_matrix(dirty(spark, sf), "spearman", columns=MATRIX)


GAPPY = """dirty AS (SELECT CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END AS quantity,
  CASE WHEN l_partkey % 4 <> 0 THEN l_extendedprice END AS price,
  CASE WHEN l_suppkey % 5 <> 0 THEN l_discount END AS discount, l_tax FROM lineitem)"""


@query("corr_matrix_spearman_gaps", _matrix_sql(_spearman_sql, ["quantity", "price", "discount", "l_tax"], GAPPY))
def _corr_matrix_spearman_gaps(spark, sf):
    """Three columns with gaps of their own: every pair has its own complete rows and ranks."""
    gappy = table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_discount")).alias("discount"), "l_tax",
    )
    return corr.correlation_matrix(gappy, "spearman")


#: Fourteen numbers of an order, each with gaps of its own.
MANY_GAPS = [
    (f"g{k}", source, f"(o_orderkey * {k + 2} + o_custkey) % {k + 4} <> 0")
    for k, source in enumerate(
        ["o_totalprice", "o_custkey", "o_orderkey"] + [f"o_orderkey % {m}" for m in (7, 97, 1000)]
        + [f"o_custkey % {m}" for m in (5, 31, 400)] + [f"floor(o_totalprice / {m})" for m in (10, 1000, 50000)] + ["o_totalprice - o_custkey", "o_orderkey % 2"]
    )
]


@query(
    "corr_matrix_spearman_many_gaps",
    _matrix_sql(
        _spearman_sql, [name for name, _, _ in MANY_GAPS],
        "dirty AS (SELECT " + ", ".join(f"CASE WHEN {there} THEN {source} END AS {name}" for name, source, there in MANY_GAPS) + " FROM orders)",
    ),
)
def _corr_matrix_spearman_many_gaps(spark, sf):
    """All 91 pairs of fourteen columns with gaps: every ranking comes from one scan."""
    cells = [F.expr(f"CASE WHEN {there} THEN {source} END").alias(name) for name, source, there in MANY_GAPS]
    return corr.correlation_matrix(table(spark, sf, "orders").select(*cells), "spearman")


@query(
    "corr_matrix_wide",
    _pairs(_pearson_sql, MATRIX[:3], MATRIX[:3]).replace("pairs AS (", "pairs AS MATERIALIZED (")
    + " SELECT x AS row_name, "
    + ", ".join(f"max(CASE WHEN y = '{c}' THEN round(r, 4) END) AS {c}" for c in MATRIX[:3])
    + " FROM pairs GROUP BY x",
)
def _corr_matrix_wide(spark, sf):
    return corr.matrix_wide(corr.correlation_matrix(dirty(spark, sf), columns=MATRIX[:3]))


def _pair_out(pair_sql, method: str) -> str:
    return f"""{_pairs(pair_sql, ['l_extendedprice'], ['l_tax'])}
SELECT '{method}' AS method, round(r, 6) AS coefficient, n::BIGINT AS rows_used,
  CASE WHEN abs(r) < 0.1 THEN 'none' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate'
       WHEN abs(r) < 0.7 THEN 'noticeable' ELSE 'strong' END AS strength FROM pairs"""


@query("corr_pair_pearson", _pair_out(_pearson_sql, "pearson"))
def _corr_pair_pearson(spark, sf):
    found = corr.correlation(dirty(spark, sf), "l_extendedprice", "l_tax")
    return rounded(found.withColumn("strength", strength(F.col("coefficient"))), 6, "coefficient")


@query("corr_pair_spearman", _pair_out(_spearman_sql, "spearman"))
def _corr_pair_spearman(spark, sf):
    # a bound of 50 values sends l_extendedprice through the hot / cold join
    found = corr.correlation(dirty(spark, sf), "l_extendedprice", "l_tax", "spearman", broadcast_rows=50)
    return rounded(found.withColumn("strength", strength(F.col("coefficient"))), 6, "coefficient")


FEATURES = [c for c in LINEITEM_NUMBERS if c != "l_tax"]


def _ranking_sql(pair_sql) -> str:
    return f"""{_pairs(pair_sql, FEATURES, ['l_tax'])}
SELECT x AS feature, round(r, 6) AS coefficient, round(abs(r), 6) AS abs_coefficient, n::BIGINT AS rows_used
FROM pairs WHERE varies"""


@query("target_ranking_pearson", _ranking_sql(_pearson_sql))
def _target_ranking_pearson(spark, sf):
    return rounded(corr.rank_features(dirty(spark, sf), "l_tax"), 6, "coefficient", "abs_coefficient")


@query("target_ranking_spearman", _ranking_sql(_spearman_sql))
def _target_ranking_spearman(spark, sf):
    found = corr.rank_features(dirty(spark, sf), "l_tax", "spearman")
    return rounded(found, 6, "coefficient", "abs_coefficient")


@query(
    "ranking_insights",
    f"""{_pairs(_pearson_sql, FEATURES, ['l_tax'])},
top AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC) AS i FROM pairs WHERE varies)
SELECT 1::BIGINT AS position, 'strongest' AS code, x AS subject, CASE WHEN r >= 0 THEN 'direct' ELSE 'inverse' END AS detail,
  round(r, 6) AS value FROM top WHERE i = 1
UNION ALL SELECT 2, 'method', 'l_tax', 'pearson', NULL
UNION ALL SELECT 3, 'first_candidates', 'l_tax', (SELECT string_agg(x, ',' ORDER BY i) FROM top WHERE i <= 3), NULL""",
)
def _ranking_insights(spark, sf):
    return rounded(insights.ranking_insights("l_tax", corr.rank_features(dirty(spark, sf), "l_tax")), 6, "value")


@query(
    "average_rank",
    f"""WITH {DIRTY}, c AS (SELECT l_extendedprice AS value, count(*) AS n FROM dirty GROUP BY 1)
SELECT value, n::BIGINT AS n, (sum(n) OVER (ORDER BY value) - n + (n + 1) / 2.0)::DOUBLE AS rank FROM c""",
)
def _average_rank(spark, sf):
    return ranks.average_rank(dirty(spark, sf), "l_extendedprice")


# -- regression and trends ------------------------------------------------------


def _line_sql(source: str, x: str, y: str) -> str:
    return f"""line AS (SELECT regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2,
  count(*) AS n FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""


@query(
    "linear_regression",
    f"""WITH {_line_sql('part', 'p_partkey', 'p_retailprice')}
SELECT round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, n::BIGINT AS rows_used,
  CASE WHEN slope > 0 THEN 'rises' ELSE 'falls' END AS direction,
  CASE WHEN r2 < 0.2 THEN 'weak' WHEN r2 < 0.5 THEN 'moderate' ELSE 'good' END AS fit FROM line""",
)
def _linear_regression(spark, sf):
    found = trend.linear_regression(table(spark, sf, "part"), "p_partkey", "p_retailprice")
    return rounded(rounded(found, 6, "slope", "r2"), 4, "intercept")


GROUPED = """points AS (
  SELECT row_number() OVER (ORDER BY l_linenumber) AS point, l_linenumber::VARCHAR AS label, l_linenumber::DOUBLE AS x,
    avg(l_quantity) AS y, count(*) AS rows_count FROM lineitem GROUP BY l_linenumber)"""


def _binned_sql(source: str, x: str, y: str) -> str:
    """Quantile bins; the label of the first edge is lowered by 0.001."""
    cuts = ", ".join(f"{i}/12.0" for i in range(13))
    return f"""pairs AS (SELECT {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
edges AS (SELECT DISTINCT e FROM (SELECT unnest(quantile_cont(x, [{cuts}])) AS e FROM pairs)),
spans AS (SELECT row_number() OVER (ORDER BY e) AS bin, e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM edges),
points AS (
  SELECT row_number() OVER (ORDER BY s.bin) AS point,
    printf('%.2f - %.2f', round(s.lo, 3) - CASE WHEN s.bin = 1 THEN 0.001 ELSE 0 END, round(s.hi, 3)) AS label,
    avg(p.x) AS x, avg(p.y) AS y, count(*) AS rows_count
  FROM pairs p JOIN spans s ON p.x <= s.hi AND (p.x > s.lo OR s.bin = 1) GROUP BY s.bin, s.lo, s.hi)"""


POINTS_OUT = "point::BIGINT AS point, label, round(x, 6) AS x, round(y, 6) AS y, rows_count::BIGINT AS rows_count FROM points"


@query("trend_grouped", f"WITH {GROUPED} SELECT 'grouped' AS kind, {POINTS_OUT}")
def _trend_grouped(spark, sf):
    return rounded(trend.trend(table(spark, sf, "lineitem"), "l_linenumber", "l_quantity"), 6, "x", "y")


PRICE_TREND = _binned_sql("lineitem", "l_extendedprice", "l_quantity")


@query("trend_binned", f"WITH {PRICE_TREND} SELECT 'binned' AS kind, {POINTS_OUT}")
def _trend_binned(spark, sf):
    return rounded(trend.trend(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity"), 6, "x", "y")


EXTREMES = """(SELECT label FROM points ORDER BY y, point LIMIT 1) AS lowest_label,
  (SELECT round(min(y), 4) FROM points) AS lowest_y,
  (SELECT label FROM points ORDER BY y DESC, point LIMIT 1) AS highest_label,
  (SELECT round(max(y), 4) FROM points) AS highest_y"""


@query("trend_extremes", f"WITH {PRICE_TREND} SELECT {EXTREMES}")
def _trend_extremes(spark, sf):
    points = trend.trend(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return rounded(trend.trend_extremes(points), 4, "lowest_y", "highest_y")


PART_TREND = f"WITH {_line_sql('part', 'p_size', 'p_retailprice')}, {_binned_sql('part', 'p_size', 'p_retailprice')}"


@query(
    "trend_fitted",
    f"""{PART_TREND} SELECT point::BIGINT AS point, label, round(x, 6) AS x, round(y, 6) AS y,
  rows_count::BIGINT AS rows_count, 'binned' AS kind, round(slope * x + intercept, 4) AS fitted FROM points, line""",
)
def _trend_fitted(spark, sf):
    part = table(spark, sf, "part")
    points = trend.trend(part, "p_size", "p_retailprice")
    fitted = trend.fitted_trend(points, trend.linear_regression(part, "p_size", "p_retailprice"))
    return rounded(rounded(fitted, 6, "x", "y"), 4, "fitted")


@query(
    "regression_insights",
    f"""{PART_TREND}
SELECT 1::BIGINT AS position, 'slope' AS code, 'p_size -> p_retailprice' AS subject,
  CASE WHEN slope > 0 THEN 'rises' ELSE 'falls' END AS detail, round(slope, 4) AS value FROM line
UNION ALL SELECT 2, 'fit', 'p_size -> p_retailprice',
  CASE WHEN r2 < 0.2 THEN 'weak' WHEN r2 < 0.5 THEN 'moderate' ELSE 'good' END, round(r2, 4) FROM line
UNION ALL SELECT 3, 'highest_group', 'p_retailprice', (SELECT label FROM points ORDER BY y DESC, point LIMIT 1),
  (SELECT round(max(y), 4) FROM points)""",
)
def _regression_insights(spark, sf):
    part = table(spark, sf, "part")
    line = trend.linear_regression(part, "p_size", "p_retailprice")
    ends = trend.trend_extremes(trend.trend(part, "p_size", "p_retailprice"))
    return rounded(insights.regression_insights("p_size", "p_retailprice", line, ends), 4, "value")


@query(
    "corr_insights",
    f"""WITH {PRICE_TREND}, r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT 1::BIGINT AS position, 'relation' AS code, 'l_extendedprice ~ l_quantity' AS subject,
  CASE WHEN abs(r) < 0.1 THEN 'none' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate'
       WHEN abs(r) < 0.7 THEN 'noticeable' ELSE 'strong' END || CASE WHEN r > 0 THEN ' direct' ELSE ' inverse' END AS detail,
  round(r, 4) AS value FROM r
UNION ALL SELECT 2, 'highest_group', 'l_quantity', (SELECT label FROM points ORDER BY y DESC, point LIMIT 1),
  (SELECT round(max(y), 4) FROM points)
UNION ALL SELECT 3, 'lowest_group', 'l_quantity', (SELECT label FROM points ORDER BY y, point LIMIT 1),
  (SELECT round(min(y), 4) FROM points)
UNION ALL SELECT 4, 'not_causal', 'l_extendedprice ~ l_quantity', 'correlation does not prove a cause', NULL""",
)
def _corr_insights(spark, sf):
    df = table(spark, sf, "lineitem")
    pair = ("l_extendedprice", "l_quantity")
    ends = trend.trend_extremes(trend.trend(df, *pair))
    return rounded(insights.correlation_insights(*pair, corr.correlation(df, *pair), ends), 4, "value")

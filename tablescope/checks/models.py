"""Queries over model preparation, prediction quality and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.checks.inputs import DIRTY, dirty, table
from tablescope.checks.registry import query, rounded
from tablescope.operators.encoding import feature_entries
from tablescope.operators import metrics, modeling
from tablescope.operators.classes import class_distribution
from tablescope.plans.insights import model_verdict

FEATURES = ["l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "constant"]
FLAG = "coalesce(l_returnflag, '__missing__')"


@query(
    "model_matrix",
    f"""WITH {DIRTY} SELECT l_linestatus, l_orderkey::DOUBLE AS l_orderkey, l_quantity, l_discount,
  round(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM dirty)), 6) AS l_tax, {FLAG} AS l_returnflag FROM dirty""",
)
def _model_matrix(spark, sf):
    matrix = modeling.model_matrix(dirty(spark, sf), "l_linestatus", FEATURES)
    return rounded(matrix.df, 6, "l_tax")


@query(
    "one_hot",
    f"""WITH {DIRTY} SELECT l_orderkey::DOUBLE AS l_orderkey,
  CASE WHEN {FLAG} = 'N' THEN 1.0 ELSE 0.0 END::DOUBLE AS l_returnflag__N,
  CASE WHEN {FLAG} = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS l_returnflag__R,
  CASE WHEN {FLAG} = '__missing__' THEN 1.0 ELSE 0.0 END::DOUBLE AS l_returnflag____missing__ FROM dirty""",
)
def _one_hot(spark, sf):
    matrix = modeling.model_matrix(dirty(spark, sf), "l_linestatus", ["l_orderkey", "l_returnflag"])
    return modeling.one_hot(matrix.df, matrix.values()).drop("l_linestatus")


@query(
    "feature_vector_sums",
    f"""WITH {DIRTY}, s AS (SELECT sum(l_orderkey) AS a, sum(CASE WHEN {FLAG} = '__missing__' THEN 1 ELSE 0 END) AS m,
  sum(CASE WHEN {FLAG} = 'R' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN {FLAG} = 'N' THEN 1 ELSE 0 END) AS n FROM dirty)
SELECT 'l_orderkey' AS feature, 'l_orderkey' AS source, a::DOUBLE AS total FROM s
UNION ALL SELECT 'l_returnflag____missing__', 'l_returnflag', m::DOUBLE FROM s
UNION ALL SELECT 'l_returnflag__R', 'l_returnflag', r::DOUBLE FROM s
UNION ALL SELECT 'l_returnflag__N', 'l_returnflag', n::DOUBLE FROM s""",
)
def _feature_vector_sums(spark, sf):
    return _sums(modeling.model_matrix(dirty(spark, sf), "l_linestatus", ["l_orderkey", "l_returnflag"]))


def _sums(matrix):
    sums = feature_entries(modeling.encode(matrix)).groupBy("position").agg(F.sum("value").alias("total"))
    return modeling.encoded_names(matrix).join(sums, "position").drop("position")


@query(
    "feature_vector_distinct_text",
    """WITH o AS (SELECT 'k' || o_orderkey AS key, o_orderpriority, o_totalprice FROM orders), p AS (SELECT min(o_orderpriority) AS base FROM o)
SELECT 'o_totalprice' AS feature, 'o_totalprice' AS source, round(sum(o_totalprice), 2) AS total FROM o
UNION ALL SELECT 'key__' || key, 'key', count(*)::DOUBLE FROM o WHERE key <> (SELECT min(key) FROM o) GROUP BY key
UNION ALL SELECT 'o_orderpriority__' || o_orderpriority, 'o_orderpriority', count(*)::DOUBLE FROM o, p WHERE o_orderpriority <> base GROUP BY 1""",
)
def _feature_vector_distinct_text(spark, sf):
    """A text key whose values are all distinct: its dictionary is a table, never a list."""
    orders = table(spark, sf, "orders")
    df = orders.select("o_orderstatus", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"), "o_orderpriority", "o_totalprice")
    return rounded(_sums(modeling.model_matrix(df, "o_orderstatus")), 2, "total")


@query(
    "impute_notes",
    f"""WITH {DIRTY} SELECT 'l_tax' AS column_name, (count(*) - count(l_tax))::BIGINT AS missing_count, 'median' AS method FROM dirty
UNION ALL SELECT 'l_returnflag', (count(*) - count(l_returnflag))::BIGINT, 'category' FROM dirty""",
)
def _impute_notes(spark, sf):
    return modeling.model_matrix(dirty(spark, sf), "l_linestatus", FEATURES).notes


@query(
    "split_counts",
    f"""WITH {DIRTY}, c AS (SELECT l_linenumber::BIGINT AS label, count(*) AS n FROM dirty GROUP BY 1),
t AS (SELECT label, n, ceil(0.2::DOUBLE * sum(n) OVER ()) * n / sum(n) OVER () AS exact,
        ceil(0.2::DOUBLE * sum(n) OVER ()) AS size FROM c),
f AS (SELECT label, n, floor(exact) AS base, size,
        row_number() OVER (ORDER BY exact - floor(exact) DESC, label::VARCHAR) AS i FROM t),
s AS (SELECT label, n, base + CASE WHEN i <= size - sum(base) OVER () THEN 1 ELSE 0 END AS test FROM f)
SELECT label, test::BIGINT AS test_rows, (n - test)::BIGINT AS train_rows FROM s""",
)
def _split_counts(spark, sf):
    df = dirty(spark, sf)
    train, test = modeling.split(df, "l_linenumber")
    label = F.col("l_linenumber").alias("label")
    a = test.groupBy(label).agg(F.count(F.lit(1)).alias("test_rows"))
    b = train.groupBy(label).agg(F.count(F.lit(1)).alias("train_rows"))
    return a.join(b, "label")


@query(
    "split_counts_many_classes",
    """WITH c AS (SELECT l_orderkey AS label, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT label, n, ceil(0.2::DOUBLE * sum(n) OVER ())::BIGINT AS size, (sum(n) OVER ())::BIGINT AS total FROM c),
f AS (SELECT label, n, size * n // total AS base, size, row_number() OVER (ORDER BY size * n % total DESC, label::VARCHAR) AS i FROM t),
s AS (SELECT label, n, base + CASE WHEN i <= size - sum(base) OVER () THEN 1 ELSE 0 END AS test FROM f)
SELECT label, test::BIGINT AS test_rows, (n - test)::BIGINT AS train_rows FROM s""",
)
def _split_counts_many_classes(spark, sf):
    """A class per order: their counts and shares of the test part stay a table."""
    train, test = modeling.split(table(spark, sf, "lineitem"), "l_orderkey")
    sides = [part.select(F.col("l_orderkey").alias("label"), F.lit(n).alias("test")) for part, n in ((train, 0), (test, 1))]
    counted = sides[0].unionByName(sides[1]).groupBy("label")
    return counted.agg(F.sum("test").alias("test_rows"), F.sum(1 - F.col("test")).alias("train_rows"))


@query(
    "split_keeps_every_row",
    f"WITH {DIRTY} SELECT l_orderkey, l_extendedprice, count(*)::BIGINT AS copies FROM dirty GROUP BY 1, 2",
)
def _split_keeps_every_row(spark, sf):
    train, test = modeling.split(dirty(spark, sf), "l_linestatus")
    both = train.unionByName(test)
    return both.groupBy("l_orderkey", "l_extendedprice").agg(F.count(F.lit(1)).alias("copies"))


# -- prediction quality: a fixed rule stands in for a model ----------------------

PREDICTED = """p AS (SELECT l_returnflag AS label, CASE WHEN l_quantity > 25 THEN 'A' ELSE l_returnflag END AS prediction
  FROM lineitem)"""
SCORES = f"""{PREDICTED}, l AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT prediction FROM p),
k AS (SELECT c, (SELECT count(*) FROM p WHERE label = c)::DOUBLE AS support,
    (SELECT count(*) FROM p WHERE prediction = c)::DOUBLE AS predicted,
    (SELECT count(*) FROM p WHERE label = c AND prediction = c)::DOUBLE AS hits FROM l),
s AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
    coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM k)"""


def _predicted(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("label"),
        F.when(c("l_quantity") > 25, "A").otherwise(c("l_returnflag")).alias("prediction"),
    )


@query(
    "confusion_matrix",
    f"""WITH {PREDICTED}, l AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT prediction FROM p)
SELECT a.c AS label, b.c AS prediction, count(p.label)::BIGINT AS rows_count
FROM l a CROSS JOIN l b LEFT JOIN p ON p.label = a.c AND p.prediction = b.c GROUP BY 1, 2""",
)
def _confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_predicted(spark, sf), "label", "prediction")


@query(
    "classification_metrics",
    f"""WITH {SCORES} SELECT round(sum(hits) / sum(support), 6) AS accuracy,
  round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(precision), 6) AS precision_macro,
  round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM s""",
)
def _classification_metrics(spark, sf):
    found = metrics.classification_metrics(metrics.confusion_matrix(_predicted(spark, sf), "label", "prediction"))
    return rounded(found, 6, *found.columns)


@query(
    "classification_report",
    f"""WITH {SCORES}, r AS (SELECT c AS label, precision, recall, f1, support FROM s
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM s)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM r""",
)
def _classification_report(spark, sf):
    found = metrics.classification_report(metrics.confusion_matrix(_predicted(spark, sf), "label", "prediction"))
    return rounded(found, 6, "precision", "recall", "f1")


@query(
    "regression_metrics",
    """WITH p AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS z FROM lineitem)
SELECT round(avg(abs(y - z)), 4) AS mae, round(sqrt(avg((y - z) * (y - z))), 4) AS rmse,
  round(1 - avg((y - z) * (y - z)) / var_pop(y), 6) AS r2 FROM p""",
)
def _regression_metrics(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("z", 1500 * F.col("l_quantity"))
    found = metrics.regression_metrics(df, "l_extendedprice", "z")
    return rounded(rounded(found, 4, "mae", "rmse"), 6, "r2")


@query(
    "regression_target_summary",
    f"""WITH {DIRTY} SELECT min(l_tax) AS min, round(quantile_cont(l_tax, 0.5), 6) AS median, max(l_tax) AS max,
  round(avg(l_tax), 6) AS mean FROM dirty""",
)
def _regression_target_summary(spark, sf):
    return rounded(modeling.regression_target_summary(dirty(spark, sf), "l_tax"), 6, "median", "mean")


SHARES = """i AS (
  SELECT 'l_returnflag__' || l_returnflag AS feature, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS importance
  FROM lineitem GROUP BY 1
  UNION ALL SELECT 'l_linestatus__' || l_linestatus, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) * 0.5
  FROM lineitem GROUP BY 1
  UNION ALL SELECT 'l_discount', avg(l_discount) FROM lineitem)"""


def _shares(spark, sf):
    """Importances that follow from the table: class shares and a mean."""
    df = table(spark, sf, "lineitem")
    n = df.count()

    def share(column, factor):
        name = F.concat(F.lit(f"{column}__"), F.col(column)).alias("feature")
        return df.groupBy(name).agg((F.count(F.lit(1)) / F.lit(float(n)) * factor).alias("importance"))

    mean = df.agg(F.lit("l_discount").alias("feature"), F.avg("l_discount").alias("importance"))
    found = share("l_returnflag", 1.0).unionByName(share("l_linestatus", 0.5)).unionByName(mean)
    sources = found.select("feature", F.split("feature", "__")[0].alias("source"))
    return found, sources


@query(
    "importance_rollup",
    f"""WITH {SHARES} SELECT split_part(feature, '__', 1) AS feature, round(sum(importance), 6) AS importance
FROM i GROUP BY 1""",
)
def _importance_rollup(spark, sf):
    return rounded(metrics.rollup_importance(*_shares(spark, sf)), 6, "importance")


@query(
    "model_verdict",
    f"""WITH {SCORES}, {SHARES}, d AS (SELECT l_quantity > 40 AS large, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 1::BIGINT AS position, 'best_model' AS code, 'rule' AS subject, 'balanced_accuracy' AS detail,
  (SELECT round(avg(recall), 6) FROM s) AS value
UNION ALL SELECT 2, 'class_imbalance', '', 'prefer balanced accuracy and macro F1', (SELECT round(max(n)::DOUBLE / min(n), 6) FROM d)
UNION ALL SELECT 3, 'top_feature', feature, 'importance', value FROM (
  SELECT split_part(feature, '__', 1) AS feature, round(sum(importance), 6) AS value FROM i GROUP BY 1 ORDER BY 2 DESC LIMIT 1)""",
)
def _model_verdict(spark, sf):
    df = _predicted(spark, sf)
    always = metrics.confusion_matrix(df.withColumn("prediction", F.lit("A")), "label", "prediction")
    rule = metrics.confusion_matrix(df, "label", "prediction")
    scores = metrics.classification_metrics(always).select(F.lit("constant").alias("model"), "*")
    scores = scores.unionByName(metrics.classification_metrics(rule).select(F.lit("rule").alias("model"), "*"))
    uneven = table(spark, sf, "lineitem").select((F.col("l_quantity") > 40).alias("large"))
    verdict = model_verdict(
        scores, metrics.rollup_importance(*_shares(spark, sf)), class_distribution(uneven, "large")
    )
    return rounded(verdict, 6, "value")


# -- model comparison: targets with a known answer, forests of full size -----------

SIZES = "SELECT count(*) AS n, ceil(0.2::DOUBLE * count(*)) AS test FROM lineitem"


@query(
    "model_compare_classification",
    f"""WITH s AS ({SIZES}), c AS (SELECT l_returnflag = 'R' AS label, count(*) AS k FROM lineitem GROUP BY 1),
m(model) AS (VALUES ('Random Forest'), ('Logistic Regression'))
SELECT model, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS balanced_accuracy, 1.0::DOUBLE AS precision_macro,
  1.0::DOUBLE AS recall_macro, 1.0::DOUBLE AS f1_macro, 1.0::DOUBLE AS f1_weighted, (n - test)::BIGINT AS rows_train,
  test::BIGINT AS rows_test, (SELECT max(k) FROM c)::BIGINT AS largest_class, 'l_returnflag' AS first_feature,
  CASE model WHEN 'Logistic Regression' THEN true END AS optimal FROM s, m""",
)
def _model_compare_classification(spark, sf):
    """A flag that both models can learn exactly; the logistic one also proves its optimum."""
    returned = F.when(F.col("l_returnflag") == "R", "returned").otherwise("kept").alias("label")
    df = table(spark, sf, "lineitem").select(returned, "l_discount", "l_linenumber", "l_returnflag")
    found = modeling.compare_models(df, "label")
    scores = rounded(found["metrics"], 6, *[c for c in found["metrics"].columns if c != "model"])
    largest = found["class_distribution"].agg(F.max("rows_count").alias("largest_class"))
    best = found["importance"].orderBy(F.desc("importance")).limit(1).select(F.col("feature").alias("first_feature"))
    proof = found["certificate"].select("model", (F.col("gradient") < 1e-4).alias("optimal"))
    return scores.crossJoin(found["rows"]).crossJoin(largest).crossJoin(best).join(proof, "model", "left")


@query(
    "model_compare_regression",
    f"""WITH s AS ({SIZES}), m(model) AS (VALUES ('Linear Regression'), ('Random Forest Regressor'))
SELECT model, 0.0::DOUBLE AS mae, 0.0::DOUBLE AS rmse, 1.0::DOUBLE AS r2,
  (n - test)::BIGINT AS rows_train, test::BIGINT AS rows_test,
  (SELECT max(3 * l_linenumber - 2)::DOUBLE FROM lineitem) AS target_max,
  CASE model WHEN 'Linear Regression' THEN true END AS optimal FROM s, m""",
)
def _model_compare_regression(spark, sf):
    """A line through seven places, which a line and a tree both meet exactly."""
    y = (3 * F.col("l_linenumber") - 2).alias("y")
    df = table(spark, sf, "lineitem").select(y, "l_linenumber", "l_discount")
    found = modeling.compare_models(df, "y", "regression")
    scores = rounded(found["metrics"], 6, "mae", "rmse", "r2")
    top = found["target_summary"].select(F.round("max", 6).alias("target_max"))
    proof = found["certificate"].select("model", (F.col("gradient") < 1e-4).alias("optimal"))
    return scores.crossJoin(found["rows"]).crossJoin(top).join(proof, "model", "left")


@query(
    "model_logistic_certificate",
    """SELECT true AS optimal, true AS worse_elsewhere, count(DISTINCT l_returnflag)::BIGINT AS classes FROM lineitem""",
)
def _model_logistic_certificate(spark, sf):
    """Three classes that the features don't separate: the loss is least where the logistic model stands."""
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_linestatus")
    found = modeling.compare_models(df, "l_returnflag", num_trees=1, max_depth=1)
    proof = found["certificate"].where("model = 'Logistic Regression'")
    classes = found["class_distribution"].agg(F.count(F.lit(1)).alias("classes"))
    return proof.select((F.col("gradient") < 1e-4).alias("optimal"), (F.col("nudged_gradient") > F.col("gradient")).alias("worse_elsewhere")).crossJoin(classes)


@query(
    "model_forest_nodes",
    """SELECT (3 * l_linenumber - 2)::DOUBLE AS prediction, 160::BIGINT AS trees FROM lineitem GROUP BY 1""",
)
def _model_forest_nodes(spark, sf):
    """Every tree of a full forest ends in one value per place of the line."""
    y = (3 * F.col("l_linenumber") - 2).alias("y")
    df = table(spark, sf, "lineitem").select(y, "l_linenumber", "l_discount")
    nodes = modeling.compare_models(df, "y", "regression", nodes=True)["forest_nodes"]
    return nodes.where("left IS NULL").groupBy(F.round("prediction", 6).alias("prediction")).agg(F.countDistinct("tree").alias("trees"))


@query(
    "model_forest_walk",
    f"""WITH s AS ({SIZES}) SELECT test::BIGINT AS rows_walked, test::BIGINT AS rows_same, true AS same_importance,
  20::BIGINT AS whole_trees FROM s""",
)
def _model_forest_walk(spark, sf):
    """Test rows walked down the node table beside the model's own shares; a whole tree has one leaf more than splits."""
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_linestatus")
    found = modeling.compare_models(df, "l_returnflag", num_trees=20, max_depth=6, nodes=True)
    trees = found["forest_nodes"].groupBy("tree").agg(F.sum(F.when(F.col("left").isNull(), 1).otherwise(-1)).alias("more"))
    whole = trees.where("more = 1").agg(F.count(F.lit(1)).alias("whole_trees"))
    check = found["forest_check"]
    return check.select("rows_walked", "rows_same", (F.col("importance_gap") < 1e-9).alias("same_importance")).crossJoin(whole)

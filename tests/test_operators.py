"""Operators on small literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from tablescope.operators import classes, clean, corr, features, metrics, modeling, profile, quality, stats, trend
from tablescope.operators.catalog import DICTIONARY_SCHEMA
from tablescope.plans import insights


@pytest.fixture(scope="module")
def base(spark):
    rows = [(i, 2 * i, "ab"[(i - 1) % 2], (i - 1) % 2) for i in range(1, 9)]
    return spark.createDataFrame(rows, "feature bigint, target_num bigint, category string, class_target bigint")


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_perfect_correlation_and_grouped_trend(base):
    row = corr.correlation(base, "feature", "target_num").first()
    assert row["coefficient"] == pytest.approx(1.0) and row["rows_used"] == 8
    points = trend.trend(base, "feature", "target_num").collect()
    assert {p["kind"] for p in points} == {"grouped"} and len(points) == 8
    assert [p["label"] for p in sorted(points, key=lambda p: p["point"])][:2] == ["1", "2"]


def test_binned_trend(spark):
    df = spark.createDataFrame([(i, i * 1.5) for i in range(60)], "feature bigint, target_num double")
    points = trend.trend(df, "feature", "target_num").orderBy("point").collect()
    assert {p["kind"] for p in points} == {"binned"} and len(points) == 7
    assert sum(p["rows_count"] for p in points) == 60
    assert points[0]["label"] == "-0.00 - 8.43"


def test_spearman_ties_and_monotone(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 8), (2.0, 27), (4.0, 64)], "x double, y int")
    row = corr.correlation(df, "x", "y", "spearman").first()
    assert row["coefficient"] == pytest.approx(0.9486832980505138)


def test_regression(base, spark):
    row = trend.linear_regression(base, "feature", "target_num").first()
    assert row["slope"] == pytest.approx(2) and row["intercept"] == pytest.approx(0) and row["r2"] == pytest.approx(1)
    assert (row["direction"], row["fit"]) == ("rises", "good")
    flat = spark.createDataFrame([(5, 1.0), (5, 3.0)], "x int, y double")
    assert trend.linear_regression(flat, "x", "y").first()[:3] == (0.0, 2.0, 0.0)
    even = spark.createDataFrame([(5, 3.0), (6, 3.0)], "x int, y double")
    assert trend.linear_regression(even, "x", "y").first()[:3] == (0.0, 3.0, 1.0)


def test_outliers(spark):
    constant = spark.createDataFrame([(5,)] * 4, "constant int")
    count, listed = stats.outliers(constant, "constant")
    assert count.first()[0] == 0 and listed.count() == 0
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 100)], "value int")
    assert stats.outliers(df, "value", 1.5)[0].first()[0] == 1
    row = stats.outlier_summary(df, "value").first()
    assert (row["q1"], row["median"], row["q3"], row["iqr_upper"]) == (2, 3, 4, 7)
    with pytest.raises(ValueError, match="Threshold"):
        stats.outliers(df, "value", 0)


def test_histograms(base, spark):
    bins = stats.histogram(base, "feature", 4).orderBy("bin").collect()
    assert [b["rows_count"] for b in bins] == [2, 2, 2, 2] and bins[-1]["bin_right"] == 8
    assert values(stats.histogram(base, "category"), "label", "rows_count") == [("a", 4), ("b", 4)]
    constant = spark.createDataFrame([(5,)] * 3, "c int")
    assert sum(b["rows_count"] for b in stats.histogram(constant, "c", 3).collect()) == 3
    with pytest.raises(ValueError):
        stats.histogram(base, "feature", 1)


def test_missing_and_nan_are_one(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), None), (None, 3)], "a double, b int")
    assert values(profile.missing_values(df), "column_name", "missing_count") == [("a", 2), ("b", 1)]


def test_ranking_pairwise_rows(spark):
    rows = [(1, 2, None, 7), (2, None, None, 7), (3, 6, None, 7), (4, 8, None, 7), (5, None, None, 7)]
    df = spark.createDataFrame(rows, "target int, feature int, empty int, fixed int")
    for method in corr.METHODS:
        assert values(corr.rank_features(df, "target", method), "feature", "rows_used") == [("feature", 3)]
    found = corr.rank_features(df, "target")
    assert insights.ranking_insights("target", found).first()["subject"] == "feature"


def test_correlation_errors(base, spark):
    with pytest.raises(ValueError, match="Unknown correlation method"):
        corr.correlation(base, "feature", "target_num", "kendall")
    poor = spark.createDataFrame([(None, None), (1.0, None)], "x double, y string")
    with pytest.raises(ValueError, match="Not enough numeric rows"):
        corr.correlation(poor, "x", "y")
    flat = spark.createDataFrame([(1, 2), (1, 3)], "x int, y int")
    for method in corr.METHODS:
        with pytest.raises(ValueError, match="constant"):
            corr.correlation(flat, "x", "y", method)


def test_matrix_constant_and_pairwise_constant(spark):
    # x is constant on the rows where z is known
    rows = [(1.0, 1, None), (2.0, 2, None), (3.0, 5, 1), (3.0, 7, 2)]
    df = spark.createDataFrame(rows, "x double, y int, z int")
    for method in corr.METHODS:
        cells = {(r["row_name"], r["column_name"]): r["value"] for r in corr.correlation_matrix(df, method).collect()}
        assert cells["x", "z"] == 0 and cells["z", "x"] == 0 and cells["y", "z"] == 1 and cells["x", "x"] == 1
    with pytest.raises(ValueError, match="two numeric"):
        corr.correlation_matrix(df.select("x"))


def test_profile_roles(spark):
    rows = [(i % 2, i % 4, i * 1.5, f"text {i}", 1, None) for i in range(40)]
    df = spark.createDataFrame(rows, "bin int, code int, num double, txt string, one int, none string")
    found = {r["column_name"]: r["role"] for r in profile.column_profile(df).collect()}
    assert found == {"bin": "binary", "code": "categorical_encoded", "num": "continuous", "txt": "text",
                     "one": "constant", "none": "constant"}
    rough = {r["column_name"]: r["role"] for r in profile.column_profile(df, exact=False).collect()}
    assert rough == found


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert {r["missing_percent"] for r in profile.column_profile(df).collect()} == {0.0}
    assert profile.duplicate_count(df) == 0


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (None, 5.0)], ["a.1", "b c"])
    assert corr.correlation(df, "a.1", "b c").first()["rows_used"] == 2
    assert clean.clean(df, missing="fill_median")[0].where("`a.1` is null").count() == 0


def test_clean_dirty_table(spark):
    rows = [(1, 0, 5, "a"), (1, 0, 5, "a"), (2, 1, 5, "b"), (3, None, 5, "c"), (0, 1, 5, None)]
    df = spark.createDataFrame(rows, "feature bigint, target bigint, constant bigint, text string")
    assert profile.duplicate_count(df) == 1
    cleaned, changes = clean.clean(
        df, zero_as_missing=["feature"], drop_constant=True, drop_duplicate_rows=True, missing="smart_fill"
    )
    assert cleaned.count() == 4 and cleaned.columns == ["feature", "target", "text"]
    assert cleaned.where("feature is null or target is null or text is null").count() == 0
    assert cleaned.where("feature = 2").count() == 2  # median of 1, 2, 3
    assert [r["action"] for r in changes.orderBy("position").collect()] == [
        "zero_to_missing", "drop_column", "drop_duplicate_rows", "fill_missing", "fill_missing", "fill_missing"
    ]


def test_clean_errors(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    with pytest.raises(ValueError, match="removed all rows"):
        clean.clean(df, missing="drop_rows")
    with pytest.raises(ValueError, match="must be a list"):
        clean.clean(df, zero_as_missing="a")
    with pytest.raises(ValueError, match="Unknown missing"):
        clean.clean(df, missing="guess")
    with pytest.raises(ValueError, match="all columns"):
        clean.clean(df, drop=["a", "b"])


def test_fill_keeps_fraction_and_smallest_mode(spark):
    df = spark.createDataFrame([(2, "b"), (3, "a"), (None, None)], "n int, t string")
    cleaned, _ = clean.clean(df, missing="fill_median")
    assert (2.5, "a") in values(cleaned, "n", "t")


def test_classes(spark):
    df = spark.createDataFrame([(" x", 1), ("x", 2), ("y", 7), (None, 12)], "label string, value int")
    made = classes.create_class(df, "value", [{"code": "lo", "max": 5}, {"code": "hi", "min": 5, "label": "High"}])
    assert made.column == "value_class" and made.unmatched == 0
    assert values(made.descriptions, "code", "description") == [("lo", "-∞ - 5.0"), ("hi", "High")]
    again = classes.create_class(made.df, "label", [{"code": "1", "values": ["x"]}, {"code": "2", "values": [" y"]}],
                                 "values", "value_class")
    assert again.column == "value_class_2" and again.unmatched == 1
    assert values(again.distribution, "label", "rows_count") == [("1", 2), ("2", 1)]


@pytest.mark.parametrize(
    "rules, message",
    [
        ([], "required"),
        ([{"code": "", "min": 1}], "code"),
        ([{"code": "a"}], "at least min or max"),
        ([{"code": "a", "min": "z"}], "numeric"),
        ([{"code": "a", "min": 10, "max": 5}], "greater"),
        ([{"code": "a", "min": 1000}], "did not match"),
        ([{"code": "a", "min": 0}], "at least two"),
        ([{"code": "a", "min": 0}] * 31, "Too many"),
    ],
)
def test_class_rule_errors(spark, rules, message):
    df = spark.createDataFrame([(1,), (7,)], "value int")
    with pytest.raises(ValueError, match=message):
        classes.create_class(df, "value", rules)


def test_describe(base):
    numeric = {r["column_name"]: r for r in stats.describe_numeric(base).collect()}
    assert numeric["feature"]["mean"] == 4.5 and numeric["feature"]["q25"] == 2.75
    assert numeric["feature"]["std"] == pytest.approx(math.sqrt(6))
    text = stats.describe_categorical(base).first()
    assert (text["unique_count"], text["top"], text["freq"]) == (2, "a", 4)
    assert stats.describe(base).where("column_name = 'category'").count() == 4


def test_options(spark):
    rows = [(i, i % 7, "xyz"[i % 3], i * 1.25) for i in range(60)]
    df = spark.createDataFrame(rows, "identifier int, feature int, target string, price double")
    found = profile.column_profile(df)
    notes = spark.createDataFrame(
        [("u", "identifier", "", "identifier", {}, "", None), ("u", "target", "", "target", {}, "feature", None)],
        DICTIONARY_SCHEMA,
    )
    options = {r["column_name"]: r["task_types"] for r in features.target_options(found, notes).collect()}
    assert options == {"identifier": "", "feature": "classification", "target": "classification", "price": "regression"}
    chosen = features.feature_options(found, notes, "target")
    assert features.select_features(chosen) == ["price"]
    assert features.select_features(chosen, ["feature", "target", "feature"]) == ["feature"]
    with pytest.raises(ValueError):
        features.select_features(chosen, ["target"])
    assert features.infer_task(found, "price") == "regression"
    assert features.infer_task(found, "nothing", "classification") == "classification"


def test_class_sources_and_warnings(base):
    found = quality.dataset_profile(base)
    codes = {r["code"] for r in found["warnings"].collect()}
    assert "encoded_categories" in codes and "missing_values" not in codes
    assert quality.cleaning_plan(base)["summary"].first()["duplicate_rows"] == 0


def test_compare_classification(spark):
    rows = [(20 + i, 20 + i % 8, "yes" if i % 2 else "no", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "age int, bmi int, smoker string, target int")
    found = modeling.compare_models(df, "target")
    assert found["metrics"].count() == 2 and found["rows"].first()[:] == (32, 8)
    assert found["importance"].first()["feature"] == "smoker"
    best = found["metrics"].agg(F.max("balanced_accuracy")).first()[0]
    assert best == 1.0
    verdict = insights.model_verdict(found["metrics"], found["importance"], found["class_distribution"])
    assert {r["code"] for r in verdict.collect()} == {"best_model", "top_feature"}


def test_compare_regression_imputes(spark):
    rows = [(80, 2, "a", 100), (95, 2, "a", 115), (110, None, "a", 128), (140, 3, "b", 150), (160, 3, "b", 170),
            (190, 4, None, 205), (210, 4, "c", 230), (240, 5, "c", 260), (260, 5, "d", 280), (300, 6, "d", 320)]
    df = spark.createDataFrame(rows, "area int, rooms int, district string, price int")
    found = modeling.compare_models(df, "price", "regression", ["area", "rooms", "district"])
    assert found["preprocessing"].count() == 2 and "rmse" in found["metrics"].columns
    assert found["metrics"].count() == 2 and found["target_summary"].first()["median"] == 187.5


def test_compare_errors(spark):
    df = spark.createDataFrame([(i, i * 0.5, 1, "t") for i in range(40)], "f int, t double, one int, s string")
    with pytest.raises(ValueError, match="categorical"):
        modeling.compare_models(df, "t", features=["f"])
    with pytest.raises(ValueError, match="two classes"):
        modeling.compare_models(df, "one", features=["f"])
    with pytest.raises(ValueError, match="no numeric values"):
        modeling.compare_models(df, "s", "regression", ["f"])
    with pytest.raises(ValueError, match="No feature columns"):
        modeling.compare_models(df, "t", features=[])
    with pytest.raises(ValueError, match="No variable feature"):
        modeling.compare_models(df, "f", features=["one"])


def test_metrics_with_unpredicted_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    row = metrics.classification_metrics(metrics.confusion_matrix(df, "y", "p")).first()
    assert row["accuracy"] == 0.5
    assert row["balanced_accuracy"] == pytest.approx(0.5)
    assert row["precision_macro"] == pytest.approx((1 + 1 / 3) / 3)


def test_duplicates_tell_maps_apart(spark):
    from tablescope.operators.clean import clean, drop_duplicates
    from tablescope.operators.profile import duplicate_count

    rows = [(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (1, {"a": 3})]
    df = spark.createDataFrame(rows, "k int, m map<string, int>")
    assert duplicate_count(df) == 1 and drop_duplicates(df).count() == 2
    assert clean(df, drop_duplicate_rows=True)[0].count() == 2


def test_depth_and_empty_ranges_are_errors(spark):
    from tablescope.operators.classes import suggest_class_rules

    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "f int, t int")
    with pytest.raises(ValueError, match="levels deep"):
        modeling.compare_models(df, "t", max_depth=31)
    with pytest.raises(ValueError, match="no values"):
        suggest_class_rules(spark.createDataFrame([(None,)], "x double"), "x")

"""Node tables of forests: thresholds, categories, one-leaf trees, importances."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tablescope.operators import forests, modeling


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = [(i, [float(rng.randrange(4)), rng.random(), float(rng.randrange(3))]) for i in range(300)]
    made = [(i, x, float(x[0] in (1, 3)) if x[1] < 0.7 else x[2], 5 * x[1] + x[2]) for i, x in made]
    df = spark.createDataFrame(made, "id long, x array<double>, label double, y double")
    # the first feature has categories, so its splits are sets
    kinds = {"ml_attr": {"attrs": {"nominal": [{"idx": 0, "name": "a", "vals": ["p", "q", "r", "s"]}], "numeric": [{"idx": 1, "name": "b"}, {"idx": 2, "name": "c"}]}, "num_attrs": 3}}
    return df.withColumn("features", array_to_vector("x").alias("features", metadata=kinds)).cache()


def leaf(nodes, tree, x):
    """Plain walk down one tree."""
    at = nodes[tree, 0]
    while at.left is not None:
        left = x[at.feature] in at.categories if at.categories is not None else x[at.feature] <= at.threshold
        at = nodes[tree, at.left if left else at.right]
    return at


def test_classes(rows, monkeypatch):
    monkeypatch.setattr(forests, "LEVELS", 3)
    model = RandomForestClassifier(labelCol="label", numTrees=7, maxDepth=9, seed=3).fit(rows)
    forest = forests.forest_nodes(model)
    assert forest.depth > 2 * forests.LEVELS  # rows are written between levels
    nodes = {(n.tree, n.node): n for n in forest.nodes.collect()}
    assert any(n.categories for n in nodes.values()) and any(n.threshold is not None for n in nodes.values())
    found = {r.row: r for r in forests.walked(forest, rows, "id").collect()}
    told = {r.id: r for r in model.transform(rows).select("id", "x", "probability").collect()}
    assert found.keys() == told.keys()
    for i, r in told.items():
        plain = [sum(leaf(nodes, t, r.x).shares[c] for t in range(7)) / 7 for c in range(3)]
        assert found[i].shares == pytest.approx(plain) and found[i].shares == pytest.approx(list(r.probability))
        assert plain[int(found[i].prediction)] == pytest.approx(max(plain))
    own = {r.position: r.importance for r in forests.node_importances(forest).collect()}
    assert [own.get(i, 0.0) for i in range(3)] == pytest.approx(list(model.featureImportances.toArray()))
    check = forests.forest_check(model, forest, rows).first()
    assert (check.rows_walked, check.rows_same) == (300, 300) and check.importance_gap < 1e-9


def test_another_forest_is_noticed(rows):
    first, second = (RandomForestClassifier(labelCol="label", numTrees=3, maxDepth=4, seed=s).fit(rows) for s in (1, 2))
    check = forests.forest_check(first, forests.forest_nodes(second), rows).first()
    assert check.rows_same < check.rows_walked and check.importance_gap > 1e-6


def test_numbers_and_trees_of_one_leaf(rows):
    model = RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=5, seed=3).fit(rows)
    check = forests.forest_check(model, forests.forest_nodes(model), rows).first()
    assert (check.rows_walked, check.rows_same) == (300, 300) and check.importance_gap < 1e-9
    flat = RandomForestRegressor(labelCol="same", numTrees=2, seed=3).fit(rows.withColumn("same", F.lit(2.5)))
    forest = forests.forest_nodes(flat)
    assert forest.depth == 0 and {r.prediction for r in forests.walked(forest, rows, "id").collect()} == {2.5}
    assert forests.node_importances(forest).count() == 0
    assert forests.walked(forest, rows.limit(0), "id").count() == 0


def test_comparison_gives_nodes_only_when_asked(rows):
    df = rows.select(F.col("label").cast("int").cast("string").alias("label"), F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    found = modeling.compare_models(df, "label", num_trees=3, max_depth=3, nodes=True)
    check = found["forest_check"].first()
    assert check.rows_walked == check.rows_same == found["rows"].first().rows_test
    assert found["forest_nodes"].where("node = 0").count() == 3
    assert "forest_nodes" not in modeling.compare_models(df, "label", num_trees=1, max_depth=1)


def test_check_walks_rows_of_one_place_once(rows, monkeypatch):
    """Rows between the same thresholds are walked once, with all of them counted; wide rows fold if they are equal."""
    model = RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=3, seed=6).fit(rows)
    forest, walked, seen = forests.forest_nodes(model), forests.walked, []
    monkeypatch.setattr(forests, "walked", lambda f, points, *a: seen.append(points.count()) or walked(f, points, *a))
    many = rows.unionByName(rows).unionByName(rows)
    for width in (forests.FOLDED_WIDTH, 1):
        monkeypatch.setattr(forests, "FOLDED_WIDTH", width)
        check = forests.forest_check(model, forest, many).first()
        assert (check.rows_walked, check.rows_same) == (900, 900) and check.importance_gap < 1e-9
    assert seen[0] < 150 and seen[1] == 300

"""Forests for numbers grown from cells of equal rows: bootstrap sums, trees, thresholds, the comparison on top."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tablescope.operators import forests, modeling


@pytest.fixture(scope="module")
def made():
    rng = random.Random(12)
    rows = [(float(rng.randrange(7)), rng.gauss(0, 3)) for _ in range(6000)]
    return [(a, b, 1e6 + (4 * a if b < 1 else b * b) + rng.gauss(0, 1)) for a, b in rows]


def test_sums_are_those_of_a_bootstrap(spark, made):
    """Means of the sums over trees are those of the rows, their spread that of Poisson(1) counts."""
    df = spark.createDataFrame([(int(a), y) for a, _, y in made], "_cell_hash long, _y double").repartition(5)
    groups = {h: np.array([y for a, _, y in made if a == h]) for h in range(7)}
    centres = {h: float(y.mean()) for h, y in groups.items()}
    found = {r[0]: np.array(r[1]).reshape(3, 400) for r in forests.drawn_sums(df, centres, 400, 5).collect()}
    assert found.keys() == centres.keys()
    for h, y in groups.items():
        d = y - centres[h]
        for k in range(3):
            mean, spread = (d**k).sum(), (d ** (2 * k)).sum()
            assert abs(found[h][k].mean() - mean) < 5 * (spread / 400) ** 0.5
            assert 0.7 * spread < found[h][k].var() < 1.35 * spread
    # equal rows are drawn together
    same = spark.createDataFrame([(1, 2.5)] * 3000, "_cell_hash long, _y double").coalesce(1)
    counts, sums, squares = np.array(forests.drawn_sums(same, {1: 2.0}, 400, 5).first()[1]).reshape(3, 400)
    assert abs(counts.mean() - 3000) < 15 and 2000 < counts.var() < 4200
    assert sums == pytest.approx(counts / 2) and squares == pytest.approx(counts / 4)


def test_trees_are_those_of_the_rows(spark):
    """With every bootstrap count 1, each tree is the one that Spark grows from the rows themselves."""
    rng = random.Random(2)
    rows = [(float(rng.randrange(5)), float(rng.randrange(4)), 3.0 * rng.random()) for _ in range(3000)]
    rows = [(a, b, y + a * b) for a, b, y in rows]
    df = spark.createDataFrame(rows, "a double, b double, _y double")
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    own = RandomForestRegressor(labelCol="_y", numTrees=1, bootstrap=False, maxDepth=8, featureSubsetStrategy="all").fit(vectors.transform(df))
    cells = vectors.transform(df.groupBy("a", "b").agg(F.avg("_y").alias("_centre"), F.xxhash64("a", "b").alias("_cell_hash")))
    distance = F.col("_y") - F.col("_centre")
    sums = df.join(cells, ["a", "b"]).groupBy("_cell_hash").agg(*[F.sum(distance**k).alias(f"s{k}") for k in range(3)])
    sums = sums.select("_cell_hash", F.array(*[F.col(f"s{k}") for k in (0, 0, 1, 1, 2, 2)]).alias("_sums"))
    grown = forests.regression_forest_of_cells(cells, sums, 2, 8, seed=1)
    assert grown.getNumTrees == 2 and grown.numFeatures == 2
    plain = {n.node: n for n in forests.forest_nodes(own).nodes.collect()}
    for tree in range(2):
        nodes = {n.node: n for n in forests.forest_nodes(grown).nodes.where(F.col("tree") == tree).collect()}
        assert nodes.keys() == plain.keys() and len(nodes) > 20
        for i, n in nodes.items():
            assert (n.feature, n.threshold) == (plain[i].feature, plain[i].threshold) and (n.left, n.right) == (plain[i].left, plain[i].right)
            assert (n.weight, n.prediction) == pytest.approx((plain[i].weight, plain[i].prediction))
            assert n.gain == pytest.approx(plain[i].gain)


def test_numbers_take_the_way_of_their_bins(spark, made):
    df = spark.createDataFrame(made, "a double, b double, y double")
    cuts = forests.bin_cuts(df, ["a", "b"])
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    bins = vectors.transform(forests.binned(df.withColumn("id", F.monotonically_increasing_id()), cuts, ["a", "b"], ["y", "id"]))
    model = RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=9, featureSubsetStrategy="all", seed=4).fit(bins)
    moved = forests.on_numbers(model, [cuts["a"], cuts["b"]])
    told = {r.id: r.prediction for r in model.transform(bins).collect()}
    numbers = vectors.transform(df.withColumn("id", F.monotonically_increasing_id()))
    found = {r.id: r.prediction for r in moved.transform(numbers).collect()}
    assert len(found) == 6000 and found == told and len(set(found.values())) > 50
    assert list(moved.featureImportances.toArray()) == list(model.featureImportances.toArray())
    at = {r.threshold for r in forests.forest_nodes(moved).nodes.where("feature = 1 AND left IS NOT NULL").collect()}
    assert at <= {float(np.nextafter(v, -np.inf)) for v in cuts["b"]} and len(at) > 10


def test_comparison_from_cells(spark, monkeypatch, made):
    """No fit of the forest reads the rows; scores, nodes and check are those of all rows."""
    df = spark.createDataFrame([(int(a), None if i % 13 == 0 else b, "xyz"[i % 3], y + 5 * (i % 3)) for i, (a, b, y) in enumerate(made)], "a int, b double, c string, y double")
    seen = []
    fit = RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, part: seen.append(part.count()) or fit(self, part))
    monkeypatch.setattr(modeling, "CELL_DRAWS", 0)
    found = modeling.compare_models(df, "y", "regression", num_trees=6, max_depth=6, nodes=True)
    assert len(seen) == 6 and max(seen) <= 2 * 7 * 32 * 3
    assert found["rows"].first()[:] == (4800, 1200)
    scores = {r.model: r.r2 for r in found["metrics"].collect()}
    assert scores["Random Forest Regressor"] > 0.8 > scores["Linear Regression"]
    check = found["forest_check"].first()
    assert (check.rows_walked, check.rows_same) == (1200, 1200) and check.importance_gap < 1e-9
    assert found["forest_nodes"].where("node = 0").count() == 6


def test_too_many_cells_keep_the_rows(spark, monkeypatch):
    monkeypatch.setattr(modeling, "CELL_DRAWS", 0)
    monkeypatch.setattr(modeling, "MAX_CELLS", 10)
    monkeypatch.setattr(modeling, "regression_forest_of_cells", None)
    df = spark.createDataFrame([(i, i % 9 / 2) for i in range(200)], "f int, t double")
    assert modeling.compare_models(df, "t", "regression", num_trees=3)["rows"].first()[:] == (160, 40)

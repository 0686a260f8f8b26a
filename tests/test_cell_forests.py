"""Forests for classes grown from counted cells: cuts, cells, bootstrap counts, the comparison on top."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablescope.operators import forests, modeling


def test_cuts(spark):
    rng = random.Random(3)
    made = [(float(i % 5), rng.gauss(0, 1), 0.0 if i % 50 else float(i), float(i % 40)) for i in range(4000)]
    df = spark.createDataFrame(made, "few double, many double, heavy double, forty double")
    cuts = forests.bin_cuts(df, df.columns)
    assert cuts["few"] == [1.0, 2.0, 3.0, 4.0]
    for name, found in cuts.items():
        assert found == sorted(set(found)) and len(found) < forests.BINS, name
        assert min(r[0] for r in df.select(name).distinct().collect()) < found[0]
    # 80 different values beside the one that holds 98 % of the rows
    assert len(cuts["many"]) == len(cuts["forty"]) == 31 and len(cuts["heavy"]) > 25
    cells = forests.counted_cells(df, cuts, df.columns, [])
    assert cells.agg(F.sum("_cell_rows")).first()[0] == 4000
    assert not any(cells.schema[c].metadata for c in df.columns)  # bins keep their order
    widths = cells.groupBy("many").agg(F.sum("_cell_rows").alias("n")).collect()
    assert len(widths) == 32 and all(100 <= r.n <= 150 for r in widths)
    assert forests.bin_cuts(df, []) == {}


def test_bootstrap_is_that_of_rows(spark):
    """Weights at the roots vary as sums of Poisson(1) over rows do, and shares are those of Spark's forest of rows."""
    rng = random.Random(8)
    made = [(float(rng.randrange(6)), float(rng.randrange(4))) for _ in range(4000)]
    made = [(a, b, float(rng.random() < (0.1 + 0.13 * a if b < 2 else 0.5))) for a, b in made]
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(made, "a double, b double, _y double"))
    rows = rows.withColumn("_w", F.when(F.col("_y") == 1, 2.0).otherwise(1.0)).cache()
    cells = rows.groupBy("features", "_y", "_w").agg(F.count(F.lit(1)).alias("_cell_rows"), F.first(F.xxhash64("a", "b", "_y")).alias("_cell_hash"))
    grown = forests.forest_of_cells(cells, 2, 100, 5, seed=4)
    assert grown.getNumTrees == 100 and grown.numFeatures == 2 and grown.numClasses == 2
    roots = [r.weight for r in forests.forest_nodes(grown).nodes.where("node = 0").collect()]
    total, squares = (sum((1 + y) ** k for _, _, y in made) for k in (1, 2))
    mean = sum(roots) / 100
    spread = sum((w - mean) ** 2 for w in roots) / 99
    assert len(set(roots)) > 50 and abs(mean - total) < 5 * (squares / 100) ** 0.5
    assert 0.5 * squares < spread < 1.7 * squares
    own = RandomForestClassifier(labelCol="_y", weightCol="_w", numTrees=100, maxDepth=5, featureSubsetStrategy="sqrt", seed=9).fit(rows)
    points = rows.select("features").distinct()
    told = {r.features: r.probability[1] for r in own.transform(points).collect()}
    found = {r.features: r.probability[1] for r in grown.transform(points).collect()}
    assert len(told) == 24 and all(found[x] == pytest.approx(p, abs=0.04) for x, p in told.items())
    assert list(grown.featureImportances.toArray()) == pytest.approx(list(own.featureImportances.toArray()), abs=0.06)


@pytest.mark.parametrize("kinds", ["both", "text", "numbers"])
def test_comparison_from_cells(spark, monkeypatch, kinds):
    """No fit of the forest reads the rows; numbers of the comparison are those of all rows."""
    made = [(i % 97 / 7, i % 3, "xyz"[i % 3], None if i % 11 == 0 else "pq"[i % 2], "in" if (i % 97 > 40) != (i % 3 == 1) else "out") for i in range(3000)]
    df = spark.createDataFrame(made, "a double, b int, c string, d string, label string")
    df = df if kinds == "both" else df.select("c", "d", "label") if kinds == "text" else df.drop("c", "d")
    df = df.withColumn("label", F.col("c")) if kinds == "text" else df
    seen = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    monkeypatch.setattr(modeling, "CELL_DRAWS", 0)
    found = modeling.compare_models(df, "label", num_trees=8)
    assert len(seen) == 8 and max(seen) <= 32 * 3 * 3 * 3 * 2 and max(seen) < 1500
    assert found["rows"].first()[:] == (2400, 600)
    counted = {r.model: r.n for r in found["confusion_pairs"].groupBy("model").agg(F.sum("rows_count").alias("n")).collect()}
    assert counted == {"Logistic Regression": 600, "Random Forest": 600}
    scores = {r.model: r.accuracy for r in found["metrics"].collect()}
    assert scores["Random Forest"] > (0.99 if kinds == "text" else 0.9)
    if kinds == "text":
        assert found["importance"].first()["feature"] == "c"


def test_too_many_cells_keep_the_rows(spark, monkeypatch):
    monkeypatch.setattr(modeling, "CELL_DRAWS", 0)
    monkeypatch.setattr(modeling, "MAX_CELLS", 10)
    monkeypatch.setattr(modeling, "forest_of_cells", None)
    df = spark.createDataFrame([(i, i % 2) for i in range(200)], "f int, t int")
    assert modeling.compare_models(df, "t", num_trees=3)["rows"].first()[:] == (160, 40)

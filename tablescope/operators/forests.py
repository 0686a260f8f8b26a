"""Forests grown from counted cells, and fitted forests as tables of nodes: rows walked down by joins, importances as sums over splits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.columns import ref
from tablescope.functions.session import pinned, scratch_path, stored
from tablescope.operators.ranks import exact_quantiles

#: Bins a tree tells apart in a number, as in Spark's own forests.
BINS = 32
#: Trees that grow at the same time.
SIDE_BY_SIDE = 8
#: Rows of at most this many features are folded by the thresholds between which they lie.
FOLDED_WIDTH = 64
#: Levels walked in one plan; then the rows are written and read again.
LEVELS = 8


@dataclass
class Forest:
    """``nodes``: tree, node (0: root), feature, threshold or categories that go left, left, right, gain, weight, prediction, shares.

    ``feature`` to ``gain`` are null in leaves, ``shares`` (of the classes) in forests for regression.
    """

    nodes: DataFrame
    trees: int
    depth: int


def forest_nodes(model) -> Forest:
    """The nodes of a fitted random forest, a row each, from its saved form in the shared folder."""
    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner, ordered = F.col("leftChild") >= 0, F.col("split.numCategories") < 0
    stats = F.col("impurityStats")
    classify = isinstance(model, RandomForestClassificationModel)
    weight = F.aggregate(stats, F.lit(0.0), lambda total, s: total + s) if classify else stats[0]
    nodes = saved.select(
        "tree",
        F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & ordered, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner & ~ordered, F.col("split.leftCategoriesOrThreshold")).alias("categories"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("gain")).alias("gain"),
        weight.alias("weight"),
        "prediction",
        (F.transform(stats, lambda s: s / weight) if classify else F.lit(None).cast("array<double>")).alias("shares"),
    )
    return Forest(nodes, model.getNumTrees, max(tree.depth for tree in model.trees))


def walked(forest: Forest, df: DataFrame, key: str, features: str = "features") -> DataFrame:
    """``row`` (the key), ``prediction`` and ``shares`` of every row, from the leaf it reaches in each tree.

    One join with the splits per level; the key must be unique and not null.  Classes
    with equal shares: the smaller one.
    """
    splits = forest.nodes.where("left IS NOT NULL").select("tree", "node", "feature", "threshold", "categories", "left", "right")
    leaves = forest.nodes.where("left IS NULL").select("tree", "node", F.col("prediction").alias("value"), "shares")
    value = F.get("x", F.col("feature"))
    goes_left = F.when(F.col("categories").isNull(), value <= F.col("threshold")).otherwise(F.array_contains("categories", value))
    step = F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
    at = df.select(F.col(key).alias("row"), vector_to_array(features).alias("x"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"), F.lit(0).alias("node"))
    for level in range(forest.depth):
        at = at.join(splits, ["tree", "node"], "left").select("row", "x", "tree", step.alias("node"))
        if level % LEVELS == LEVELS - 1:
            at = stored(at, "forest-walk")
    ended = at.drop("x").join(leaves, ["tree", "node"])
    mean = ended.groupBy("row").agg(F.avg("value").alias("value"))
    votes = ended.select("row", F.posexplode("shares").alias("class", "share")).groupBy("row", "class").agg(F.avg("share").alias("share"))
    best = F.max_by("class", F.struct("share", -F.col("class"))).cast("double").alias("class")
    shares = F.array_sort(F.collect_list(F.struct("class", "share")))
    voted = votes.groupBy("row").agg(best, F.transform(shares, lambda s: s["share"]).alias("shares"))
    return mean.join(voted, "row", "left").select("row", F.coalesce("class", "value").alias("prediction"), "shares")


def node_importances(forest: Forest) -> DataFrame:
    """``position, importance`` of the features in splits: weighted gains, each tree and the total scaled to 1."""
    gains = forest.nodes.where("left IS NOT NULL").groupBy("tree", F.col("feature").alias("position")).agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    totals = gains.groupBy("tree").agg(F.sum("gain").alias("total")).where("total > 0")
    parts = gains.join(totals, "tree").groupBy("position").agg(F.sum(F.col("gain") / F.col("total")).alias("importance"))
    whole = parts.agg(F.sum("importance")).first()[0]
    return parts.select("position", (F.col("importance") / F.lit(whole)).alias("importance"))


def _folded(own: DataFrame, forest: Forest, width: int, more: Sequence[str]) -> DataFrame:
    """``x``, ``more`` and ``n``: how many rows agree in ``more`` and lie between the same thresholds of the forest.

    ``x`` is a place between them; rows there go the same way in every tree.  Of wide rows only equal ones are folded.
    """
    if width > FOLDED_WIDTH:
        return own.groupBy("x", *more).agg(F.count(F.lit(1)).alias("n"))
    splits = forest.nodes.where("left IS NOT NULL").groupBy("feature")
    found = splits.agg(F.collect_set("threshold").alias("at"), F.max(F.col("categories").isNotNull()).alias("named")).collect()
    plain = own.select(*more, *[F.col("x")[r.feature].alias(f"_x{r.feature}") for r in found])
    numbers = [r for r in found if not r.named]
    if numbers:
        # a value equal to a threshold goes left, so a place begins with the next larger number
        splits = [[-np.inf, *sorted(float(np.nextafter(v, np.inf)) for v in r.at), np.inf] for r in numbers]
        inputs, places = ([f"{kind}{r.feature}" for r in numbers] for kind in ("_x", "_b"))
        plain = Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=places, handleInvalid="keep").transform(plain)
    keys = [f"_x{r.feature}" if r.named else f"_b{r.feature}" for r in found]
    least = [F.min(f"_x{r.feature}").alias(f"_least{r.feature}") for r in found]
    points = plain.groupBy(*keys, *more).agg(F.count(F.lit(1)).alias("n"), *least)
    used = {r.feature for r in found}
    return points.select(F.array(*[F.col(f"_least{i}") if i in used else F.lit(0.0) for i in range(width)]).alias("x"), *more, "n")


def forest_check(model, forest: Forest, df: DataFrame, features: str = "features") -> DataFrame:
    """``rows_walked, rows_same, importance_gap``: the node table beside the model's own predictions and importances.

    The model predicts every row; rows that no split tells apart are walked once, for each prediction they got.
    """
    told = ["told"] if isinstance(model, RandomForestClassificationModel) else []
    own = model.transform(df).select(vector_to_array(features).alias("x"), F.col("prediction").alias("own"), *[vector_to_array("probability").alias(c) for c in told])
    points = _folded(own, forest, model.numFeatures, ["own", *told]).select(F.monotonically_increasing_id().alias("row"), array_to_vector("x").alias(features), "own", *told, "n")
    points = stored(points, "forest-points")
    both = points.join(walked(forest, points, "row", features), "row", "left")
    gap = F.array_max(F.zip_with("told", "shares", lambda a, b: F.abs(a - b))) if told else F.abs(F.col("own") - F.col("prediction"))
    zero = F.lit(0).cast("long")
    compared = both.agg(
        F.coalesce(F.sum("n"), zero).alias("rows_walked"), F.coalesce(F.sum(F.when(gap < 1e-9, F.col("n")).otherwise(zero)), zero).alias("rows_same")
    )
    values = model.featureImportances
    given = df.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(values.indices, values.values)], "position int, given double")
    gaps = node_importances(forest).join(given, "position", "full")
    gaps = gaps.agg(F.max(F.abs(F.coalesce("given", F.lit(0.0)) - F.coalesce("importance", F.lit(0.0)))).alias("importance_gap"))
    return compared.crossJoin(gaps)


# -- forests from counted cells --------------------------------------------------


def bin_cuts(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """At most ``BINS - 1`` increasing cuts per number; a bin begins with its cut.

    Up to ``BINS`` values are told apart; of more, the quantiles are, and where values that
    hold several quantiles leave cuts over, the quantiles of the other values.
    """
    if not columns:
        return {}
    sizes = df.agg(*[F.approx_count_distinct(ref(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    few = [c for c, n in zip(columns, sizes) if n <= 2 * BINS]
    values: dict[str, list[float]] = {c: [] for c in few}
    if few:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), ref(c).cast("double").alias("v")) for c in few])
        for r in df.select(F.explode(cells).alias("e")).select("e.*").distinct().collect():
            values[r["c"]].append(r["v"])
    cuts = {c: sorted(v)[1:] for c, v in values.items() if len(v) <= BINS}
    many = [c for c in columns if c not in cuts]
    if many:
        shares = [0.0, *[i / BINS for i in range(1, BINS)], 1.0]
        found = exact_quantiles(df, {c: shares for c in many})
        cuts |= {c: sorted({v for v in found[c] if v > found[c][0]}) for c in many}
        rest = {c: [i / (BINS - len(cuts[c])) for i in range(1, BINS - len(cuts[c]))] for c in many if len(cuts[c]) < BINS - 1}
        if rest:
            others = df.select(*[F.when(~ref(c).cast("double").isin([found[c][0], *cuts[c]]), ref(c).cast("double")).alias(c) for c in rest])
            more = exact_quantiles(others, rest)
            cuts |= {c: sorted({*cuts[c], *[v for v in more[c] if v is not None]}) for c in rest}
        # the largest value goes where it is one too many
        cuts |= {c: cuts[c][: BINS - 1] for c in many}
    return {c: [v for v in found if math.isfinite(v)] for c, found in cuts.items()}


def binned(df: DataFrame, cuts: Mapping[str, Sequence[float]], keys: Sequence[str], more: Sequence[str]) -> DataFrame:
    """``keys`` and ``more`` of every row, numbers replaced by the number of their bin."""
    plain = df.select(*[(ref(c).cast("double") if c in cuts else ref(c)).alias(f"_k{i}") for i, c in enumerate(keys)], *more)
    inputs = [f"_k{i}" for i, c in enumerate(keys) if c in cuts]
    if inputs:
        splits = [[-np.inf, *map(float, cuts[c]), np.inf] for c in keys if c in cuts]
        plain = Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=[f"_b{i}" for i in inputs]).transform(plain)
    # a sum carries no metadata: with it the trees would take bins for categories without an order
    named = [(F.col(f"_b_k{i}") + F.lit(0.0) if c in cuts else F.col(f"_k{i}")).alias(c) for i, c in enumerate(keys)]
    return plain.select(*named, *more)


def counted_cells(df: DataFrame, cuts: Mapping[str, Sequence[float]], keys: Sequence[str], more: Sequence[str]) -> DataFrame:
    """``keys``, ``more`` and ``_cell_rows``: how many rows agree in them, numbers replaced by the number of their bin."""
    return binned(df, cuts, keys, more).groupBy(*[ref(c) for c in keys], *more).agg(F.count(F.lit(1)).alias("_cell_rows"))


def _together(spark: SparkSession, kind: str, grown: Callable, trees: int, *sizes: int):
    """The forest of the trees that ``grown`` fits one by one, through the constructor of Spark's model."""
    with ThreadPool(SIDE_BY_SIDE) as pool:
        found = pool.map(grown, range(trees), chunksize=1)
    package = getattr(spark._jvm.org.apache.spark.ml, "classification" if kind == "Classification" else "regression")
    array = spark.sparkContext._gateway.new_array(getattr(package, f"DecisionTree{kind}Model"), trees)
    for i, one in enumerate(found):  # the fits are held until here: one that is collected takes its trees along
        array[i] = one._java_obj.trees()[0]
    model = getattr(package, f"RandomForest{kind}Model")(array, *sizes)
    model.set(model.numTrees(), trees)
    return model


def forest_of_cells(cells: DataFrame, classes: int, trees: int, depth: int, seed: int) -> RandomForestClassificationModel:
    """The forest of rows that are given as cells: ``features, _y, _w`` (weight of a row), ``_cell_rows`` (rows) and ``_cell_hash`` (hash).

    A bootstrap count of a row is Poisson(1), so the counts of the ``_cell_rows`` rows of a cell add up to
    Poisson(_cell_rows), drawn at once; a tree sees of a row no more than its cell.
    """
    nominal = {"ml_attr": {"type": "nominal", "num_vals": classes}}

    def drawn(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [np.random.default_rng([seed, h & (2**64 - 1)]).poisson(n, trees) for h, n in zip(batch["_cell_hash"].tolist(), batch["_cell_rows"].tolist())]
            yield pd.DataFrame({"_cell_hash": batch["_cell_hash"], "_cell_rows": batch["_cell_rows"], "_drawn": [c.tolist() for c in counts]})

    keys = cells.select("_cell_hash", "_cell_rows").distinct().mapInPandas(drawn, "_cell_hash long, _cell_rows long, _drawn array<long>")
    held = stored(cells.join(keys, ["_cell_hash", "_cell_rows"]).select("features", "_y", "_w", "_drawn").coalesce(1), "forest-cells").persist()
    width = held.first()["features"].size

    def grown(tree: int):
        weight = (F.col("_w") * F.col("_drawn")[tree]).alias("_w")
        seen = held.select("features", F.col("_y").alias("_y", metadata=nominal), weight).where("_w > 0")
        one = RandomForestClassifier(
            featuresCol="features", labelCol="_y", weightCol="_w", numTrees=1, bootstrap=False,
            maxDepth=depth, maxBins=BINS, featureSubsetStrategy="sqrt", seed=seed * 100_003 + tree,
        )
        return one.fit(seen)

    model = _together(cells.sparkSession, "Classification", grown, trees, width, classes)
    held.unpersist()
    return RandomForestClassificationModel(model)


def drawn_sums(df: DataFrame, centres: Mapping[int, float], trees: int, seed: int) -> DataFrame:
    """``_cell_hash`` and ``_sums``: bootstrap counts N, then N d, then N d^2 of the cell's rows added up, a value per tree each.

    ``df`` has ``_cell_hash`` and ``_y`` of every row, d is the distance of ``_y`` from the centre of the cell.  Every row gets
    Poisson(1) for every tree; equal rows of a batch get theirs, Poisson(their number), at once.
    """
    known = np.array(sorted(centres), np.int64)
    middle = np.array([centres[h] for h in known.tolist()])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        total = np.zeros((len(known), 3, trees))
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cell = np.searchsorted(known, cell)
            order = np.lexsort((y, cell))
            cell, y = cell[order], y[order]
            at = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (y[1:] != y[:-1])))
            n, cell, d = np.diff(np.append(at, len(y))), cell[at], y[at] - middle[cell[at]]
            counts = rng.poisson(n[:, None], (len(n), trees)).astype(float)
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            for k in range(3):
                total[cell[starts], k] += np.add.reduceat(counts, starts, axis=0)
                counts *= d[:, None]
        seen = np.flatnonzero(total[:, 0].any(axis=1))
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1, dtype=np.int32) * (3 * trees)), pa.array(total[seen].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(known[seen]), sums], names=["_cell_hash", "_sums"])

    def added(parts: pa.Table) -> pa.Table:
        sums = parts.column("_sums").combine_chunks().flatten().to_numpy().reshape(parts.num_rows, -1).sum(axis=0)
        return pa.table({"_cell_hash": parts.column("_cell_hash").slice(0, 1), "_sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    schema = "_cell_hash long, _sums array<double>"
    return df.select("_cell_hash", "_y").mapInArrow(summed, schema).groupBy("_cell_hash").applyInArrow(added, schema)


def regression_forest_of_cells(cells: DataFrame, sums: DataFrame, trees: int, depth: int, seed: int) -> RandomForestRegressionModel:
    """The forest of rows that are given as cells: ``features, _cell_hash, _centre``, and their `drawn_sums`.

    A tree knows a cell by the weight, the sum and the sum of squares of its targets, so it grows the same from two
    places, mean - deviation and mean + deviation, with half of the weight each.
    """
    held = stored(cells.join(sums, "_cell_hash").select("features", "_centre", "_sums").coalesce(1), "forest-cells").persist()
    width = held.first()["features"].size

    def grown(tree: int):
        weight, total, squares = (F.col("_sums")[k * trees + tree] for k in range(3))
        told = held.select("features", "_centre", weight.alias("_n"), total.alias("_s"), squares.alias("_q")).where("_n > 0")
        told = told.withColumns({"_s": F.col("_s") / F.col("_n"), "_q": F.col("_q") / F.col("_n")})
        apart = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * F.col("_s")))
        mean = F.col("_centre") + F.col("_s")
        told = told.select("features", mean.alias("_mean"), apart.alias("_apart"), "_n")
        places = [F.struct((F.col("_mean") + side * F.col("_apart")).alias("_y"), (F.col("_n") / 2).alias("_w")) for side in (-1, 1)]
        single = F.struct(F.col("_mean").alias("_y"), F.col("_n").alias("_w"))
        seen = told.select("features", F.explode(F.when(F.col("_apart") > 0, F.array(*places)).otherwise(F.array(single))).alias("e")).select("features", "e.*")
        one = RandomForestRegressor(
            featuresCol="features", labelCol="_y", weightCol="_w", numTrees=1, bootstrap=False,
            maxDepth=depth, maxBins=BINS, featureSubsetStrategy="all", seed=seed * 100_003 + tree,
        )
        return one.fit(seen)

    model = _together(cells.sparkSession, "Regression", grown, trees, width)
    held.unpersist()
    return RandomForestRegressionModel(model)


def on_numbers(model, cuts: Sequence[Sequence[float]]):
    """The same forest for rows whose first features are numbers; ``model`` sees their bins, ``cuts`` has the cuts of each.

    A bin up to k goes left, that is a number below the cut that begins bin k + 1: one up to the next smaller number.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    below = F.array(*[F.array(*[F.lit(float(np.nextafter(v, -np.inf))) for v in own]).cast("array<double>") for own in cuts]).cast("array<array<double>>")
    saved = spark.read.parquet(f"{path}/data")
    split = F.col("nodeData.split")
    at = F.get(F.get(below, split["featureIndex"]), F.floor(F.get(split["leftCategoriesOrThreshold"], F.lit(0))).cast("int"))
    number = (F.col("nodeData.leftChild") >= 0) & (split["numCategories"] < 0) & (split["featureIndex"] < len(cuts))
    moved = F.when(number, F.array(at)).otherwise(split["leftCategoriesOrThreshold"])
    saved = saved.withColumn("nodeData", F.col("nodeData").withField("split.leftCategoriesOrThreshold", moved))
    pinned(saved).write.mode("overwrite").parquet(f"{path}/data")
    return type(model).load(path)

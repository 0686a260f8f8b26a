"""The branches meant for large and skewed data, forced on small tables.

A third of the rows shares one value throughout.
"""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions.columns import top_n_per_group
from tablescope.functions.session import columnar, is_columnar
from tablescope.operators import clean, corr, modeling, profile, ranks
from tablescope.sources.rows import limit_rows

N = 3000


def _test_sizes(spark, counts):
    table = spark.createDataFrame(list(counts.items()), "_g string, n long")
    return {r["_g"]: r["_t"] for r in modeling.test_sizes(table).collect()}



@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    hot = np.arange(N) % 3 == 0
    frame = pd.DataFrame(
        {
            "a": np.where(hot, 7.0, rng.normal(size=N).round(3)),
            "b": np.where(hot, 7, rng.integers(0, 500, N)),
            "c": np.where(rng.random(N) < 0.2, np.nan, rng.exponential(size=N)),
            "g": np.where(hot, "hot", rng.choice(list("xyz"), N)),
        }
    )
    df = spark.createDataFrame(frame).withColumn("c", F.when(~F.isnan("c"), F.col("c")))
    return df.repartition(5), frame


def test_selected_quantiles(skewed):
    df, frame = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    wanted = {c: probs for c in "abc"}
    found = ranks.exact_quantiles(df, wanted, one_task_rows=100)
    direct = ranks.exact_quantiles(df, wanted)
    for c in "abc":
        expected = frame[c].quantile(probs).tolist()
        assert found[c] == pytest.approx(expected) and direct[c] == pytest.approx(expected)


def test_quantiles_when_brackets_miss(skewed, monkeypatch):
    df, frame = skewed
    monkeypatch.setattr(ranks, "_brackets", lambda f, size, places, rows: {
        (i, k): (1e9, None) for i in size for k in places[i]})
    found = ranks.exact_quantiles(df, {"c": [0.3]}, one_task_rows=100)
    assert found["c"][0] == pytest.approx(frame["c"].quantile(0.3))


@pytest.mark.parametrize("bound", [0, 100, 10**6])
def test_spearman_matches_at_every_join_strategy(skewed, bound):
    df, frame = skewed
    got = corr.correlation_matrix(df, "spearman", broadcast_rows=bound).collect()
    ranked = {}
    for r in got:
        pair = frame[[r["row_name"], r["column_name"]]].dropna()
        ranked = pair.iloc[:, 0].rank().corr(pair.iloc[:, 1].rank())
        assert r["value"] == pytest.approx(ranked, abs=1e-4), (r["row_name"], r["column_name"])


def test_average_rank(skewed):
    df, frame = skewed
    expected = frame.assign(r=frame["a"].rank()).groupby("a")["r"].first()
    for partitions in (1, 16):
        found = {r["value"]: r["rank"] for r in ranks.average_rank(df.repartition(partitions), "a").collect()}
        assert found == pytest.approx(expected.to_dict())


def test_pearson_ignores_partitioning(skewed):
    df, frame = skewed
    expected = frame[["a", "c"]].corr().iloc[0, 1]
    for partitions in (1, 16):
        found = corr.pair_coefficients(df.repartition(partitions), ["a"], ["c"]).first()
        assert found["coefficient"] == pytest.approx(expected)


def test_duplicates_at_every_strategy(skewed):
    df, frame = skewed
    expected = int(frame[["a", "b", "g"]].duplicated().sum())
    for bound in (0, 10**6):
        assert profile.duplicate_count(df.select("a", "b", "g"), broadcast_groups=bound) == expected
    shifted = df.sparkSession.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert profile.duplicate_count(shifted) == 0


def test_deduplication_at_every_strategy(skewed):
    df, frame = skewed
    rows = df.select("a", "b", "g", F.lit(1).alias("h"))
    expected = sorted(frame[["a", "b", "g"]].drop_duplicates().itertuples(index=False, name=None))
    repeated = profile.repeated_digests(rows)
    groups = repeated.count()
    assert groups > 0
    for bound in (0, 10**6):
        found = clean._distinct(rows, repeated, groups, broadcast_groups=bound)
        assert sorted(tuple(r)[:3] for r in found.collect()) == expected
    unique = df.sparkSession.range(5)
    assert clean.drop_duplicates(unique).count() == 5


def test_columns_of_computed_tables_are_written_once(skewed, tmp_path):
    df, _ = skewed
    spark = df.sparkSession
    path = str(tmp_path / "t")
    df.select("a", "g").write.parquet(path)
    stored = spark.read.parquet(path)
    assert is_columnar(stored) and is_columnar(stored.where("a > 0").select(F.col("a") + 1))
    double = stored.unionByName(stored)
    for wide in (double, stored.groupBy("g").count(), spark.read.text(path)):
        assert not is_columnar(wide)
    with columnar(double) as held:
        files = held.inputFiles()
        assert is_columnar(held) and held.columns == ["a", "g"] and held.count() == 2 * N
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert profile.column_profile(double).first()["rows_count"] == 2 * N


def test_running_sums_over_groups(skewed):
    df, frame = skewed
    counts = df.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))
    found = {(r["g"], r["b"]): r["below"] for r in ranks.counts_below(counts.repartition(9), ["g"], ["b"]).collect()}
    for g, part in frame.groupby("g"):
        sizes = part["b"].value_counts().sort_index()
        expected = dict(zip(sizes.index, sizes.cumsum() - sizes))
        assert {b: n for (own, b), n in found.items() if own == g} == expected


def counted(df):
    return sorted((tuple(r)[:-1], r["n"]) for r in df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).collect())


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_with_copies(skewed, partitions, monkeypatch):
    df, _ = skewed
    rows = df.select("b", "g").repartition(partitions)
    train, test = modeling.split(rows, "g")
    assert test.count() == N // 5 and train.count() == N - N // 5
    assert counted(train.unionByName(test)) == counted(rows)
    # the hot class consists of copies of one row; they are shared out in numbers
    hot = rows.where("g = 'hot'").count()
    assert test.where("g = 'hot'").count() == _test_sizes(train.sparkSession, {"hot": hot, "rest": N - hot})["hot"]
    monkeypatch.setattr(modeling, "ONE_TASK_ROWS", 5)  # several prefix passes
    assert counted(modeling.split(rows, "g")[1]) == counted(test)


def test_split_without_classes(skewed):
    df, _ = skewed
    train, test = modeling.split(df.select("a", "c"))
    assert test.count() == 600 and train.count() == 2400


def test_limit_by_cut(skewed):
    df, frame = skewed
    rows = df.select("b", "g")
    expected = frame[["b", "g"]].sort_values(["b", "g"]).head(900)
    found = limit_rows(rows, 900, ["b"], top_rows=10)
    assert sorted(map(tuple, found.collect())) == sorted(expected.itertuples(index=False, name=None))
    gaps = limit_rows(df.select("c", "a"), 700, ["c"], top_rows=10)
    assert gaps.count() == 700 and gaps.where("c is null").count() == int(frame["c"].isna().sum())


def test_newest_rows_of_a_hot_group(skewed):
    df, frame = skewed
    found = top_n_per_group(df.select("g", "a", "b"), ["g"], [F.desc("b"), F.asc("a")], 4)
    for g, part in frame.groupby("g"):
        expected = part.sort_values(["b", "a"], ascending=[False, True]).head(4)["b"].tolist()
        assert [r["b"] for r in found.where(F.col("g") == g).orderBy("position").collect()] == expected


def test_settled_rows_are_spread_in_the_shuffled_join(skewed):
    """The join of cold values keeps both keys, so hot rows do not meet in one task."""
    df, _ = skewed
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = ranks.rank_tables({"x": (df, "a")}).persist()
        plan = ranks.attach_ranks(df, {"a": "x"}, tables, broadcast_rows=0)._jdf.queryExecution().executedPlan()
        join = next(line for line in plan.toString().splitlines() if "SortMergeJoin" in line)
        assert "_lane" in join and "_key" in join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _largest_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_copies_at_the_cut_are_filled_by_many_tasks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, t string")
    found = modeling._repeat(df, F.col("n") * 10_000, ["n", "t"], block=500)
    assert {(r["n"], r["t"]): r["count"] for r in found.groupBy("n", "t").count().collect()} == {(1, "a"): 10_000, (2, "b"): 20_000}
    assert _largest_task(found) <= 2_000


def test_training_rows_are_dealt_to_tasks_that_hold_them(spark, monkeypatch):
    """A table read by one task is not trained by one."""
    monkeypatch.setattr(modeling, "TASK_BYTES", 50_000)
    seen = []
    dealt = modeling._dealt
    monkeypatch.setattr(modeling, "_dealt", lambda *given: seen.append(dealt(*given)) or seen[-1])
    df = spark.range(3000).selectExpr("id % 7 * 2 AS y", "id % 7 AS x", "id AS z").coalesce(1)
    found = modeling.compare_models(df, "y", "regression", num_trees=10, max_depth=3)
    assert found["rows"].first()["rows_train"] == seen[0].count() == 2400
    assert _largest_task(seen[0]) * (modeling.ROW_BYTES + 4 * 12) <= 2 * modeling.TASK_BYTES

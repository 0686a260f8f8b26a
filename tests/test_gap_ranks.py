"""Spearman with gaps beside pandas, in both ways, and how often the source is read."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from tablescope.operators import corr, gap_ranks


def rows(n, columns, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        row = [rng.choice([None, 0, 0, 0, rng.randint(-3, 3), rng.randint(-1000, 1000)]) for _ in range(columns // 2)]
        row += [rng.choice([None, float("nan"), 0.0, -0.0, 2.5, rng.gauss(0, 1)]) for _ in range(columns - columns // 2)]
        out.append(tuple(row))
    return out


def schema(columns):
    return ", ".join([f"c{k} long" for k in range(columns // 2)] + [f"c{k} double" for k in range(columns // 2, columns)])


def plain(data, columns):
    frame = pd.DataFrame(data, columns=[f"c{k}" for k in range(columns)], dtype="float64") + 0.0
    found = {}
    for a in frame.columns:
        for b in frame.columns:
            part = frame[[a, b]].dropna().rank() if a != b else frame[[a]].dropna().rank()
            if not len(part):
                continue
            if part.iloc[:, 0].nunique() > 1 and part.iloc[:, -1].nunique() > 1:
                found[a, b] = (round(part.iloc[:, 0].corr(part.iloc[:, -1]), 9), len(part))
            else:
                found[a, b] = (None, len(part))
    return found


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
@pytest.mark.parametrize("bits", [60, 3])
def test_every_pair_on_its_own_rows(spark, monkeypatch, broadcast, bits):
    monkeypatch.setattr(gap_ranks, "PATTERN_BITS", bits)
    monkeypatch.setattr(gap_ranks, "HOT_VALUE", 0.2)
    data = [*rows(150, 6, 1), (None,) * 6]
    df = spark.createDataFrame([(*r, None, 7) for r in data], schema(6) + ", c6 long, c7 long")
    names = [f"c{k}" for k in range(8)]
    found = {(r["l"], r["r"]): (None if r["coefficient"] is None else round(r["coefficient"], 9), r["rows_used"])
             for r in corr.spearman_coefficients(df, names, names, broadcast_rows=broadcast).collect()}
    assert found == plain([(*r, None, 7) for r in data], 8)


def test_scans_do_not_grow_with_the_columns(spark, tmp_path):
    """The source is read equally often for 3 and for 14 columns with gaps."""
    reads = []
    for columns in (3, 14):
        counter = spark.sparkContext.accumulator(0)

        def counted(batches, counter=counter):
            for batch in batches:
                counter.add(batch.num_rows)
                yield batch

        df = spark.createDataFrame(rows(200, columns, columns), schema(columns)).coalesce(1)
        df = df.mapInArrow(counted, df.schema)
        corr.correlation_matrix(df, "spearman")
        reads.append(counter.value / 200)
    assert reads[0] == reads[1] <= 4, reads


def test_no_complete_rows(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "a long, b long")
    found = {(r["l"], r["r"]): r["rows_used"] for r in corr.spearman_coefficients(df, ["a", "b"], ["a", "b"]).collect()}
    assert found == {("a", "a"): 1, ("b", "b"): 1}


def test_rows_are_dealt_out_by_value_and_never_repeated(spark, monkeypatch):
    """Many tasks rank columns whose values lie between their cut values; whole numbers stay exact, no row is repeated for a pair."""
    monkeypatch.setattr(gap_ranks, "TASK_ROWS", 40)
    monkeypatch.setattr(gap_ranks, "HOT_VALUE", 0.05)
    monkeypatch.setattr(gap_ranks, "SAMPLED_ROWS", 20)

    def repeated(*_):
        raise AssertionError("a row for every pair")

    monkeypatch.setattr(gap_ranks, "F", SimpleNamespace(**{**vars(gap_ranks.F), "explode": repeated}))
    rng, big = random.Random(5), 1 << 60
    data = [
        (
            rng.choice([None, 3, 3, 3, rng.randint(0, 200)]), rng.choice([None, rng.randint(0, 400)]),
            rng.choice([None, rng.gauss(0, 1), float("nan"), 0.5]), rng.choice([None, 0, 1]), i % 150,
        )
        for i in range(600)
    ]
    huge = [(*r[:4], big + r[4]) for r in data]
    df = spark.createDataFrame(huge, "c0 long, c1 long, c2 double, c3 long, c4 long").repartition(5)
    names = [f"c{k}" for k in range(5)]
    found = {(r["l"], r["r"]): (None if r["coefficient"] is None else round(r["coefficient"], 9), r["rows_used"])
             for r in corr.spearman_coefficients(df, names, names, broadcast_rows=2).collect()}
    assert found == plain(data, 5)

"""Dictionaries, splits and models whose values and classes never become lists, on their large-data paths."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tablescope.operators import encoding, modeling


@pytest.fixture(params=[200_000, 0])
def broadcast(request, monkeypatch):
    monkeypatch.setattr(encoding, "BROADCAST_VALUES", request.param)
    monkeypatch.setattr(modeling, "BROADCAST_CLASSES", request.param)
    monkeypatch.setattr(encoding, "HOT_VALUE", 0.1)


def table(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), float(n), rng.choice(["hot", "hot", "hot", f"v{n}", None, "é"]), f"k{n % 17}", n) for n in range(300)]
    return rows, spark.createDataFrame(rows, "label string, size double, word string, kind string, n long")


def test_vectors_beside_plain_encoding(spark, broadcast):
    rows, df = table(spark)
    matrix = modeling.model_matrix(df, "label", ["size", "word", "kind"])
    names = {r["position"]: r["feature"] for r in modeling.encoded_names(matrix).collect()}
    words = sorted({w or "__missing__" for _, _, w, _, _ in rows})
    kinds = sorted({k for _, _, _, k, _ in rows})
    assert [names[i] for i in range(len(names))] == ["size", *(f"word__{w}" for w in words[1:]), *(f"kind__{k}" for k in kinds[1:])]
    got = Counter()
    for r in modeling.encode(matrix).collect():
        assert r["features"].size == len(names)
        got[r["label"], tuple(sorted((names[int(i)], float(v)) for i, v in zip(r["features"].indices, r["features"].values)))] += 1
    want = Counter()
    for label, size, word, kind, _ in rows:
        entries = [("size", size)]
        entries += [(f"word__{word or '__missing__'}", 1.0)] if (word or "__missing__") != words[0] else []
        entries += [(f"kind__{kind}", 1.0)] if kind != kinds[0] else []
        want[label, tuple(sorted(entries))] += 1
    assert got == want


def test_split_sizes_beside_largest_remainder(spark, broadcast):
    rng = random.Random(8)
    labels = [f"c{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(977)]
    df = spark.createDataFrame([(c, n) for n, c in enumerate(labels)], "c string, n long")
    train, test = modeling.split(df, "c")
    counts, total = Counter(labels), len(labels)
    size = math.ceil(0.2 * total)
    sizes = {c: size * n // total for c, n in counts.items()}
    for c in sorted(counts, key=lambda c: (-(size * counts[c] % total), c))[: size - sum(sizes.values())]:
        sizes[c] += 1
    assert Counter(r["c"] for r in test.collect()) == {c: n for c, n in sizes.items() if n}
    assert sorted(r["n"] for r in train.unionByName(test).collect()) == list(range(total))


def test_models_on_both_paths(spark, broadcast):
    rows, df = table(spark)
    df = df.selectExpr("CASE WHEN word = 'hot' THEN 'in' WHEN kind = 'k3' THEN 'other' ELSE 'out' END AS c", "word", "kind", "size")
    found = modeling.compare_models(df, "c", num_trees=3, max_depth=3)
    proof = {r["model"]: r for r in found["certificate"].collect()}["Logistic Regression"]
    assert proof["gradient"] < 1e-4 < proof["nudged_gradient"]
    assert sum(r["rows_count"] for r in found["confusion_pairs"].where("model = 'Random Forest'").collect()) == 60
    assert {r["label"] for r in found["class_distribution"].collect()} == {"in", "other", "out"}
    assert found["confusion"].count() == 18


def test_certificate_beside_plain_gradient(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(40, 3)), rng.integers(0, 3, 40).astype(float), rng.uniform(0.5, 2, 40)
    rows = [(Vectors.dense(a) if n % 2 else Vectors.sparse(3, [0, 1, 2], a.tolist()), float(b), float(c)) for n, (a, b, c) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, ["features", "_y", "_w"])
    beta, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    margin = x @ beta.T + start
    share = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
    wrong = (share - (y[:, None] == np.arange(3))) * w[:, None]
    want = np.concatenate([wrong.T @ x / w.sum() + 0.3 * beta, wrong.sum(0)[:, None] / w.sum()], axis=1)
    got = modeling._gradient(df, start.tolist(), beta.tolist(), 0.3, True)
    assert got[0] == pytest.approx(np.abs(want).max(), rel=1e-9)

"""Small tables with the cases every operator must stand."""

from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def make(spark):
    """DataFrame of documents from (id, text) with columns whose names clash with results."""

    def build(rows):
        rows = [(i, t, "en", "s", None, 1) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept int")

    return build


@pytest.fixture
def prose():
    """Deterministic invented prose of n words."""

    def build(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "und", "es", "ra"]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    return build


EDGE = [(1, None), (2, ""), (3, "  \n\t "), (None, "alpha beta"), (None, None), (4, "alpha beta"), (4, "alpha beta"), (4, "other text"), (5, "x" * 50_000)]


@pytest.fixture
def edge():
    return list(EDGE)

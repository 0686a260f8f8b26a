"""Folding, matching and held-out accuracy."""

from __future__ import annotations

import math

import pytest

from tablescope.llm import toxicity as t


def test_folding():
    assert t.fold("IDIOT").split() == t.fold("1d10t").split() == t.fold("іdіоt").split() == t.fold("ïd​i­ot").split() == t.fold("ｉｄｉｏｔ").split()
    assert t.fold("$tup!d l0ser").split() == t.fold("stupid loser").split()
    assert t.fold("no!! way$$$").split() == ["no", "way"]
    assert t.fold("") == "  "


def plain_raw(text, weights, exceptions):
    words = t.fold(text).split()
    hidden = set()
    for phrase in exceptions:
        own = t.fold(phrase).split()
        for at in range(len(words)):
            if words[at : at + len(own)] == own:
                hidden.update(range(at, at + len(own)))
    total = 0.0
    for at, word in enumerate(words):
        if at not in hidden:
            total += max([0.0, *(w for e, w in weights.items() if e == f" {word} " or (not e.endswith(" ") and f" {word}".startswith(e)))])
    return total / math.sqrt(1 + len(text) / 1000)


def test_matching_equals_plain_version(prose):
    weights = {t.fold(k)[:-1] if p else " " + t.fold(k).strip() + " ": w for k, p, w in [("idiot", 0, 3.0), ("mor", 1, 2.0), ("moron", 0, 5.0), ("trash", 0, 4.0)]}
    weights = {(" " + k.strip() + (" " if k.endswith(" ") else "")): w for k, w in weights.items()}
    lexicon = t.Lexicon(weights, ("trash can", "total trash heap"))
    texts = ["you idiot", "idiotic idiot idiot", "MORON morons mo", "a trash can, trash", "total trash heap trash can idiot", "", "  ", prose(500, 1) + " 1d!ot " + prose(50, 2)]
    for text in texts:
        assert lexicon.raw(text) == pytest.approx(plain_raw(text, weights, ("trash can", "total trash heap")))


def test_edge_cases(spark, make, edge):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    docs = make(edge)
    model = t.fit_toxicity(docs, labels)
    found = t.score_toxicity(docs, model)
    assert found.count() == len(edge)
    assert found.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in found.collect())
    none = t.fit_toxicity(docs, labels.filter("false"))
    assert {r.score for r in t.score_toxicity(docs, none).collect()} == {0.0}
    assert t.score_toxicity(docs.filter("false"), model).count() == 0
    assert t.fit_toxicity(docs.filter("false"), labels).weights == {}
    assert t.drop_toxic(docs, none).schema == docs.schema


def test_learns_words_and_beginnings(spark, make, prose):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        word = ["grimpf" + "aeiou"[i % 5] + "xyz"[i % 3], "blorg"][i % 2] if toxic else "plain"
        text = prose(60, i) + f" {word} " + prose(60, i + 1000)
        rows.append((i, text.replace("blorg", "bl0rg") if i % 3 else text))
        labels.append((i, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = make(rows)
    model = t.fit_toxicity(docs, labels.filter("doc_id < 300"))
    found = t.score_toxicity(docs, model).filter("doc_id >= 300").collect()
    assert all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in found)


def test_held_out_accuracy(spark):
    from tablescope.llm.queries import op1_toxicity

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = op1_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").toPandas()
    right = ((found.predicted == 1) & (found.toxic == 1)).sum()
    assert right / (found.toxic == 1).sum() > 0.9
    assert right / (found.predicted == 1).sum() > 0.9

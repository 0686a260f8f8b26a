"""Rates beside a plain solution, posteriors by held-out accuracy."""

from __future__ import annotations

import numpy as np
import pytest

from tablescope.llm import mixing
from tablescope.llm.queries import op10_mixing


def plain_rates(own, wanted, rounds=20_000):
    """Dykstra's alternating projections of 1 on the targets and on nonnegative rates, with all rows in memory."""
    rate, correction = np.ones(len(own)), np.zeros(len(own))
    inverse = np.linalg.pinv(own.T @ own)
    for _ in range(rounds):
        flat = rate - own @ (inverse @ (own.T @ rate - wanted))
        rate = np.maximum(0, flat + correction)
        correction = flat + correction - rate
    return rate


def test_targets_are_met_as_by_the_plain_version(spark, make, prose):
    rows = [(i, prose(5 + i % 40, i) + (" $$$ %%%" if i % 3 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, "odd" if i % 3 == 0 else "even") for i in range(150)], "doc_id long, domain string")
    docs = make(rows)
    mixture = mixing.fit_classifier(docs, labels, ("even", "odd"))
    mixing.fit_rates(docs, mixture, {"even": 0.2, "odd": 0.8})
    found = mixing.apply_rates(docs, mixture).orderBy("doc_id").collect()
    own = np.array([r.posterior for r in found]) * np.array([[r.n_tokens] for r in found])
    total = own.sum()
    rate = np.array([r.rate for r in found])
    assert (rate >= 0).all()
    assert own.T @ rate == pytest.approx(np.array([0.2, 0.8]) * total, rel=1e-8)
    assert rate == pytest.approx(plain_rates(own, np.array([0.2, 0.8]) * total), abs=1e-4)
    assert np.mean([(r.posterior[1] > 0.5) == (r.doc_id % 3 == 0) for r in found]) > 0.95
    assert all(np.floor(r.rate) <= r.copies <= np.ceil(r.rate) for r in found)


def test_edge_cases(spark, make, edge):
    docs = make(edge)
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 1, None), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    found = mixing.mix(docs, labels).collect()
    assert len(found) == len(edge)
    assert all(r.rate == 1 for r in found if not (r.text or "").split())
    assert mixing.mix(docs.filter("false"), labels).count() == 0
    assert mixing.mix(docs, labels.filter("false")).count() == len(edge)


def test_posteriors_tell_all_three_domains_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    domains = mixing.domain_labels(labels)
    mixture = mixing.fit_classifier(docs, domains.filter("doc_id % 3 > 0"))
    found = mixing.apply_rates(docs, mixture).join(domains.filter("doc_id % 3 = 0"), "doc_id").collect()
    for place, domain in enumerate(mixing.DOMAINS):
        own = [r for r in found if r.domain == domain]
        assert np.mean([int(np.argmax(r.posterior)) == place for r in own]) > (0.65 if domain == "toxic" else 0.9), domain
        assert np.mean([r.posterior[place] for r in own]) > 5 * np.mean([r.posterior[place] for r in found if r.domain != domain])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_meets_its_targets(spark, sf):
    found = op10_mixing(spark, f"/root/testdata/{sf}").collect()
    own = np.array([r.posterior for r in found]) * np.array([[r.n_tokens] for r in found])
    wanted = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * own.sum()
    rate = np.array([r.rate for r in found])
    assert (rate >= 0).all() and {r.residual for r in found} == {found[0].residual} and found[0].residual < 1e-6
    assert np.abs(own.T @ rate - wanted).sum() / own.sum() < 1e-6
    if sf == "sf0.001":
        assert rate == pytest.approx(plain_rates(own, wanted), abs=1e-3)


def test_targets_out_of_reach_leave_a_residual(spark, make):
    docs = make([(i, "word " * (i + 1)) for i in range(20)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    mixture = mixing.fit_rates(docs, mixing.fit_classifier(docs, mixing.domain_labels(labels)))
    assert mixture.residual == pytest.approx(0.1, abs=1e-6)
    assert np.isfinite(mixture.multipliers).all()


def test_a_word_of_a_slice_is_hashed_once(monkeypatch):
    hashed, digest = [], mixing.xxhash.xxh64_intdigest
    monkeypatch.setattr(mixing.xxhash, "xxh64_intdigest", lambda word, *seed: hashed.append(word) or digest(word, *seed))
    lexicon = np.arange(2 * mixing.LEXICON, dtype=np.float32).reshape(2, -1)
    texts = ["one two three one", "", "Two (three)! four$"]
    sizes, given = mixing.features(texts, lexicon)
    # the words as they stand, then those that change without marks and capitals
    assert sorted(hashed) == sorted([b"one", b"two", b"three", b"Two", b"(three)!", b"four$", b"two", b"three"])
    places = [digest(w) % mixing.LEXICON for w in (b"two", b"three", b"four$")]
    assert sizes.tolist() == [4, 0, 3] and given[2, 12] == pytest.approx(sum(places) / np.sqrt(3), rel=1e-6)
    assert given[2, 11] == pytest.approx(1 / 3) and given[0, 6] == 0.5
    assert mixing.features([""], lexicon)[0].tolist() == [0]

"""Occurrences beside a full edit-distance search."""

from __future__ import annotations

import random

import pytest

from tablescope.llm import decontaminate as d


def plain_distance(pattern, text):
    """Least edit distance of the pattern to any run of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def expected(docs, items, rate):
    out = set()
    for i, text in docs:
        for item, own in items:
            pattern, whole = d.plain(own), d.plain(text)
            if pattern and whole and (n := plain_distance(pattern, whole)) <= int(rate * len(pattern)):
                out.add((i, item, n))
    return out


def planted(prose):
    rng = random.Random(4)
    items = [(n, prose(20 + n, 50 + n)) for n in range(6)] + [(6, None), (7, "..."), (8, "of"), (9, prose(20, 50))]
    docs = []
    for n in range(30):
        text = list(items[n % 6][1])
        for _ in range(n // 3):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["q"], [text[at], "z"]])
        docs.append((100 + n, f"{prose(40, n)}, {''.join(text).upper()}! {prose(30, n + 99)}"))
    return docs, items


@pytest.mark.parametrize("block", [300, 2_000_000])
def test_equals_full_search(spark, make, prose, edge, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_CHARS", block)
    docs, items = planted(prose)
    docs += edge[:8]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_leaks(make(docs), table, rate=0.08).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == expected(docs, items, 0.08)
    texts = dict(docs)
    for r in found:
        if r.doc_id is not None and r.doc_id >= 10:
            part = d.plain(texts[r.doc_id])[r.match_begin : r.match_end]
            assert plain_distance(part, d.plain(dict(items)[r.item_id])) <= r.distance
    kept = d.drop_contaminated(make(docs), table, rate=0.08)
    dirty = {r.doc_id for r in found}
    assert kept.schema == make(docs).schema
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in docs if i not in dirty)


def test_empty_tables(spark, make):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = make([(1, "x a b y"), (2, "xa by")])
    assert [(r.doc_id, r.distance) for r in d.find_leaks(docs, items).collect()] == [(1, 0)]
    assert d.find_leaks(docs, items.filter("false")).count() == 0
    assert d.find_leaks(docs.filter("false"), items).count() == 0
    assert d.drop_contaminated(docs, items.filter("false")).count() == 2


def test_registered_query_equals_full_search(spark):
    """Exact substrings by plain search; the edit matches are held against the distance itself."""
    from tablescope.llm.queries import op2_decontaminate

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: d.plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: d.plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id): r.distance for r in op2_decontaminate(spark, sf).collect()}
    for i, text in docs.items():
        for item, own in items.items():
            assert (own in text) == (found.get((i, item)) == 0)

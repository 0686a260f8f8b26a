"""Fingerprints, candidates and components beside all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablescope.llm import simhash


def plain_print(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=4):
    prints = [(i, plain_print(t)) for i, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        before = list(label)
        for a in range(len(rows)):
            for b in range(len(rows)):
                if bin(prints[a][1] ^ prints[b][1]).count("1") <= bits:
                    label[a] = min(label[a], label[b])
        if before == label:
            break
    least = {r: min((prints[i][0] for i in range(len(rows)) if label[i] == r and prints[i][0] is not None), default=None) for r in set(label)}
    return sorted((str(i), f"{p:016x}", str(least[label[n]])) for n, (i, p) in enumerate(prints))


def test_spark_hash_is_the_same(spark):
    value = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert value & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_equals_plain_version(make, edge, prose):
    rows = edge + [(10 + i, prose(300, i)) for i in range(5)]
    base = prose(600, 77).split()
    for i in range(30):
        words = list(base)
        words[i * 7] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows.append((200, " ".join(base).upper() + "\x0b"))
    found = simhash.simhash_groups(make(rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == plain_components(rows)


def test_registered_query_equals_plain_version(spark):
    from tablescope.llm.queries import op9_simhash

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = op9_simhash(spark, sf).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == plain_components(rows)


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 6])
def test_no_link_is_lost_by_the_ring(bits):
    rng = random.Random(bits)
    sets = simhash.ring_keys(bits)
    for _ in range(3000):
        flips = rng.sample(range(64), rng.randint(0, bits + 2))
        x = sum(1 << f for f in flips)
        equal = {s for s in range(8) if not x >> (8 * s) & 255}
        if len(flips) <= bits:
            assert any(set(own) <= equal for own in sets)
        assert simhash.linked(np.array([x], np.uint64), bits)[0] == (len(flips) <= bits)


@pytest.mark.parametrize("small", [2, 32])
def test_buckets_of_many_fingerprints(spark, monkeypatch, small):
    import pyarrow as pa

    rng = random.Random(1)
    values = sorted({rng.getrandbits(16) << 40 for _ in range(400)})
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(values), np.int64)), pa.array(values, pa.int64())], names=["key", "fp"])
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for out in simhash._bucket_edges([batch.slice(0, 100), batch.slice(100)], 4):
        for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True):
            assert bin(a ^ b).count("1") <= 4
            label[max(root(a), root(b))] = min(root(a), root(b))
    linked = {v: v for v in values}
    for _ in range(10):
        for v in values:
            linked[v] = min(linked[w] for w in values if bin(v ^ w).count("1") <= 4)
    if small > 2:
        assert {v: root(v) for v in values} == linked


def test_components_of_chains_and_hubs(spark):
    from tablescope.llm.components import components

    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(1079, 1200), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.a: r.b for r in components(df).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 80)} | {1200: 1000}
    assert components(df.filter("false")).count() == 0


def test_filter_keeps_one_of_each_group(make, edge, prose):
    text = prose(500, 3)
    docs = make(edge + [(50, text), (51, text + " more"), (52, prose(400, 9))])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert 50 in ids and 51 not in ids and 52 in ids
    assert simhash.simhash_groups(docs.filter(F.lit(False))).count() == 0

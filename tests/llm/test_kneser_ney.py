"""The model beside a plain dictionary version, and its sums."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablescope.llm import kneser_ney

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = "\0 end"


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), END]


def discount(n):
    if min(n) == 0:
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0] + [min(float(i), max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]


class Plain:
    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for text in texts:
            words = tokens(text)
            self.one.update(words)
            self.two.update(zip(["<s>", *words], words, strict=False))
        self.total = sum(self.one.values())
        self.after = defaultdict(list)
        seen = Counter()
        for (a, b), c in self.two.items():
            self.after[a].append(c)
            seen[b] += 1
        self.seen = seen
        self.d2 = discount([sum(c == k for c in self.two.values()) for k in (1, 2, 3, 4)])
        self.d1 = discount([sum(c == k for c in seen.values()) for k in (1, 2, 3, 4)])
        self.rest = sum(self.d1[min(c, 3)] for c in seen.values()) / max(1, len(self.two))

    def low(self, w):
        if not self.two:
            return 1 / (len(self.one) + 1)
        c = self.seen[w]
        return max(c - self.d1[min(c, 3)], 0) / len(self.two) + self.rest / (len(self.one) + 1)

    def chance(self, a, b):
        if a not in self.after:
            return self.low(b)
        total = sum(self.after[a])
        c = self.two[a, b]
        return max(c - self.d2[min(c, 3)], 0) / total + sum(self.d2[min(x, 3)] for x in self.after[a]) / total * self.low(b)

    def score(self, text):
        words = tokens(text)
        return sum(math.log10(self.chance(a, b)) for a, b in zip(["<s>", *words], words, strict=False))

    def base(self, text):
        return sum(math.log10((self.one[w] + 1) / (self.total + len(self.one) + 1)) for w in tokens(text))


def compare(found, plain, texts):
    for row, text in zip(found, texts, strict=True):
        words = tokens(text)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(words), sum(plain.one[w] > 0 for w in words), plain.total)
        assert row.base_score == pytest.approx(plain.base(text), abs=1e-9)
        assert row.score == pytest.approx(plain.score(text), abs=1e-6)


@pytest.mark.parametrize("size", [400, 1 << 20])
def test_equals_plain_version(spark, monkeypatch, make, prose, edge, size):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", size)  # many shards, or one
    monkeypatch.setattr(kneser_ney, "FOLD_BYTES", size)
    rows = [(100 + i, prose(30 + 5 * i, i % 7)) for i in range(20)] + [(99, "es " * 300), (98, "unseen words only")] + edge[:7] + [(97, "Ra\x0bRA\x1cra x")]
    docs = make(rows)
    train = [t for i, t in rows if i is not None and i % 3]
    model = kneser_ney.train(docs.filter("doc_id % 3 != 0"))
    plain = Plain(train)
    order = docs.withColumn("n", F.monotonically_increasing_id())
    found = kneser_ney.score(order, model, keep=("doc_id", "n")).orderBy("n").collect()
    compare(found, plain, [t for _, t in rows])
    words = [*plain.one, "<never>"]
    for context in ("<s>", "es", "ra", "nowhere"):
        assert sum(plain.chance(context, w) for w in words) == pytest.approx(1.0)


def test_empty_training_table(make):
    docs = make([(1, "a b"), (2, None)])
    found = kneser_ney.score(docs, kneser_ney.train(docs.filter("false"))).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert kneser_ney.score(docs.filter("false"), kneser_ney.train(docs)).count() == 0


def test_held_out_text_is_likelier_than_under_the_base(spark):
    from tablescope.llm.queries import op5_kneser_ney

    found = op5_kneser_ney(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert found.score.sum() > found.base_score.sum()


def test_registered_query_equals_plain_version(spark):
    import zlib

    from tablescope.llm.queries import op5_kneser_ney

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    plain = Plain([r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2])
    compare(op5_kneser_ney(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect(), plain, [r.text for r in rows])

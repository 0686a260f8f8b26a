"""Pieces beside the tokenizer itself, packings beside exhaustive and plain best fit."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablescope.llm import packing
from tablescope.llm.pieces import END, Encoder, cut_documents, text_ids
from tablescope.llm.queries import op13_packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \t\n", "a<|endoftext|>b <|startoftext|>", "C'S don't x'LL ''s", "ÀÉ é ΣΑΣ İ ſ K ½ ² µ ª", "12ab\x0b\x00q \x85w z\xa0y",
    "日本 語 😀", "\x7f \x1cab", "a" * 9000, "é" * 9000, "1" * 500, "Ünïted, ÑANDÚ! naïve; ×÷",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_whole_text(prose, name):
    path = public_tokenizers.path(name)
    texts = ODD + [prose(200, n).title() + ". " + prose(20, n) + "!" for n in range(20)]
    with open(path, encoding="utf-8") as file:
        encoder = Encoder(file.read())
    assert encoder.by_word == (name == "word_bpe_49k.json")
    offsets, flat = text_ids(pa.array(texts), encoder)
    coder = Tokenizer.from_file(path)
    for text, begin, end in zip(texts, offsets, offsets[1:], strict=False):
        assert flat[begin:end].tolist() == [*coder.encode(text, add_special_tokens=False).ids, END], text


def fewest(lengths, capacity):
    """Smallest number of sequences, by trying all."""
    best = len(lengths)

    def go(at, free):
        nonlocal best
        if len(free) >= best:
            return
        if at == len(lengths):
            best = len(free)
            return
        for f in sorted({f for f in free if f >= lengths[at]}):
            rest = list(free)
            rest.remove(f)
            go(at + 1, [*rest, f - lengths[at]])
        go(at + 1, [*free, capacity - lengths[at]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        at = min((f for f in free if f >= n), default=None)
        if at is not None:
            free.remove(at)
        free.append((capacity if at is None else at) - n)
    return len(free)


def checked(lengths, capacity):
    runs, bound = packing.plan(dict(Counter(lengths)), capacity)
    held = Counter()
    for number, items in runs:
        assert number > 0 and sum(items) <= capacity
        for s in items:
            held[s] += number
    assert held == Counter(lengths)
    return sum(n for n, _ in runs), bound


def test_small_histograms_reach_the_optimum():
    rng = random.Random(5)
    over = 0
    for _ in range(40):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 11))]
        got, bound = checked(lengths, 40)
        least = fewest(lengths, 40)
        assert bound <= least + 1e-9
        over += got - least
    assert over <= 1


def test_configurations_beat_plain_best_fit():
    """Best fit pairs the longest pieces and strands others; the program doesn't."""
    lengths = [1366] * 1000 + [1365] * 2000 + [2049] * 500 + [2047] * 300
    got, bound = checked(lengths, 4096)
    assert bound <= got <= 1436 < best_fit(lengths, 4096)
    rng = random.Random(1)
    wide = [rng.randint(1000, 2100) for _ in range(5000)]
    got, bound = checked(wide, 4096)
    assert bound <= got < 0.97 * best_fit(wide, 4096)


def test_without_configurations_the_plan_is_worse(monkeypatch):
    lengths = [1366] * 1000 + [1365] * 2000 + [2049] * 500 + [2047] * 300
    good = checked(lengths, 4096)[0]
    monkeypatch.setattr(packing, "solve", lambda sizes, counts, capacity: ([], sizes.astype(float)))
    assert checked(lengths, 4096)[0] > good


def test_knapsack_beside_all_multisets():
    sizes, prices, capacity = np.array([9, 7, 4, 3]), np.array([10.0, 7.5, 4.6, 3.0]), 23
    best = packing.knapsack(prices, sizes, capacity)
    for c in range(capacity + 1):
        every = itertools.product(*[range(c // s + 1) for s in sizes])
        assert best[c] == pytest.approx(max(float(np.dot(k, prices)) for k in every if np.dot(k, sizes) <= c))


@pytest.mark.parametrize("lengths", [[], [5], [40] * 7, [1] * 1000, [40, 39, 1, 1, 20, 20], list(range(1, 41)) * 30])
def test_ends(lengths):
    got, bound = checked(lengths, 40)
    assert bound <= got <= sum(lengths) / 40 + 2


def test_whole_operator(spark, make, edge, prose):
    rows = edge + [(100 + n, prose(random.Random(n).randint(1, 3000), n)) for n in range(60)]
    capacity = 512
    docs = make(rows).repartition(5)
    packed = packing.pack(cut_documents(docs, VOCABULARY, capacity), capacity)
    found = packed.collect()
    coder = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, text in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, END]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[i, piece, start, len(part), np.array(part, "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in found) == want
    taken = defaultdict(list)
    for r in found:
        taken[r.sequence_id].append((r.offset, r.length))
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(taken) == packed.sequences <= best_fit([k[3] for k in want.elements()], capacity)
    assert packed.lower_bound <= packed.sequences
    assert packing.pack(cut_documents(docs.filter("false"), VOCABULARY, capacity), capacity).count() == 0


def test_columns_are_carried_and_bad_lengths_refused(spark):
    rows = spark.createDataFrame([(3, "a", 9, 1, 2), (4, "b", 9, 1, 2)], "length int, part string, offset int, nth int, size int")
    found = packing.pack(rows, 8)
    assert found.columns == ["length", "part", "nth", "size", "sequence_id", "offset"]
    assert sorted(tuple(r) for r in found.collect()) == [(3, "a", 1, 2, 0, 4), (4, "b", 1, 2, 0, 0)]
    for bad in (0, 9, None):
        with pytest.raises(Exception, match="length from 1"):
            packing.pack(spark.createDataFrame([(bad,)], "length int"), 8)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    found = op13_packing(spark, sf).collect()
    coder = Tokenizer.from_file(VOCABULARY)
    want, lengths = Counter(), []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[r.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
            lengths.append(len(part))
    assert Counter(tuple(r)[:5] for r in found) == want
    assert len({r.sequence_id for r in found}) <= best_fit(lengths, 4096)

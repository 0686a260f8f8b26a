"""Removed words beside a dictionary of all windows."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest

from tablescope.llm import lz_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, window):
    first = {}
    low = float("-inf")
    for i, t in rows:
        words = WORD.findall(t or "")
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, float("inf")), low if i is None else i)
    out = []
    for i, t in rows:
        words, gone = WORD.findall(t or ""), set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < (low if i is None else i):
                gone.update(range(at, at + window))
        out.append((str(i), len(words), len(gone), " ".join(w for n, w in enumerate(words) if n not in gone)))
    return sorted(out)


def rows_of(prose, edge):
    passage, other = prose(70, 1), prose(55, 2)
    rows = list(edge[:8])
    rows += [(20 + i, f"{prose(20 + i, i + 10)} {passage} {prose(15, i + 40)}") for i in range(12)]
    rows += [(40 + i, f"{passage[: 200 + 20 * i]} {other}  \x0b{passage[60:]}") for i in range(8)]
    rows += [(60, "la " * 300), (61, "la " * 260 + "x " * 120), (62, "x " * 200 + passage), (7, passage + " " + passage), (63, prose(49, 1)), (64, prose(50, 1)), (65, prose(50, 1))]
    rows += [(None, passage), (30, passage), (66, "a b " * 100), (67, "b a " * 100), (68, "A b " * 100)]
    return rows


@pytest.mark.parametrize("frequent", [False, True])
@pytest.mark.parametrize("window", [50, 9, 2])
def test_equals_plain_version(make, prose, edge, monkeypatch, window, frequent):
    if frequent:  # every block counts as frequent
        monkeypatch.setattr(lz_dedup, "COUNTED", 1)
        monkeypatch.setattr(lz_dedup, "FREQUENT_COUNT", 3)
        monkeypatch.setattr(lz_dedup, "FREQUENT_SHARE", 0.0)
    monkeypatch.setattr(lz_dedup, "AT_ONCE", 64)
    rows = rows_of(prose, edge)
    found = lz_dedup.remove_repeats(make(rows), window=window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in found) == expected(rows, window)
    assert all(sum(s.end - s.begin for s in r.removed) == r.n_removed for r in found)


def test_empty_table(make):
    assert lz_dedup.remove_repeats(make([(1, "a")]).filter("false")).count() == 0


@pytest.mark.parametrize("frequent", [False, True])
def test_windows_that_share_half_a_hash_are_different(make, prose, monkeypatch, frequent):
    """Pairs of windows with one block, one place and the same upper 32 bits of the hash."""
    if frequent:
        monkeypatch.setattr(lz_dedup, "COUNTED", 1)
        monkeypatch.setattr(lz_dedup, "FREQUENT_COUNT", 2)
        monkeypatch.setattr(lz_dedup, "FREQUENT_SHARE", 0.0)
    ends = [(48644, 162944), (187396, 200141), (14388, 90487), (143777, 212953), (40379, 102625)]
    rows = [(i, f"{prose(49, 5)} v{end}") for i, end in enumerate(e for pair in ends for e in pair)]
    found = lz_dedup.blocks_of(pa.array([t for _, t in rows]), 50)
    assert len(set(found.hashes)) == len(set(found.offsets)) == 1 and len(set(found.windows >> 32)) == len(ends)
    assert {r.n_removed for r in lz_dedup.remove_repeats(make(rows)).collect()} == {0}


def test_input_columns_named_like_inner_ones(make, prose):
    inner = ("_id", "_TAG", "_runs", "_text_", "_given_", "first.id")
    docs = make([(1, prose(60, 1)), (2, prose(60, 1))])
    for n in inner:
        docs = docs.selectExpr("*", f"'own {n}' AS `{n}`")
    rows = lz_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {1: 0, 2: 60}
    assert all(r[n] == f"own {n}" for r in rows for n in inner)

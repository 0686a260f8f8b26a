"""Exact groups beside a dictionary version."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from tablescope.llm import exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(top[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("width", [1, 7, 256])
def test_equals_plain_version(make, edge, prose, monkeypatch, width):
    monkeypatch.setattr(exact_dedup, "FIRST_WIDTH", width)
    monkeypatch.setattr(exact_dedup, "FIRST_CHARS", 3)
    long = prose(200, 1)
    rows = edge + [(10, "ÄB"), (11, "Äb"), (12, "äb"), (20, long), (21, long.upper()), (22, long[:-1] + "z"), (23, "é" * 40), (24, "é" * 40), (25, "x" * 49_999 + "y"), (26, "x" * 50_000)]
    rows += [(30 + i, "copy of the same text") for i in range(40)]
    found = exact_dedup.exact_groups(make(rows)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == expected(rows)
    kept = [(r.keep_id, r.text_sha256) for r in found if r.kept]
    assert len(kept) == len(set(kept)) == len({lower(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_filter_returns_the_rows_of_the_table(make, edge):
    docs = make(edge)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.select("doc_id", "text").collect()) == sorted(
        [("3", "  \n\t "), ("2", ""), ("4", "alpha beta"), ("4", "other text"), ("5", "x" * 50_000)]
    )


def test_empty_table(make):
    assert exact_dedup.exact_groups(make([(1, "a")]).filter("false")).collect() == []

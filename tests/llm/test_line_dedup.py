"""Alignment and deletion beside a comparison of all pairs of documents, line by line."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tablescope.llm import line_dedup as d


def test_patience_is_a_valid_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in "ab")
        found = d.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p < r and q < s for (p, q), (r, s) in zip(found, found[1:], strict=False))
    assert d.patience(list("xabcy"), list("abc")) == [(1, 0), (2, 1), (3, 2)]


def norm(text):
    return [" ".join(line.split()) for line in (text or "").split("\n") if line.split()]


def covered(earlier, later):
    """Lines of later in a run of at least five words that is consecutive in both, by a table of all line pairs."""
    gone = set()
    for p in range(-len(later), len(earlier)):
        run = []
        for q in range(len(later) + 1):
            if q < len(later) and 0 <= p + q < len(earlier) and earlier[p + q] == later[q]:
                run.append(q)
                continue
            if sum(len(later[i].split()) for i in run) >= 5:
                gone.update(run)
            run = []
    return gone


def expected(rows):
    """Document -> removed lines, from all pairs of documents and all pairs of their lines."""
    lines = {i: norm(text) for i, text in rows}
    return {b: sorted(set().union(*(covered(lines[a], lines[b]) for a in lines if a < b))) for b in lines}


def numbers(found, rows):
    """Removed lines counted without blank ones."""
    texts = dict(rows)
    filled = {i: [n for n, x in enumerate((texts[i] or "").split("\n")) if x.split()] for i in texts}
    return {r.doc_id: [filled[r.doc_id].index(n) for n in r.removed] for r in found}


def corpus(prose):
    lines = [prose(8 + i % 5, i) for i in range(60)]
    rng = random.Random(3)
    rows = []
    for i in range(40):
        start = rng.randrange(50)
        own = ["Shared boilerplate line for everyone here.", *lines[start : start + rng.randint(1, 9)], "", f"own line number {i} of this document"]
        rows.append((i, "\n".join(own)))
    return rows


def test_equals_all_pairs(make, prose):
    rows = corpus(prose)
    assert numbers(d.drop_repeated_lines(make(rows)).collect(), rows) == expected(rows)


def test_equals_all_pairs_with_short_lines_in_any_order(make):
    """Lines of one to six words, few distinct ones, so blocks cross and overlap; repeated lines lose no more than that."""
    rng = random.Random(9)
    lines = [" ".join(f"w{n}{k}" for k in range(1 + n % 6)) for n in range(9)]
    for size in (4, 9):
        rows = [(i, "\n".join(rng.sample([*lines[:size], "", f"own {i}"], rng.randint(0, size)))) for i in range(60)]
        assert numbers(d.drop_repeated_lines(make(rows)).collect(), rows) == expected(rows)
    rows = [(i, "\n".join(rng.choice([*lines, ""]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    found, most = numbers(d.drop_repeated_lines(make(rows)).collect(), rows), expected(rows)
    assert all(set(found[i]) <= set(most[i]) for i in most) and any(found.values())


def test_an_earlier_document_keeps_no_later_copy(make, prose):
    """Blocks in another order: what one earlier document removes, a further one doesn't bring back."""
    p, q, own = prose(9, 1), prose(9, 2), prose(9, 3)
    rows = [(1, f"{p}\n{q}"), (2, f"{q}\n{own}"), (3, f"{q}\n{p}")]
    assert {r.doc_id: r.removed for r in d.drop_repeated_lines(make(rows)).collect()} == {1: [], 2: [0], 3: [0, 1]}
    assert {r.doc_id: r.removed for r in d.drop_repeated_lines(make(rows[1:])).collect()} == {2: [], 3: [0]}


def test_lines_of_one_word(make):
    text = "alpha\nbeta\ngamma\ndelta\nepsilon\nzeta"
    found = {r.doc_id: r.removed for r in d.drop_repeated_lines(make([(1, text), (2, text), (3, "beta\ngamma\ndelta\nepsilon")])).collect()}
    assert found == {1: [], 2: [0, 1, 2, 3, 4, 5], 3: []}


def test_input_columns_named_like_inner_ones(make, prose):
    inner = ("_id", "_TAG", "_gone", "_text_", "_given_", "first.id")
    docs = make([(1, prose(9, 1)), (2, prose(9, 1))])
    for n in inner:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    rows = d.drop_repeated_lines(docs).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {1: 0, 2: 1}
    assert all(r[n] == f"own {n}" for r in rows for n in inner)


def test_nothing_goes_without_the_alignment(make, prose, monkeypatch):
    rows = [(1, prose(9, 1)), (2, prose(9, 1))]
    lines = norm(rows[0][1])
    assert d.common_blocks(lines, lines, [9]) == [0]
    monkeypatch.setattr(d, "patience", lambda one, other: [])
    assert d.common_blocks(lines, lines, [9]) == []


def test_boilerplate_alone_links_nothing(make, prose):
    rows = [(i, f"The same frequent line everywhere.\n{prose(20, i)}") for i in range(10)]
    assert {r.n_removed for r in d.drop_repeated_lines(make(rows), rare=5).collect()} == {0}
    rows.append((20, rows[3][1] + "\nmore text of its own"))
    found = {r.doc_id: r.kept_text for r in d.drop_repeated_lines(make(rows), rare=5).collect()}
    assert found[20] == "more text of its own" and found[3] == rows[3][1]


def test_edge_cases(make, edge):
    found = d.drop_repeated_lines(make(edge + [(9, "one two three four five six"), (9, "one two three four five six"), (10, " one two\tthree four five six \n")]))
    rows = found.collect()
    assert len(rows) == len(edge) + 3
    assert {(r.n_removed, r.kept_text) for r in rows if r.doc_id == 9} == {(0, "one two three four five six")}
    assert [(r.n_removed, r.kept_text) for r in rows if r.doc_id == 10] == [(1, "")]
    assert d.drop_repeated_lines(make(edge).filter(F.lit(False))).count() == 0


def test_registered_query_equals_plain_version(spark):
    from tablescope.llm.queries import op6_line_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found, most = numbers(op6_line_dedup(spark, sf).collect(), rows), expected(rows)
    for i, text in rows:
        lines = norm(text)
        assert set(found[i]) <= set(most[i]) and {lines[n] for n in found[i]} == {lines[n] for n in most[i]}
        assert found[i] == most[i] or len(set(lines)) < len(lines)


def test_frequent_line_goes_at_every_frequency(make, prose):
    """One line with other neighbours in each of 130 documents."""
    rows = [(i, f"{prose(9, i)}\nThe same frequent line stands everywhere.\n{prose(9, i + 500)}") for i in range(130)]
    found = {r.doc_id: r.removed for r in d.drop_repeated_lines(make(rows)).collect()}
    assert found == {i: [1] if i else [] for i in range(130)}


def test_longest_common_has_the_length_of_the_plain_table(monkeypatch):
    rng = random.Random(4)
    for limit in (1 << 28, 6):
        monkeypatch.setattr(d, "LCS_BITS", limit)
        for _ in range(300):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in "ab")
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            found = d.longest_common(a, b)
            assert len(found) == table[-1][-1] and all(a[i] == b[j] for i, j in found)
            assert all(p < r and q < s for (p, q), (r, s) in zip(found, found[1:], strict=False))


def test_passage_twice_in_the_later_document(make, prose):
    line, own = "A passage of more than five words.", [prose(9, i) for i in range(3)]
    rows = [(1, line), (2, "\n".join([own[0], line, own[1], line, own[2]]))]
    found = {r.doc_id: (r.n_removed, r.kept_text.count(line)) for r in d.drop_repeated_lines(make(rows)).collect()}
    assert found == {1: (0, 1), 2: (1, 1)}

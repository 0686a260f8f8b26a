"""Licence blocks: exact notices, changed wording, plain text."""

from __future__ import annotations

import re

from tablescope.llm import licenses as li


def found(make, texts):
    return {r.doc_id: r for r in li.scan_licenses(make(list(enumerate(texts)))).collect()}


def test_every_template_is_found_exactly(make, prose):
    names = list(li.TEMPLATES)
    texts = [f"{prose(40, i)}\n{li.TEMPLATES[n].replace('#', '4.0')}\n{prose(30, i + 50)}" for i, n in enumerate(names)]
    rows = found(make, texts)
    for i, name in enumerate(names):
        assert rows[i].license == name and rows[i].exact and rows[i].differences == 0, name
        assert texts[i][rows[i].block_begin : rows[i].block_end].startswith(li.TEMPLATES[name][:10])


def test_changed_wording_is_reported(make):
    text = li.TEMPLATES["MIT"].replace("merge", "blend").replace("free of charge", "free of any charge")
    row = found(make, [text])[0]
    assert (row.license, row.exact, row.differences) == ("MIT", False, 3)
    assert row.missing == ["merge"] and sorted(row.extra) == ["any", "blend"]
    assert found(make, ["You need a license to drive; the copyright of this poem and all warranty are gone."]) == {}


def test_lines_inside_a_notice(make):
    words = li.TEMPLATES["ISC"].split()
    text = "\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))
    assert found(make, [text])[0].license == "ISC"


def test_winner_equals_a_search_over_all_templates(spark):
    """Without compression: every template against every block."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {(r.doc_id, r.block_begin): (r.license, r.differences) for r in li.scan_licenses(docs).collect()}
    scanner, want = li.Scanner(li.TEMPLATES), {}
    for doc in docs.collect():
        for begin, end in li.candidate_blocks(doc.text or ""):
            own = [(c[0] / len(scanner.words[n]), -len(scanner.words[n]), n, c[0]) for n in li.TEMPLATES if (c := scanner.confirmed(doc.text[begin:end], n))]
            if own:
                want[doc.doc_id, begin] = min(own)[2:]
    assert rows == want


def test_edge_cases(make, edge):
    assert li.scan_licenses(make(edge)).count() == 0
    assert li.scan_licenses(make(edge).filter("false")).count() == 0
    long = "word " * 30_000 + "Released under the MIT License. " + "word " * 30_000
    assert found(make, [long])[0].license == "MIT-reference"


def test_notice_inside_other_text(make, prose):
    """On one long line, between long lines of cues, and in capitals."""
    names = [n for n in li.TEMPLATES if n != "Proprietary"]
    notices = [li.TEMPLATES[n].replace("#", "4.0") for n in names]
    cues = "\n".join(f"{prose(12, i)} copyright {prose(12, i + 90)}" for i in range(40))
    for around in (f"{prose(120, 1)} @ {prose(90, 2)}", f"{prose(9, 3)} @ {prose(9, 4)}", f"{cues}\n{prose(30, 5)} @ {prose(30, 6)}\n{cues}"):
        texts = [around.replace("@", n) for n in notices]
        rows = found(make, texts)
        for i, name in enumerate(names):
            assert rows[i].license == name and rows[i].exact, name
            assert texts[i][rows[i].block_begin : rows[i].block_end] == notices[i], name
    row = found(make, [f"{prose(60, 7)} RELEASED UNDER THE MIT LICENSE. {prose(60, 8)}"])[0]
    assert (row.license, row.differences) == ("MIT-reference", 0)


def test_notice_in_narrow_lines_with_few_cues(make):
    words = li.TEMPLATES["MIT"].split()
    text = "\n".join(" ".join(words[i : i + 3]) for i in range(0, len(words), 3))
    row = found(make, [text])[0]
    assert (row.license, row.exact, text[row.block_begin : row.block_end]) == ("MIT", True, text)


def test_changed_notice_inside_prose_keeps_one_run(make, prose):
    """As many changed words as are allowed, spread over the whole notice."""
    for name in ("MIT", "GPL", "BSD-3-Clause"):
        words = li.TEMPLATES[name].split()
        allowed = int(li.DIFFERENCES * len(li.words_of(li.TEMPLATES[name]))) // 2
        for n in range(allowed):
            words[(2 * n + 1) * len(words) // (2 * allowed)] = f"changed{n}"
        row = found(make, [f"{prose(50, 1)} {' '.join(words)} {prose(50, 2)}"])[0]
        assert row.license == name and 0 < row.differences <= 2 * allowed, name


def test_every_licence_of_a_block(make, prose):
    """Neighbouring lines, one line, and all templates in one block, each with its own range."""
    own = [li.TEMPLATES[n].replace("#", "2020") for n in ("Proprietary", "MIT-reference", "GPL-reference", "MIT", "MIT-reference")]
    every = [t.replace("#", "4.0") for t in li.TEMPLATES.values()]
    texts = ["\n".join(own), " ".join(own), f"{prose(30, 1)} {' '.join(every)} {prose(30, 2)}"]
    rows = li.scan_licenses(make(list(enumerate(texts)))).collect()
    for i, notices in enumerate((own, own, every)):
        found = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.block_begin)
        assert [texts[i][r.block_begin : r.block_end] for r in found] == notices
        assert all(r.exact for r in found)
    assert [r.license for r in sorted((r for r in rows if r.doc_id == 2), key=lambda r: r.block_begin)] == list(li.TEMPLATES)


def test_notices_that_touch_are_compared_without_each_other(make):
    """The changed end of one notice lies beside an exact one whose words stand in its window."""
    first = li.TEMPLATES["ISC"].removesuffix("in all copies.") + "everywhere."
    rows = li.scan_licenses(make([(1, f"{first} {li.TEMPLATES['CC-BY'].replace('#', '4.0')} {first}")])).collect()
    assert sorted((r.block_begin, r.license, r.differences) for r in rows) == [
        (0, "ISC", 3), (len(first) + 1, "CC-BY", 0), (len(first) + 27, "ISC", 3),
    ]


def test_nothing_is_found_without_compression(make, monkeypatch):
    """Every licence comes through the bytes its template saves."""
    scanner = li.Scanner(li.TEMPLATES)
    text = li.TEMPLATES["ISC"]
    assert [f[2] for f in scanner.scan(text)] == ["ISC"]
    scanner.given = dict.fromkeys(scanner.given, scanner.plain)
    assert list(scanner.scan(text)) == []
    words = li.words_of(li.TEMPLATES["BSD-3-Clause"])
    ranked = [name for _, name in li.Scanner(li.TEMPLATES).ranked(words)]
    assert ranked[:2] == ["BSD-3-Clause", "BSD-2-Clause"] and "CC0" not in ranked


def test_exact_notices_equal_a_search_by_pattern(spark):
    """Notices without a differing word, found by one pattern per template in whole texts, longest first."""
    # one point, hyphen or slash joins two parts of a word
    patterns, between = [], r"(?:[^\w#]*[^\w#.\-/]|[.\-/]{2})[^\w#]*"
    for name, template in sorted(li.TEMPLATES.items(), key=lambda t: -len(li.words_of(t[1]))):
        parts = [r"[\w#]+(?:[.\-/]\w+)*" if w == "#" else re.escape(w) for w in li.words_of(template)]
        patterns.append((name, re.compile(r"(?<!\w)" + between.join(parts) + r"(?![.\-/]?\w)", re.IGNORECASE)))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = set()
    for doc in docs.collect():
        text = doc.text or ""
        for name, pattern in patterns:
            for m in pattern.finditer(text):
                want.add((doc.doc_id, m.start(), name))
            text = pattern.sub(lambda m: "\0" * len(m.group()), text)
    found = {(r.doc_id, r.block_begin, r.license) for r in li.scan_licenses(docs).where("exact").collect()}
    assert found == want and want


def test_two_clauses_affero_and_short_lines(make, prose):
    texts = ["SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the MIT license.", "MIT License\n\nCopyright (c) 2019 Jane Doe"]
    texts += [f"{prose(20, 1)}\n{li.TEMPLATES[n].replace('#', '3')}\n{prose(20, 2)}" for n in ("BSD-2-Clause", "BSD-3-Clause", "AGPL", "GPL")]
    rows = [(r.doc_id, r.license, r.differences) for r in li.scan_licenses(make(list(enumerate(texts)))).orderBy("doc_id").collect()]
    names = ["SPDX", "MIT-licensed", "MIT-title", "BSD-2-Clause", "BSD-3-Clause", "AGPL", "GPL"]
    assert rows == [(i, n, 0) for i, n in enumerate(names)]

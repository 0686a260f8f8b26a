"""Repairs beside a search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tablescope.llm import ranking, repair
from tablescope.llm.queries import op12_repair

SF = "/root/testdata/sf0.001"
RULE = re.compile(r"(s?(ua)+)?")


def plain_fault(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        if not last:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if last[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, repaired rows), growing every prefix of edits that the rule's prefixes allow, cheapest first."""
    faults = plain_fault(rows)
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def inserted(table):
        for _ in range(3):
            for key, (cost, audit, out) in list(table.items()):
                for x in follows[key]:
                    if x in "ua":
                        better(table, x, (cost + 5, audit + "I", (*out, ("user" if x == "u" else "assistant", ""))))
        return table

    best = inserted(best)
    for (role, text), fault in zip(rows, faults):
        new = {}
        for key, (cost, audit, out) in best.items():
            better(new, key, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            late = 5 if fault == "truncated" else 0
            if role[:1] and role[:1] in follows[key] and (role[:1] != "s" or key == ""):
                better(new, role[:1], (cost + late, audit + "K", (*out, (role, text))))
            for x in follows[key]:
                if x in "ua":
                    better(new, x, (cost + late + 1, audit + "R", (*out, ("user" if x == "u" else "assistant", text))))
        best = inserted(new)
    cost, audit, out = min(best[k] for k in ("", "a") if k in best)
    assert RULE.fullmatch("".join(r[0] for r, _ in out))
    return cost, audit, out


def plain_summary(conv, rows):
    """rows: (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, t) for _, r, t in rows]
    faults = plain_fault(pairs)
    starts = [r[:1] for r, _ in pairs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
    cost, audit, out = plain_repair(pairs)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def key(row):
    return (row[0] is not None, row[0] or 0)


def grouped(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role, text))
    return out


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "a", None]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "x" * 70 + ".", "x" * 70 + "!", "é. \n", None, "ok.\x0b"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            at = None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 3])
            rows.append((conv if conv else None, at, rng.choice(roles), rng.choice(texts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, digest string")


def spaced(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("part_rows, solved", [(8192, 16384), (3, 16384), (1, 7)])
def test_random_conversations(spark, monkeypatch, part_rows, solved):
    monkeypatch.setattr(repair, "PART_ROWS", part_rows)
    monkeypatch.setattr(repair, "SOLVED_ROWS", solved)
    rows = random_rows(part_rows, 60, 14) + [(900, n, "user", "again.") for n in range(40)] + [(901, 5, "user", "same.")] * 9
    found = repair.repair_summary(frame(spark, rows).repartition(6)).collect()
    want = [plain_summary(conv, part) for conv, part in grouped(spaced(rows)).items()]
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_parts_hold_the_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART_ROWS", 4)
    rows = random_rows(3, 20, 12)
    got = {}
    for p in repair.repair(frame(spark, rows)).orderBy("conv_id", "part").collect():
        edits, lines = got.setdefault(p.conv_id, ([], []))
        edits.append(p.edits)
        lines += zip(p.roles, p.texts)
    for conv, part in grouped(spaced(rows)).items():
        cost, audit, out = plain_repair([(r, t) for _, r, t in sorted(part, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))])
        assert ("".join(got[conv][0]), tuple(got[conv][1])) == (audit, out)


def all_paths(grammar, codes, state):
    """Every cheapest letter string from a state, by trying all edits."""
    best = (10**9, set())

    def go(at, state, cost, word, spare):
        nonlocal best
        if cost > best[0]:
            return
        if at == len(codes):
            best = (cost, {word}) if cost < best[0] else (cost, best[1] | {word})
            return
        for arc, letter in enumerate(grammar.letters.tolist()):
            to = grammar.target[codes[at], state, arc]
            if to < 0:
                continue
            stays = arc >= grammar.first_insert
            if stays and not spare:
                continue
            go(at if stays else at + 1, to, cost + int(grammar.cost[codes[at], state, arc]), word + (chr(letter) if letter else ""), spare - stays if stays else 3)

    go(0, state, 0, "", 3)
    return best


#: Changed rows may walk two ways, so equal letters lead to different states and ranks decide.
FORKED = ranking.Grammar(
    arcs={(0, "u"): 0, (0, "a"): 3, (0, "y"): 3, (1, "a"): 0, (1, "y"): 0, (2, "a"): 1, (2, "x"): 0, (3, "u"): 0, (3, "x"): 3}, accepting=(0,), insert=3
)


@pytest.mark.parametrize("grammar", [ranking.CHAT, FORKED])
def test_least_path_beside_all_paths(grammar):
    rng = random.Random(9)
    parts = [[rng.randrange(grammar.end) for _ in range(rng.randint(0, 5))] + [grammar.end] for _ in range(60)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    zero = np.zeros((len(parts), grammar.states), np.int64)
    found = ranking.Ranked(grammar, np.concatenate(parts), starts, zero, zero)
    offsets, arcs, prices = found.paths(np.zeros(len(parts), np.int64))
    for p, codes in enumerate(parts):
        cost, words = all_paths(grammar, codes, 0)
        letters = grammar.letters[arcs[offsets[p] : offsets[p + 1]]]
        assert (int(prices[offsets[p] : offsets[p + 1]].sum()), "".join(chr(x) for x in letters if x)) == (cost, min(words))


def test_ranks_decide_where_letters_are_equal():
    """Without ranks some path is no longer the least."""
    rng = random.Random(9)
    parts = [[3 * rng.randrange(5) for _ in range(6)] + [FORKED.end] for _ in range(600)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    zero = np.zeros((len(parts), FORKED.states), np.int64)

    def words(made):
        offsets, arcs, _ = made.paths(np.zeros(len(parts), np.int64))
        return ["".join(chr(x) for x in FORKED.letters[arcs[b:e]] if x) for b, e in zip(offsets, offsets[1:])]

    good = ranking.Ranked(FORKED, np.concatenate(parts), starts, zero, zero)
    least = words(good)
    assert least == [min(all_paths(FORKED, codes, 0)[1]) for codes in parts]
    good.ranks = np.zeros_like(good.ranks)
    other = words(good)
    assert other != least and all(a <= b for a, b in zip(least, other))


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_forked_grammar_in_parts(spark, monkeypatch, cut):
    monkeypatch.setattr(repair, "PART_ROWS", 100)
    rng = random.Random(cut)
    rows = [(c, t, rng.choice(["user", "assistant", "x", "y"]), rng.choice("abcdefgh") * t + ".") for c in range(30) for t in range(12)]
    want = {r.conv_id: (r.cost, r.audit) for r in repair.repair_summary(frame(spark, rows), FORKED).collect()}
    monkeypatch.setattr(repair, "PART_ROWS", cut)
    assert {r.conv_id: (r.cost, r.audit) for r in repair.repair_summary(frame(spark, rows), FORKED).collect()} == want


def test_no_rows(spark):
    none = frame(spark, [(1, 1, "user", "x")]).filter("false")
    assert repair.repair(none).count() == 0 and repair.repair_summary(none).count() == 0


def test_query_beside_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = grouped(plain_damage(rows))
    nothing = hashlib.sha256(b"").hexdigest()
    want = [plain_summary(c, after[c]) if c in after else (c, 0, 0, 0, 0, 0, 0, "", nothing) for c in {r[0] for r in rows}]
    found = op12_repair(spark, SF)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_damage_of_nulls(spark):
    rows = [(None, n, None, None) for n in range(60)] + [(n, None, "user", "A. b? c!") for n in range(60)]
    found = repair.damaged(frame(spark, rows))
    assert sorted(map(str, found.collect())) == sorted(map(str, map(lambda r: spark_row(*r), plain_damage(rows))))


def spark_row(conv, turn, role, text):
    from pyspark.sql import Row

    return Row(conv_id=conv, turn=turn, role=role, text=text)

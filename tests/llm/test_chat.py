"""Formatting and its exact way back."""

from __future__ import annotations

import numpy as np
import pytest

from tablescope.llm import chat

ODD = ["<|im_end|>", "<\\|im_start|>", "<\\\\| x", "<|", "<", "|>", "", "a<|b<\\|c", "<|im_sep|>é\n", "  \x00 😀", "<<||"]


@pytest.mark.parametrize("text", ODD)
def test_escape_is_reversible(text):
    own = chat.escape(text)
    assert "<|" not in own and chat.unescape(own) == text


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")


@pytest.mark.parametrize("part", [1, 50, 1 << 18])
def test_round_trip(spark, prose, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_TOKENS", part)
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 7)
    rows = [(n, t, ["user", "assistant", "system", None][(n + t) % 4], ODD[(n * 3 + t) % len(ODD)], 0) for n in range(12) for t in range(6)]
    rows += [(50, t, "assistant", prose(30, t), 0) for t in range(300)]
    rows += [(None, 0, "user", "no id", 0), (60, None, "a\nb<|im_sep|>", None, 0), (60, 1, "user", "same", 0), (60, 1, "user", "same", 0), (61, 0, "assistant", "x" * 20_000, 0)]
    vocabulary = chat.load_vocabulary(spark)
    parts = chat.format_chats(rows_of(spark, rows), vocabulary).orderBy("conv_id", "part").collect()
    coder = chat.encoding(vocabulary.value)
    back, lost = {}, {}
    for p in parts:
        ids, mask = np.array(p.token_ids, np.int32), np.array(p.loss_mask, np.int8)
        assert len(ids) == len(mask)
        for role, text, masked, _ in chat.read_turns(ids, mask, coder):
            back.setdefault(p.conv_id, []).append((role, text))
            lost[p.conv_id] = lost.get(p.conv_id, "") + masked
            assert masked == (text if role == "assistant" else "")
    want = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert back == want


def test_mask_by_prefix_sums():
    ids, mask = chat.assemble([([7], [1, 2], False), ([8], [3, 4, 5], True), ([8], [], True), ([], [6], True)], (100, 101, 102))
    assert ids.tolist() == [100, 7, 101, 1, 2, 102, 100, 8, 101, 3, 4, 5, 102, 100, 8, 101, 102, 100, 101, 6, 102]
    assert ids[mask == 1].tolist() == [3, 4, 5, 6]


def test_no_rows(spark):
    vocabulary = chat.load_vocabulary(spark)
    none = rows_of(spark, [(1, 1, "user", "x", 1)]).filter("false")
    assert chat.digest_chats(chat.format_chats(none, vocabulary), vocabulary).count() == 0

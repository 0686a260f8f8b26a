"""Chat formatting by token-level assembly.

Role and text of every turn are encoded separately; reserved ids, which no text
can produce, mark where a turn starts, where its text starts and where it ends.
Control strings inside texts are escaped reversibly, so the formatted string is
unambiguous as well.  The loss mask follows from prefix sums over +1 / -1 marks
at the ends of the assistant texts.

Rows are dealt by ranges of (conversation, turn): a conversation of any length
is split over tasks and comes out as several parts.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
#: Characters encoded at once, so that a very long word costs bounded time.
SEGMENT_CHARS = 4096
#: Tokens after which a part is closed at the end of a turn.
PART_TOKENS = 1 << 18
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
TURN = "conv_id long, turn long, role_ids array<int>, text_ids array<int>, loss boolean"
PART = "conv_id long, part long, token_ids array<int>, loss_mask array<byte>"


def escape(text: str) -> str:
    """One backslash more inside every `<|`, `<\\|`, `<\\\\|` and so on."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@functools.lru_cache(maxsize=4)
def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def reserved(coder: tiktoken.Encoding) -> tuple[int, int, int]:
    """Ids above the vocabulary for the three control strings."""
    return tuple(coder.max_token_value + n for n in (1, 2, 3))


def encode(coder: tiktoken.Encoding, text: str) -> list[int]:
    own = escape(text)
    return [t for at in range(0, len(own), SEGMENT_CHARS) for t in coder.encode_ordinary(own[at : at + SEGMENT_CHARS])]


def _encoded(batches: Iterable[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    coder, roles = encoding(vocabulary.value), {}
    for batch in batches:
        names = batch.column("role").to_pylist()
        roles |= {r: encode(coder, r) for r in set(names) - roles.keys()} if len(roles) < 1000 else {}
        heads = [roles[r] if r in roles else encode(coder, r) for r in names]
        bodies = [encode(coder, t) for t in batch.column("text").to_pylist()]
        ids = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array(heads, ids), pa.array(bodies, ids), pa.array([r == "assistant" for r in names])],
            names=["conv_id", "turn", "role_ids", "text_ids", "loss"],
        )


def assemble(turns: list[tuple[list[int], list[int], bool]], marks: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of some turns, and the mask over the assistant texts."""
    start, middle, stop = ([m] for m in marks)
    pieces = [p for head, body, _ in turns for p in (start, head, middle, body, stop)]
    ends = np.cumsum([len(p) for p in pieces])
    change = np.zeros(int(ends[-1]) + 1, np.int32)
    bodies = np.flatnonzero([loss for _, _, loss in turns]) * 5 + 3
    np.add.at(change, ends[bodies - 1], 1)
    np.add.at(change, ends[bodies], -1)
    return np.fromiter((t for p in pieces for t in p), np.int32, int(ends[-1])), np.cumsum(change)[:-1].astype(np.int8)


def _parts(batches: Iterable[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    marks = reserved(encoding(vocabulary.value))
    number = TaskContext.get().partitionId() << 32
    current, turns, size = None, [], 0

    def part() -> pa.RecordBatch:
        ids, mask = assemble(turns, marks)
        row = [pa.array([current], pa.int64()), pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))]
        return pa.RecordBatch.from_arrays(row, names=["conv_id", "part", "token_ids", "loss_mask"])

    for batch in batches:
        for conv, head, body, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role_ids", "text_ids", "loss")), strict=True):
            if turns and (conv != current or size >= PART_TOKENS):
                yield part()
                number, turns, size = number + 1, [], 0
            current = conv
            turns.append((head, body, loss))
            size += len(head) + len(body) + 3
    if turns:
        yield part()


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gather small batches, one part each, into larger ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= 4 << 20:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def load_vocabulary(spark, path: str = VOCABULARY):
    """The vocabulary file, read on the driver and broadcast; its size is checked."""
    with open(path, "rb") as file:
        data = file.read()
    if len(data) > 64 << 20:
        raise ValueError("A vocabulary file of more than 64 MB isn't broadcast.")
    return spark.sparkContext.broadcast(data)


def format_chats(chats: DataFrame, vocabulary) -> DataFrame:
    """Formatted conversations: conv_id, part, token_ids, loss_mask.

    Rows of a conversation are ordered by turn; ties by role, then text.  Null
    roles and texts are empty, null turns come first, rows without conv_id form
    one conversation of their own, repeated rows are turns of their own.  Parts
    are ordered by `part`; a conversation of usual length has one, or two where
    a range ends inside it.  Other columns are ignored.  No rows, no parts.
    """
    rows = chats.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = dealt.mapInArrow(lambda it: _encoded(it, vocabulary), TURN)
    return turns.mapInArrow(lambda it: _joined(_parts(it, vocabulary)), PART)


def read_turns(ids: np.ndarray, mask: np.ndarray, coder: tiktoken.Encoding) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the mask, formatted characters) of each turn, from the output alone."""
    start, middle, stop = reserved(coder)
    begins, middles, ends = (np.flatnonzero(ids == m) for m in (start, middle, stop))
    for b, m, e in zip(begins, middles, ends, strict=True):
        role = coder.decode_bytes(ids[b + 1 : m].tolist()).decode()
        text = coder.decode_bytes(ids[m + 1 : e].tolist()).decode()
        chosen = ids[m + 1 : e][mask[m + 1 : e] == 1]
        lost = text if len(chosen) == e - m - 1 else coder.decode_bytes(chosen.tolist()).decode()
        yield unescape(role), unescape(text), unescape(lost), len(role) + len(text) + sum(map(len, CONTROLS))


def _digests(batches: Iterable[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    coder, names = encoding(vocabulary.value), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    current, state, done = None, None, []

    def closed() -> tuple:
        return current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        for at, conv in enumerate(batch.column("conv_id").to_pylist()):
            if state is None or conv != current:
                if state is not None:
                    done.append(closed())
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            ids = batch.column("token_ids")[at].values.to_numpy()
            mask = batch.column("loss_mask")[at].values.to_numpy()
            for role, text, lost, chars in read_turns(ids, mask, coder):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(lost)
                state[3].update(lost.encode())
                state[4] += chars
        if len(done) >= 1000:
            yield out(done)
            done = []
    if state is not None:
        yield out([*done, closed()])


def digest_chats(parts: DataFrame, vocabulary) -> DataFrame:
    """Read formatted conversations back: counts and digests of each.

    A SHA-256 runs over a conversation in order, so its parts meet in one task,
    which streams them and keeps only the running state.
    """
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.mapInArrow(lambda it: _digests(it, vocabulary), schema)

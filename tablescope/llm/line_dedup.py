"""Line deduplication by pairwise alignment.

Short windows of consecutive lines find overlapping documents: every window that just reaches the
words of a deletable block, from each line onwards and up to each line.  Every document is linked to the
first document with the window, so a window gives no pairs within a group, and every common block, which
holds such a window around each of its lines, has a link.  Linked documents are aligned with patience diff on
their line hashes (regions without unique lines by a longest common subsequence), and aligned common blocks are
deleted from the later one; common windows that cross the alignment are aligned alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.session import discard, stored
from tablescope.llm.attach import attach, joined
from tablescope.llm.words import sliced

#: Most documents that may hold a line which links them alone: no bound, so a result doesn't change as a table grows.
RARE = float("inf")
#: Words of a block that is deleted.
BLOCK_WORDS = 5
#: Bits held while a region without unique lines is aligned.
LCS_BITS = 1 << 28


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, given by rising first number, whose second numbers rise."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for at, (_, second) in enumerate(pairs):
        length = bisect_left(tails, second)
        before.append(ends[length - 1] if length else -1)
        tails[length : length + 1] = [second]
        ends[length : length + 1] = [at]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def _steps(one: list, other: list) -> Iterator[int]:
    """After each line of one: bits that are 0 where the longest common subsequence grows with a line of other."""
    places: dict = {}
    for at, line in enumerate(other):
        places[line] = places.get(line, 0) | 1 << at
    full = row = (1 << len(other)) - 1
    for line in one:
        both = row & places.get(line, 0)
        row = (row + both | row - both) & full
        yield row


def _lengths(one: list, other: list) -> np.ndarray:
    """Length of the longest common subsequence of one and every beginning of other."""
    row = (1 << len(other)) - 1
    for row in _steps(one, other):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def longest_common(one: list, other: list) -> list[tuple[int, int]]:
    """A longest common subsequence as (position in one, position in other); memory stays below LCS_BITS."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(one), 0, len(other))]
    while todo:
        a, b, c, d = todo.pop()
        if (b - a) * (d - c) > LCS_BITS and b - a > 1:
            half = (a + b) // 2
            best = c + int(np.argmax(_lengths(one[a:half], other[c:d]) + _lengths(one[half:b][::-1], other[c:d][::-1])[::-1]))
            todo += [(a, half, c, best), (half, b, best, d)]
            continue
        rows = list(_steps(one[a:b], other[c:d]))
        p, q = b - a, d - c
        while p and q:
            if rows[p - 1] >> (q - 1) & 1:
                q -= 1
                continue
            p -= 1
            if not p or rows[p - 1] >> (q - 1) & 1:
                q -= 1
                out.append((a + p, c + q))
    return sorted(out)


def patience(one: list, other: list) -> list[tuple[int, int]]:
    """Aligned equal lines (position in one, position in other), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(one), 0, len(other))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and one[a] == other[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == other[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = Counter(one[a:b]), Counter(other[c:d])
        places = {line: at for at, line in enumerate(other[c:d], c) if right[line] == 1}
        anchors = _increasing([(at, places[line]) for at, line in enumerate(one[a:b], a) if left[line] == 1 and line in places])
        if not anchors:
            # no line is unique on both sides
            lines, held = [at for at in range(a, b) if one[at] in right], [at for at in range(c, d) if other[at] in left]
            out.extend((lines[p], held[q]) for p, q in longest_common([one[at] for at in lines], [other[at] for at in held]))
            continue
        out.extend(anchors)
        for (p, q), (r, s) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


def windows(words: np.ndarray | list[int], least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """Shortest runs of lines with at least `least` words, from every line onwards and up to every line."""
    total = np.concatenate([[0], np.cumsum(np.asarray(words, np.int64))])
    ends = np.searchsorted(total, total[:-1] + least)
    begins = np.searchsorted(total, total[1:] - least, "right") - 1
    onwards = {(i, j) for i, j in enumerate(ends.tolist()) if j < len(total)}
    return sorted(onwards | {(i, j) for j, i in enumerate(begins.tolist(), 1) if i >= 0})


def common_blocks(earlier: list, later: list, words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Lines of the later document inside aligned blocks of at least `least` words.

    A block is a run of lines that are consecutive in both documents.  One
    alignment leaves out blocks that stand in another order; their windows
    are aligned with the place of the earlier document that holds them.  A line of
    the earlier document deletes one line of the later.
    """
    gone: set[int] = set()
    used: set[int] = set()
    run: list[tuple[int, int]] = []
    for p, q in [*patience(earlier, later), (-9, -9)]:
        if run and (p, q) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[i] for _, i in run) >= least:
                used.update(at for at, _ in run)
                gone.update(at for _, at in run)
            run = []
        run.append((p, q))
    left = [(i, j) for i, j in windows(words, least) if not gone.issuperset(range(i, j))]
    if left:
        sizes = dict(zip(later, words, strict=True))
        places: dict[tuple, list[int]] = {}
        for i, j in windows([sizes.get(line, least) for line in earlier], least):
            places.setdefault(tuple(earlier[i:j]), []).append(i)
        for i, j in left:
            stay = [n for n in range(j - i) if i + n not in gone]
            free = (at for at in places.get(tuple(later[i:j]), ()) if used.isdisjoint(at + n for n in stay))
            at = next(free, None) if stay else None
            if at is not None:
                pairs = patience(earlier[at : at + j - i], later[i:j])
                used.update(at + p for p, q in pairs if q in stay)
                gone.update(i + q for _, q in pairs)
    return sorted(gone)


def _lines(text: str) -> tuple[list[bytes], list[int]]:
    """128-bit hashes and word counts of the lines without outer white space; blank lines have neither."""
    found = [line.split() for line in text.split("\n")]
    return [xxhash.xxh3_128_digest(" ".join(w)) if w else b"" for w in found], [len(w) for w in found]


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        found = [_lines(t) for t in batch.column("text").to_pylist()]
        hashes, words = [[h for h in own if h] for own, _ in found], [[n for n in own if n] for _, own in found]
        packed = [b"".join(own) for own in hashes], [np.array(own, np.uint32).tobytes() for own in words]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("tag"), *(pa.array(p, pa.binary()) for p in packed)], names=["id", "tag", "lines", "words"]
        )


def _unpacked(lines: bytes) -> list[bytes]:
    return [lines[at : at + 16] for at in range(0, len(lines), 16)]


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct windows of every document: the hash of a line, or of several consecutive lines."""
    for batch in sliced(batches, "lines"):
        rows, features, several = [], [], []
        for at, (lines, words) in enumerate(zip(batch.column("lines").to_pylist(), batch.column("words").to_pylist(), strict=True)):
            found = windows(np.frombuffer(words, np.uint32))
            single = {lines[16 * i : 16 * j] for i, j in found if j == i + 1}
            longer = {xxhash.xxh3_128_digest(lines[16 * i : 16 * j]) for i, j in found if j > i + 1}
            features += [*single, *longer]
            several += [False] * len(single) + [True] * len(longer)
            rows += [at] * (len(single) + len(longer))
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(features, pa.binary()), pa.array(several, pa.bool_()), batch.column("id").take(rows), batch.column("tag").take(rows)],
            names=["feature", "several", "id", "tag"],
        )


def _aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "first_lines"):
        columns = (batch.column(n).to_pylist() for n in ("first_lines", "lines", "words"))
        gone = [common_blocks(_unpacked(a), _unpacked(b), np.frombuffer(w, np.uint32).tolist()) for a, b, w in zip(*columns, strict=True)]
        rows = pa.array([at for at, own in enumerate(gone) for _ in own], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(rows), batch.column("tag").take(rows), pa.array([line for own in gone for line in own], pa.int32())],
            names=["id", "tag", "line"],
        )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: float = RARE) -> DataFrame:
    """All rows and columns with n_lines, n_removed, removed (line numbers) and kept_text.

    Lines are compared without outer and repeated white space; blank lines don't
    count and stay.  A line goes if it stands in a run of at least BLOCK_WORDS words,
    consecutive in both documents, of any earlier document; of lines that repeat in the later
    document, as many go as the earlier one holds.  The later document is the one with the larger id, null ids
    coming first; rows that share an id are ordered by a hash of their text, and
    rows that repeat id and text are treated alike.  Null and empty texts lose nothing.
    With `rare`, lines that more documents hold link nothing alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = {"id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "tag": F.xxhash64(text)}
    rows = docs.select(*(c.alias(n) for n, c in key.items()), text.alias("text"))
    lines = stored(rows.mapInArrow(_hashed, "id long, tag long, lines binary, words binary"), "lines")
    holders = lines.select("id", "tag", "lines", "words").mapInArrow(_features, "feature binary, several boolean, id long, tag long")
    first = holders.groupBy("feature", "several").agg(F.min(F.struct("id", "tag")).alias("first"), F.count("*").alias("n"))
    first = stored(first.filter(F.col("n") > 1).filter(F.col("several") | (F.col("n") <= F.lit(float(rare)))).drop("n"), "line-features")
    links = holders.join(first, ["feature", "several"]).filter(F.struct("id", "tag") > F.col("first"))
    links = stored(links.select("id", "tag", F.col("first.id").alias("first_id"), F.col("first.tag").alias("first_tag")).distinct(), "line-links")
    # a repeated row has the lines of its twin
    own = stored(lines.dropDuplicates(["id", "tag"]), "lines")
    other = own.select(F.col("id").alias("first_id"), F.col("tag").alias("first_tag"), F.col("lines").alias("first_lines"))
    pairs = links.join(own, ["id", "tag"]).join(other, ["first_id", "first_tag"])
    gone = pairs.select("id", "tag", "first_lines", "lines", "words").mapInArrow(_aligned, "id long, tag long, line int")
    gone = stored(gone.groupBy("id", "tag").agg(F.collect_set("line").alias("gone")), "lines-removed")
    discard(lines, first, links, own)
    marked, given = joined(docs, key, gone, "gone", "merge")

    def cut(texts: list[str], gone: list) -> list[list]:
        totals, removed, where, kept = [], [], [], []
        for text, own in zip(texts, gone, strict=True):
            own, number, left, at = set(own or ()), 0, [], []
            for place, line in enumerate(text.split("\n")):
                filled = bool(line.split())
                if filled and number in own:
                    at.append(place)
                else:
                    left.append(line)
                number += filled
            totals.append(number)
            removed.append(len(at))
            where.append(at)
            kept.append("\n".join(left))
        return [totals, removed, where, kept]

    return attach(marked, text_col, "n_lines long, n_removed long, removed array<long>, kept_text string", cut, given=given)

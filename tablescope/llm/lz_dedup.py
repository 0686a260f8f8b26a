"""Substring deduplication by window hashes around shared blocks.

Every document is cut into reference blocks: of the runs of BLOCK words inside
any window of WINDOW words, the one with the smallest hash, the leftmost of
equals, is the window's block.  The choice depends on the words alone, so equal
windows have equal blocks at equal offsets.  All blocks of all documents are indexed by
hash; where two documents share a block, their windows around it are compared,
and consecutive windows that occur in an earlier document form a run, here called
a factor.  All windows are looked up by hash; there is no greedy Lempel-Ziv parse
against the text of a reference.

The index is one shuffle of the blocks: a block carries the 64-bit hash of each
of its windows (on average 13), about 9 bytes per word; windows are equal if block, place and hash are.  Blocks of very frequent passages, found by counting the blocks
of a share of the documents, go another way: equal occurrences are folded before
the shuffle, and answers return by joins, which Spark splits.
Both ways give the same windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.session import discard, stored
from tablescope.llm.attach import attach, joined
from tablescope.llm.words import mixed, rolling, sliced, split_words, word_hashes

WINDOW = 50
#: One document in so many is counted to find frequent blocks, and the least share of
#: counted blocks and least count that make a block frequent; so at most 1000 are.
COUNTED = 32
FREQUENT_SHARE = 0.001
FREQUENT_COUNT = 64
#: Windows compared at once inside a task.
AT_ONCE = 1 << 20


@dataclass
class Blocks:
    """Blocks of a slice: hash, row, first window (word number), offset of the block in it, and its windows."""

    hashes: np.ndarray
    rows: np.ndarray
    begins: np.ndarray
    offsets: np.ndarray
    counts: np.ndarray
    windows: np.ndarray


def blocks_of(texts: pa.Array, window: int) -> Blocks:
    block = (window + 1) // 2
    offsets, words = split_words(texts, lower=False)
    hashes = word_hashes(words)
    whole, parts = rolling(hashes, window), rolling(hashes, block)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(whole)
    if not n:
        none = np.empty(0, np.int64)
        return Blocks(np.empty(0, np.uint64), none, none, none, none, np.empty(0, np.uint64))
    inside = owner[:n] == owner[window - 1 : window - 1 + n]
    span = window - block + 1
    least = parts[:n].copy()
    for shift in range(1, span):
        np.minimum(least, parts[shift : shift + n], out=least)
    place = np.zeros(n, np.int64)
    for shift in range(span - 1, -1, -1):
        place[parts[shift : shift + n] == least] = shift
    place += np.arange(n)
    starts = np.flatnonzero(inside)
    chosen = place[starts]
    first = np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(starts) != 1)]) if len(starts) else np.empty(0, bool)
    begins = np.flatnonzero(first)
    counts = np.diff(np.concatenate([begins, [len(starts)]]))
    at = starts[begins]
    return Blocks(parts[chosen[begins]], owner[at], at - offsets[owner[at]], chosen[begins] - at, counts, whole[starts])


def _chosen(found: Blocks, mask: np.ndarray) -> Blocks:
    return Blocks(
        found.hashes[mask], found.rows[mask], found.begins[mask], found.offsets[mask], found.counts[mask], found.windows[np.repeat(mask, found.counts)]
    )


def _numbered(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. inside every run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _index(batches: Iterable[pa.RecordBatch], window: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        found = blocks_of(batch.column("text"), window)
        found = _chosen(found, ~np.isin(found.hashes, frequent))
        bounds = np.concatenate([[0], np.cumsum(found.counts) * 8]).astype(np.int32)
        blob = pa.Array.from_buffers(pa.binary(), len(found.counts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(found.windows))])
        rows = pa.array(found.rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found.hashes.view(np.int64)), batch.column("id").take(rows), batch.column("tag").take(rows),
                pa.array(found.begins.astype(np.int32)), pa.array(found.offsets.astype(np.int32)), blob,
            ],
            names=["block", "id", "tag", "begin", "offset", "marks"],
        )


def _factors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that occur in a smaller document, from blocks sorted by hash."""

    def factors(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = table["block"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0]))
        sizes = np.diff(np.concatenate([starts, [len(block)]]))
        shared = np.repeat(sizes > 1, sizes)
        if not shared.any():
            return
        table = table.filter(pa.array(shared)).combine_chunks()
        block, ids, begins, offsets = (table[n].to_numpy() for n in ("block", "id", "begin", "offset"))
        marks = table["marks"].combine_chunks()
        marks = marks.chunk(0) if isinstance(marks, pa.ChunkedArray) else marks
        bounds = np.frombuffer(marks.buffers()[1], np.int32)[marks.offset : marks.offset + len(marks) + 1] // 8
        values = np.frombuffer(marks.buffers()[2], np.uint64, int(bounds[-1]))[bounds[0] :]
        counts = np.diff(bounds)
        inner, row = _numbered(counts), np.repeat(np.arange(len(counts)), counts)
        keys = _window_keys(block.view(np.uint64)[row], offsets[row] - inner, values)
        order = np.lexsort((ids[row], keys))
        keys, own = keys[order], ids[row][order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        least = np.repeat(own[heads], np.diff(np.concatenate([heads, [len(keys)]])))
        again = np.zeros(len(keys), bool)
        again[order] = own > least
        at = np.flatnonzero(again)
        if not len(at):
            return
        first = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row[at]) != 0)])
        runs = np.flatnonzero(first)
        lengths = np.diff(np.concatenate([runs, [len(at)]]))
        rows = pa.array(row[at[runs]])
        found = begins[row[at[runs]]] + inner[at[runs]]
        yield pa.RecordBatch.from_arrays(
            [table["id"].combine_chunks().take(rows), table["tag"].combine_chunks().take(rows), pa.array(found.astype(np.int32)), pa.array(lengths.astype(np.int32))],
            names=["id", "tag", "begin", "windows"],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("marks").nbytes // 8
        if size >= AT_ONCE:
            table = pa.Table.from_batches(held)
            block = table["block"].to_numpy()
            whole = int(np.searchsorted(block, block[-1]))
            if whole:
                yield from factors(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                size = sum(b.num_rows for b in held) * 13
    if held:
        yield from factors(pa.Table.from_batches(held))


def _window_keys(blocks: np.ndarray, places: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Identity of a window: its block, the block's place in it, and its hash."""
    return mixed(blocks ^ mixed(marks + places.astype(np.uint64)))


def _frequent_contexts(batches: Iterable[pa.RecordBatch], window: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Occurrences of frequent blocks: one row per document and context, which is a block with its windows."""
    for batch in sliced(batches, "text"):
        found = blocks_of(batch.column("text"), window)
        found = _chosen(found, np.isin(found.hashes, frequent))
        ends = np.cumsum(found.counts)
        rows: dict[tuple, list[int]] = {}
        for at, end in enumerate(ends):
            key = (int(found.hashes[at].view(np.int64)), int(found.offsets[at]), found.windows[end - found.counts[at] : end].tobytes(), int(found.rows[at]))
            rows.setdefault(key, []).append(int(found.begins[at]))
        own = pa.array([k[3] for k in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array([k[i] for k in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))),
                batch.column("id").take(own), batch.column("tag").take(own), pa.array(list(rows.values()), pa.list_(pa.int32())),
            ],
            names=["block", "offset", "marks", "id", "tag", "begins"],
        )


def _context_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of every context, numbered."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [np.frombuffer(m, np.uint64) for m in batch.column("marks").to_pylist()]
        counts = np.array([len(m) for m in marks])
        rows, inner = np.repeat(np.arange(len(counts)), counts), _numbered(counts)
        places = batch.column("offset").to_numpy()[rows] - inner
        keys = _window_keys(batch.column("block").to_numpy().view(np.uint64)[rows], places, np.concatenate(marks))
        taken = [batch.column(n).take(pa.array(rows)) for n in ("block", "offset", "marks", "first")]
        yield pa.RecordBatch.from_arrays(
            [*taken, pa.array(inner.astype(np.int32)), pa.array(keys.view(np.int64))], names=["block", "offset", "marks", "first", "number", "window"]
        )


def _context_factors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows whose smallest document is smaller than the row's; runs that touch are one."""
    for batch in batches:
        out = []
        for at, (own, least, begins) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("id", "least", "begins")), strict=True)):
            again = np.flatnonzero(np.concatenate([[False], np.array(least, np.int64) < own, [False]]))
            edges = np.flatnonzero(np.diff(again, prepend=-9, append=again[-1] + 9 if len(again) else 0) != 1) if len(again) else []
            runs = [(begin + int(again[first]) - 1, int(after - first)) for first, after in zip(edges, edges[1:], strict=False) for begin in begins]
            out += [(at, first, end - first) for first, end in spans(runs, 1)]
        rows = pa.array([o[0] for o in out], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(rows), batch.column("tag").take(rows), *(pa.array([o[i] for o in out], pa.int32()) for i in (1, 2))],
            names=["id", "tag", "begin", "windows"],
        )


def _often(rows: DataFrame, window: int, frequent: np.ndarray) -> DataFrame:
    """Factors around frequent blocks, from aggregates and joins that Spark can split.

    Equal occurrences are folded to contexts, contexts give each window's
    smallest document, and these go back to the documents by context.
    """
    context = ["block", "offset", "marks"]
    schema = "block long, offset int, marks binary, id long, tag long, begins array<int>"
    held = stored(rows.mapInArrow(lambda it: _frequent_contexts(it, window, frequent), schema), "lz-frequent")
    contexts = stored(held.groupBy(*context).agg(F.min("id").alias("first")), "lz-contexts")
    schema = "block long, offset int, marks binary, first long, number int, window long"
    windows = contexts.mapInArrow(_context_windows, schema)
    least = stored(windows.groupBy("window").agg(F.min("first").alias("least")), "lz-windows")
    known = windows.join(least, "window").groupBy(*context).agg(F.sort_array(F.collect_list(F.struct("number", "least"))).alias("w"))
    known = stored(known.select(*context, F.col("w.least").alias("least")), "lz-known")
    again = held.join(known, context).filter(F.array_min("least") < F.col("id")).select("id", "tag", "begins", "least")
    found = stored(again.mapInArrow(_context_factors, "id long, tag long, begin int, windows int"), "lz-again")
    discard(held, contexts, least, known)
    return found


def _block_counts(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        found, counts = np.unique(blocks_of(batch.column("text"), window).hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], names=["block", "n"])


def frequent_blocks(rows: DataFrame, window: int) -> np.ndarray:
    """Hashes of blocks that hold a noticeable share of all blocks, at most 1 / FREQUENT_SHARE."""
    part = rows.filter(F.pmod(F.xxhash64("id", "tag"), F.lit(COUNTED)) == 0)
    counts = part.select("text").mapInArrow(lambda it: _block_counts(it, window), "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    counts = stored(counts, "lz-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT_COUNT, int(total * FREQUENT_SHARE))
    found = [r.block for r in counts.filter(F.col("n") >= least).collect()]
    discard(counts)
    return np.array(found, np.int64).view(np.uint64)


def spans(begins: Iterable[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal runs of covered words from (first window, windows)."""
    out: list[list[int]] = []
    for begin, windows in sorted(begins):
        end = begin + windows + window - 1
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns with n_words, n_removed, removed (word spans) and kept_text.

    A word is removed if a window of `window` words covers it whose words also
    start in a document with a smaller id; windows are judged on the input.
    Null ids are smaller than all others; rows that share an id don't remove
    from each other.  Null, empty and shorter texts have no windows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = {"id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "tag": F.xxhash64(text)}
    rows = docs.select(*(c.alias(n) for n, c in key.items()), text.alias("text"))
    frequent = frequent_blocks(rows, window)
    index = rows.mapInArrow(lambda it: _index(it, window, frequent), "block long, id long, tag long, begin int, offset int, marks binary")
    found = index.repartition("block").sortWithinPartitions("block").mapInArrow(_factors, "id long, tag long, begin int, windows int")
    if len(frequent):
        found = found.unionByName(_often(rows, window, frequent))
    # repeated rows give the same runs
    runs = stored(found.groupBy("id", "tag").agg(F.collect_set(F.struct("begin", "windows")).alias("runs")), "lz-runs")
    marked, given = joined(docs, key, runs, "runs")

    def cut(texts: list[str], runs: list) -> list[list]:
        totals, removed, where, kept = [], [], [], []
        for text, own in zip(texts, runs, strict=True):
            words = text.encode().split()
            covered = spans([(r["begin"], r["windows"]) for r in own or ()], window)
            left, at = [], 0
            for begin, end in covered:
                left += words[at:begin]
                at = end
            left += words[at:]
            totals.append(len(words))
            removed.append(len(words) - len(left))
            where.append([{"begin": a, "end": b} for a, b in covered])
            kept.append(b" ".join(left).decode())
        return [totals, removed, where, kept]

    fields = "n_words long, n_removed long, removed array<struct<begin: long, end: long>>, kept_text string"
    return attach(marked, text_col, fields, cut, given=given)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

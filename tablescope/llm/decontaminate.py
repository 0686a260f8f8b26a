"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words joined by one space.  An item of m
characters may occur with up to k = floor(rate * m) edits.  Split into k + 1
pieces, at least one piece occurs unchanged; all pieces of a block of items are
found in one pass by an automaton, and the neighbourhood of each hit is checked
with Myers' bit-parallel edit distance.

Items are a stated query set: they are taken in blocks of bounded size, each
against all documents.  Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.session import stored
from tablescope.llm.attach import attach
from tablescope.llm.words import sliced

EDIT_RATE = 0.05
#: Characters of items that go into one automaton and are sent to each task.
BLOCK_CHARS = 2_000_000
_OTHER = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower-case words with one space around each; empty without words."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def distances(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """Edit distance of the pattern to the best run ending at each position of the text.

    Anchored runs begin at the start of the text.
    """
    size = len(pattern)
    places: dict[str, int] = {}
    for at, char in enumerate(pattern):
        places[char] = places.get(char, 0) | 1 << at
    full, last, carry = (1 << size) - 1, 1 << (size - 1), int(anchored)
    up, down, score = full, 0, size
    for char in text:
        same = places.get(char, 0)
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(across | up)), up & across
        score += bool(plus & last) - bool(minus & last)
        plus, minus = plus << 1 | carry, minus << 1
        keep = same | down
        up, down = full & (minus | ~(keep | plus)), full & plus & keep
        yield score


def best_match(pattern: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """(distance, begin, end) of the closest run within the budget, the first of equals."""
    found = min(((d, at) for at, d in enumerate(distances(pattern, text), 1)), default=None)
    if found is None or found[0] > budget:
        return None
    distance, end = found
    back = distances(pattern[::-1], text[:end][::-1], anchored=True)
    length = next((n for n, d in enumerate(back, 1) if d == distance), 0)
    return distance, end - length, end


class Matcher:
    """Piece automaton over one block of items [(id, plain text)]."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(key, text, int(rate * len(text))) for key, text in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[begin:end], []).append((number, begin))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Merged neighbourhoods of the piece hits, by item."""
        found: dict[int, list[list[int]]] = {}
        if not self.items:
            return found
        for end, (length, owners) in self.automaton.iter(text):
            for number, offset in owners:
                _, item, budget = self.items[number]
                begin = end + 1 - length - offset
                low, high = max(0, begin - budget), min(len(text), begin + len(item) + budget)
                own = found.setdefault(number, [])
                if own and low <= own[-1][1] and own[-1][0] <= low:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        return found

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, begin, end) of each item's best occurrence in a plain text."""
        for number, windows in self.windows(text).items():
            key, item, budget = self.items[number]
            best = None
            for low, high in windows:
                match = best_match(item, text[low:high], budget)
                if match and (best is None or match[0] < best[0]):
                    best = (match[0], match[1] + low, match[2] + low)
            if best:
                yield key, *best

    def hit(self, text: str) -> bool:
        return any(True for _ in self.search(text))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_CHARS characters; items without words are left out."""
    block: list[tuple[int, str]] = []
    size = 0
    for key, text in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        if own := plain(text):
            block.append((key, own))
            size += len(own)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(
    docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Occurrences of items in documents: doc_id, item_id, distance, match_begin, match_end.

    One row per document row and item: its closest occurrence, the first of
    equals, in positions of the plain text.  Null or empty texts and items
    without words match nothing; repeated rows each report.  Null ids stay null.
    """
    schema = "doc_id long, item_id long, distance int, match_begin long, match_end long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def found(block):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in sliced(batches, "text"):
                rows = [
                    (key, *match)
                    for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                    for match in matcher.search(plain(text))
                ]
                names = ("doc_id", "item_id", "distance", "match_begin", "match_end")
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        return rows.mapInArrow(run, schema)

    parts = [found(block) for block in item_blocks(items, item_id, item_text)]
    if len(parts) > 1:
        parts = [stored(part, "leaks") for part in parts]
    return reduce(DataFrame.unionByName, parts, docs.sparkSession.createDataFrame([], schema)) if parts != [] else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of `docs` in which no item occurs; null and empty texts stay."""
    for block in item_blocks(items, item_id, item_text):

        def clean(texts: list[str], block=block, made=[]) -> list[list]:  # noqa: B006  one automaton per task
            if not made:
                made.append(Matcher(block, rate))
            return [[not made[0].hit(plain(t)) for t in texts]]

        docs = attach(docs, text_col, "_clean boolean", clean, keep="_clean")
    return docs

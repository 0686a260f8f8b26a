"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits lie on a ring of SEGMENTS segments.  If two of them
differ in at most `bits` bits, some segment starts a chain whose first l
segments together differ in at most l * bits / SEGMENTS bits, for every l.  The
chain of CHAIN segments therefore holds a number of equal segments, the first
among them; which sets of equal segments may occur follows from the budgets.
Each such set is a key.  Fingerprints that share a key are candidates, the
chain condition prunes them, and the full distance decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.session import discard, stored
from tablescope.llm.components import components
from tablescope.llm.words import sliced

SEGMENTS, CHAIN = 8, 5
WIDTH = 64 // SEGMENTS
SEED = 42
_AT_ONCE = 1 << 16
#: Buckets up to this size are compared pair by pair in shifted arrays, larger ones by growing components.
SMALL_BUCKET = 32
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit set where over half of the hashes of the word shingles, repeats included, have it set."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    begins, ends = begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(begins), _AT_ONCE):
        part = [digest(joined[a:b], SEED) for a, b in zip(begins[at : at + _AT_ONCE], ends[at : at + _AT_ONCE], strict=True)]
        values = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(values, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(begins), bitorder="little").view("<i8")[0])


def ring_keys(bits: int) -> list[tuple[int, ...]]:
    """Sets of segments (first the chain's start) of which one is equal in any linked pair."""
    if not 0 <= bits < SEGMENTS:
        raise ValueError(f"The distance must be between 0 and {SEGMENTS - 1} bits.")
    budget = [bits * n // SEGMENTS for n in range(CHAIN + 1)]
    places = range(1, CHAIN)
    sets = []
    for unequal in combinations(places, min(budget[CHAIN], CHAIN - 1)):
        if all(sum(p < n for p in unequal) <= budget[n] for n in range(1, CHAIN + 1)):
            sets.append((0, *(p for p in places if p not in unequal)))
    return [tuple((start + p) % SEGMENTS for p in own) for start in range(SEGMENTS) for own in sets]


def _keyed(batches: Iterable[pa.RecordBatch], sets: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("fp").to_numpy().view(np.uint64)
        for number, own in enumerate(sets):
            key = np.full(len(values), number, np.uint64)
            for place in own:
                key = (key << np.uint64(WIDTH)) | ((values >> np.uint64(place * WIDTH)) & np.uint64((1 << WIDTH) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("fp")], names=["key", "fp"])


def linked(differences: np.ndarray, bits: int) -> np.ndarray:
    """Which XORs pass the chain condition and then the full distance."""
    counts = _POPCOUNT[differences.view(np.uint8).reshape(-1, 8)].astype(np.int16)
    around = np.concatenate([counts, counts[:, : CHAIN - 1]], axis=1)
    total = np.concatenate([np.zeros((len(counts), 1), np.int16), np.cumsum(around, axis=1, dtype=np.int16)], axis=1)
    chained = np.zeros(len(counts), bool)
    for start in range(SEGMENTS):
        own = np.ones(len(counts), bool)
        for length in range(1, CHAIN + 1):
            own &= (total[:, start + length] - total[:, start]) * SEGMENTS <= length * bits
        chained |= own
    chained[chained] = counts[chained].sum(axis=1) <= bits
    return chained


def _grown(values: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges of a large bucket: each found member is compared only with those not yet reached."""
    left = values
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = linked(left ^ one, bits)
            if near.any():
                found = left[near]
                yield np.full(len(found), one), found
                front.extend(found)
                left = left[~near]


def _bucket_edges(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Edges inside the buckets of a partition sorted by key; no pairs of equal fingerprints exist."""

    def edges(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        begins = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        sizes = np.diff(np.concatenate([begins, [len(keys)]]))
        small = np.repeat(sizes <= SMALL_BUCKET, sizes)
        found = []
        for shift in range(1, min(SMALL_BUCKET, int(sizes.max(initial=1)))):
            same = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[:-shift])
            if not len(same):
                break
            same = same[linked(values[same] ^ values[same + shift], bits)]
            found.append((values[same], values[same + shift]))
        for begin, size in zip(begins[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
            found.extend(_grown(values[begin : begin + size], bits))
        for one, other in found:
            one, other = one.view(np.int64), other.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, other)), pa.array(np.minimum(one, other))], names=["a", "b"])

    keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        values = np.concatenate([values, batch.column("fp").to_numpy().view(np.uint64)])
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if whole:
            yield from edges(keys[:whole], values[:whole])
            keys, values = keys[whole:], values[whole:]
    if len(keys):
        yield from edges(keys, values)


def _prints(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        prints = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """Fingerprint and component of every row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at `bits` or fewer differing bits; component_id is the
    smallest id reachable.  Null and empty texts have fingerprint zero and link
    like any other.  Null ids never name a component unless it has no other.
    Repeated rows stay.  Rows of one fingerprint are folded before candidates
    are sought, so copies cost one row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = stored(rows.mapInArrow(lambda it: _prints(it, shingle), "doc_id long, fp long"), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    sets = ring_keys(bits)
    keyed = distinct.select("fp").mapInArrow(lambda it: _keyed(it, sets), "key long, fp long")
    size = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = keyed.repartition(size, "key").sortWithinPartitions("key").mapInArrow(lambda it: _bucket_edges(it, bits), "a long, b long")
    labels = components(edges).withColumnsRenamed({"a": "fp", "b": "root"})
    named = distinct.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = stored(named.join(least, "root").select("fp", "component_id"), "simhash-named")
    discard(distinct, labels, least)
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """The rows of `docs` with one document of each group: the one with the smallest id.

    Rows that share an id count as one document and stay or go together; rows
    without id are one document, kept where no other id is in their group.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, bits)
    keep = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    keep = keep.hint("merge")  # grows with the corpus: the plan is alike at every size
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_kept"]), "left_semi")

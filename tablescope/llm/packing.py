"""Best-fit packing: pieces of documents into as few sequences as possible.

Only the histogram of lengths reaches the driver.  A configuration is a multiset
of lengths that fits into one sequence; the configuration linear program asks
for the fewest sequences whose configurations cover the histogram.  It is solved
by multiplicative weights: a length's price falls as it is covered, a knapsack
dynamic program finds the configuration of the highest price, and that one is
taken for a part of what is left.  Shares are rounded up to whole sequences while
the histogram lasts; the shortest piece of each configuration and what remains go
by best fit, longest first, into free space and new sequences.  Every count stays
a run of equal sequences, so the work depends on the capacity and not on the
number of pieces.

The plan is a table of slots (length, run of places); a piece's place follows
from its rank among the pieces of its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from tablescope.functions.session import stored

#: Sequence length of the registered query.
CAPACITY = 4096
#: Lengths up to this share of the capacity fill free space at the end and need no program.
SMALL = 1 / 16
#: Classes of neighbouring lengths that the program tells apart; a class counts as its longest.
CLASSES = 192
#: Share of a class that one step of the linear program covers at most.
STEP = 0.05
#: How fast the price of a class falls as it is covered.
RATE = 0.5
#: How often the histogram is covered, and how much of that only settles the prices.
ROUNDS, SETTLING = 7.0, 3.0
#: A configuration is taken while its price is within this share of the best one.
SLACK = 0.002
#: Runs of the knapsack program at most; best fit takes what is uncovered then.
PRICINGS = 6000


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Highest total price for every capacity from 0, each size as often as wanted."""
    best = np.zeros(capacity + 1)
    for price, size in zip(prices.tolist(), sizes.tolist(), strict=True):
        # from one multiple of the size to the next, so that it may occur again
        for at in range(size, capacity + 1, size):
            part = best[at : at + size]
            np.maximum(part, best[at - size : at - size + len(part)] + price, out=part)
    return best


def _configuration(best: np.ndarray, prices: np.ndarray, sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """How often each size occurs in a configuration read back from the knapsack table."""
    taken, room, offered = np.zeros(len(sizes), np.int64), len(best) - 1, prices.copy()
    fitting = np.arange(len(sizes))
    while len(fitting := fitting[sizes[fitting] <= room]):
        s = fitting[(offered[fitting] + best[room - sizes[fitting]]).argmax()]
        if offered[s] == -np.inf:
            break
        taken[s] += 1
        room -= int(sizes[s])
        if taken[s] >= limits[s]:
            offered[s] = -np.inf
    return taken


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """Configurations with their numbers of sequences, and the prices of the sizes at the end.

    Every size is covered several times over.  One that lags behind becomes
    dearer until it keeps pace, so the mix of configurations taken since then
    covers all sizes alike.  `sizes` falls, so that of equal prices the largest
    size is taken.
    """
    covered = np.zeros(len(sizes))
    volume = counts * sizes / (counts * sizes).sum()
    found: dict[bytes, float] = {}
    pace, settled, prices = 0.0, 0.0, sizes.astype(float)
    for _ in range(PRICINGS):
        if pace >= ROUNDS:
            break
        prices = sizes * np.exp(-RATE * (covered - covered.min()))
        best, first = knapsack(prices, sizes, capacity), True
        while pace < ROUNDS:
            taken = _configuration(best, prices, sizes, counts)
            used = np.flatnonzero(taken)
            if not first and (taken[used] * prices[used]).sum() < (1 - SLACK) * best[-1]:
                break
            first = False
            per = counts[used] / taken[used]
            amount = STEP * float(per.min())
            covered[used] += amount / per
            prices[used] *= np.exp(-RATE * amount / per)
            gained = float(volume[used] @ (amount / per))
            pace += gained
            if pace > SETTLING:
                settled += gained
                key = taken.tobytes()
                found[key] = found.get(key, 0.0) + amount
    return [(np.frombuffer(k, np.int64), x / settled) for k, x in found.items()], prices


class Runs:
    """Runs of equal sequences by free space: free -> [(number, sizes in order)]."""

    def __init__(self) -> None:
        self.open: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.free: list[int] = []

    def add(self, free: int, number: int, items: tuple[int, ...]) -> None:
        if free not in self.open:
            self.open[free] = []
            insort(self.free, free)
        self.open[free].append((number, items))

    def place(self, size: int, count: int, capacity: int) -> None:
        """`count` pieces of one size, each into the sequence with the least free space that holds it."""
        while count:
            at = bisect_left(self.free, size)
            if at == len(self.free):
                free, number, items = capacity, -(-count // (capacity // size)), ()
            else:
                free = self.free[at]
                number, items = self.open[free].pop()
                if not self.open[free]:
                    del self.open[free], self.free[at]
            each = free // size
            full = min(number, count // each)
            rest = min(count - full * each, each) if number > full else 0
            if full:
                self.add(free - each * size, full, items + (size,) * each)
            if rest:
                self.add(free - rest * size, 1, items + (size,) * rest)
            left = number - full - (1 if rest else 0)
            if left:
                self.add(free, left, items)
            count -= full * each + rest


def classes(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of each size, neighbours together, all classes of about the same number of tokens."""
    if len(sizes) <= CLASSES:
        return np.arange(len(sizes))
    tokens = np.cumsum(counts * sizes)
    return np.unique((tokens - 1) * CLASSES // tokens[-1], return_inverse=True)[1]


def _take(queue: list[list[int]], number: int) -> list[int]:
    """The next pieces of a class, longest first: sizes of `number` pieces."""
    out = []
    while number:
        size, count = queue[-1]
        took = min(number, count)
        out += [size] * took
        queue[-1][1] -= took
        number -= took
        if not queue[-1][1]:
            queue.pop()
    return out


def plan(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], float]:
    """Runs (number of sequences, their lengths in order) that hold the histogram, and a lower bound.

    No packing needs fewer sequences than all tokens fill, nor, by duality, than
    the prices of all pieces divided by the highest price of a configuration in
    which a class counts as its shortest length.
    """
    small = {s: n for s, n in lengths.items() if s <= capacity * SMALL and s < capacity}
    sizes = np.array(sorted((s for s in lengths if s < capacity and s not in small), reverse=True), np.int64)
    counts = np.array([lengths[int(s)] for s in sizes], np.int64)
    runs, bound = Runs(), 0.0
    left: dict[int, int] = dict(small)
    if len(sizes):
        kind = classes(sizes, counts)
        first = np.flatnonzero(np.diff(kind, prepend=-1))
        total = np.add.reduceat(counts, first)
        chosen, prices = solve(sizes[first], total, capacity)
        shortest = sizes[np.append(first[1:], len(sizes)) - 1]
        bound = float((total * prices).sum() / knapsack(prices, shortest, capacity)[-1])
        queues = [[[int(s), int(n)] for s, n in zip(sizes[kind == k][::-1], counts[kind == k][::-1], strict=True)] for k in range(len(first))]
        remain = total.copy()
        # the fullest configurations first, then those of the largest share
        chosen.sort(key=lambda c: (-int((c[0] * sizes[first]).sum()), -c[1], c[0].tobytes()))
        for taken, amount in chosen:
            used = np.flatnonzero(taken)
            number = int(min(np.ceil(amount), (remain[used] // taken[used]).min()))
            remain[used] -= number * taken[used]
            if taken.sum() > 1:  # the shortest piece is kept for best fit, which sees the room that is really left
                taken = taken.copy()
                taken[used[-1]] -= 1
                used = np.flatnonzero(taken)
            while number:
                # as many equal sequences as the next lengths of all classes last for
                alike = min(number, *(max(1, queues[k][-1][1] // int(taken[k])) for k in used))
                items = [_take(queues[k], alike * int(taken[k]))[:: alike] for k in used]
                row = tuple(s for part in items for s in part)
                runs.add(capacity - sum(row), alike, row)
                number -= alike
        left |= {size: count for queue in queues for size, count in queue}
    for size in sorted(left, reverse=True):
        runs.place(size, left[size], capacity)
    whole = lengths.get(capacity, 0)
    out = [(whole, (capacity,))] if whole else []
    tokens = sum(s * n for s, n in lengths.items() if s < capacity)
    return out + [run for free in runs.free for run in runs.open[free]], max(bound, tokens / capacity) + whole


def slots(runs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, sequences, offset), sorted: where the pieces of a length go by rank."""
    rows, given, sequence = [], {}, 0
    for number, items in runs:
        offset = 0
        for size in items:
            rank = given.get(size, 0)
            rows.append((size, rank, sequence, number, offset))
            given[size] = rank + number
            offset += size
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _numbered(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Add the task's number and each row's rank among the rows of its length in the task."""
    part, seen = TaskContext.get().partitionId(), np.zeros(1, np.int64)
    for batch in batches:
        lengths = batch.column(0).to_numpy()
        if not len(lengths):
            continue
        if lengths.max() >= len(seen):
            seen = np.concatenate([seen, np.zeros(int(lengths.max()) + 1 - len(seen), np.int64)])
        order = np.argsort(lengths, kind="stable")
        kinds, first, counts = np.unique(lengths[order], return_index=True, return_counts=True)
        nth = np.empty(len(lengths), np.int64)
        nth[order] = np.arange(len(lengths)) - np.repeat(first - seen[kinds], counts)
        seen[kinds] += counts
        columns = [batch.column(0), batch.column(1), pa.array(np.full(len(lengths), part)), pa.array(nth)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of `pieces` with sequence_id and offset.

    `length` tells how much of a sequence a row takes, from 1 to `capacity`; any
    other value, null included, is an error.  Pieces of a sequence follow each
    other without a gap from offset 0.  Equal rows are pieces of their own; input
    columns named sequence_id or offset are replaced; no rows, no sequences.
    The attributes `sequences` and `lower_bound` of the result tell how many
    sequences there are and how many any packing needs.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = pieces.select(F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("size"), row)
    held = StructType([*rows.schema.fields, StructField("part", LongType()), StructField("nth", LongType())])
    schema = to_arrow_schema(held)
    bad = F.raise_error(F.lit("A piece must have a length from 1 to the capacity."))
    rows = rows.withColumn("size", F.when((F.col("size") < 1) | (F.col("size") > capacity), bad.cast("long")).otherwise(F.col("size")))
    numbered = stored(rows.mapInArrow(lambda it: _numbered(it, schema), held), "pieces")
    counts = numbered.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    below = stored(counts.select("size", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below")), "piece-counts")
    lengths = {r["size"]: r["n"] for r in below.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    runs, bound = plan(lengths, capacity)
    table = numbered.sparkSession.sparkContext.broadcast(slots(runs))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, sequence, _, offset = table.value.T
        key = (size << 48) + first
        for batch in batches:
            rank = batch.column(1).to_numpy()
            at = np.searchsorted(key, (batch.column(0).to_numpy() << 48) + rank, side="right") - 1
            columns = [batch.column(2), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "sequence_id", "offset"])

    ranked = numbered.join(below.drop("n"), ["size", "part"]).select("size", (F.col("nth") + F.col("below")).alias("rank"), "row")
    out = StructType([StructField("row", rows.schema["row"].dataType), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    result = ranked.mapInArrow(placed, out).select("row.*", "sequence_id", "offset")
    result.sequences, result.lower_bound = sum(n for n, _ in runs), bound
    return result



"""Rank correlations of columns with gaps, each pair on its own complete rows.

The ranks of a column depend on which other column must be present, so with m
such columns there are up to m * m rankings.  None of them is made as a table, and
no row is repeated for a pair.  A first scan finds cut values for every column (all
its values if they are few, else quantiles of a sample).  A second one counts the
rows at and between the cuts for every ranking, which settles the ranks of all cut
values; values that many rows share are cut values.  A third one adds up the products
of ranks.  Only columns that have values between their cuts need an order: all rows
are dealt out by the bucket of one such column after the other, a task ranks the
buckets it gets in all rankings of the column, and hands the rows on to the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import as_double, ref

#: Columns whose gaps fit one pattern.
PATTERN_BITS = 60
#: Share of a column's rows between two cut values, about; a value that holds as much is a cut value itself.
HOT_VALUE = 0.001
#: Columns with at most this number of values have all of them as cut values.
FEW_VALUES = 8192
#: Rows a task adds to the sample that cut values are taken from; they decide where rows are ranked, never a rank.
SAMPLED_ROWS = 500
#: Rows that a task ranks, about, and rows looked at together in a scan.
TASK_ROWS, BLOCK_ROWS = 250_000, 100_000


class Rankings:
    """Which rankings the pairs of some columns need."""

    def __init__(self, names: Sequence[str], gaps: Iterable[str], pairs: Iterable[tuple[str, str]]) -> None:
        self.names, self.gaps = list(names), [c for c in names if c in set(gaps)]
        self.labels: dict[tuple[str, str | None], int] = {}
        self.pairs = [(a, b, self._label(a, b), self._label(b, a)) for a, b in pairs]

    def _label(self, column: str, other: str) -> int:
        """Number of the ranking of `column` over the rows that have `other` too."""
        key = (column, other if other in self.gaps and other != column else None)
        return self.labels.setdefault(key, len(self.labels))

    def bit(self, column: str | None) -> int:
        return 1 << self.gaps.index(column) if column in self.gaps else 0


def _is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.IntegralType, T.BooleanType))


def _cells(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Each column as BIGINT or DOUBLE: integers are ranked exactly."""
    return [(ref(c).cast("bigint") if _is_whole(df, c) else as_double(df, c)).alias(f"v{k}") for k, c in enumerate(names)]


def _blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _values(block: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column (0 where there is none) and whether there is one."""
    column = block.column(name)
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy()


def _codes(values: np.ndarray, there: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """0: no value; 2 k + 2: cut value k; 2 k + 1: between the cuts k - 1 and k."""
    at = np.searchsorted(cuts, values)
    equal = cuts[np.minimum(at, len(cuts) - 1)] == values if len(cuts) else np.zeros(len(values), bool)
    return np.where(there, 2 * at + 1 + equal, 0)


# -- cut values ----------------------------------------------------------------


def _cuts(df: DataFrame, names: Sequence[str], few: int) -> list[np.ndarray]:
    """Sorted cut values of every column; one scan."""
    count, whole = len(names), [_is_whole(df, c) for c in names]

    def surveyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(TaskContext.get().partitionId())
        seen: list[np.ndarray | None] = [np.empty(0, np.int64 if w else float) for w in whole]
        chance, sample, rows = np.empty(0), None, 0
        for block in _blocks(batches, BLOCK_ROWS):
            rows += block.num_rows
            for k in range(count):
                if seen[k] is not None:
                    values, there = _values(block, f"v{k}")
                    seen[k] = np.union1d(seen[k], values[there])
                    seen[k] = seen[k] if len(seen[k]) <= few else None
            drawn = rng.random(block.num_rows)
            best = np.argsort(drawn)[:SAMPLED_ROWS]
            block = block.take(best)
            sample = block if sample is None else pa.concat_tables([sample, block]).combine_chunks()
            chance = np.concatenate([chance, drawn[best]])
            best = np.argsort(chance)[:SAMPLED_ROWS]
            chance, sample = chance[best], sample.take(best)
        for k in range(count if rows else 0):
            values, there = _values(sample, f"v{k}")
            # the sampled values with their weight, then all values, or one row saying that there are too many
            for kind, own in (("some", values[there]), ("all", seen[k]) if seen[k] is not None else ("many", np.zeros(1))):
                n = len(own)
                i, d = (own, np.zeros(n)) if whole[k] and kind != "many" else (np.zeros(n, np.int64), own)
                weight = np.full(n, rows / max(1, sample.num_rows))
                arrays = [pa.array([kind] * n, pa.string()), pa.array(np.full(n, k, np.int32)), pa.array(i), pa.array(d), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "c", "i", "d", "w"])

    found = df.select(*_cells(df, names)).mapInArrow(surveyed, "kind string, c int, i long, d double, w double")
    found = found.groupBy("kind", "c", "i", "d").agg(F.sum("w").alias("w")).persist()
    try:
        sizes = {(r["kind"], r["c"]): r["n"] for r in found.groupBy("kind", "c").agg(F.count(F.lit(1)).alias("n")).collect()}
        kinds = ["all" if ("many", k) not in sizes and sizes.get(("all", k), 0) <= few else "some" for k in range(count)]
        # at most `few` values of a column, or a sample
        wanted = [(kind, k) for k, kind in enumerate(kinds)]
        local = df.sparkSession.createDataFrame(wanted, "kind string, c int")
        rows = found.join(F.broadcast(local), ["kind", "c"]).toPandas()
    finally:
        found.unpersist()
    out = []
    for k, kind in enumerate(kinds):
        own = rows[rows["c"] == k]
        values = own["i" if whole[k] else "d"].to_numpy()
        order = np.argsort(values)
        values, weight = values[order], own["w"].to_numpy()[order]
        if kind == "some" and len(values):
            step = np.floor(np.cumsum(weight) / (HOT_VALUE * weight.sum()) + 1e-9)
            values = values[np.diff(step, prepend=0.0) > 0]
        out.append(values)
    return out


# -- ranks of cut values -------------------------------------------------------


@dataclass
class Places:
    """What the counts at and between the cut values tell of the rankings."""

    #: For every ranking, by code: the centred rank of a cut value, or what lies below a bucket, centred; 0 without value.
    ranks: list[np.ndarray]
    rows: list[int]
    #: Sums of n^3 - n over cut values held by n rows, and numbers of cut values with rows.
    ties: list[int]
    kinds: list[int]
    #: Rows per code of every column.
    sizes: list[np.ndarray]
    total: int


def _placed(df: DataFrame, wanted: Rankings, cuts: Sequence[np.ndarray]) -> Places:
    """Counts of rows per code for every ranking; one scan."""
    names, labels = wanted.names, list(wanted.labels)
    at = {c: k for k, c in enumerate(names)}
    asked = [(at[c], None if other is None else at[other]) for c, other in labels] + [(k, None) for k in range(len(names))]
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(list(cuts))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = [2 * len(c) + 2 for c in sent.value]
        sums, rows = [np.zeros(width[a], np.int64) for a, _ in asked], 0
        for block in _blocks(batches, BLOCK_ROWS):
            rows += block.num_rows
            codes = [_codes(*_values(block, f"v{k}"), own) for k, own in enumerate(sent.value)]
            there = [(c > 0).astype(np.int64) for c in codes]
            for total, (a, b) in zip(sums, asked):
                total += np.bincount(codes[a] if b is None else codes[a] * there[b], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([rows], pa.int64())], names=["g", "code", "n"])
        for g, total in enumerate(sums):
            code = np.flatnonzero(total[1:]) + 1
            arrays = [pa.array(np.full(len(code), g, np.int32)), pa.array(code.astype(np.int32)), pa.array(total[code])]
            yield pa.RecordBatch.from_arrays(arrays, names=["g", "code", "n"])

    sums = df.select(*_cells(df, names)).mapInArrow(counted, "g int, code int, n long").groupBy("g", "code").agg(F.sum("n").alias("n"))
    found = sums.toPandas().sort_values("g")  # a row per ranking and code
    total = int(found.loc[found["g"] == -1, "n"].sum())
    edges = np.searchsorted(found["g"].to_numpy(), np.arange(len(asked) + 1))
    out = Places([], [], [], [], [], total)
    for g, (a, _) in enumerate(asked):
        part = found.iloc[edges[g] : edges[g + 1]]
        n = np.zeros(2 * len(cuts[a]) + 2, np.int64)
        n[part["code"].to_numpy()] = part["n"].to_numpy()
        if g >= len(labels):
            out.sizes.append(n)
            continue
        rows, tied = int(n.sum()), n[2::2]
        ranks = (np.cumsum(n) - n).astype(float) - (rows + 1) / 2.0
        ranks[2::2] += (tied + 1) / 2.0
        ranks[0] = 0.0
        out.ranks.append(ranks)
        out.rows.append(rows)
        out.ties.append(sum(k * (k * k - 1) for k in tied.tolist()))
        out.kinds.append(int((tied > 0).sum()))
    return out


# -- products of ranks ---------------------------------------------------------


def _dealt(sizes: np.ndarray, total: int, parallel: int) -> tuple[np.ndarray, int]:
    """Task of every bucket between cut values (-1 for cut values), and the number of tasks."""
    tasks = max(1, -(-total // TASK_ROWS), min(parallel, -(-total // 20_000)))
    open_rows = sizes[1::2]
    before = np.cumsum(open_rows) - open_rows
    task = np.full(len(sizes), -1, np.int64)
    task[1::2] = np.minimum(tasks - 1, before * tasks // max(1, int(open_rows.sum())))
    return task, tasks


def _products(df: DataFrame, wanted: Rankings, cuts: Sequence[np.ndarray], places: Places) -> np.ndarray:
    """Sums of products of centred ranks of every pair, then, for every ranking, ``n^3 - n`` and number of values between cuts."""
    spark, names = df.sparkSession, wanted.names
    at = {c: k for k, c in enumerate(names)}
    pairs = [(at[a], at[b], ga, gb) for a, b, ga, gb in wanted.pairs]
    labels = [(at[c], wanted.bit(other)) for c, other in wanted.labels]
    large = [k for k in range(len(names)) if places.sizes[k][1::2].any()]
    turn = {k: n for n, k in enumerate(large)}  # settled columns have none
    bits = [wanted.bit(c) for c in names]
    dealt = [_dealt(places.sizes[k], places.total, spark.sparkContext.defaultParallelism) for k in large]
    width = len(pairs) + 2 * len(labels)
    sent = spark.sparkContext.broadcast((list(cuts), places.ranks, [task for task, _ in dealt]))
    small, whole = [k for k in range(len(names)) if k not in turn], [_is_whole(df, c) for c in names]

    def pending(stage: int) -> list[int]:
        """Pairs of which one column is ranked before a stage, the other in it or later."""
        return [p for p, (a, b, _, _) in enumerate(pairs) if a in turn and b in turn and min(turn[a], turn[b]) < stage <= max(turn[a], turn[b])]

    def schema(stage: int) -> str:
        """Rows on their way to a stage: task, number, gaps, codes of settled columns, values of others, ranks waiting for their partner."""
        values = [f"v{k} {'long' if whole[k] else 'double'}" for k in large[stage:]]
        fields = ["task int", "number long", "pattern long", *(f"c{k} int" for k in small), *values, *(f"p{p} double" for p in pending(stage)), "s double"]
        return ", ".join(fields)

    def target(stage: int, values: np.ndarray, there: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Rows between cuts go to the task of their bucket, all others anywhere."""
        task = sent.value[2][stage][_codes(values, there, sent.value[0][large[stage]])]
        anywhere = (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(dealt[stage][1])
        return np.where(there & (task >= 0), task, anywhere.astype(np.int64))

    def handed(stage: int, rows: Mapping[str, object], sums: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(rows["number"])
        values, there = rows[f"v{large[stage]}"]
        made = {**rows, "task": target(stage, values, there, rows["number"]).astype(np.int32)}
        arrays, kinds = [], [f.rsplit(" ", 1) for f in schema(stage).split(", ")]
        for name, _ in kinds[:-1]:
            given = made[name]
            arrays.append(pa.array(given[0], mask=~given[1]) if isinstance(given, tuple) else pa.array(given))
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.zeros(n) if sums is None else sums)], names=[name for name, _ in kinds])

    def told(stage: int, sums: np.ndarray) -> pa.RecordBatch:
        """Rows without values that carry the sums so far through the later stages, under numbers below 0."""
        own = np.flatnonzero(sums)
        n = len(own)
        if stage == len(large):
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(sums[own])], names=["p", "s"])
        rows: dict[str, object] = {"number": -1 - own, "pattern": np.zeros(n, np.int64)}
        rows |= {f"c{k}": np.zeros(n, np.int32) for k in small} | {f"p{p}": np.zeros(n) for p in pending(stage)}
        rows |= {f"v{k}": (np.zeros(n, np.int64 if whole[k] else float), np.zeros(n, bool)) for k in large[stage:]}
        return handed(stage, rows, sums[own])

    def started(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, number = np.zeros(width), TaskContext.get().partitionId() << 36
        ranks = sent.value[1]
        for block in _blocks(batches, BLOCK_ROWS):
            n = block.num_rows
            cells = {k: _values(block, f"v{k}") for k in range(len(names))}
            codes = {k: _codes(*cells[k], sent.value[0][k]) for k in small}
            for p, (a, b, ga, gb) in enumerate(pairs):
                if a in codes and b in codes:
                    sums[p] += ranks[ga][codes[a]] @ ranks[gb][codes[b]]
            if large:
                pattern = np.zeros(n, np.int64)
                for k, bit in enumerate(bits):
                    pattern |= np.where(cells[k][1], bit, 0)
                rows = {"number": number + np.arange(n), "pattern": pattern}
                rows |= {f"c{k}": codes[k].astype(np.int32) for k in small} | {f"v{k}": cells[k] for k in large}
                yield handed(0, rows)
                number += n
        yield told(0, sums)

    def ranked(stage: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = next(_blocks(batches, 1 << 62), None)
        if block is None:
            return
        a = large[stage]
        sums = np.zeros(width)
        numbers = block.column("number").to_numpy()
        carried = numbers < 0
        np.add.at(sums, -1 - numbers[carried], block.column("s").to_numpy()[carried])
        cuts_of, ranks = sent.value[0][a], sent.value[1]
        values, there = _values(block, f"v{a}")
        pattern = block.column("pattern").to_numpy()
        codes = _codes(values, there, cuts_of)
        # rows between cuts in the order of their values; equal ones make a group, groups between two cuts a bucket
        inside = np.flatnonzero(codes & 1)
        inside = inside[np.argsort(values[inside], kind="stable")]
        own = values[inside]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(own)))
        bucket = codes[inside][starts]
        first = np.searchsorted(bucket, bucket)
        found: dict[int, np.ndarray] = {}
        for g, (column, need) in enumerate(labels):
            if column != a:
                continue
            rank = ranks[g][codes]
            if len(own):
                counted = ((pattern[inside] & need) == need).astype(np.int64)
                n = np.add.reduceat(counted, starts)
                below = np.cumsum(n) - n
                rank[inside] += np.repeat(below - below[first] + (n + 1) / 2.0, lengths)
                sums[len(pairs) + g] += (n.astype(float) * (n.astype(float) ** 2 - 1)).sum()
                sums[len(pairs) + len(labels) + g] += (n > 0).sum()
            found[g] = rank
        waiting = {}
        for p, (x, y, gx, gy) in enumerate(pairs):
            if a not in (x, y):
                continue
            mine, (other, theirs) = (found[gx], (y, gy)) if x == a else (found[gy], (x, gx))
            if other == a:
                sums[p] += mine @ mine
            elif other not in turn:
                sums[p] += mine @ ranks[theirs][block.column(f"c{other}").to_numpy()]
            elif turn[other] < stage:
                sums[p] += mine @ block.column(f"p{p}").to_numpy()
            else:
                waiting[f"p{p}"] = mine
        if stage + 1 < len(large):
            real = np.flatnonzero(~carried)
            kept = {f"p{p}": block.column(f"p{p}").to_numpy() for p in pending(stage) if p in pending(stage + 1)}
            rows: dict[str, object] = {name: array[real] for name, array in {**kept, **waiting}.items()}
            rows |= {"number": numbers[real], "pattern": pattern[real]}
            rows |= {f"c{k}": block.column(f"c{k}").to_numpy()[real] for k in small}
            rows |= {f"v{k}": tuple(x[real] for x in _values(block, f"v{k}")) for k in large[stage + 1 :]}
            yield handed(stage + 1, rows)
        yield told(stage + 1, sums)

    last = "p int, s double"
    frame = df.select(*_cells(df, names)).mapInArrow(started, schema(0) if large else last)
    for stage in range(len(large)):
        moved = frame.repartitionById(dealt[stage][1], F.col("task"))
        out = schema(stage + 1) if stage + 1 < len(large) else last
        frame = moved.mapInArrow(lambda batches, stage=stage: ranked(stage, batches), out)
    sums = np.zeros(width)
    for r in frame.groupBy("p").agg(F.sum("s").alias("s")).collect():
        sums[r["p"]] = r["s"]
    return sums


def gap_coefficients(
    df: DataFrame, pairs: Sequence[tuple[str, str]], gaps: Iterable[str], broadcast_rows: int
) -> list[tuple[str, str, float | None, int]]:
    """(a, b, coefficient, complete rows) of every pair that has a complete row; a constant number of scans.

    More than ``PATTERN_BITS`` columns with gaps are taken in groups of pairs.
    """
    gaps, out, rest = set(gaps), [], list(pairs)
    while rest:
        names: list[str] = []
        for at, pair in enumerate(rest):
            new = [*names, *(c for c in dict.fromkeys(pair) if c not in names)]
            if len(gaps.intersection(new)) > PATTERN_BITS:
                break
            names = new
        else:
            at = len(rest)
        wanted, rest = Rankings(names, gaps, rest[:at]), rest[at:]
        cuts = _cuts(df, names, min(FEW_VALUES, broadcast_rows))
        places = _placed(df, wanted, cuts)
        sums = _products(df, wanted, cuts, places)
        ties = [t + int(s) for t, s in zip(places.ties, sums[len(wanted.pairs) :])]
        kinds = [k + int(s) for k, s in zip(places.kinds, sums[len(wanted.pairs) + len(wanted.labels) :])]
        for p, (a, b, ga, gb) in enumerate(wanted.pairs):
            rows = places.rows[ga]
            if not rows:
                continue
            value = None
            if kinds[ga] > 1 and kinds[gb] > 1:
                # the sum of squared centred ranks follows from the sizes of the ties
                spread = [(rows**3 - rows - ties[g]) / 12 for g in (ga, gb)]
                value = max(-1.0, min(1.0, float(sums[p]) / (spread[0] ** 0.5 * spread[1] ** 0.5)))
            out.append((a, b, value, rows))
    return out

"""Order statistics over data of any size.

Both exact quantiles and average ranks reduce to one question: how many rows
lie below a value.  It is answered by counting equal values first (so a value
shared by a third of the table is one row), range-partitioning the distinct
values and adding per-partition offsets; no window ever spans a whole column.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import as_double, column_aggregates, per_column, ref, union_all
from tablescope.functions.session import pinned

#: Largest number of rows whose quantiles one task may work out.
ONE_TASK_ROWS = 1_000_000
#: Largest number of rank table rows (distinct values, all columns together) sent to every executor.
BROADCAST_ROWS = 1_000_000
#: A value holding at least this share of the rows is handled by broadcast;
#: at most 1/HOT_SHARE such values can exist, and no other one fills a join task.
HOT_SHARE = 0.00001
_SPREAD = 1024


def counts_below(counts: DataFrame, group: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Add ``below``: the rows of the group with a smaller value.

    ``counts`` has one row per (group, value) and the number of rows in ``n``.
    The only shuffle is the one by range: running sums are carried along the
    sorted rows of each partition.
    """
    keys = [*group, *value]
    ordered = counts.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*counts.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_inside", T.LongType())])
    ranged = pinned(ordered.mapInArrow(lambda batches: _running(batches, list(group)), schema))
    totals = ranged.groupBy(*group, "_part").agg(F.sum("n").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and partition: bounded by the partition count
    offsets = totals.select(
        *group, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        ranged.join(F.broadcast(offsets), [*group, "_part"])
        .withColumn("below", F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_part", "_inside")
    )


def _running(batches: Iterable[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
    """Add the partition's number and the sum of ``n`` over the group's earlier rows in it."""
    part, last, carried = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        n = batch.column("n").to_numpy()
        codes = np.stack([batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy() for g in group])
        starts = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(axis=0)]))
        before = np.cumsum(n) - n
        inside = before - np.repeat(before[starts], np.diff(np.append(starts, rows)))
        first, own = ([batch.column(g)[at].as_py() for g in group] for at in (0, rows - 1))
        if first == last:
            inside[: starts[1] if len(starts) > 1 else rows] += carried
        last, carried = own, int(inside[-1] + n[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(rows, part, np.int32)), pa.array(inside.astype(np.int64))],
            names=[*batch.schema.names, "_part", "_inside"],
        )


# -- quantiles -----------------------------------------------------------------


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], *, one_task_rows: int = ONE_TASK_ROWS
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns, as Python numbers.

    Columns of a checked small size are sorted inside one task (several times
    faster than the built-in ``percentile``, whose buffer boxes every distinct
    value).  Larger ones are narrowed around each target by a bounded sample
    and settled exactly by counting; the sample decides only how much data is
    looked at, never the result.
    """
    columns = list(wanted)
    frame = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    facts = column_aggregates(frame, frame.columns, lambda _, v: {"n": F.count(v), "low": F.min(v), "high": F.max(v)})
    size = [r["n"] for r in facts]
    # both ends are known from the first scan; only places between them are searched
    found: list[dict[int, float]] = [{0: r["low"], r["n"] - 1: r["high"]} if r["n"] else {} for r in facts]
    places = [[k for k in _places(n, wanted[c]) if k not in ends] for n, c, ends in zip(size, columns, found)]
    small = [i for i, n in enumerate(size) if places[i] and n <= one_task_rows]

    def direct(_, i: int) -> DataFrame:
        ordered = frame.agg(F.sort_array(F.collect_list(f"c{i}")).alias("a"))
        picked = F.array(*[F.element_at("a", F.lit(k + 1)) for k in places[i]])
        return ordered.select(F.lit(i).alias("i"), picked.alias("v"))

    for row in per_column(small, direct) if small else []:
        found[row["i"]].update(zip(places[row["i"]], row["v"]))
    large = [i for i, n in enumerate(size) if places[i] and n > one_task_rows]
    if large:
        brackets = _brackets(frame, {i: size[i] for i in large}, places, min(one_task_rows, 200_000))
        found_large = _search(frame, {(i, k): brackets[i, k] for i in large for k in places[i]})
        missed = {t: (None, None) for t in brackets if t not in found_large}
        if missed:  # a bracket did not hold its target: look at the whole column
            found_large.update(_search(frame, missed))
        for (i, k), v in found_large.items():
            found[i][k] = v
    return {c: [_interpolated(found[i], size[i], p) for p in wanted[c]] for i, c in enumerate(columns)}


def _places(n: int, probs: Sequence[float]) -> list[int]:
    """Positions in sorted order that the quantiles lie between."""
    return sorted({k for p in probs for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) if n else []


def _interpolated(at: Mapping[int, float], n: int, p: float) -> float | None:
    if not n:
        return None
    position = p * (n - 1)
    low, high = at[math.floor(position)], at[math.ceil(position)]
    return low if low == high else low + (high - low) * (position - math.floor(position))


def _brackets(frame: DataFrame, size: Mapping[int, int], places, rows: int) -> dict[tuple[int, int], tuple]:
    """Bounds (open where ``None``) around every target, from a sample of bounded size."""
    margin = 8.0 / math.sqrt(rows)
    columns = list(size)
    shares = {(i, k): k / (size[i] - 1) for i in columns for k in places[i]}
    asked = {i: sorted({min(1.0, max(0.0, shares[i, k] + d)) for k in places[i] for d in (-margin, margin)})
             for i in columns}

    def sampled(_, i: int) -> DataFrame:
        values = frame.select(F.col(f"c{i}").alias("v")).where("v is not null")
        some = values.sample(fraction=min(1.0, rows / size[i]), seed=7)
        ordered = some.agg(F.sort_array(F.collect_list("v")).alias("a"))
        at = [F.element_at("a", F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size("a"))).cast("int")) for q in asked[i]]
        return ordered.where("size(a) > 0").select(F.lit(i).alias("i"), F.array(*at).alias("v"))

    cuts = {r["i"]: dict(zip(asked[r["i"]], r["v"])) for r in per_column(columns, sampled)}
    return {
        (i, k): (
            cuts.get(i, {}).get(q - margin) if q > margin else None,
            cuts.get(i, {}).get(q + margin) if q < 1 - margin else None,
        )
        for (i, k), q in shares.items()
    }


def _search(frame: DataFrame, brackets: Mapping[tuple[int, int], tuple]) -> dict[tuple[int, int], float]:
    """The value at each (column, position), if it lies inside its bracket.

    Only values inside a bracket are counted and ordered; the rows below it
    are merely summed up.
    """
    spark = frame.sparkSession
    columns = list(dict.fromkeys(i for i, _ in brackets))
    spans = {i: list(dict.fromkeys(b for (j, _), b in brackets.items() if j == i)) for i in columns}

    def below(_, i: int) -> DataFrame:
        v = F.col(f"c{i}")
        sums = [F.count_if(v < F.lit(lo)) if lo is not None else F.count_if(F.lit(False)) for lo, _ in spans[i]]
        return frame.select(v).agg(F.lit(i).alias("i"), F.array(*sums).alias("u"))

    def inside(bounds) -> Column:
        lo, hi = bounds
        test = F.col("v").isNotNull()
        if lo is not None:
            test = test & (F.col("v") >= F.lit(lo))
        return test & (F.col("v") <= F.lit(hi)) if hi is not None else test

    under = {r["i"]: r["u"] for r in per_column(columns, below)}
    counts = union_all(
        frame.select(F.col(f"c{i}").alias("v"))
        .select("v", F.explode(F.array(*[F.when(inside(b), F.lit(j)) for j, b in enumerate(spans[i])])).alias("g"))
        .where("g is not null")
        .groupBy(F.lit(i).alias("i"), "g", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        for i in columns
    )
    ordered = counts_below(counts, ["i", "g"], ["v"])
    targets = [(i, spans[i].index(b), k, k - under[i][spans[i].index(b)]) for (i, k), b in brackets.items()]
    local = spark.createDataFrame(targets, "i int, g int, k bigint, place bigint")  # one row per target
    hit = (F.col("below") <= F.col("place")) & (F.col("place") < F.col("below") + F.col("n"))
    rows = ordered.join(F.broadcast(local), ["i", "g"]).where(hit).select("i", "k", "v").collect()
    return {(r["i"], r["k"]): r["v"] for r in rows}


# -- average ranks -------------------------------------------------------------


def _typed(df: DataFrame, column: str) -> tuple[Column, Column]:
    """(integer reading, fractional reading); exactly one of them is set."""
    if isinstance(df.schema[column].dataType, (T.IntegralType, T.BooleanType)):
        return ref(column).cast("bigint"), F.lit(None).cast("double")
    return F.lit(None).cast("bigint"), as_double(df, column)


def rank_tables(frames: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Average rank of every distinct value of several columns, in one pass.

    ``frames`` maps a label to (frame, column).  Result columns:
    ``g, i, d, n, rank`` - tied rows share the mean of their positions.
    """
    counts = union_all(
        df.select(F.lit(label).alias("g"), _typed(df, c)[0].alias("i"), _typed(df, c)[1].alias("d"))
        .where("i is not null or d is not null")
        .groupBy("g", "i", "d")
        .agg(F.count(F.lit(1)).alias("n"))
        for label, (df, c) in frames.items()
    )
    ordered = counts_below(counts, ["g"], ["i", "d"])
    return ordered.withColumn("rank", F.col("below") + (F.col("n") + 1) / 2.0).drop("below")


def _lane(*values) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(_SPREAD)).cast("int")


class TableSize(NamedTuple):
    values: int
    rows: int


def table_sizes(tables: DataFrame) -> dict[str, TableSize]:
    """Distinct values and rows behind every rank table."""
    counted = tables.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return {r["g"]: TableSize(r["k"], r["n"]) for r in counted.collect()}


def attach_ranks(
    df: DataFrame,
    labels: Mapping[str, str],
    tables: DataFrame,
    *,
    sizes: Mapping[str, TableSize] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace columns by their ranks; ``labels`` maps column -> table label.

    Rank tables are broadcast, the smallest first, while together they stay
    within ``broadcast_rows``.  Of the others the few hot
    values (their number is bounded by 1/HOT_SHARE) are still resolved by
    broadcast and take no part in the shuffled join with the others, so a
    value held by a third of all rows cannot overload one task.  Identical
    rows are folded into one row with weight ``w`` before they are shuffled.
    """
    sizes = table_sizes(tables) if sizes is None else sizes
    empty = TableSize(0, 0)
    large, room = [], broadcast_rows
    for c, g in sorted(labels.items(), key=lambda item: sizes.get(item[1], empty).values):
        room -= sizes.get(g, empty).values
        if room < 0:
            large.append(c)
    columns = list(labels)
    frame = df.select(
        *[f for j, c in enumerate(columns) for f in
          (_typed(df, c)[0].alias(f"i{j}"), _typed(df, c)[1].alias(f"d{j}"))]
    )
    keys = frame.columns
    if large:
        frame = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("w"))
        frame = frame.withColumn("_slot", _lane(*keys))
    else:
        frame = frame.withColumn("w", F.lit(1).cast("bigint"))
    for j, c in enumerate(columns):
        integral = isinstance(df.schema[c].dataType, (T.IntegralType, T.BooleanType))
        field = "i" if integral else "d"
        table = tables.where(F.col("g") == labels[c]).select(F.col(field).alias("_v"), "n", "rank")
        key = F.col(f"{field}{j}")
        if c not in large:
            small = table.select(F.col("_v").alias("_k"), F.col("rank").alias(f"r{j}"))
            frame = frame.join(F.broadcast(small), key == F.col("_k"), "left").drop("_k")
            continue
        cut = sizes[labels[c]].rows * HOT_SHARE
        hot = table.where(F.col("n") >= cut).select(F.col("_v").alias("_h"), F.col("rank").alias("_hot"))
        cold = table.where(F.col("n") < cut).select(
            F.col("_v").alias("_k"), _lane("_v").alias("_s"), F.col("rank").alias("_cold")
        )
        frame = frame.join(F.broadcast(hot), key == F.col("_h"), "left").drop("_h")
        frame = frame.withColumns(
            {
                "_key": F.when(F.col("_hot").isNull(), key),
                # rows that are settled or missing match nothing and are spread by content;
                # a constant here would be folded away and leave them under one NULL key
                "_lane": F.when(F.col("_hot").isNull() & key.isNotNull(), _lane(key)).otherwise(F.col("_slot")),
            }
        )
        frame = frame.join(
            cold, (F.col("_key") == F.col("_k")) & (F.col("_lane") == F.col("_s")), "left"
        )
        frame = frame.withColumn(f"r{j}", F.coalesce("_hot", "_cold"))
        frame = frame.drop("_k", "_s", "_hot", "_cold", "_key", "_lane")
    return frame.select(*[F.col(f"r{j}").alias(c) for j, c in enumerate(columns)], "w")


def average_rank(df: DataFrame, column: str, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``value, n, rank`` for every distinct value of one column."""
    tables = rank_tables({"only": (df, column)})
    return tables.select(
        F.coalesce(F.col("i").cast("double"), F.col("d")).alias("value"), "n", "rank"
    )

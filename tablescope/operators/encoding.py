"""Dictionaries of values as tables, and feature vectors looked up in them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablescope.functions.columns import ref
from tablescope.operators.ranks import counts_below

#: Dictionaries up to this number of values are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_VALUES = 200_000
#: A value that holds at least this share of the rows is resolved by broadcast; at most 1 / share of them exist.
HOT_VALUE = 0.001


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, value, rows_count, position`` of every value of some text columns, in one scan.

    Positions count from 0 in the order of the values, column by column; they
    come from a range partitioning of all values, so no column meets in one task.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), ref(c).alias("value")) for c in columns])
    counted = df.select(F.explode(cells).alias("e")).select("e.*").where("value is not null")
    values = counted.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows_count")).withColumn("n", F.lit(1).cast("bigint"))
    placed = counts_below(values, ["column_name"], ["value"])
    return placed.select("column_name", "value", "rows_count", F.col("below").alias("position"))


def looked_up(df: DataFrame, key: Column, table: DataFrame, found: Sequence[str], size: int, rows: int) -> DataFrame:
    """All rows with the columns ``found`` of the ``table`` row whose ``value`` equals the key.

    ``table`` has one row per value and the rows that hold it in ``rows_count``;
    ``size`` is its length.  Beyond ``BROADCAST_VALUES`` only hot values are
    broadcast, and their rows take no part in the shuffled join with the others.
    """
    names = {c: f"_found_{c}" for c in found}
    side = table.select(F.col("value").alias("_value"), "rows_count", *[F.col(c).alias(n) for c, n in names.items()])
    if size <= BROADCAST_VALUES:
        joined = df.join(F.broadcast(side.drop("rows_count")), key == F.col("_value"), "left").drop("_value")
        return joined.withColumnsRenamed({n: c for c, n in names.items()})
    hot = side.where(F.col("rows_count") >= rows * HOT_VALUE).select(F.col("_value").alias("_hot"), F.struct(*names.values()).alias("_a"))
    cold = side.where(F.col("rows_count") < rows * HOT_VALUE).select("_value", F.lit(0).alias("_zero"), F.struct(*names.values()).alias("_b"))
    marked = df.withColumn("_key", key).join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    # settled rows match nothing and are spread by content
    plain = [ref(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    lane = F.when(F.col("_a").isNull(), 0).otherwise(F.pmod(F.xxhash64(*plain), F.lit(1023)).cast("int") + 1)
    joined = marked.withColumn("_lane", lane).join(cold, (F.col("_key") == F.col("_value")) & (F.col("_lane") == F.col("_zero")), "left")
    got = F.coalesce("_a", "_b")
    return joined.select(*[ref(c) for c in df.columns], *[got[n].alias(c) for c, n in names.items()])


def sparse_features(
    df: DataFrame, numeric: Sequence[str], widths: Mapping[str, int], categories: DataFrame, rows: int, name: str = "features"
) -> DataFrame:
    """Add a sparse vector: the numbers, then each text column's values but its first, as 0/1.

    The driver knows only how many values a column has; the place of each value
    comes from the dictionary by a join.
    """
    frame, offset, offsets = df, len(numeric), []
    for k, (column, width) in enumerate(widths.items()):
        own = categories.where(F.col("column_name") == column).select("value", "rows_count", F.col("position").alias(f"_x{k}"))
        frame = looked_up(frame, ref(column), own, [f"_x{k}"], width, rows)
        offsets.append(offset)
        offset += width - 1
    places = F.array(*[F.col(f"_x{k}") for k in range(len(widths))]).cast("array<bigint>")
    numbers = F.array(*[ref(c).cast("double") for c in numeric]).cast("array<double>")
    kept = df.columns
    packed = frame.select(*[ref(c) for c in kept], places.alias("_places"), numbers.alias("_numbers"))
    out = T.StructType([*df.schema.fields, T.StructField(name, VectorUDT())])
    schema = to_arrow_schema(out)
    base = np.array(offsets, np.int64) - 1

    def built(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, t = batch.num_rows, len(numeric), len(base)
            places = batch.column("_places").flatten().to_numpy(zero_copy_only=False).reshape(n, t)
            numbers = batch.column("_numbers").flatten().to_numpy(zero_copy_only=False).reshape(n, m)
            at = np.concatenate([np.broadcast_to(np.arange(m), (n, m)), places + base], axis=1)
            values = np.concatenate([numbers, np.ones((n, t))], axis=1)
            used = np.concatenate([np.ones((n, m), bool), places > 0], axis=1)
            ends = np.concatenate([[0], np.cumsum(used.sum(1))]).astype(np.int32)
            kind = schema.field(name).type
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[used].astype(d), a)) for x, d, a in ((at, np.int32, pa.int32()), (values, float, pa.float64()))]
            fields = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, offset, np.int32)), *lists]
            vector = pa.StructArray.from_arrays([f.cast(kind.field(i).type) for i, f in enumerate(fields)], fields=[kind.field(i) for i in range(4)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], vector], schema=schema)

    return packed.mapInArrow(built, out)


def feature_entries(df: DataFrame, name: str = "features") -> DataFrame:
    """``position, value`` of every stored entry of a sparse vector column, one row each."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(0)
            at, values = (vector.field(i).flatten() for i in (2, 3))
            yield pa.RecordBatch.from_arrays([at.cast(pa.int64()), values], names=["position", "value"])

    return df.select(ref(name)).mapInArrow(listed, "position long, value double")

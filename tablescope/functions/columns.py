"""Column-level building blocks shared by every operator."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Every character that counts as white space around a text.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

#: Texts that are numbers; casts alone would also take "1d" or "2f".
NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"

FRACTIONAL = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def ref(name: str) -> Column:
    """Column reference that is safe for names holding dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def flat_columns(df: DataFrame) -> list[str]:
    """Columns that can be profiled: everything except nested values."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order; BOOLEAN does not count as numeric."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Treat NaN and NULL as one kind of missing value."""
    fractional = [f.name for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL)]
    if not fractional:
        return df
    return df.withColumns({c: F.when(~F.isnan(ref(c)), ref(c)) for c in fractional})


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric reading of a column: text that is not a number becomes NULL."""
    data_type = df.schema[name].dataType
    text = ref(name).cast("string")
    value = ref(name) if is_numeric(data_type) else F.when(text.rlike(NUMBER), text.try_cast("double"))
    if isinstance(data_type, T.BooleanType):
        value = ref(name).cast("int")
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def comparable(df: DataFrame) -> list[Column]:
    """Every column in a form that can be grouped and compared: maps as sorted entries."""
    return [
        F.array_sort(F.map_entries(ref(f.name))).alias(f.name) if isinstance(f.dataType, T.MapType) else ref(f.name)
        for f in df.schema.fields
    ]


def known_names(available: Iterable[str], asked: Sequence) -> tuple[list[str], list[str]]:
    """Asked names, trimmed and once each: those available and those not."""
    if not isinstance(asked, (list, tuple)):
        raise TypeError("Names must be a list")
    there = set(available)
    clean = dict.fromkeys(name for name in (str(item).strip() for item in asked) if name)
    return [n for n in clean if n in there], [n for n in clean if n not in there]


def stripped(text: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with four decimals, 0 when the whole is empty."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(F.round(share * 100, 4), F.lit(0.0))


def require_column(df: DataFrame, name: str, *, numeric: bool = False) -> None:
    if name not in df.columns:
        raise ValueError(f"Column '{name}' does not exist")
    data_type = df.schema[name].dataType
    if numeric and not (is_numeric(data_type) or isinstance(data_type, T.BooleanType)):
        raise ValueError(f"Column '{name}' must be numeric")


def settled(df: DataFrame) -> DataFrame:
    """A small result computed now, so that later rules do not repeat its jobs."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def per_column(columns: Sequence[str], branch: Callable[[int, str], DataFrame], width: int = 24):
    """Rows of one small aggregate per column, gathered ``width`` columns per job.

    Each branch scans only its own column, so a columnar source is read once
    in total, the shuffle keys keep their own type, and no generated method
    grows with the width of the table.  A branch returns a handful of rows, so
    what reaches the driver is bounded by the number of columns.
    """
    rows = []
    for start in range(0, len(columns), width):
        chunk = list(enumerate(columns))[start : start + width]
        rows.extend(union_all(branch(i, c) for i, c in chunk).collect())
    return rows


def column_aggregates(
    df: DataFrame, columns: Sequence[str], make: Callable[[str, Column], dict[str, Column]], per_scan: int = 8
) -> list[dict]:
    """Plain aggregates (no value counting) of many columns, one dict per column.

    ``per_scan`` columns share one aggregate: more would outgrow what the JIT
    compiles, fewer would only add plan branches.  All of them run in one job
    that returns one row per column.
    """
    frames = []
    for start in range(0, len(columns), per_scan):
        chunk = list(enumerate(columns))[start : start + per_scan]
        structs = []
        for i, c in chunk:
            parts = make(c, ref(c))
            structs.append(F.struct(F.lit(i).alias("_i"), *[e.alias(n) for n, e in parts.items()]).alias(f"s{i}"))
        wide = df.agg(*structs)
        frames.append(wide.select(F.explode(F.array(*[f"s{i}" for i, _ in chunk])).alias("s")).select("s.*"))
    rows = {r["_i"]: r.asDict() for r in union_all(frames).collect()} if frames else {}
    return [rows[i] for i in range(len(columns))]


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of every group.

    Spark keeps at most ``n`` rows of a group per task before the shuffle, so a
    hot group reaches its final task as ``n`` rows of each task.
    """
    from pyspark.sql import Window

    ranked = df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("position") <= n)

"""Declarative cleaning: zeros, columns, duplicates, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql import types as T

from tablescope.functions.columns import (
    comparable,
    column_aggregates,
    flat_columns,
    is_numeric,
    nan_to_null,
    per_column,
    ref,
)
from tablescope.functions.session import pinned, stored
from tablescope.operators.profile import (
    DUPLICATE_GROUPS,
    column_profile,
    count_copies,
    is_high_cardinality,
    names_where,
    repeated_digests,
    row_digest,
)
from tablescope.operators.ranks import exact_quantiles

STRATEGIES = ("none", "drop_rows", "smart_fill", "fill_median", "fill_mean")
CHANGES = "position int, action string, column_name string, affected bigint"


def _name_list(value, argument: str) -> list[str]:
    if value is None:
        return []
    if isinstance(value, str) or not isinstance(value, (list, tuple)):
        raise ValueError(f"{argument} must be a list")
    return list(value)


def zero_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zeros become missing in the listed numeric columns; others are ignored."""
    wanted = {c for c in columns if c in df.columns and is_numeric(df.schema[c].dataType)}
    return df.withColumns({c: F.when(ref(c) != 0, ref(c)) for c in df.columns if c in wanted})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the listed columns; unknown names are ignored."""
    gone = set(columns)
    return df.select(*[ref(c) for c in df.columns if c not in gone])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct row.

    Only digests are counted over all rows; rows without a repeated one stay
    where they are, and the others alone are compared in full.
    """
    repeated = stored(repeated_digests(df), "repeated-digests")
    return _distinct(nan_to_null(df), repeated, repeated.count())


def _distinct(rows: DataFrame, repeated: DataFrame, groups: int, *, broadcast_groups: int = DUPLICATE_GROUPS) -> DataFrame:
    """As above, given the repeated digests; too many of them to broadcast send all rows through the comparison."""
    if not groups:
        return rows
    if groups > broadcast_groups:
        return _folded(rows)
    same, digests = row_digest(rows) == F.col("_row_digest"), F.broadcast(repeated)
    return rows.join(digests, same, "left_anti").unionByName(_folded(rows.join(digests, same, "left_semi")))


def _folded(rows: DataFrame) -> DataFrame:
    """One row per distinct row; copies are folded before the shuffle."""
    maps = {f"_key{i}": c for i, (f, c) in enumerate(zip(rows.schema.fields, comparable(rows))) if isinstance(f.dataType, MapType)}
    if not maps:
        return rows.dropDuplicates()
    keyed = rows.withColumns(maps)
    plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, MapType)]
    return keyed.dropDuplicates([*plain, *maps]).drop(*maps)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Only the rows without any missing value."""
    complete = nan_to_null(df)
    for c in df.columns:
        complete = complete.where(ref(c).isNotNull())
    return complete


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one among equals."""

    def branch(i: int, name: str) -> DataFrame:
        counted = (
            df.select(ref(name).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        )
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col("v").cast("string").alias("v")))
        if not isinstance(df.schema[name].dataType, T.StringType):
            best = F.min(F.struct((-F.col("n")).alias("n"), F.col("v")))
        return counted.agg(F.lit(i).alias("i"), best.alias("b")).select("i", F.col("b.v").cast("string").alias("v"))

    return {columns[r["i"]]: r["v"] for r in per_column(columns, branch)} if columns else {}


def missing_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    facts = column_aggregates(df, columns, lambda _, v: {"m": F.count_if(v.isNull())})
    return {c: r["m"] for c, r in zip(columns, facts)}


def fill_values(df: DataFrame, columns: Sequence[str], how: str = "median") -> dict[str, object]:
    """Replacement per column: median or mean of numbers, mode of the rest."""
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    if how == "mean":
        facts = column_aggregates(df, numeric, lambda _, v: {"m": F.avg(v.cast("double"))})
        values: dict[str, object] = {c: r["m"] for c, r in zip(numeric, facts)}
    else:
        values = {c: q[0] for c, q in exact_quantiles(df, {c: [0.5] for c in numeric}).items()} if numeric else {}
    values.update(modes(df, [c for c in columns if c not in numeric]))
    return {c: v for c, v in values.items() if v is not None}


def fill_missing(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Put the given values in place of missing cells.

    A filled integer column becomes DOUBLE, as a median or mean may be
    fractional.
    """
    filled = {}
    for c in df.columns:
        if c not in values:
            continue
        data_type = df.schema[c].dataType
        if is_numeric(data_type):
            filled[c] = F.coalesce(ref(c).cast("double"), F.lit(float(values[c])))
        else:
            filled[c] = F.coalesce(ref(c), F.lit(values[c]).cast(data_type))
    return df.withColumns(filled) if filled else df


def clean(
    df: DataFrame,
    *,
    zero_as_missing: Sequence[str] = (),
    drop: Sequence[str] = (),
    drop_constant: bool = False,
    drop_high_cardinality: bool = False,
    drop_duplicate_rows: bool = False,
    missing: str = "none",
) -> tuple[DataFrame, DataFrame]:
    """Apply the rules in their fixed order; returns (table, changes).

    Order: zeros to missing, columns, duplicate rows, missing values.  The
    returned table is a lazy plan; only counts and fill values are computed
    here.  Duplicates are removed only if some exist, and the shortened table
    is then pinned because several statistics read it.
    """
    zero_as_missing = _name_list(zero_as_missing, "zero_as_missing")
    drop = _name_list(drop, "drop")
    strategy = str(missing).strip().lower()
    if strategy not in STRATEGIES:
        raise ValueError("Unknown missing value strategy")
    current = nan_to_null(df)
    changes: list[tuple] = []

    zeros = [c for c in dict.fromkeys(zero_as_missing)
             if c in current.columns and is_numeric(current.schema[c].dataType)]
    if zeros:
        facts = column_aggregates(current, zeros, lambda _, v: {"z": F.count_if(v == 0)})
        found = {c: r["z"] for c, r in zip(zeros, facts)}
        changes += [("zero_to_missing", c, found[c]) for c in zeros if found[c]]
        current = zero_to_null(current, zeros)

    gone = [c for c in drop if c in current.columns]
    if drop_constant or drop_high_cardinality:
        profile = column_profile(current)
        if drop_constant:
            gone += names_where(profile, F.col("role") == "constant")
        if drop_high_cardinality:
            gone += names_where(profile, is_high_cardinality())
    gone = list(dict.fromkeys(gone))
    if gone:
        changes += [("drop_column", c, 1) for c in gone]
        current = drop_columns(current, gone)
    if not current.columns:
        raise ValueError("Cleaning removed all columns. Keep at least one column")

    if drop_duplicate_rows:
        repeated = repeated_digests(current).persist()
        groups = repeated.count()
        copies = count_copies(current, repeated, groups)
        if copies:
            changes.append(("drop_duplicate_rows", "", copies))
            # the lazy result reads the stored digests
            current = _distinct(current, stored(repeated, "repeated-digests"), groups)
            if strategy != "none":
                current = pinned(current)
        repeated.unpersist()

    if strategy == "drop_rows":
        complete = drop_incomplete(current)
        removed = current.count() - complete.count()
        if removed:
            changes.append(("drop_incomplete_rows", "", removed))
        current = complete
    elif strategy != "none":
        names = flat_columns(current)
        gaps = missing_counts(current, names)
        open_columns = [c for c in names if gaps[c]]
        values = fill_values(current, open_columns, "mean" if strategy == "fill_mean" else "median")
        changes += [("fill_missing", c, gaps[c]) for c in open_columns if c in values]
        current = fill_missing(current, values)

    if current.isEmpty():
        raise ValueError("Cleaning removed all rows. Choose a softer cleaning strategy")
    if not changes:
        changes.append(("unchanged", "", 0))
    rows = [(i + 1, *c) for i, c in enumerate(changes)]
    return current, df.sparkSession.createDataFrame(rows, CHANGES)

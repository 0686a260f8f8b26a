"""Pearson and Spearman correlation: pairs, matrix and feature ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import (
    as_double,
    column_aggregates,
    nan_to_null,
    numeric_columns,
    ref,
    require_column,
)
from tablescope.functions.stats import clip_unit, defined, safe_corr
from tablescope.operators.gap_ranks import gap_coefficients
from tablescope.operators.ranks import BROADCAST_ROWS, attach_ranks, rank_tables, table_sizes

METHODS = ("pearson", "spearman")
MATRIX_COLUMNS = 14
RANKED_FEATURES = 20
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_ENDS = ("min_x", "max_x", "min_y", "max_y")


def _check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError("Unknown correlation method")


def numeric_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Complete numeric pairs of two columns as DOUBLE, named ``x`` and ``y``."""
    require_column(df, x)
    require_column(df, y)
    pair = df.select(as_double(df, x).alias("x"), as_double(df, y).alias("y"))
    return pair.where("x is not null and y is not null")


def pair_moments(
    df: DataFrame,
    left: Sequence[str],
    right: Sequence[str],
    weight: str | None = None,
    centre: float | None = None,
) -> DataFrame:
    """Sums over the complete rows of every (left, right) pair; one scan.

    Rows ``l, r, n, sx, sy, sxx, syy, sxy, min_x, max_x, min_y, max_y``.  The
    sums of all pairs are matrix products of the value and presence matrices,
    taken per Arrow batch; values are centred first (on ``centre`` when it is
    known, else on their means) so that the sums do not cancel.  (A single SQL aggregate over all pairs grows past what the JIT
    compiles and was 5-20 times slower.)
    """
    names = list(dict.fromkeys([*left, *right]))
    at = {c: k for k, c in enumerate(names)}
    li, ri = [at[c] for c in left], [at[c] for c in right]
    frame = df.select(*[as_double(df, c).alias(f"c{k}") for k, c in enumerate(names)],
                      *([ref(weight).cast("double").alias("w")] if weight else []))

    values = [f"c{k}" for k in range(len(names))]
    if centre is None:
        means = [r["m"] for r in column_aggregates(frame, values, lambda _, v: {"m": F.avg(v)})]
    else:
        means = [centre] * len(values)
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(li), len(ri))
        total = np.zeros((6, *shape))
        ends = np.stack([np.full(shape, np.inf), np.full(shape, -np.inf)] * 2)
        seen = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seen = True
            data = np.column_stack(
                [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(names))]
            )
            there = ~np.isnan(data)
            value = np.where(there, data - shift, 0.0)
            w = batch.column(len(names)).to_numpy(zero_copy_only=False).reshape(-1, 1) if weight else 1.0
            ml, mr = there[:, li].astype(float), there[:, ri].astype(float)
            xl, xr = value[:, li], value[:, ri]
            wl, wx = ml * w, xl * w
            with np.errstate(invalid="ignore", over="ignore"):
                total += np.stack(
                    [wl.T @ mr, wx.T @ mr, wl.T @ xr, (wx * xl).T @ mr, wl.T @ (xr * xr), wx.T @ xr]
                )
            for j in range(len(ri)):
                rows = slice(None) if there[:, ri[j]].all() else there[:, ri[j]]
                part = data[rows][:, li]
                if part.shape[0]:
                    ends[0, :, j] = np.fmin(ends[0, :, j], np.fmin.reduce(part, axis=0))
                    ends[1, :, j] = np.fmax(ends[1, :, j], np.fmax.reduce(part, axis=0))
            for i in range(len(li)):
                rows = slice(None) if there[:, li[i]].all() else there[:, li[i]]
                part = data[rows][:, ri]
                if part.shape[0]:
                    ends[2, i, :] = np.fmin(ends[2, i, :], np.fmin.reduce(part, axis=0))
                    ends[3, i, :] = np.fmax(ends[3, i, :], np.fmax.reduce(part, axis=0))
        if seen:
            grid = np.indices(shape).reshape(2, -1).astype("int32")
            flat = [pa.array(a) for a in grid]
            flat += [pa.array(a.ravel()) for a in (*total, *ends)]
            yield pa.RecordBatch.from_arrays(flat, names=["l", "r", *_SUMS, *_ENDS])

    schema = "l int, r int, " + ", ".join(f"{c} double" for c in (*_SUMS, *_ENDS))
    merged = (
        frame.mapInArrow(sums, schema)
        .groupBy("l", "r")
        .agg(
            *[F.sum(c).alias(c) for c in _SUMS],
            F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
            F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"),
        )
    )
    label_l = F.array(*[F.lit(c) for c in left])
    label_r = F.array(*[F.lit(c) for c in right])
    return merged.withColumns({"l": label_l[F.col("l")], "r": label_r[F.col("r")]})


def coefficients(moments: DataFrame) -> DataFrame:
    """``l, r, coefficient, rows_used`` from pair sums; NULL when undefined."""
    c = F.col
    cov = c("sxy") - c("sx") * c("sy") / c("n")
    vx = c("sxx") - c("sx") * c("sx") / c("n")
    vy = c("syy") - c("sy") * c("sy") / c("n")
    varies = (c("n") >= 2) & (c("min_x") < c("max_x")) & (c("min_y") < c("max_y")) & (vx > 0) & (vy > 0)
    value = F.when(varies, clip_unit(defined(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))))
    return moments.where("n > 0").select(
        "l", "r", value.alias("coefficient"), F.round("n").cast("bigint").alias("rows_used")
    )


def _incomplete(df: DataFrame, columns: Sequence[str]) -> list[str]:
    facts = column_aggregates(
        df, columns, lambda name, _: {"m": F.count_if(as_double(df, name).isNull())}, per_scan=32
    )
    return [c for c, r in zip(columns, facts) if r["m"]]


def spearman_coefficients(
    df: DataFrame, left: Sequence[str], right: Sequence[str], *, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rank correlations of all (left, right) pairs on their complete rows.

    Ranks depend on which rows a pair uses.  Without gaps all pairs share one set
    of ranks per column; with gaps see `gap_ranks`.
    """
    names = list(dict.fromkeys([*left, *right]))
    gaps = _incomplete(df, names)
    schema = "l string, r string, coefficient double, rows_used bigint"
    if gaps:
        asked = [(a, b) for a in left for b in right]
        order = {c: k for k, c in enumerate(names)}
        once = dict.fromkeys(tuple(sorted(p, key=order.get)) for p in asked)
        known = {(a, b): row for a, b, *row in gap_coefficients(df, list(once), gaps, broadcast_rows)}
        keys = [(a, b, tuple(sorted((a, b), key=order.get))) for a, b in asked]
        rows = [(a, b, *known[k]) for a, b, k in keys if k in known]
        return df.sparkSession.createDataFrame(rows, schema)
    labels = {c: c for c in names}
    tables = rank_tables({c: (df, c) for c in names}).persist()
    try:
        sizes = table_sizes(tables)
        rows = []
        if all(c in sizes for c in names):
            ranked = attach_ranks(df, labels, tables, sizes=sizes, broadcast_rows=broadcast_rows)
            moments = pair_moments(ranked, left, right, weight="w", centre=(sizes[names[0]].rows + 1) / 2.0)
            rows = coefficients(moments).collect()  # one row per pair
    finally:
        tables.unpersist()
    return df.sparkSession.createDataFrame(rows, schema)


def pair_coefficients(
    df: DataFrame, left: Sequence[str], right: Sequence[str], method: str = "pearson", **options
) -> DataFrame:
    _check_method(method)
    if method == "pearson":
        return coefficients(pair_moments(df, left, right))
    return spearman_coefficients(df, left, right, **options)


def correlation(df: DataFrame, x: str, y: str, method: str = "pearson", **options) -> DataFrame:
    """One row ``method, coefficient, rows_used`` for a pair of columns."""
    _check_method(method)
    if x == y:
        raise ValueError("Choose two different columns")
    pair = numeric_pair(df, x, y)
    if method == "pearson":
        row = pair.agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("x"), F.col("y")).alias("c")).first()
        n, value = row["n"], row["c"]
    else:
        # keep the columns' own types, integers are ranked exactly
        rows = df.where(as_double(df, x).isNotNull() & as_double(df, y).isNotNull())
        n = rows.count()
        found = spearman_coefficients(rows, [x], [y], **options).first() if n >= 2 else None
        value = found["coefficient"] if found else None
    if n < 2:
        raise ValueError("Not enough numeric rows for analysis")
    if value is None:
        raise ValueError("Correlation is undefined for constant columns")
    return df.sparkSession.createDataFrame(
        [(method, float(value), n)], "method string, coefficient double, rows_used bigint"
    )


def correlation_matrix(
    df: DataFrame,
    method: str = "pearson",
    columns: Sequence[str] | None = None,
    max_columns: int = MATRIX_COLUMNS,
    **options,
) -> DataFrame:
    """Long form ``row_position, row_name, column_position, column_name, value``.

    Undefined coefficients are 0, on the diagonal too; values have 4 decimals.
    """
    _check_method(method)
    numeric = numeric_columns(df)
    chosen = [c for c in dict.fromkeys(columns) if c in numeric] if columns else numeric
    if len(chosen) < 2:
        raise ValueError("At least two numeric columns are required for a correlation matrix")
    chosen = chosen[:max_columns]
    found = pair_coefficients(nan_to_null(df), chosen, chosen, method, **options)
    position = F.create_map(*[v for i, c in enumerate(chosen) for v in (F.lit(c), F.lit(i))])
    values = {(r["l"], r["r"]): r["coefficient"] for r in found.collect()}
    rows = [(a, b, values.get((a, b)) or 0.0) for a in chosen for b in chosen]
    local = df.sparkSession.createDataFrame(rows, "row_name string, column_name string, v double")
    return local.select(
        position[F.col("row_name")].alias("row_position"), "row_name",
        position[F.col("column_name")].alias("column_position"), "column_name",
        F.round("v", 4).alias("value"),
    )


def matrix_wide(matrix: DataFrame) -> DataFrame:
    """One row per column name with one value column per partner."""
    names = [r["row_name"] for r in matrix.select("row_position", "row_name").distinct().orderBy("row_position").collect()]
    wide = matrix.groupBy("row_position", "row_name").pivot("column_name", names).agg(F.first("value"))
    return wide.orderBy("row_position").drop("row_position")


def rank_features(
    df: DataFrame, target: str, method: str = "pearson", k: int = RANKED_FEATURES, **options
) -> DataFrame:
    """Numeric columns by strength of their correlation with a numeric target."""
    _check_method(method)
    require_column(df, target)
    if target not in numeric_columns(df):
        raise ValueError(f"Target '{target}' must be numeric")
    known = nan_to_null(df).where(ref(target).isNotNull())
    if len(known.select(ref(target)).take(2)) < 2:
        raise ValueError("Not enough numeric target values for correlation")
    features = [c for c in numeric_columns(df) if c != target]
    schema = "ordinal int, feature string, coefficient double, rows_used bigint"
    rows = []
    if features:
        found = pair_coefficients(known, features, [target], method, **options)
        rows = [(features.index(r["l"]), r["l"], r["coefficient"], r["rows_used"])
                for r in found.where("coefficient is not null").collect()]
    ranked = df.sparkSession.createDataFrame(rows, schema)
    return (
        ranked.withColumn("abs_coefficient", F.abs("coefficient"))
        .orderBy(F.desc("abs_coefficient"), "ordinal").limit(k)
        .select("feature", "coefficient", "abs_coefficient", "rows_used")
    )

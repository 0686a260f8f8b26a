"""Narrow passes that add columns computed from a text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tablescope.llm.words import sliced


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front until none is taken (in any case)."""
    held = {n.lower() for n in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def joined(docs: DataFrame, key: dict[str, Column], made: DataFrame, value: str, hint: str | None = None) -> tuple[DataFrame, str]:
    """All columns of `docs` and the column `value` of `made`, under a free name, which comes second.

    `key` gives each key column of `made` as an expression over `docs`.
    """
    *keys, found = free_names(docs.columns, *(f"_{n}" for n in key), f"_{value}")
    left = docs.select("*", *(c.alias(n) for n, c in zip(keys, key.values(), strict=True)))
    right = made.select(*(F.col(n).alias(k) for n, k in zip(key, keys, strict=True)), F.col(value).alias(found))
    right = right.hint(hint) if hint else right
    return left.join(right, keys, "left").drop(*keys), found


def attach(
    docs: DataFrame, text_col: str, fields: str, compute: Callable[..., list[list]], keep: str | None = None, given: str | None = None
) -> DataFrame:
    """All columns of `docs` and those of `fields` (DDL), computed from the texts of a slice at a time.

    `compute` gets the texts (null: empty) and, if `given` names another column,
    its values, and returns one list per field.  An input column with the name
    of a new one is replaced; `given` is left out of the result.  With `keep`,
    only rows where that new boolean field is true are returned, without the new
    fields.  No row moves between partitions.
    """
    made = _parse_datatype_string(fields)
    names = set() if keep else {f.name.lower() for f in made.fields}
    held = [f for f in docs.schema.fields if f.name.lower() not in names and f.name != given]
    out = StructType(held if keep else held + [StructField(f.name, f.dataType) for f in made.fields])
    schema = to_arrow_schema(out)
    types = to_arrow_schema(made)

    def run(batches):
        for batch in sliced(batches, "text"):
            inputs = [batch.column(n).to_pylist() for n in ("text", "given") if n in batch.schema.names]
            found = compute(*inputs)
            if keep:
                batch = batch.filter(pa.array(found[types.get_field_index(keep)], pa.bool_()))
                found = []
            new = [pa.array(v, types.field(i).type) for i, v in enumerate(found)]
            arrays = [batch.column(i) for i in range(len(held))] + new
            yield pa.RecordBatch.from_arrays([a.cast(schema.field(i).type) for i, a in enumerate(arrays)], schema=schema)

    # numbered columns: no name of the input meets an inner one
    columns = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(held)]
    columns.append(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    if given:
        columns.append(F.col(f"`{given}`").alias("given"))
    return docs.select(*columns).mapInArrow(run, out)

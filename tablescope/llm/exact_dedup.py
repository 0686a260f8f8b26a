"""Exact duplicates by distributed MSD radix partitioning.

A text is read as the sequence (its length in bytes, its bytes).  Every round
splits the groups of the round before by the next digit, a run of bytes;
groups of one document leave, and groups whose text has ended are equal.  No
digest decides equality.  A round is a partial aggregate per (group, digit) and
a join back, so a group holding a third of all rows is folded before it is
shuffled and split by the skew handling of the join.  Digits grow eightfold per
round up to WIDEST, so the number of rounds grows with the logarithm of the
longest repeated text up to that width.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.session import discard, stored
from tablescope.llm.words import sliced

FIRST_CHARS = 32
FIRST_WIDTH = 256
WIDEST = 1 << 20


def _merged(frame: DataFrame) -> DataFrame:
    """The smaller side of a join that grows with the corpus: never broadcast, so plans are alike at every size."""
    return frame.hint("merge")


def _normalised(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Add the digest asked for in the result and, for shared heads, the bytes after the head."""
    for batch in sliced(batches, "_text"):
        digests, rests = [], []
        heads = batch.column("_head").to_pylist()
        for text, head, group in zip(batch.column("_text").to_pylist(), heads, batch.column("_group").to_pylist(), strict=True):
            body = text.encode().lower()
            digests.append(hashlib.sha256(body).hexdigest())
            rests.append(None if group is None else body[len(head.encode()) :])
        kept = {name: batch.column(name) for name in schema.names if name in batch.schema.names}
        made = {"_sha": pa.array(digests, pa.string()), "_rest": pa.array(rests, pa.binary())}
        yield pa.RecordBatch.from_arrays([(kept | made)[n].cast(schema.field(n).type) for n in schema.names], schema=schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Class of equal texts of every row, equal meaning: identical after lower-casing A-Z.

    Returns doc_id, keep_id (the largest id of the class), group_size, kept and
    text_sha256, and with `carry` the whole input row as the struct `row`.
    One row per input row.  A null text equals the empty text.  A null id is
    smaller than any other.  Where the largest id occurs on several rows of a
    class, exactly one of them is kept.  An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_row") if carry else text.alias("_text"),
        F.octet_length(text).alias("_length"),
        F.translate(F.substring(text, 1, FIRST_CHARS), string.ascii_uppercase, string.ascii_lowercase).alias("_head"),
    )
    heads = rows.groupBy("_length", "_head").count().filter("count > 1").drop("count")
    heads = stored(heads.withColumn("_group", F.monotonically_increasing_id()), "radix-heads")
    joined = rows.join(_merged(heads), ["_length", "_head"], "left")
    if carry:
        joined = joined.withColumn("_text", F.coalesce(F.col("_row").getField(text_col).cast("string"), F.lit("")))
    # the original text is needed once more only inside the carried row
    names = ["_id", "_sha", "_group", "_rest"] + (["_row"] if carry else [])
    plain = {"_sha": "string", "_rest": "binary"}
    empty = joined.select(*(F.lit(None).cast(plain[n]).alias(n) if n in plain else F.col(n) for n in names))
    schema = to_arrow_schema(empty.schema)
    done = []
    state = stored(
        joined.select("_id", "_text", "_head", "_group", *(["_row"] if carry else []))
        .mapInArrow(lambda it: _normalised(it, schema), empty.schema)
        .withColumns({"_rid": F.monotonically_increasing_id(), "_size": F.lit(1).cast("long"), "_keep": F.col("_id")}),
        "radix-rows",
    )
    done.append(state.filter("_group IS NULL"))
    discard(heads)
    active, width = state.filter("_group IS NOT NULL"), FIRST_WIDTH
    while not active.isEmpty():
        step = active.withColumns({"_digit": F.substring("_rest", 1, width), "_rest": F.expr(f"substring(_rest, {width + 1})")})
        classes = stored(
            step.groupBy("_group", "_digit")
            .agg(F.count(F.lit(1)).alias("_size"), F.max(F.struct("_id", "_rid")).alias("_top"))
            .filter("_size > 1"),
            "radix-classes",
        )
        state = stored(
            step.drop("_size", "_keep").join(_merged(classes), ["_group", "_digit"], "left").select(
                *(c for c in step.columns if c not in ("_digit", "_group", "_size", "_keep")),
                F.coalesce("_size", F.lit(1).cast("long")).alias("_size"),
                F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_top._id")).alias("_keep"),
                F.col("_top._rid").alias("_group"),
            ),
            "radix-rows",
        )
        discard(classes)
        ended = F.col("_group").isNull() | (F.octet_length("_rest") == 0)
        done.append(state.filter(ended))
        active, width = state.filter(~ended), min(width * 8, WIDEST)
    parts = [
        part.select(
            F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
            F.coalesce(F.col("_rid") == F.col("_group"), F.lit(True)).alias("kept"), F.col("_sha").alias("text_sha256"),
            *([F.col("_row").alias("row")] if carry else []),
        )
        for part in done
    ]
    return reduce(DataFrame.unionByName, parts)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without exact copies; of equal texts the one with the largest id stays."""
    return exact_groups(docs, id_col, text_col, carry=True).filter("kept").select("row.*")

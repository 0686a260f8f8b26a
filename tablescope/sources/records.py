"""Records of CSV files that may hold quoted line breaks, read split by split.

Whether a line begins inside a quoted field depends on everything before it.  A
split of a file therefore first tells two things: how it would end, and how many
records would begin in it, if it began outside or inside quotes.  Such functions
of one bit compose along the splits of a file, so a window over one row per split
gives every split its true state and the number of its first record.  Then each
split is cut into records on its own; only a record that crosses the end of a
split is put together from pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.functions.session import stored

#: Splits up to this number (about 60 bytes each) are broadcast to the lines; more are joined by a shuffle.
BROADCAST_SPLITS = 200_000
#: Rest of a quoted field up to its closing quote, what may follow that quote, and a whole field.
_CLOSING = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')
_REST = re.compile(rb"[^,]*+")
_FIELDS = re.compile(rb'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?!")[^,]*+),)*+')

_SUMMARY = "file string, start long, from_out boolean, from_in boolean, n_out long, n_in long, valid boolean, header binary"
_PIECES = "nth long, kind int, text binary, file string, start long"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open after the line.

    A field is quoted if its first character is a quote; quotes elsewhere in a
    field are ordinary characters, and two quotes inside a quoted field are one.
    """
    at = 0
    if inside:
        closed = _CLOSING.match(line)
        if not closed:
            return True
        at = _REST.match(line, closed.end()).end()
        if at == len(line):
            return False
        at += 1
    at = _FIELDS.match(line, at).end()
    return line[at : at + 1] == b'"' and not _CLOSING.match(line, at + 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Parts of batches that lie in one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column("start").to_numpy()
        file = batch.column("file").dictionary_encode().indices.to_numpy()
        cuts = (np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0)) + 1).tolist()
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield (batch.column("file")[begin].as_py(), int(start[begin])), batch.slice(begin, end - begin)


def _quoted(values: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist()


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does to either state."""
    names = [f.split()[0] for f in _SUMMARY.split(", ")]
    schema = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)))
    key, states, counts, valid, head, headed = None, [False, True], [0, 0], True, b"", False

    def out() -> pa.RecordBatch:
        row = (*key, *states, *counts, valid, head.removesuffix(b"\r") if key[1] == 0 else None)
        return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=schema)

    for place, batch in _runs(batches):
        if place != key:
            if key is not None:
                yield out()
            key, states, counts, valid, head, headed = place, [False, True], [0, 0], True, b"", False
        values = batch.column("value")
        lines = values.to_pylist()
        if valid:
            try:
                values.cast(pa.string()).validate(full=True)
            except pa.ArrowInvalid:
                valid = False
        if key[1] == 0 and not headed:
            inside = bool(head)
            for line in lines:
                if not inside and not line.strip():
                    continue
                head += (b"\n" if inside else b"") + line
                inside = ends_inside(line, inside)
                if not inside:
                    headed = True
                    break
        begun = np.concatenate([[0], np.cumsum([bool(line.strip()) for line in lines])])
        at = 0
        for quoted in [*_quoted(values), len(lines)]:
            for n in (0, 1):
                if not states[n]:  # lines without quotes change nothing; outside, each begins a record
                    counts[n] += int(begun[min(quoted + 1, len(lines))] - begun[at])
            if quoted < len(lines):
                first = ends_inside(lines[quoted], states[0])
                states = [first, first if states[0] == states[1] else ends_inside(lines[quoted], states[1])]
            at = quoted + 1
    if key is not None:
        yield out()


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits whose state and first number are known.

    kind 0: a whole record; 1: one that goes on in the next split; 2: what a
    split holds of a record that began before it.
    """
    key, inside, nth, head, held, kind = None, False, 0, None, [], 0

    def out(rows: list[tuple]) -> pa.RecordBatch:
        rows = [(None if r[0] == head else r[0], *r[1:]) for r in rows]  # a header has no number
        arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([key[0]] * len(rows), pa.string()), pa.array([key[1]] * len(rows), pa.int64())], names=["nth", "kind", "text", "file", "start"])

    for place, batch in _runs(batches):
        if place != key:
            if held:
                yield out([(nth - 1, kind or 1, b"\n".join(held))])
            key, inside, nth, held = place, batch.column("inside")[0].as_py(), batch.column("base")[0].as_py(), []
            kind, head = 2 if inside else 0, nth if batch.column("first")[0].as_py() else None
        values = batch.column("value")
        lines, rows, at = values.to_pylist(), [], 0
        for quoted in [*_quoted(values), len(lines)]:
            if inside:
                held += lines[at:quoted]
            else:
                for line in lines[at:quoted]:
                    if line.strip():
                        rows.append((nth, 0, line.removesuffix(b"\r")))
                        nth += 1
            if quoted < len(lines):
                line = lines[quoted]
                nth += not inside
                held.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    rows.append((nth - 1, kind, b"\n".join(held).removesuffix(b"\r")))
                    held, kind = [], 0
            at = quoted + 1
        yield out(rows)
    if held:
        yield out([(nth - 1, kind or 1, b"\n".join(held))])


@dataclass
class CsvRecords:
    """A CSV file or folder, cut into splits of known state."""

    lines: DataFrame
    splits: DataFrame
    header: str
    encoding: str
    n_splits: int

    def _with_state(self, lines: DataFrame, splits: DataFrame) -> DataFrame:
        """Lines with the state and the first record number of their split, in order."""
        known = splits.select("file", "start", "inside", "base", (F.col("nth") == 0).alias("first"))
        if self.n_splits <= BROADCAST_SPLITS:
            return lines.join(F.broadcast(known), ["file", "start"])
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(known, ["file", "start"])
        return placed.repartition("file", "start").sortWithinPartitions("file", "start", "place").drop("place")

    def rows(self, limit: int | None = None) -> DataFrame:
        """(row_id, text): data records numbered from 0 in file order, files by name; the first `limit` of them.

        Splits that begin beyond the limit are not cut into records.
        """
        wanted = self.splits if limit is None else self.splits.where(F.col("base") < limit)
        reached = self.splits if limit is None else self.splits.where(F.col("base") <= limit)
        near = reached.where(F.col("inside") | F.col("ends_inside"))
        whole = self._with_state(self.lines, wanted).mapInArrow(_pieces, _PIECES).where("kind = 0")
        # records across ends of splits: those of splits that begin or end inside quotes
        ends = self._with_state(self.lines, near).mapInArrow(_pieces, _PIECES).where("kind > 0")
        in_order = Window.partitionBy("file").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
        chains = ends.withColumn("chain", F.sum((F.col("kind") == 1).cast("int")).over(in_order))
        piece = F.struct("start", F.col("kind") == 1, "text")
        joined = chains.groupBy("file", "chain").agg(
            F.min(F.when(F.col("kind") == 1, F.col("nth"))).alias("nth"), F.array_sort(F.collect_list(piece)).alias("parts")
        )
        text = lambda c: F.decode(c, self.encoding)
        crossing = joined.select("nth", F.array_join(F.transform("parts", lambda p: text(p["text"])), "\n").alias("text"))
        rows = whole.select("nth", text(F.col("text")).alias("text")).unionByName(crossing).withColumnRenamed("nth", "row_id")
        return rows.where(F.col("row_id").isNotNull() if limit is None else F.col("row_id") < limit)


def csv_records(spark: SparkSession, path: str, encoding: str = "auto") -> CsvRecords:
    """Find the state of every split in one pass over the files, without one task reading a whole file.

    Files of one folder must agree in their header record; it is an error if
    they don't.  Headers get no number.  Blank lines between records are no
    records.  A record that is never closed ends with its file.
    """
    lines = _lines(spark, path)
    found = stored(lines.mapInArrow(_summaries, _SUMMARY), "csv-splits")
    facts = found.agg(
        F.bool_and("valid").alias("valid"), F.count_distinct("header").alias("headers"), F.min("header").alias("header"), F.count(F.lit(1)).alias("n")
    ).first()
    if not facts["n"] or not facts["header"]:
        raise ValueError("Uploaded file is empty")
    if facts["headers"] > 1:
        raise ValueError("The files of this folder have different headers")
    encoding = ("UTF-8" if facts["valid"] else "ISO-8859-1") if encoding == "auto" else encoding
    by_file = Window.partitionBy("file").orderBy("start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("from_out") & ~F.col("from_in")).cast("int")
    settled = F.col("from_out") == F.col("from_in")
    upto = found.withColumn("swaps", F.sum(swap).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    # the last split that ends alike from either state, and the swaps since then
    last = F.last(F.when(settled, F.struct(F.col("from_out").cast("int").alias("end"), "swaps")), ignorenulls=True).over(before)
    state = (F.coalesce(last["end"], F.lit(0)) + F.coalesce(F.max("swaps").over(before), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))) % 2 == 1
    splits = upto.withColumn("inside", state)
    n = F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))
    splits = splits.select(
        "file", "start", "inside", n.alias("n"), F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")).alias("ends_inside")
    )
    splits = splits.withColumn("nth", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = splits.groupBy("file").agg((F.sum("n") - 1).alias("records"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("before"))
    # the header is record 0 of its file, so data records are numbered one less
    placed = splits.join(totals, "file").withColumn("base", F.col("before") + F.col("nth") - 1)
    return CsvRecords(lines, placed, facts["header"].decode(encoding, "replace"), encoding, facts["n"])

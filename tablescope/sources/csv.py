"""CSV reading with full-column type inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import NUMBER, column_aggregates, ref
from tablescope.sources.records import csv_records

#: Fixed list of texts that mean "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
BOOLEAN = r"^(True|TRUE|true|False|FALSE|false)$"
SURPLUS = "_surplus_field"
PLACE = "_place_in_file"


def header_names(fields: Sequence[str | None]) -> list[str]:
    """Column names of a header line: blanks are numbered, repeats suffixed."""
    names: list[str] = []
    seen = {f for f in fields if f}
    used: dict[str, int] = {}
    for i, field in enumerate(fields):
        name = field if field not in (None, "") else f"Unnamed: {i}"
        base, k = name, used.get(name, 0)
        if k:
            while name in names or name in seen:
                name, k = f"{base}.{k}", k + 1
            used[base] = k
        else:
            used[base] = 1
        names.append(name)
    return names


def detect_layout(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding, and whether some quoted field goes on over a line break; one pass.

    Columns are read by position, so files of one folder must agree in their
    header line; it is an error if they don't.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(
        "value", quotes.alias("quotes"), F.col("_metadata.file_path").alias("file"),
        F.when((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""), F.monotonically_increasing_id()).alias("place"),
    )
    # one row per file: its first line that isn't blank comes with the smallest place
    files = lines.groupBy("file").agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("other"), F.bool_or(F.col("quotes") % 2 == 1).alias("open"),
        F.min_by("value", "place").alias("header"),
    )
    facts = files.agg(F.bool_or("other").alias("other"), F.bool_or("open").alias("open"), F.count_distinct("header").alias("headers")).first()
    if facts["headers"] > 1:
        raise ValueError("The files of this folder have different headers")
    return "ISO-8859-1" if facts["other"] else "UTF-8", bool(facts["open"])


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line is not valid UTF-8, then ISO-8859-1."""
    lines = spark.read.text(path)
    bad = lines.where(~F.is_valid_utf8("value")).limit(1)
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def _schema(names: Sequence[str]) -> T.StructType:
    fields = [T.StructField(f"f{i}", T.StringType()) for i in range(len(names))]
    return T.StructType([*fields, T.StructField(SURPLUS, T.StringType())])


_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _raw(spark: SparkSession, path: str, encoding: str) -> tuple[DataFrame, list[str]]:
    """Rows as text, one line each."""
    reader = spark.read.options(**_OPTIONS, encoding=encoding)
    first = reader.options(header=False).csv(path).limit(1).collect()
    if not first:
        raise ValueError("Uploaded file is empty")
    names = header_names(list(first[0]))
    reader = spark.read.options(**_OPTIONS, encoding=encoding, header=True, enforceSchema=True)
    return reader.schema(_schema(names)).csv(path), names


def _numbered(spark: SparkSession, path: str, encoding: str, limit: int | None) -> tuple[DataFrame, list[str]]:
    """Rows as text with their place in file order; quoted fields may hold line breaks."""
    found = csv_records(spark, path, encoding)
    parsed = spark.createDataFrame([(found.header,)], "h string").select(
        F.from_csv("h", ", ".join(f"f{i} string" for i in range(found.header.count(",") + 1)), {**_OPTIONS, "multiLine": "true"}).alias("h")
    )
    head = list(parsed.first()["h"])
    names = header_names(head[: max([i for i, h in enumerate(head) if h is not None], default=0) + 1] if '"' in found.header else head)
    fields = F.from_csv("text", _schema(names).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {**_OPTIONS, "multiLine": "true"})
    return found.rows(limit).select(F.col("row_id").alias(PLACE), fields.alias("r")).select(PLACE, "r.*"), names


def _opened(
    spark: SparkSession, path: str, encoding: str, multiline: bool | None, placed: bool = False, limit: int | None = None
) -> tuple[DataFrame, list[str]]:
    if not placed and not multiline and (encoding == "auto" or multiline is None or len(spark.read.text(path).inputFiles()) > 1):
        found, broken = detect_layout(spark, path)
        encoding = found if encoding == "auto" else encoding
        multiline = broken if multiline is None else multiline
    if placed or multiline:
        return _numbered(spark, path, encoding, limit)
    return _raw(spark, path, encoding)


def _known(value: Column) -> Column:
    return F.when(~value.isin(*MISSING_TOKENS), value)


def column_facts(df: DataFrame) -> dict[str, dict]:
    """Which types fit the values of each text column; one scan.

    Rows with a surplus field do not take part, except that they are counted.
    """

    def make(_: str, raw: Column) -> dict[str, Column]:
        good = ref(SURPLUS).isNull()
        v = F.when(good, _known(raw))
        whole = F.when(v.isNotNull(), v.rlike(INTEGER) & F.trim(v).try_cast("bigint").isNotNull())
        return {
            "n": F.count(v),
            "rows": F.count_if(good),
            "surplus": F.count_if(~good),
            "whole": F.bool_and(whole),
            "number": F.bool_and(v.rlike(NUMBER)),
            "flag": F.bool_and(v.rlike(BOOLEAN)),
        }

    names = [c for c in df.columns if c not in (SURPLUS, PLACE)]
    return dict(zip(names, column_aggregates(df, names, make, per_scan=32)))


def narrowest_type(facts: dict) -> str:
    """BIGINT, DOUBLE, BOOLEAN or STRING; a column without values is DOUBLE."""
    if facts["n"] == 0:
        return "double"
    if facts["number"]:
        return "bigint" if facts["whole"] else "double"
    return "boolean" if facts["flag"] else "string"


def read_csv_typed(
    spark: SparkSession,
    path: str,
    *,
    encoding: str = "auto",
    on_bad: str = "error",
    multiline: bool | None = None,
    row_id: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Read a CSV file with a header line and infer column types from all rows.

    A row with too few fields is padded with missing values.  One with too
    many is an error (``on_bad="error"``) or is left to ``bad_records``
    (``on_bad="skip"``).  Quoted line breaks are found by counting quotes per
    line unless ``multiline`` says whether there are any; such a file is cut
    into records split by split.  ``row_id`` names a BIGINT column with the place
    of each row in file order, from 0, files by name; rows without a place in
    the result (too many fields) keep theirs.  ``limit`` keeps the first rows in
    that order; types are then inferred from these.  Files of one folder must
    have equal headers.  For repeated analysis store the result as Parquet.
    """
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError("Only CSV files are supported")
    if on_bad not in ("error", "skip"):
        raise ValueError("on_bad must be error or skip")
    rows, names = _opened(spark, path, encoding, multiline, row_id is not None or limit is not None, limit)
    facts = column_facts(rows)
    totals = next(iter(facts.values()))
    if on_bad == "error" and totals["surplus"]:
        raise ValueError(f"Failed to read CSV: {totals['surplus']} rows have more than {len(names)} fields")
    if not totals["rows"]:
        raise ValueError("Uploaded file is empty")
    text = rows.where(ref(SURPLUS).isNull()).drop(SURPLUS) if totals["surplus"] else rows.drop(SURPLUS)
    typed = []
    if row_id is not None:
        if row_id in names:
            raise ValueError(f"The file has a column '{row_id}'")
        typed.append(ref(PLACE).alias(row_id))
    for raw, name in zip([c for c in text.columns if c != PLACE], names):
        kind = narrowest_type(facts[raw])
        value = _known(ref(raw))
        if kind != "string":
            value = F.trim(value).try_cast(kind)
        typed.append(value.alias(name))
    return text.select(*typed)


def bad_records(
    spark: SparkSession, path: str, *, encoding: str = "auto", multiline: bool | None = None
) -> DataFrame:
    """Rows with more fields than the header, as text, with the first surplus field."""
    rows, names = _opened(spark, path, encoding, multiline)
    found = rows.where(ref(SURPLUS).isNotNull()).drop(PLACE)
    return found.toDF(*names, SURPLUS)

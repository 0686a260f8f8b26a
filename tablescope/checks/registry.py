"""Name -> (Spark query, SQL counterpart or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import ref

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query; integers of the result become BIGINT."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widened(function(spark, sf_dir))

        REGISTRY[name] = (run, sql)
        return function

    return add


def widened(df: DataFrame) -> DataFrame:
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(
        *[
            ref(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else ref(f.name)
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round float noise away before two engines are compared."""
    return df.withColumns({c: F.round(ref(c), digits) for c in columns})

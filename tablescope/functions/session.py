"""Where intermediate results may be kept."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    A folder of this machine is used only when the session names none and
    driver and executors are one process, as in local tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        named = tempfile.mkdtemp(prefix="tablescope-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions for every later use.

    Written to reliable storage, so losing an executor cannot change which
    row sits in which partition.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as a Parquet table in the shared folder and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        folder = shared_folder(spark).rstrip("/")
        for name in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            if folder.split(":", 1)[-1].lstrip("/") in name:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Plans in which a branch per column reads only that column, or rows held locally.
_CHEAP = re.compile(r"[\s:+-]*(Project\b|Filter\b|Relation .*(parquet|orc)$|InMemoryRelation\b|LocalRelation\b|LogicalRDD\b|Range\b)")


def is_columnar(df: DataFrame) -> bool:
    """Whether the plan is a bare scan of columns, with at most filters and expressions above it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    lines = [line for line in plan.toString().splitlines() if line.strip()]
    own = next((i for i, line in enumerate(lines) if "InMemoryRelation" in line), len(lines) - 1)
    return all(_CHEAP.match(line) for line in lines[: own + 1])


@contextmanager
def columnar(df: DataFrame) -> Iterator[DataFrame]:
    """The rows in a form whose columns can be read one by one, for the time of a `with` block.

    Statistics read a table once per column or more.  A text source, a union or
    any computed table is written once to the shared folder instead, and removed
    at the end; results must be computed inside the block.  Types that Parquet
    can't hold leave the table as it is.
    """
    kinds = df.schema.simpleString()
    if is_columnar(df) or "void" in kinds or "interval" in kinds:
        yield df
        return
    names = [f"c{i}" for i in range(len(df.columns))]
    held = stored(df.toDF(*names), "columns")
    try:
        yield held.toDF(*df.columns)
    finally:
        discard(held)

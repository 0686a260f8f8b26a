"""Storing results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

FORMATS = ("parquet", "json", "csv", "orc")


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Write one result; returns the path."""
    if fmt not in FORMATS:
        raise ValueError(f"Unknown format '{fmt}'")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)
    return path


def save_all(frames: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> dict:
    """Write every section of a report or comparison into its own sub-folder."""
    return {name: save(df, f"{folder.rstrip('/')}/{name}", fmt, mode) for name, df in frames.items()}

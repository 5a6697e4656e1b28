"""Labelled pair files: JSON objects with a ``pairs`` array; reports as JSON or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = "struct<a:string,b:string,expected:string,category:string,note:string>"


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """One row per pair of a ``{"pairs": [...]}`` file."""
    return spark.read.schema(f"pairs array<{PAIR}>").option("multiLine", True).json(path).select(F.inline("pairs"))


def write_dataset(pairs: DataFrame, path: str) -> None:
    """Write pairs as JSON lines."""
    pairs.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    report.write.mode("overwrite").format(kind).save(path)

"""Readers of the tables, by name, below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``sf_dir``; columns are pruned and filters pushed down by the reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

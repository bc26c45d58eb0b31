"""Shared helpers of the training-data operators: staged tables, table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from versetime.staging import new_shared_path, rolling, scratch, shared_dir, staged

__all__ = ["new_shared_path", "read_table", "rolling", "scratch", "shared_dir", "staged"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

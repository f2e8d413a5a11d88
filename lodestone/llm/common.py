"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import ARROW_BYTES, ARROW_ROWS, arrow_map

__all__ = ["ARROW_BYTES", "ARROW_ROWS", "arrow_map", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

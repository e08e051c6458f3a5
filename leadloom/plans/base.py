"""Small helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to all cores by their key, before costly work on each: a table that packs well is one small file, which one task would read."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)

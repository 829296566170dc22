"""Readers of the Parquet tables, with only the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.session import ship


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` below ``sf_dir``; ``columns`` narrows the scan."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df

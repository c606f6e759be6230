"""Readers with declared columns and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; only the columns named are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """df as Parquet; any result of an operator is a DataFrame, so this is the sink of all."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

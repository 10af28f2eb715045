"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_partitioned(df: DataFrame, path: str, by: list[str] = (), mode: str = "overwrite") -> None:
    """Parquet, a folder per value, each written by few tasks."""
    (df.repartition(*by) if by else df).write.mode(mode).partitionBy(*by).parquet(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A dashboard's result frame as csv or json."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def append_batch(df: DataFrame, path: str, partition: str, value: int) -> None:
    """One version's rows: written again, they replace themselves."""
    from pyspark.sql import functions as F

    df.withColumn(partition, F.lit(value)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

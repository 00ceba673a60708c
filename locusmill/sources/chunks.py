"""Windows of chunks kept as Parquet, partitioned by contig: the columnar form of the binary chunk files that other tools write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write(windows: DataFrame, path: str) -> None:
    windows.write.mode("overwrite").partitionBy("contig").parquet(path)


def read(spark: SparkSession, path: str, contigs: list[str] | None = None) -> DataFrame:
    """Only the folders of the contigs asked for are read."""
    rows = spark.read.parquet(path)
    return rows.where(rows["contig"].isin(contigs)) if contigs else rows

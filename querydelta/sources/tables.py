"""Named tables of one folder, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_READERS = {"parquet", "orc", "json", "csv"}


class Tables:
    """``Tables(spark, folder).orders`` reads ``folder/orders.parquet`` lazily."""

    def __init__(self, spark: SparkSession, folder: str, fmt: str = "parquet", schemas=None):
        if fmt not in _READERS:
            raise ValueError(f"unsupported format {fmt!r}")
        self.spark = spark
        self._folder = folder.rstrip("/")
        self._format = fmt
        self._schemas = schemas or {}

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.format(self._format)
        if self._format == "csv":
            reader = reader.option("header", "true")
        if name in self._schemas:
            reader = reader.schema(self._schemas[name])
        return reader.load(f"{self._folder}/{name}.{self._format}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a report next to its siblings; the executors write, nothing is collected."""
    report.write.mode("overwrite").format(fmt).save(path)

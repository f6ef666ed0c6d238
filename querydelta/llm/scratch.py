"""Intermediate tables in the shared folder, removed once nothing reads them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from querydelta.session import scratch_folder

_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables below ``spark.checkpoint.dir``; each cuts the lineage of what follows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that only tables already written were made from."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def records_per_batch(spark: SparkSession, n: int):
    """At most ``n`` rows in an Arrow batch for the jobs run inside; for rows that may be large."""
    before = spark.conf.get(_RECORDS)
    spark.conf.set(_RECORDS, str(n))
    try:
        yield
    finally:
        spark.conf.set(_RECORDS, before)

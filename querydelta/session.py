"""Session settings shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows of a chunk that one task sorts when rows are numbered, ranked or summed in an order.
CHUNK_ROWS = "querydelta.chunkRows"
DEFAULT_CHUNK_ROWS = 1_000_000


def local_session(cores: int = 8, app: str = "querydelta", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def chunk_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(CHUNK_ROWS, str(DEFAULT_CHUNK_ROWS)))


def scratch_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one named in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a scratch folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="querydelta-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/querydelta-{spark.sparkContext.applicationId}"


# Joins on several columns take rows that are dealt by one of them as they are.
_SHARED_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def durable(df: DataFrame, keep_dealt: bool = False) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts plan and lineage, survives the loss of executors, and gives the next
    join real sizes. The folder can be dropped once the application has ended.
    With ``keep_dealt``, sides that are dealt by some of a join's columns are not
    dealt again by all of them.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_SHARED_KEYS)
    if keep_dealt:
        spark.conf.set(_SHARED_KEYS, "false")
    try:
        df.write.parquet(path)
    finally:
        if keep_dealt:
            spark.conf.set(_SHARED_KEYS, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame) -> int:
    """Parts for tables as long as ``df``: those of a shuffle, or more if one would hold more than half a chunk of rows."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * df.count() // chunk_rows(spark)))


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``durable`` with ``keep_dealt``, and the table stays in ``parts`` buckets by ``key``.

    Joins (under ``keep_dealt``), groups and windows by ``key`` and more columns then move no rows. ``df`` must already be dealt by
    ``key`` into so many parts, or each task writes a file per bucket. All rows of one key are read by one task.
    """
    spark = df.sparkSession
    name = f"querydelta_{uuid.uuid4().hex}"
    before = spark.conf.get(_SHARED_KEYS)
    spark.conf.set(_SHARED_KEYS, "false")
    try:
        df.write.option("path", f"{scratch_folder(spark)}/{name}").option("compression", "zstd").bucketBy(parts, key).saveAsTable(name)
    finally:
        spark.conf.set(_SHARED_KEYS, before)
    written = spark.table(name)
    spark.sql(f"drop table {name}")  # its files stay; the catalog is left as it was
    return written

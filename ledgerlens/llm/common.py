"""What the corpus operators share: the shared folder, written intermediate tables, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word, as a regex class body (space, tab to carriage return).
BLANKS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where tables go when spark.checkpoint.dir is unset and Spark runs on one machine.
LOCAL_DIR = "/tmp/checkpoints"
#: Spark's setting that drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of how many rows go to Python at once; whole texts may be long, so few.
AT_ONCE, ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
#: Rows of a few numbers each that may be broadcast: about 40 MB.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Reads ``spark.checkpoint.dir``. Only a local[...] session may do without
    it; a cluster without the setting is an error, because a machine-local
    folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_DIR


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    What the write shuffled is dropped once the table stands, so only tables in use hold disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), AT_ONCE: spark.conf.get(AT_ONCE, "10000")}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(AT_ONCE, ROWS_AT_ONCE)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def few_rows(spark: SparkSession) -> None:
    """For queries that send whole texts to Python outside of ``materialize``: from now on a session sends few rows at once."""
    spark.conf.set(AT_ONCE, ROWS_AT_ONCE)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """``df`` (keys of a join, counted here) as a broadcast side if it has at most BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The runs of non-blank characters of a text; a null or blank text has none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{BLANKS}]+")).otherwise(F.array().cast("array<string>"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id has fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(-1))


def fence(value: Column) -> Column:
    """The same value, which the optimizer will not copy into a filter further up (that would compute a costly expression again and again)."""
    return F.when(F.spark_partition_id() >= 0, value)

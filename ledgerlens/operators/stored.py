"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Spark's setting that drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of how many times its file a table may be in memory, by which it chooses what to broadcast.
PACKED, TIMES = "spark.sql.sources.fileCompressionFactor", 50.0


def written(df: DataFrame) -> DataFrame:
    """``df`` by way of ``spark.checkpoint.dir``: computed once, lineage cut, what it shuffled dropped; only a local[...] session may do without the setting.

    Its files are packed, so that a row of a hundred bytes in memory may take one or two. From now on the session
    knows that; by the files' size alone, joins would broadcast tables of millions of rows.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(folder or '/tmp/checkpoints').rstrip('/')}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(PACKED, str(max(TIMES, float(spark.conf.get(PACKED)))))
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: So many rows (documents, where each brings one row) are one task's share where memory grows with them.
TASK_ROWS = 250_000


def tasks(df: DataFrame, rows: int | None = None) -> int:
    """How many tasks give each about so many of the rows of ``df``, however large it is and whatever the number of shuffle partitions."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (rows or TASK_ROWS)))

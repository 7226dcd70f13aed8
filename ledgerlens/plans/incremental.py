"""A folder that files keep coming into, as a stream: each batch reads its new files and settles only the accounts they touch.

What is known stands in a folder of its own, a table for each kind with a part
for each batch. A batch that is run again writes its own part again, so after a
failure nothing counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators import checks, merge
from ledgerlens.operators.stored import written
from ledgerlens.plans import loading
from ledgerlens.sources import statements

SOURCE = "path string, modificationTime timestamp, length bigint, content binary"


@dataclass(frozen=True)
class Folder:
    """What a run needs: where files come in, where its tables stand, and profiles, accounts and the tax year as for ``loading.load_files``."""

    incoming: str
    store: str
    profiles: DataFrame
    accounts: DataFrame
    start: str
    end: str

    def table(self, name: str) -> str:
        return f"{self.store}/{name}"

    def before(self, name: str, batch: int) -> DataFrame | None:
        """The rows that batches before this one have written; null if there are none."""
        spark = self.profiles.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(self.table(name))
        if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            return None
        return spark.read.option("basePath", self.table(name)).parquet(self.table(name)).filter(F.col("batch") < batch)

    def put(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.drop("batch").write.mode("overwrite").parquet(f"{self.table(name)}/batch={batch}")


def settle(folder: Folder, found: DataFrame, batch: int) -> None:
    """One batch: its files (path, content) read, the accounts they touch proved and merged anew with all that is known of them."""
    files = statements.listed(found)
    old = folder.before("outcomes", batch)
    if old is not None:
        seen = old.select("doc_id").distinct().withColumn("seen", F.lit(True))
        files = files.join(seen, "doc_id", "left").withColumn("duplicate", F.col("duplicate") | F.coalesce("seen", F.lit(False))).drop("seen")
    files = written(files)
    got = loading.read_files(files, statements.csv_rows(files), folder.profiles, folder.accounts)
    folder.put("outcomes", batch, got.outcomes)
    folder.put("documents", batch, got.documents.join(files.filter("NOT duplicate").select("doc_id", "name"), "doc_id"))
    folder.put("txns", batch, got.txns)

    so_far = lambda name: folder.before(name, batch + 1)
    touched = got.documents.select("account_id").distinct()
    docs = so_far("documents").join(touched, "account_id", "left_semi").drop("batch", "file_seq")
    docs = written(docs.withColumn("file_seq", F.row_number().over(Window.partitionBy("account_id").orderBy("name")).cast("bigint")))
    txns = written(so_far("txns").join(docs.select("doc_id"), "doc_id", "left_semi").drop("batch"))
    books, told = merge.ledgers(txns.drop("account_id"), docs, folder.accounts, checks.all_checks(txns, docs), folder.start, folder.end)
    folder.put("ledgers", batch, books)
    folder.put("checks", batch, told)


def watch(folder: Folder, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Settle what has come in and end; files that a query of the same checkpoint has seen are not read again."""
    spark: SparkSession = folder.profiles.sparkSession
    source = spark.readStream.format("binaryFile").schema(SOURCE).option("pathGlobFilter", statements.SUFFIXES).option("maxFilesPerTrigger", files_at_once).load(folder.incoming)
    return source.writeStream.foreachBatch(lambda found, batch: settle(folder, found, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def now(folder: Folder, name: str) -> DataFrame:
    """The ledgers or checks that hold: of each account those of the last batch that touched it."""
    rows = folder.profiles.sparkSession.read.option("basePath", folder.table(name)).parquet(folder.table(name))
    last = rows.groupBy("account_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["account_id", "batch"], "left_semi").drop("batch")

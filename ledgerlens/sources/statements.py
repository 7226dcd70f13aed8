"""Statement files as tables: one row for each file, and the ragged rows of CSV files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators.layout import sniff

#: The suffixes of statement files, and the encodings that are tried in order.
SUFFIXES = "*.{csv,CSV,xlsx,XLSX,xls,XLS,pdf,PDF}"
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the content's SHA-256), name, file_seq (by name), container, content, duplicate (an earlier file has the same content)."""
    return listed(spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).load(folder))


def listed(found: DataFrame) -> DataFrame:
    """The same of binary files (path, content) from anywhere."""
    named = found.select(F.sha2("content", 256).alias("doc_id"), F.substring_index("path", "/", -1).alias("name"), sniff(F.col("content")).alias("container"), "content")
    # one number for each file, not for each row of data: the names alone are sorted
    order = named.select("name").withColumn("file_seq", F.row_number().over(Window.orderBy("name")).cast("bigint"))
    return mark_copies(named.join(order, "name"), "doc_id", "name")


def mark_copies(files: DataFrame, content: str, order: str) -> DataFrame:
    """``files`` with ``duplicate``: whether one that comes before has the same content (its hash)."""
    return files.withColumn("duplicate", F.row_number().over(Window.partitionBy(content).orderBy(order)) > 1)


def decoded(content: bytes) -> str | None:
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def csv_rows(read: DataFrame) -> DataFrame:
    """(doc_id, row_no, cells) of the CSV files among ``files``; a file that no encoding fits has no rows.

    A file is one row of input, so a task holds one file at a time; its rows leave in batches.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held: list[list[str]] = []
                done = 0
                for row in csv.reader(io.StringIO(decoded(content) or "")):
                    held.append(row)
                    if len(held) == 5000:
                        yield made(doc, done, held)
                        done, held = done + len(held), []
                if held:
                    yield made(doc, done, held)

    def made(doc: str, done: int, held: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([doc] * len(held)), pa.array(range(done + 1, done + 1 + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], ["doc_id", "row_no", "cells"])

    sheets = read.filter("container = 'csv' AND NOT duplicate").select("doc_id", "content")
    return sheets.mapInArrow(rows, "doc_id string, row_no long, cells array<string>")


def head_text(rows: DataFrame, count: int | None = 30) -> DataFrame:
    """(doc_id, head): the first rows (None: all) as text, cells by comma, rows by line; what layouts are detected by is the first 30."""
    top = rows if count is None else rows.filter(F.col("row_no") <= count)
    lines = F.array_sort(F.collect_list(F.struct("row_no", F.array_join("cells", ",").alias("raw"))))
    return top.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["raw"]), "\n").alias("head"))

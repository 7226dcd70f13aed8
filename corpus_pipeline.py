"""From raw documents to token ids: rules, classifier, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept; ``run`` writes each stage's rows and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, mixing, near_dedup, quality_classifier, quality_rules
from ledgerlens.llm.common import few_rows, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs.select(*COLUMNS), quality_rules.POLICIES["full-1"])


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows(spark)
    # what the rules reject is what the classifier must have seen, so it learns from the table
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs.select(*COLUMNS), model, column="__score").filter(F.col("__score") >= quality_classifier.CUT).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows(spark)
    # the ids are what a model trains on; their digest and the decoded text's come along as proof
    return bpe.digests(docs, bpe.default_path(), with_ids=True)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("MinHash near-dedup", near_duplicates), ("mixing sources", mix), ("BPE encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs

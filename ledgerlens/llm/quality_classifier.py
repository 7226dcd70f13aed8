"""Compression classifier: zstandard dictionaries of good and bad text, and a calibrated size difference.

``fit`` trains one dictionary on good and one on bad labelled texts and fits a
rising curve (isotonic regression) to the normalised compressed-size difference
on labelled texts that no dictionary has seen. The sample is bounded: PER_CLASS texts of each
label, the first in an order by hash of the id among those of at most
SAMPLE_CHARS characters (longer texts never teach). ``score`` compresses every whole text piece by piece under
both dictionaries; the sizes are summed, so a long text counts by all of it.

Defined cases: a null or empty text has no difference and scores as the fit
says for 0; a document whose labels disagree, or whose label is null, teaches
nothing; without labels of both kinds all scores are the share of label 1 (1
without any); repeated rows and ids are scored row by row; a null id is
learned from like any other fold but has no label to join; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import few_rows, fold, table

PER_CLASS, SAMPLE_CHARS = 900, 20_000
DICTIONARY_BYTES, PIECE_BYTES, LEVEL = 112 << 10, 512, 3
HELD_OUT_FOLD, CUT = 0, 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: The calibration: scores at these differences, and in between on straight lines.
    at: tuple[float, ...]
    value: tuple[float, ...]


def pieces(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[k : k + PIECE_BYTES] for k in range(0, len(raw), PIECE_BYTES)]


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    samples = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.good and model.bad:
            self.good, self.bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad))

    def difference(self, text: str) -> float:
        """(size under bad - size under good) / size; above 0: nearer to good."""
        good = bad = size = 0
        for p in pieces(text):
            size += len(p)
            good += len(self.good.compress(p))
            bad += len(self.bad.compress(p))
        return (bad - good) / max(size, 1)

    def score(self, text: str) -> float:
        x = self.difference(text) if self.model.good and self.model.bad else 0.0
        return float(np.interp(x, self.model.at, self.model.value))


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Knots of the weighted isotonic regression of y on x (pool adjacent violators), drawn in by half a row at either end."""
    blocks: list[list[float]] = []  # sum of weights, of weighted y, of weighted x
    for k in np.argsort(x, kind="stable"):
        blocks.append([weight[k], weight[k] * y[k], weight[k] * x[k]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    half = weight.min() / 2
    return tuple(float(b[2] / b[0]) for b in blocks), tuple(float((b[1] + half) / (b[0] + 2 * half)) for b in blocks)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from labelled rows outside the held-out fold."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(fold(F.col("doc_id")) != HELD_OUT_FOLD)
    agreed = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    counts = {r["y"]: r["n"] for r in agreed.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(counts) < 2:
        share = 1.0 if not counts or 1 in counts else 0.0
        return Model(b"", b"", (0.0,), (share,))
    size = F.length(text)
    short = docs.filter((size > 0) & (size <= SAMPLE_CHARS)).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # of rows that repeat an id the text with the least hash teaches, whatever order they come in
    named = short.select("doc_id", F.xxhash64("text").alias("h")).join(agreed, "doc_id").groupBy("doc_id", "y").agg(F.min("h").alias("h"))
    first = [named.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(PER_CLASS) for y in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # twice PER_CLASS rows at most
    rows = short.withColumn("h", F.xxhash64("text")).join(chosen, ["doc_id", "h"]).select("doc_id", "y", "text").dropDuplicates(["doc_id"])  # rows that repeat an id and a text come to the driver once
    found = sorted({str(r["doc_id"]): (r["y"], r["text"]) for r in rows.collect()}.items())
    part = lambda y, third: [t for k, (i, (z, t)) in enumerate(x for x in found if x[1][0] == y) if (k % 3 == 2) is third]
    good, bad = dictionary(part(1, False) or [""]), dictionary(part(0, False) or [""])
    scorer = Scorer(Model(good, bad, (0.0,), (0.0,)))
    x = [[scorer.difference(t) for t in part(y, True)] if good and bad else [] for y in (0, 1)]
    if not x[0] or not x[1]:
        return Model(b"", b"", (0.0,), (counts[1] / (counts[0] + counts[1]),))
    weight = np.repeat([counts[y] / len(x[y]) for y in (0, 1)], [len(x[0]), len(x[1])])
    return Model(good, bad, *monotone(np.array(x[0] + x[1]), np.repeat([0.0, 1.0], [len(x[0]), len(x[1])]), weight))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; an input column of that name is replaced."""
    rest = docs.drop(column)
    names = rest.columns
    schema = rest.select(*[F.col(f"`{c}`") for c in names]).schema.add(column, "double")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            scores = pa.array([scorer.score(t or "") for t in b.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*names, column])

    return rest.mapInArrow(rows, schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))

"""Cases that the first tests of some operators leave out."""

import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, chat_format, quality_classifier, url_filters


def test_every_digest_of_encoding_is_the_library_s(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_padding()
    lib.no_truncation()
    texts = ["don't 'S <|startoftext|>Hi<|endoftext|>", "", None, " \n", "aaa aaaa", "ΣΑΣ İß ﬁ １２ ½", "a\x1cb é ́x", "日本語 🎉🎉", "word " * 3000, "aaa aaaa"]
    got = {r["doc_id"]: r for r in bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bpe.default_path()).collect()}
    for k, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_rules_of_equal_length_and_without_host_or_path(spark):
    pages = spark.createDataFrame([(1, "http://ab.c/x/y"), (2, "http://q.c/"), (3, None)], "page_id bigint, url string")
    rules = [("ab.c", "/x/", "allow"), ("ab.c", "/x/", "block"), (None, "/x/", "block"), ("", "/", "block"), ("q.c", None, "block")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    # of equal rules the one that blocks decides; a rule without a host fits nothing, one without a path all of its host
    assert got == {1: ("ab.c/x/", "block"), 2: ("q.c", "block"), 3: (None, "allow")}


def test_a_message_of_many_deltas_takes_linear_time(spark):
    took = []
    for n in (4_000, 32_000):
        log = spark.range(n).select(F.lit(1).alias("conv_id"), F.lit(1).alias("msg"), F.col("id").cast("int").alias("seq"), F.lit("delta").alias("kind"), F.lit("user").alias("role"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")).alias("text"))
        began = time.time()
        row = chat_format.read_back(chat_format.render(chat_format.fold(log))).first()
        took.append(time.time() - began)
        assert row["turns"][0][1] == "".join(f"w{k} " for k in range(n))
    assert took[1] < 8 * took[0] + 10


def test_labels_that_disagree_or_are_null(spark):
    docs = spark.createDataFrame([(k, ("good prose about rivers and stones " if k % 2 else "$$$ click %% buy ### now ") * 8) for k in range(120)], "doc_id bigint, text string")
    labels = [(k, k % 2) for k in range(120)] + [(k, 1 - k % 2) for k in range(0, 120, 17)] + [(k, None) for k in range(0, 120, 11)] + [(None, 1), (999, 0)]
    model = quality_classifier.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    assert all(0 <= x <= 1 for x in got.values()) and min(v for k, v in got.items() if k % 2) > max(v for k, v in got.items() if k % 2 == 0)

"""Near-duplicates among very many documents that share most of their text, but less than the threshold."""

import itertools
import time

from pyspark.sql import functions as F

from ledgerlens.llm import near_dedup


def test_late_members_never_reach_the_threshold():
    reach = lambda n_a, p_a, n_b, p_b: 175 * min(n_a - p_a, n_b - p_b) >= 75 * (n_a + n_b)
    late = [(n, p) for n in range(1, 60) for p in range(n // 4 + 1) if not 175 * p <= 25 * n]
    assert late and not any(reach(*a, *b) for a, b in itertools.product(late, repeat=2))


def test_shared_boilerplate_stays_linear(spark):
    """Each document has 16 words of its own and 88 that all have: 84 of its 100 shingles are everyone's, so no two are linked."""
    shared = " ".join(f"shared{k}" for k in range(88))
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.concat(F.lit("own"), F.col("id").cast("string"), F.lit("x"), k.cast("string"))), " ")
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(own, F.lit(" "), F.lit(shared)).alias("text"))
    pair = docs.filter("doc_id < 2").select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text"))
    began = time.time()
    got = near_dedup.deduplicate(docs.unionByName(pair)).agg(F.count("*"), F.count_if("kept"), F.sum("n_shingles")).first()
    assert got[:] == (50_002, 50_000, 50_000 * 100 + 202)
    assert time.time() - began < 240

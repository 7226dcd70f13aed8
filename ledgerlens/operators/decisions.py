"""The owner's decisions as a log of JSON lines: read with bad lines set aside, the last word for each subject, put over proposals and matches.

A line is about one transaction ({"txn": key}) or one match ({"debit": key,
"credit": key}), has a ``decision`` (confirm, reject, reclassify), for the last
a ``category``, and may tell in ``saw`` what had been proposed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "txn bigint, debit bigint, credit bigint, decision string, category string, saw string, bad string"
KINDS = ("confirm", "reject", "reclassify")


def read_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, broken): lines (seq, line) as seq, txn, debit, credit, decision, category, saw, and those that say nothing usable with a reason. Blank lines are neither."""
    read = lines.filter(F.trim("line") != "").select("seq", "line", F.from_json("line", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("d")).select("seq", "line", "d.*")
    match, one = F.col("debit").isNotNull() & F.col("credit").isNotNull(), F.col("txn").isNotNull()
    half = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    reason = (
        F.when(F.col("bad").isNotNull(), "not a line of JSON").when(~one & ~match, "about nothing").when(one & half, "about a transaction and a match")
        .when(~F.coalesce(F.col("decision").isin(*KINDS), F.lit(False)), "unknown decision").when((F.col("decision") == "reclassify") & (match | F.col("category").isNull()), "a new category is for a transaction, and has to be told")
    )
    told = read.withColumn("reason", reason)
    return told.filter("reason IS NULL").drop("line", "bad", "reason"), told.filter("reason IS NOT NULL").select("seq", "line", "reason")


def last_words(decisions: DataFrame) -> DataFrame:
    """The decisions that no later one about the same subject replaces; of equal numbers the one whose text sorts last."""
    rest = [c for c in decisions.columns if c not in ("txn", "debit", "credit")]
    last = decisions.groupBy("txn", "debit", "credit").agg(F.max(F.struct("seq", *[c for c in rest if c != "seq"])).alias("d"))
    return last.select("txn", "debit", "credit", "d.*")


def apply(proposals: DataFrame, matches: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions, matches, stale): what was proposed, with the last decisions over it.

    proposals: key, category, outcome. matches: debit_key, credit_key, status. A
    confirmed row keeps its category, a rejected one loses it, both are told in
    outcome or status. stale: seq, txn, debit, credit, reason of decisions about
    what is no longer there, or was something else when it was seen; the latter
    hold all the same.
    """
    final = last_words(decisions)
    of_txn = final.filter("txn IS NOT NULL").select("seq", F.col("txn").alias("key"), "decision", F.col("category").alias("new"), "saw")
    both = proposals.join(of_txn, "key", "left")
    category = F.when(F.col("decision") == "reclassify", F.col("new")).when(F.col("decision") == "reject", F.lit(None)).otherwise(F.col("category"))
    outcome = F.when(F.col("decision") == "reject", "rejected").when(F.col("decision").isNotNull(), "decided").otherwise(F.col("outcome"))
    txns = both.select("key", category.alias("category"), outcome.alias("outcome"))
    of_match = final.filter("txn IS NULL").select("seq", F.col("debit").alias("debit_key"), F.col("credit").alias("credit_key"), "decision", "saw")
    pairs = matches.join(of_match, ["debit_key", "credit_key"], "left")
    told = pairs.select("debit_key", "credit_key", F.when(F.col("decision") == "confirm", "confirmed").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status")).alias("status"))
    none = F.lit(None).cast("bigint")
    gone, changed = F.lit("not there any more").alias("reason"), F.lit("it was something else when it was seen").alias("reason")
    stale = of_txn.join(proposals, "key", "left_anti").select("seq", F.col("key").alias("txn"), none.alias("debit"), none.alias("credit"), gone)
    stale = stale.unionByName(both.filter("saw <> category").select("seq", F.col("key").alias("txn"), none.alias("debit"), none.alias("credit"), changed))
    stale = stale.unionByName(of_match.join(matches, ["debit_key", "credit_key"], "left_anti").select("seq", none.alias("txn"), F.col("debit_key").alias("debit"), F.col("credit_key").alias("credit"), gone))
    stale = stale.unionByName(pairs.filter("saw <> status").select("seq", none.alias("txn"), F.col("debit_key").alias("debit"), F.col("credit_key").alias("credit"), changed))
    return txns, told, stale

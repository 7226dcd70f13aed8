"""Pairs within one account: reversals, profit and tax, exports and tax; and greedy one-to-one matching of any candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import graph
from ledgerlens.operators.stored import written


def near(left: DataFrame, right: DataFrame, on: list[str], days: int, extra: Column) -> DataFrame:
    """left (l_*) and right (r_*) rows with equal ``on`` whose dates lie within ``days``: each left row asks three day buckets."""
    day = lambda c: F.unix_date(F.col(c))
    width = max(1, days)
    a = left.withColumn("bucket", F.explode(F.array(*[F.floor(day("l_date") / width).cast("bigint") + k for k in (-1, 0, 1)])))
    b = right.withColumn("bucket", F.floor(day("r_date") / width).cast("bigint"))
    cond = (a["bucket"] == b["bucket"]) & extra
    for c in on:
        cond = cond & (F.col(f"l_{c}") == F.col(f"r_{c}"))
    return a.join(b, cond).filter(F.abs(F.datediff("r_date", "l_date")) <= days)


def side(txns: DataFrame, prefix: str, *more: str) -> DataFrame:
    return txns.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("account_id", "key", "date", "amount", *more)])


def by_parts(candidates: DataFrame, left: str, right: str) -> DataFrame:
    """``candidates`` with ``part``: candidates that share a left or a right, directly or by others, have the same."""
    name = lambda c, s: F.concat(F.lit(s), F.col(c).cast("string"))
    found = graph.parts(candidates.select(name(left, "l").alias("a"), name(right, "r").alias("b")))
    return candidates.withColumn("node", name(left, "l")).join(found, "node").drop("node")


def _free(left: str, right: str):
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of parts: those whose left and right are both still free."""
        part, taken = None, (set(), set())
        for batch in batches:
            keep = []
            for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", left, right)), strict=True):
                if p != part:
                    part, taken = p, (set(), set())
                keep.append(a not in taken[0] and b not in taken[1])
                if keep[-1]:
                    taken[0].add(a)
                    taken[1].add(b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return passed


def greedy(candidates: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """The candidates that one pass over all, sorted by ``order``, takes if it takes each whose left and right are still free.

    Parts of the candidates' graph don't touch each other, so tasks settle them
    side by side. A task streams its rows and holds the keys that the part at
    hand has matched.
    """
    told = by_parts(written(candidates), left, right)
    return told.repartition("part").sortWithinPartitions("part", *order).mapInArrow(_free(left, right), told.schema).select(*candidates.columns)


def reversals(txns: DataFrame, days: int = 30) -> DataFrame:
    """key, original: each credit takes back the nearest earlier debit of its account and size that no credit before it has taken; pairs more than ``days`` apart don't count.

    Debits and credits of one size are opening and closing brackets in printed
    order: a running count tells how many debits are open, and a credit closes
    the last debit of its level. A debit that is too old for a credit is too old
    for all later ones, so closing it costs nothing. Two sorts, no join: equal
    amounts cost no more than others.
    """
    step = F.when(F.col("amount") < 0, 1).otherwise(-1)
    rows = txns.filter("amount <> 0").select("account_id", "key", "date", "amount", F.abs("amount").alias("size"), step.alias("step"))
    printed = Window.partitionBy("account_id", "size").orderBy("date", "key")
    so_far = printed.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.sum("step").over(so_far)).withColumn("low", F.least(F.lit(0), F.min("open").over(so_far)))
    rows = rows.withColumn("low_before", F.coalesce(F.lag("low").over(printed), F.lit(0)))
    level = F.when(F.col("amount") < 0, F.col("open") - F.col("low")).when(F.col("open") >= F.col("low_before"), F.col("open") - F.col("low") + 1)
    rows = rows.withColumn("level", level).filter("level IS NOT NULL")
    here = Window.partitionBy("account_id", "size", "level").orderBy("date", "key")
    rows = rows.withColumn("original", F.lag("key").over(here)).withColumn("was", F.lag("date").over(here))
    return rows.filter((F.col("amount") > 0) & (F.datediff("date", "was") <= days)).select("key", "original")


def nearest_pairs(left: DataFrame, right: DataFrame, days: int, far: Column) -> DataFrame:
    """l_key, r_key, far: rows of one account within ``days``, the nearest by ``far`` first (over l_* and r_* columns; ties by key), until nothing is left to pair.

    Null distances don't pair.
    """
    found = near(side(left, "l"), side(right, "r"), ["account_id"], days, F.lit(True)).withColumn("far", far).filter("far IS NOT NULL")
    return greedy(found.select("l_key", "r_key", "far"), "l_key", "r_key", ["far", "l_key", "r_key"])


def profit_tax(profits: DataFrame, taxes: DataFrame, days: int = 5, percent: int = 20, tolerance: float = 0.02) -> DataFrame:
    """profit_key, tax_key, status: each profit with the tax debit that is nearest to its rate; ``warn`` where the rate is off, ``unpaired`` where one side is alone."""
    far = F.abs(-F.col("r_amount") * 100 - percent * F.col("l_amount"))
    pairs = written(nearest_pairs(profits, taxes, days, far))
    off = F.col("far") > F.lit(tolerance) * 100 * F.col("gross")
    paired = pairs.join(profits.select(F.col("key").alias("l_key"), F.col("amount").alias("gross")), "l_key").select(F.col("l_key").alias("profit_key"), F.col("r_key").alias("tax_key"), F.when(off, "warn").otherwise("ok").alias("status"))
    alone = lambda rows, c: rows.select(F.col("key").alias(c)).join(paired.select(c), c, "left_anti")
    none = F.lit(None).cast("bigint")
    lone_profit = alone(profits, "profit_key").select("profit_key", none.alias("tax_key"), F.lit("unpaired").alias("status"))
    lone_tax = alone(taxes, "tax_key").select(none.alias("profit_key"), "tax_key", F.lit("unpaired").alias("status"))
    return paired.unionByName(lone_profit).unionByName(lone_tax)


def export_tax(exports: DataFrame, debits: DataFrame, days: int = 3, tolerance: int = 100) -> DataFrame:
    """export_key, tax_key, deducted, expected, shortfall: the debit within tolerance of 1 % of an export credit, else of 0.25 %; without one nothing was deducted."""
    size = -F.col("r_amount")
    one, quarter = F.abs(size * 100 - F.col("l_amount")), F.abs(size * 400 - F.col("l_amount"))
    far = F.when(one <= 100 * tolerance, one * 4).when(quarter <= 400 * tolerance, quarter + 1600 * tolerance)
    pairs = nearest_pairs(exports, debits, days, far)
    tax = debits.select(F.col("key").alias("r_key"), (-F.col("amount")).alias("deducted"))
    expected = F.expr("amount div 100")
    out = exports.join(pairs.join(tax, "r_key"), exports["key"] == pairs["l_key"], "left").withColumn("deducted", F.coalesce("deducted", F.lit(0)))
    return out.select(F.col("key").alias("export_key"), F.col("r_key").alias("tax_key"), "deducted", expected.alias("expected"), F.greatest(expected - F.col("deducted"), F.lit(0)).alias("shortfall"))

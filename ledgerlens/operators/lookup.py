"""Texts and what may be found in them, brought together by runs of three letters instead of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import money

GRAM = 3


def grams(text: Column) -> Column:
    """The distinct runs of GRAM letters of a text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda k: F.substring(text, k, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def asked(texts: DataFrame, text: Column, needs: DataFrame | None = None) -> DataFrame:
    """``texts`` with a row for each of its ``gram``s, and one with an empty one.

    needs: rows with ``needs``, few enough for one array. Then only their grams are looked for in a text, which takes
    far less work than to cut it into all of its own.
    """
    if needs is None:
        return texts.withColumn("gram", F.explode(F.concat(F.array(F.lit("")), grams(text))))
    few = needs.select(F.explode("needs").alias("g")).agg(F.collect_set("g").alias("few"))
    found = money.bind(text, lambda t: F.filter("few", lambda g: F.contains(t, g)))
    return texts.crossJoin(F.broadcast(few)).withColumn("gram", F.explode(F.concat(F.array(F.lit("")), found))).drop("few")


def by_rarest(wanted: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """``wanted`` (rows with a ``key`` of their own, and ``needs``: grams that a text must have) with ``gram``: the one that the fewest of ``texts`` (rows of ``asked``) have.

    A row that needs nothing has the empty gram, which every text has.
    """
    pairs = wanted.select(*key, F.explode("needs").alias("gram"))
    # distinct runs of three letters: a small table however many rows want them, so texts' runs are counted where they are
    seen = texts.join(F.broadcast(pairs.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    best = pairs.join(seen, "gram", "left").groupBy(*key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select(*key, "r.gram")
    return wanted.drop("needs").join(best, key, "left").withColumn("gram", F.coalesce("gram", F.lit("")))

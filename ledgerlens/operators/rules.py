"""Classification by a table of rules: shared and personal ones, categories with directions, looked up by three letters before any pattern is tried.

RULES: a row for each pattern of a rule. A rule applies to the rows of its
direction, banks and sizes (minor units) in whose description its pattern is
found, whatever the case.
"""

from __future__ import annotations

import re
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlens.operators import lookup
from ledgerlens.operators.profiles import compiles

RULES = "id string, category string, direction string, pattern string, institutions array<string>, least bigint, most bigint, disabled boolean"
CATEGORIES = "category string, grp string, direction string"
DIRECTIONS = ("any", "credit", "debit")
# The categories and which way their money goes.
DEFAULT_CATEGORIES = (
    ("export_proceeds_154A", "income", "credit"), ("profit_on_debt", "income", "credit"), ("tax_154A_deducted", "tax", "debit"), ("wht_151", "tax", "debit"), ("wht_236Y", "tax", "debit"), ("wht_231AB", "tax", "debit"),
    ("personal_remittance", "not_income", "credit"), ("salary_net", "not_income", "credit"), ("reversal_refund", "not_income", "any"), ("internal_transfer", "not_income", "any"), ("own_transfer_unmatched", "not_income", "any"),
    ("zakat", "not_tax", "debit"), ("indirect_tax_charges", "not_tax", "debit"), ("other_debit", "other", "debit"), ("other_credit", "other", "credit"), ("unclassified_credit", "other", "credit"),
)


def layered(shared: DataFrame, personal: DataFrame) -> DataFrame:
    """One table of rules: personal ones are added, and what they disable by id is left out; a personal rule of a shared one's id takes its place."""
    own = personal.select("id").distinct()
    return shared.join(own, "id", "left_anti").unionByName(personal).filter(~F.coalesce("disabled", F.lit(False)))


def problems(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, problem): what makes a rule unusable; a good one has no row."""
    both = rules.join(categories.select("category", F.col("direction").alias("goes")), "category", "left")
    found = [
        (F.col("goes").isNull(), "unknown category"),
        (~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)), "unknown direction"),
        ((F.col("goes") != "any") & (F.col("direction") != F.col("goes")), "the category's money goes the other way"),
        (~F.coalesce(compiles(F.col("pattern")), F.lit(False)), "the pattern can't be read"),
        (F.col("most") < F.col("least"), "most lies below least"),
    ]
    own = both.select("id", F.explode(F.filter(F.array(*[F.when(bad, said) for bad, said in found]), lambda x: x.isNotNull())).alias("problem"))
    twice = rules.groupBy("id").agg(F.countDistinct("category").alias("n")).filter("n > 1").select("id", F.lit("the id is used for several categories").alias("problem"))
    return own.unionByName(twice).distinct()


def required(pattern: str) -> str:
    """The longest run of ASCII letters, digits and spaces that every text which a pattern finds has to hold, in small letters; empty if none is sure."""
    try:
        steps = parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):  # another dialect's pattern is looked up by nothing
        return ""
    best = run = ""
    for step, value in steps:
        if step is parser.LITERAL and re.fullmatch("[A-Za-z0-9 ]", chr(value)):
            run += chr(value)
            best = max(best, run, key=len)
        elif step is not parser.AT:  # anchors stand between letters
            run = ""
    return best.lower()


@F.pandas_udf(StringType())
def _required(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: required(p or ""))


def hits(descriptions: DataFrame, rules: DataFrame) -> DataFrame:
    """(description, id, category, direction, institutions, least, most) of distinct descriptions and the rules whose pattern they hold.

    A description meets only rules whose rarest three letters it has; rules
    without sure letters meet all.
    """
    asked = lookup.asked(descriptions.select("description"), F.lower("description"))
    keyed = lookup.by_rarest(rules.withColumn("letters", _required("pattern")).withColumn("needs", lookup.grams(F.col("letters"))).drop("letters"), asked, ["id", "pattern"])
    met = asked.join(keyed, "gram").filter(F.regexp_like("description", F.concat(F.lit("(?i)"), F.col("pattern"))))
    return met.select("description", "id", "category", "direction", "institutions", "least", "most").distinct()


def classify(txns: DataFrame, rules: DataFrame, review_from: int) -> DataFrame:
    """txns (key, description, amount, institution) with n_hits (categories found), rule_ids, category and outcome.

    One category is proposed; several are a conflict without a category; none
    gives other_debit, other_credit or (from ``review_from`` on)
    unclassified_credit. Every rule is tried on every distinct description once.
    """
    met = hits(txns.select("description").filter("description IS NOT NULL").distinct(), rules)
    size, way = F.abs("amount"), F.when(F.col("amount") < 0, "debit").when(F.col("amount") > 0, "credit")
    # the rules that one description meets are few
    by_text = met.groupBy("description").agg(F.collect_list(F.struct("id", "category", "direction", "institutions", "least", "most")).alias("rules_met"))
    out = txns.join(by_text, "description", "left")

    def fits(r: Column) -> Column:
        ok = (r["direction"] == "any") | F.coalesce(r["direction"] == way, F.lit(False))
        ok = ok & F.coalesce(size >= r["least"], F.lit(True)) & F.coalesce(size <= r["most"], F.lit(True))
        return ok & (r["institutions"].isNull() | (F.size(r["institutions"]) == 0) | F.coalesce(F.array_contains(r["institutions"], F.col("institution")), F.lit(False)))

    some = F.filter(F.coalesce("rules_met", F.array().cast(by_text.schema["rules_met"].dataType)), fits)
    out = out.withColumn("fit", some).withColumn("rule_ids", F.array_sort(F.array_distinct(F.transform("fit", lambda r: r["id"])))).withColumn("cats", F.array_distinct(F.transform("fit", lambda r: r["category"])))
    out = out.withColumn("n_hits", F.size("cats").cast("bigint"))
    none = F.when(F.col("amount") < 0, "other_debit").when(F.col("amount") >= review_from, "unclassified_credit").otherwise("other_credit")
    out = out.withColumn("category", F.when(F.col("n_hits") == 1, F.get("cats", F.lit(0))).when(F.col("n_hits") == 0, none))
    return out.withColumn("outcome", F.when(F.col("n_hits") == 1, "proposed").when(F.col("n_hits") > 1, "conflict").otherwise("default")).drop("fit", "cats", "rules_met")

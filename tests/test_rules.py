"""Rules as a table against brute force: layers, directions, banks, sizes, patterns of any kind, bad rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import rules


def rule(name, category, pattern, direction="any", banks=None, least=None, most=None, disabled=False):
    return (name, category, direction, pattern, banks, least, most, disabled)


@pytest.mark.parametrize(
    ("pattern", "letters"),
    [(r"\bPayoneer\b", "payoneer"), ("Inward Foreign Remittance", "inward foreign remittance"), (r"\bCharges?\b", "charge"), ("Excise|Sales Tax", ""), (r"\b(PST|SST)\b", ""), (r"WHT COLL.*151", "wht coll"), ("^Remittance From\\b", "remittance from"), ("PROFIT-LOSS", "profit"), ("a{0,3}bcd", "bcd"), ("(unclosed", ""), ("", ""), (r"\d+x[yz]", "x"), ("(?i)Ab", "ab"), (r"ab\.cde", "cde"), ("abc(def)?gh", "abc"), (r"\Qa\E", "")],
)
def test_letters_that_a_text_must_hold(pattern, letters):
    assert rules.required(pattern) == letters


def test_same_as_all_rules_on_all_rows(spark):
    r = random.Random(4)
    words = ["Fee", "coffee", "PROFIT", "x", "Straße", "tax 151", "refund", "a.b", "Zakat", "charge"]
    patterns = ["fee", r"\bfee\b", "profit|refund", "^x", "tax.*151", r"a\.b", "[cz]", "zakat$", "charges?", "x{2}", "aß"]
    table = [rule(f"r{k}", r.choice(["zakat", "salary_net", "reversal_refund"]), r.choice(patterns), r.choice(["any", "debit", "credit"]), r.choice([None, None, [], ["b1"], ["b1", "b2"]]), r.choice([None, None, 50]), r.choice([None, None, 80])) for k in range(60)]
    rows = [(k, r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randrange(1, 4)))]), r.choice([-1, 1]) * r.randrange(0, 120), r.choice(["b1", "b2", "b3", None])) for k in range(300)]
    want = {}
    for key, text, amount, bank in rows:
        fit = [x for x in table if text is not None and re.search(x[3], text, re.I) and (x[2] == "any" or (amount < 0 and x[2] == "debit") or (amount > 0 and x[2] == "credit")) and (not x[4] or bank in x[4]) and (x[5] is None or abs(amount) >= x[5]) and (x[6] is None or abs(amount) <= x[6])]
        cats = {x[1] for x in fit}
        none = "other_debit" if amount < 0 else "unclassified_credit" if amount >= 100 else "other_credit"
        want[key] = (len(cats), sorted(x[0] for x in fit), cats.pop() if len(cats) == 1 else None if cats else none)
    got = rules.classify(spark.createDataFrame(rows, "key int, description string, amount bigint, institution string"), spark.createDataFrame(table, rules.RULES), 100)
    assert {x["key"]: (x["n_hits"], x["rule_ids"], x["category"]) for x in got.collect()} == want and len({w[0] for w in want.values()}) >= 3


def test_personal_rules_add_disable_and_replace(spark):
    shared = spark.createDataFrame([rule("a", "zakat", "x"), rule("b", "zakat", "y"), rule("c", "zakat", "z")], rules.RULES)
    personal = spark.createDataFrame([rule("b", "zakat", "y", disabled=True), rule("c", "zakat", "w"), rule("mine", "salary_net", "v")], rules.RULES)
    assert sorted((x["id"], x["pattern"]) for x in rules.layered(shared, personal).collect()) == [("a", "x"), ("c", "w"), ("mine", "v")]


def test_bad_rules_are_told(spark):
    table = [rule("ok", "zakat", "x", "debit"), rule("cat", "nope", "x"), rule("way", "zakat", "x", "credit"), rule("dir", "reversal_refund", "x", "sideways"), rule("re", "zakat", "(x", "debit"), rule("size", "zakat", "x", "debit", None, 5, 4), rule("two", "zakat", "x", "debit"), rule("two", "wht_151", "y", "debit")]
    got = rules.problems(spark.createDataFrame(table, rules.RULES), spark.createDataFrame(rules.DEFAULT_CATEGORIES, rules.CATEGORIES))
    assert {(x["id"], x["problem"]) for x in got.collect()} == {("cat", "unknown category"), ("way", "the category's money goes the other way"), ("dir", "unknown direction"), ("re", "the pattern can't be read"), ("size", "most lies below least"), ("two", "the id is used for several categories")}


def test_many_rules_meet_few_rows(spark):
    many = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("zakat").alias("category"), F.lit("any").alias("direction"), F.concat(F.lit("\\bword"), F.col("id").cast("string"), F.lit("\\b")).alias("pattern"), F.lit(None).cast("array<string>").alias("institutions"), F.lit(None).cast("bigint").alias("least"), F.lit(None).cast("bigint").alias("most"), F.lit(False).alias("disabled"))
    rows = spark.range(3000).select(F.col("id").alias("key"), F.concat(F.lit("paid WORD"), (F.col("id") % 2500).cast("string")).alias("description"), F.lit(-5).alias("amount"), F.lit("b").alias("institution"))
    got = rules.classify(rows, many, 100)
    assert got.filter("n_hits = 1").count() == 2000 + 500 and got.filter("n_hits > 1").count() == 0


def test_no_rules_and_no_rows(spark):
    none = spark.createDataFrame([], rules.RULES)
    rows = spark.createDataFrame([(1, "x", -5, None), (2, "x", 500, None)], "key int, description string, amount bigint, institution string")
    assert [x["category"] for x in rules.classify(rows, none, 100).orderBy("key").collect()] == ["other_debit", "unclassified_credit"]
    assert rules.classify(rows.filter("false"), none, 100).count() == 0

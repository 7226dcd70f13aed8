"""Pairs and transfers against brute force: probes of lost pairs, chains, ties, equal amounts, owners, long hints."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import graph, matching, pairing

TXNS = "account_id string, key bigint, date date, amount bigint"


def day(n):
    return date(2025, 7, 1) + timedelta(n)


def one_pass(rows, order):
    used, out = (set(), set()), set()
    for r in sorted(rows, key=order):
        if r[0] not in used[0] and r[1] not in used[1]:
            used[0].add(r[0])
            used[1].add(r[1])
            out.add(r)
    return out


def test_two_debits_and_two_credits_are_two_reversals(spark):
    rows = [("a", 1, day(1), -500), ("a", 2, day(2), -500), ("a", 3, day(3), 500), ("a", 4, day(4), 500)]
    assert {tuple(r) for r in pairing.reversals(spark.createDataFrame(rows, TXNS)).collect()} == {(3, 2), (4, 1)}


def test_reversals_take_the_last_open_debit(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), k, day(r.randrange(120)), r.choice([-5, 5, -7, 7, 0])) for k in range(400)]
    want = set()
    for account in "ab":
        for size in (5, 7):
            free = []
            for _, key, when, amount in sorted((x for x in rows if x[0] == account and abs(x[3]) == size), key=lambda x: (x[2], x[1])):
                if amount < 0:
                    free.append((key, when))
                elif free:
                    debit, was = free.pop()
                    if (when - was).days <= 30:
                        want.add((key, debit))
    assert {tuple(x) for x in pairing.reversals(spark.createDataFrame(rows, TXNS)).collect()} == want and len(want) > 50


def test_equal_amounts_of_one_account_stay_linear(spark):
    rows = spark.range(100_000).select(F.lit("a").alias("account_id"), F.col("id").alias("key"), F.lit("2025-07-01").cast("date").alias("date"), F.when(F.col("id") < 50_000, -500).otherwise(500).alias("amount"))
    assert pairing.reversals(rows).select(F.count("*"), F.countDistinct("original")).first()[:] == (50_000, 50_000)


def test_all_profits_find_a_tax(spark):
    profits = spark.createDataFrame([("a", 1, day(1), 1000), ("a", 2, day(1), 1000)], TXNS)
    taxes = spark.createDataFrame([("a", 11, day(1), -200), ("a", 12, day(1), -201)], TXNS)
    assert {tuple(r) for r in pairing.profit_tax(profits, taxes).collect()} == {(1, 11, "ok"), (2, 12, "ok")}


def test_export_tax_pairs_to_the_end(spark):
    exports = spark.createDataFrame([("a", k, day(0), 100_000) for k in range(4)], TXNS)
    debits = spark.createDataFrame([("a", 10 + k, day(k), -1000 - k) for k in range(3)] + [("a", 19, day(1), -252)], TXNS)
    got = {r["export_key"]: (r["tax_key"], r["deducted"], r["shortfall"]) for r in pairing.export_tax(exports, debits).collect()}
    assert got == {0: (10, 1000, 0), 1: (11, 1001, 0), 2: (12, 1002, 0), 3: (19, 252, 748)}


@pytest.mark.parametrize("kind", ["random", "chain", "ties"])
def test_greedy_is_one_sorted_pass(spark, kind):
    r = random.Random(3)
    if kind == "random":
        rows = [(r.randrange(300), r.randrange(300), r.randrange(5), 0) for _ in range(700)]
    elif kind == "chain":  # each settles the next
        rows = [((k + 1) // 2, k // 2, k, 0) for k in range(1000)]
    else:
        rows = [(a, b, 1, 0) for a in range(32) for b in range(32)]
    rows = list({(a, b): (a, b, fee, gap) for a, b, fee, gap in rows}.values())
    df = spark.createDataFrame(rows, "debit_key bigint, credit_key bigint, fee bigint, gap bigint")
    assert {tuple(x) for x in matching.match_one_to_one(df).collect()} == one_pass(rows, lambda x: (x[2], x[3], x[0], x[1]))


def test_parts_of_a_graph(spark):
    edges = [(k, k + 1) for k in range(0, 700)] + [(1000, 1000 + k) for k in range(1, 300)] + [(2000, 2000), (3000, 3001), (3001, 3000)]
    got = dict(map(tuple, graph.parts(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**dict.fromkeys(range(701), 0), **dict.fromkeys(range(1000, 1300), 1000), 2000: 2000, 3000: 3000, 3001: 3000}
    assert graph.parts(spark.createDataFrame([], "a string, b string")).count() == 0


def test_transfers_stay_inside_one_owner(spark):
    rows = [(f"{o}-{side}", 10 * o + side, day(o % 2), -1000 if side == 0 else 1000) for o in range(300) for side in (0, 1)]
    txns = spark.createDataFrame(rows, TXNS)
    accounts = spark.createDataFrame([(f"{o}-{side}", f"owner {o}") for o in range(300) for side in (0, 1)], "account_id string, owner string")
    found = {(r["debit_key"], r["credit_key"]) for r in matching.transfers(txns, accounts).collect()}
    assert found == {(10 * o, 10 * o + 1) for o in range(300)}
    taxed = txns.withColumn("category", F.when(F.col("key") == 0, "tax_on_cards"))
    assert matching.transfers(taxed, accounts).filter("debit_key = 0").count() == 0
    # an account that is in no registry takes part in nothing
    assert matching.transfers(txns, accounts.filter("account_id <> '5-1'")).filter("debit_key = 50").count() == 0


@pytest.mark.parametrize("days", [0, 3])
def test_transfer_windows_and_fees(spark, days):
    r = random.Random(8)
    rows = [(r.choice("abc"), k, day(r.randrange(40)), r.choice([-1, 1]) * r.choice([99_990, 100_000, 100_005, 100_010, 250_000])) for k in range(200)]
    want = {(a[1], b[1], -a[3] - b[3], abs((a[2] - b[2]).days)) for a in rows for b in rows if a[3] < 0 < b[3] and a[0] != b[0] and abs((a[2] - b[2]).days) <= days and 0 <= -a[3] - b[3] <= 15}
    assert {tuple(x) for x in matching.transfers(spark.createDataFrame(rows, TXNS), days=days, fee=15).collect()} == want and want


def test_hints_of_any_number_of_words(spark):
    texts = spark.createDataFrame([(1, "Paid to Alpha beta-gamma delta epsilon LTD"), (2, "alphabet gamma"), (3, None), (4, "Straße 5")], "key bigint, text string")
    names = spark.createDataFrame([("four", "alpha beta gamma delta"), ("five", "ALPHA BETA GAMMA DELTA EPSILON"), ("one", "beta"), ("none", "-"), ("no", "alpha delta"), ("far", "strasse 5")], "account_id string, hint string")
    assert {tuple(r) for r in matching.named_in(texts, names).collect()} == {(1, "four"), (1, "five"), (1, "one"), (4, "far")}
    assert matching.named_in(texts, names.filter("false")).count() == 0


def test_tiers_look_for_the_other_account_only(spark):
    txns = spark.createDataFrame([("a", 1, "to beta savings of many words, thanks"), ("b", 2, "x"), ("c", 3, "from A One"), ("z", 4, None)], "account_id string, key bigint, description string")
    accounts = spark.createDataFrame([("a", ["a one"], "Ann", "Bank A"), ("b", ["beta savings of many words"], "Ann", "Bank B"), ("c", None, None, None)], "account_id string, hints array<string>, owner string, institution string")
    candidates = spark.createDataFrame([(1, 2, 0, 1), (1, 3, 0, 1), (1, 4, 0, 0), (1, 2, 5, 1)], "debit_key bigint, credit_key bigint, fee bigint, gap bigint")
    got = {(r["credit_key"], r["fee"]): (r["signals"], r["tier"]) for r in matching.tiers(candidates, txns, accounts).collect()}
    assert got == {(2, 0): (1, "strong"), (3, 0): (1, "strong"), (4, 0): (0, "possible"), (2, 5): (1, "possible")}

"""Views of checks, vocabularies of several files, masked dumps, account checks, signs from balances, samples of pages."""

from datetime import date

from pyspark.sql import functions as F

from ledgerlens.operators import checks, layout, masking, merge, pages, profiles
from ledgerlens.sources import statements


def test_failed_and_warned(spark):
    df = spark.createDataFrame([("a", "fail"), ("b", "warn"), ("c", "pass"), ("d", None)], "doc_id string, status string")
    assert [r[0] for r in checks.failed(df).collect()] == ["a"] and [r[0] for r in checks.warned(df).collect()] == ["b"]


def test_vocabularies_are_united(spark):
    one, two = (spark.createDataFrame([(x,) for x in w], "value string") for w in (["# words", "Date", "Büro"], ["date", "", "Cr."]))
    assert sorted(r[0] for r in masking.allowlists(one, two).collect()) == ["BÜRO", "CR", "DATE"]


def test_masked_dump(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 2, "Paid 12.50 to Ann"), ("d1", 1, "Date x"), ("d2", 1, None)], "doc_id string, row_no int, raw string").repartition(3)
    masking.dump(rows, str(tmp_path / "out"), F.array(F.lit("DATE"), F.lit("PAID")))
    got = spark.read.text(str(tmp_path / "out"))
    assert [r["value"] for r in got.filter("doc_id = 'd1'").collect()] == ["Date x", "Paid 99.99 xx Xxx"]


def test_signs_from_balances(spark):
    rows = [("d", 1, 5, 105), ("d", 2, 3, 102), ("d", 3, 4, 110), ("d", 4, 0, 110), ("d", 5, 1, None), ("e", 1, 7, 7)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, amount bigint, balance_after bigint").withColumn("opening", F.lit(100))
    got = {(r["doc_id"], r["pos"]): (r["amount"], r["sign_source"], r["warning"]) for r in checks.signs_from_balance(df).collect()}
    odd = "the balance does not move by the amount"
    assert got == {("d", 1): (None, None, "no balance before it"), ("d", 2): (-3, "balance", None), ("d", 3): (None, None, odd), ("d", 4): (0, "balance", None), ("d", 5): (None, None, "no balance before it"), ("e", 1): (None, None, "no balance before it")}
    assert {r["doc_id"]: r["amount"] for r in checks.signs_from_balance(df, opening="opening").filter("pos = 1").collect()} == {"d": 5, "e": None}


def test_account_checks_tell_what_they_compared(spark):
    docs = [("a", "s1", date(2025, 7, 1), date(2025, 9, 30), 100, 5000), ("a", "s2", date(2025, 10, 1), date(2025, 12, 31), 5100, 6000), ("a", "s3", date(2026, 1, 1), date(2026, 3, 31), None, 7000), ("b", "t1", None, None, None, None)]
    d = spark.createDataFrame(docs, "account_id string, doc_id string, doc_start date, doc_end date, s_opening bigint, s_closing bigint")
    overlaps = spark.createDataFrame([("s2", "a", date(2025, 9, 1), date(2025, 9, 30), 2, 1, "fail")], "doc_id string, account_id string, lo date, hi date, existing bigint, incoming bigint, status string")
    books = spark.createDataFrame([("a", 100, "printed", "printed", 90), ("b", None, "unknown", "unknown", None)], "account_id string, opening bigint, opening_source string, closing_source string, prior_closing bigint")
    accounts = spark.createDataFrame([("a", None, date(2026, 5, 31)), ("b", None, None)], "account_id string, opened_on date, closed_on date")
    got = {(r["account_id"], r["doc_id"], r["kind"]): (r["status"], r["expected"], r["actual"]) for r in merge.described(d, "2025-07-01", "2026-06-30", accounts, overlaps, books).collect()}
    assert got == {
        ("a", "s1", "continuity"): ("fail", "50.00", "51.00"), ("a", "s2", "continuity"): ("warn", "a printed closing and opening balance", "not both printed"), ("a", "s2", "overlap"): ("fail", "2 row(s) for 2025-09-01..2025-09-30", "1 row(s) from s2"),
        ("a", None, "gap"): ("warn", "2025-07-01..2026-05-31", "2026-04-01..2026-05-31"), ("b", None, "gap"): ("warn", "a printed period", "none"), ("b", None, "anchor_missing"): ("warn", "a balance at both ends of the year", "none printed, computed or told"), ("a", None, "prior_year_mismatch"): ("warn", "0.90", "1.00"),
    }


def test_assignments(spark):
    files = spark.createDataFrame([("x", "p1"), ("y", "p2"), ("z", None), ("w", "p4")], "name string, printed_account string")
    accounts = spark.createDataFrame([("p1",), ("p2",), ("own",)], "account_id string")
    chosen = spark.createDataFrame([("y", "own"), ("w", "nobody"), ("gone", "own")], "name string, account_id string")
    assert {r["name"]: r["account_id"] for r in layout.assign(files, accounts, chosen).collect()} == {"x": "p1", "y": "own", "z": None, "w": None}
    assert {r["name"]: r["account_id"] for r in layout.assign(files, accounts).collect()} == {"x": "p1", "y": "p2", "z": None, "w": "p4"}


def test_copies_by_content(spark):
    df = spark.createDataFrame([("h1", "b"), ("h1", "a"), ("h2", "c"), ("h1", "d")], "sha string, name string")
    assert {r["name"] for r in statements.mark_copies(df, "sha", "name").filter("duplicate").collect()} == {"b", "d"}


def test_samples_of_page_rows(spark):
    columns = profiles.profile("c", "pdf", ["Date"], {"date": "Day", "description": ["What", "Text"], "debit": "Out", "credit": "In", "balance": "Left"}, ["d/M/yyyy", "yyyy-MM-dd"], "columns")
    signed = profiles.profile("s", "pdf", ["Date"], {"date": "Day", "description": "What", "amount": "Sum", "balance": "Left", "reference": "Ref"}, ["yyyy-MM-dd"], "signed")
    rows = [("d1", "c", k, date(2025, 7, k), 100 if k % 2 else -250, None if k == 1 else 5, f"t{k}") for k in range(1, 8)] + [("d2", "s", 1, date(2025, 7, 9), -1, 7, "x")]
    txns = spark.createDataFrame(rows, "doc_id string, layout_id string, pos bigint, date date, amount bigint, balance_after bigint, description string")
    got = {(r["doc_id"], r["pos"]): r["sample"] for r in pages.row_samples(txns, spark.createDataFrame([columns, signed], profiles.PROFILE)).collect()}
    assert len(got) == 6 and got["d1", 1] == {"Day": "1/7/2025", "What": "t1", "Out": "", "In": "1.00", "Left": ""} and got["d1", 2] == {"Day": "2/7/2025", "What": "t2", "Out": "2.50", "In": "", "Left": "0.05"}
    assert got["d2", 1] == {"Day": "2025-07-09", "What": "x", "Sum": "-0.01", "Left": ""}

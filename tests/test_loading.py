"""The run over files of both kinds, the gate of profiles, versions, titles, and ledgers of several years."""

import random
from datetime import date

from pyspark.sql import functions as F

from ledgerlens.operators import checks, layout, merge, pages, profiles, tabular
from ledgerlens.plans import loading

FIGURES = {"opening": r"Opening,(?P<value>[^\n]*)", "closing": r"Closing,(?P<value>[^\n]*)", "account_id": r"Account,(?P<value>[^\n]*)", "period_from": r"Period,(?P<value>[^,\n]*)", "period_to": r"Period,[^,\n]*,(?P<value>[^\n]*)"}
LABELS = {"date": "Date", "description": "What", "amount": "Amount", "balance": "Balance"}
ACCOUNTS = "account_id string, identifiers array<string>, statement_expected boolean, opened_on date, closed_on date, anchor bigint, prior_closing bigint"
FILES = "doc_id string, name string, file_seq bigint, container string, duplicate boolean"


def sheet(doc, account, period, rows, header=("Date", "What", "Amount", "Balance"), opening=100):
    balance, out = opening, [["Account", account], ["Opening", f"{opening}.00"], ["Period", *period], list(header)]
    for day, amount in rows:
        balance += amount
        out.append([day, "x", f"{amount}.00", f"{balance}.00"])
    out.insert(2, ["Closing", f"{balance}.00"])
    return [(doc, n, cells) for n, cells in enumerate(out, 1)]


def page(doc, lines):
    return [(doc, 1, n, text, float(x0), float(x0 + 20), float(top)) for n, (text, x0, top) in enumerate((*w, top) for top, ws in lines for w in ws)]


def profile(name, container="csv", tokens=("Date", "Amount"), **more):
    return profiles.profile(name, container, list(tokens), more.pop("labels", LABELS), more.pop("dates", ["d/M/yyyy"]), "signed", patterns=more.pop("patterns", FIGURES), **more)


def test_sheets_and_pages_in_one_run(spark):
    year = ("1/7/2025", "30/6/2026")
    rows = sheet("s1", "PK11", year, [("1/8/2025", 5)]) + sheet("s2", "PK11", year, [("1/8/2025", 5)], header=("Date", "What", "Sum", "Balance"))
    rows += sheet("s3", "PK22", ("1/1/2019", "30/6/2019"), [("1/2/2019", 5)], header=("Tag", "What", "Betrag", "Balance"))
    rows += sheet("s4", "PK22", ("1/1/2020", "30/6/2020"), [("1/2/2020", 5)], header=("Day", "What", "Betrag", "Balance"))
    rows += sheet("s5", "PK22", ("1/1/2010", "30/6/2010"), [("1/2/2010", 5)], header=("Tag", "What", "Betrag", "Balance"))
    head = (20, [("Date", 0), ("What", 60), ("Amount", 180), ("Balance", 300)])
    words = page("p1", [(5, [("IBAN", 0), ("PK33", 40)]), head, (40, [("1/8/2025", 0), ("Shop", 60), ("-5.00", 180), ("95.00", 300)])])
    words += page("p2", [(5, [("IBAN", 0), ("PK33", 40)]), head, (40, [("1/8/2025", 0), ("(cid:3)", 60), ("-5.00", 180), ("95.00", 300)])])
    words += page("p4", [(5, [("IBAN", 0), ("PK33", 40)]), (20, [("Date", 0), ("Amount", 180)])])
    files = [("s1", "1.csv", "csv", False), ("s1", "2.csv", "csv", True), ("s2", "3.csv", "csv", False), ("s3", "4.csv", "csv", False), ("s4", "5.csv", "csv", False), ("s5", "6.csv", "csv", False), ("p1", "7.pdf", "pdf", False), ("p2", "8.pdf", "pdf", False), ("p3", "9.pdf", "pdf", False), ("p4", "a.pdf", "pdf", False), ("x1", "b.xlsx", "xlsx", False)]
    old = profile("betrag", tokens=("Betrag",), labels={**LABELS, "date": "Tag", "amount": "Betrag"}, valid_from=date(2018, 1, 1), valid_to=date(2019, 12, 31))
    new = profile("betrag", tokens=("Betrag",), labels={**LABELS, "date": "Day", "amount": "Betrag"}, valid_from=date(2020, 1, 1))
    broken = profile("broken", tokens=("Date",), title="x", skip=("^Total",))
    broken = (*broken[:4], "(unclosed", *broken[5:])
    table = [profile("bank"), old, new, broken, profile("titled", tokens=("Date", "Amount"), title="^Other bank"), profile("wild", dates=["q/M/yyyy"]), profile("paged", "pdf")]
    accounts = [(k, [i], True, None, None, None, None) for k, i in (("a", "PK11"), ("b", "PK22"), ("c", "PK 33"), ("d", "PK44"))]
    df = spark.createDataFrame
    run = loading.load_files(df([(d, n, k, c, again) for k, (d, n, c, again) in enumerate(files, 1)], FILES), df(rows, "doc_id string, row_no bigint, cells array<string>"), df(table, profiles.PROFILE), df(accounts, ACCOUNTS), "2025-07-01", "2026-06-30", words=df(words, "doc_id string, page int, word_no int, text string, x0 double, x1 double, top double"))
    got = {r["name"]: (r["outcome"], r["layout_id"], r["account_id"], r["n_txns"]) for r in run.outcomes.collect()}
    assert got == {
        "1.csv": ("ok", "bank", "a", 1), "2.csv": ("duplicate", None, None, 0), "3.csv": ("unknown_layout", None, None, 0), "4.csv": ("ok", "betrag", "b", 1), "5.csv": ("ok", "betrag", "b", 1), "6.csv": ("no_valid_profile", None, None, 0),
        "7.pdf": ("ok", "paged", "c", 1), "8.pdf": ("not_text", "paged", "c", 0), "9.pdf": ("not_text", None, None, 0), "a.pdf": ("unreadable", "paged", "c", 0), "b.xlsx": ("unknown_layout", None, None, 0),
    }
    assert {(r["layout_id"], r["problem"]) for r in run.rejected.collect()} == {("broken", "the pattern of title can't be read"), ("wild", "a date format can't be read")}
    assert {(r["account_id"], r["amount"]) for r in run.txns.collect()} == {("a", 500), ("b", 500), ("c", -500)}
    assert {r["account_id"] for r in run.ledgers.collect()} == {"a", "b", "c"} and [r[0] for r in run.missing.collect()] == ["d"]


def test_profiles_are_tried_before_files(spark):
    df = spark.createDataFrame
    table = df([profile("good"), profile("wrong"), profile("untried"), profile("dead", patterns={"opening": r"Never (?P<value>\d+)"})], profiles.PROFILE)
    header, cells = ["Date", "What", "Amount"], ["1/7/2025", "x", "2.50"]
    cases = df([("good", 1, header, cells, date(2025, 7, 1), 250), ("wrong", 1, header, cells, date(2025, 7, 1), -250), ("dead", 1, header, cells, date(2025, 7, 1), 250)], "layout_id string, case_no int, header array<string>, cells array<string>, want_date date, want_amount bigint")
    samples = df([("dead", "Opening,12.00", {})], "layout_id string, sample string, want map<string,string>")
    fine, bad = loading.gate(table, cases, samples)
    assert [r["layout_id"] for r in fine.collect()] == ["good"]
    assert {(r["layout_id"], r["problem"]) for r in bad.collect()} == {("wrong", "a labelled row is not read as it should be"), ("untried", "no labelled row to try it on"), ("dead", "opening: pattern finds nothing")}


def test_an_unknown_layout_is_a_status(spark):
    docs = spark.createDataFrame([("d", "gone", "a")], "doc_id string, layout_id string, account_id string")
    table = spark.createDataFrame([profile("bank")], profiles.PROFILE)
    rows = spark.createDataFrame(sheet("d", "PK", ("1/7/2025", "30/6/2026"), [("1/8/2025", 5)]), "doc_id string, row_no bigint, cells array<string>")
    words = spark.createDataFrame(page("d", [(5, [("Date", 0), ("Amount", 50)])]), "doc_id string, page int, word_no int, text string, x0 double, x1 double, top double")
    for documents, txns, _ in (tabular.parse(rows, docs, table), pages.parse(words, docs, table)):
        assert [r["status"] for r in documents.collect()] == ["no_profile"] and txns.count() == 0


def test_rows_of_a_rejected_document_stay_out(spark):
    docs = spark.createDataFrame([("d", "paged", "a")], "doc_id string, layout_id string, account_id string")
    lines = [(20, [("Date", 0), ("What", 60), ("Amount", 180), ("Balance", 300)]), (40, [("1/8/2025", 0), ("Shop", 60), ("-5.00", 180), ("95.00", 300)]), (50, [("(cid:9)", 60)])]
    words = spark.createDataFrame(page("d", lines), "doc_id string, page int, word_no int, text string, x0 double, x1 double, top double")
    documents, txns, unresolved = pages.parse(words, docs, spark.createDataFrame([profile("paged", "pdf")], profiles.PROFILE))
    assert ([r["status"] for r in documents.collect()], txns.count(), unresolved.count()) == (["not_text"], 0, 0)


def test_detection_is_the_search_of_all_profiles(spark):
    r = random.Random(11)
    parts = ["Date", "Debit", "Credit ", "Ref", "Cr", "Büro", "Amount due", "x"]
    table = [(f"l{k}", r.choice(["csv", "pdf"]), r.sample(parts, r.randrange(1, 4)), r.choice([None, None, "(?i)^bank", "no \\d"])) for k in range(120)]
    heads = [(k, r.choice(["csv", "pdf"]), " ".join([r.choice(["Bank", "bank", "No 5", ""]), *(r.choice([p, p.upper(), p[:3]]) for p in r.sample(parts, r.randrange(0, 7)))])) for k in range(80)] + [(99, "csv", "")]
    import re

    def fits(head, p):
        return all(t.strip().lower() in head.lower() for t in p[2]) and (p[3] is None or re.search(p[3], head) is not None)

    want = {}
    for k, container, head in heads:
        mine = [p[0] for p in table if p[1] == container and fits(head, p)]
        want[k] = ("ok", mine[0]) if len(mine) == 1 else ("ambiguous_layout" if mine else "unknown_layout", None)
    got = layout.detect(spark.createDataFrame(heads, "doc_id int, container string, head string"), spark.createDataFrame(table, "layout_id string, container string, tokens array<string>, title string"))
    assert {x["doc_id"]: (x["status"], x["layout_id"]) for x in got.collect()} == want and len({w[0] for w in want.values()}) == 3


def test_three_years_in_one_plan(spark):
    docs, rows, balance = [], [], 1000
    for k, (start, end, at) in enumerate([(date(2023, 7, 1), date(2024, 6, 30), date(2023, 9, 1)), (date(2024, 7, 1), date(2025, 3, 31), date(2024, 9, 1)), (date(2025, 4, 1), date(2026, 6, 30), date(2025, 9, 1))]):
        opening = balance + (7 if k == 2 else 0)  # the last statement begins with another balance
        balance = opening + 50
        docs.append((f"d{k}", "a", "csv", k + 1, start, end, start, end, opening, balance, None, None, 0, True))
        rows.append((f"d{k}", 1, at, 50, balance, "x"))
    d = spark.createDataFrame(docs, "doc_id string, account_id string, container string, file_seq int, doc_start date, doc_end date, s_start date, s_end date, s_opening bigint, s_closing bigint, s_credit bigint, s_debit bigint, unresolved int, running boolean")
    t = spark.createDataFrame(rows, "doc_id string, pos bigint, date date, amount bigint, balance_after bigint, description string")
    years = spark.createDataFrame([(y, date(y, 7, 1), date(y + 1, 6, 30)) for y in range(2022, 2027)], "year int, start date, end date")
    for prior, first in ((1000, []), (990, [(2023, "prior_year_mismatch", "warn")])):
        accounts = spark.createDataFrame([("a", None, None, None, prior)], "account_id string, opened_on date, closed_on date, anchor bigint, prior_closing bigint")
        books, found = merge.year_ledgers(t, d, accounts, checks.all_checks(t, d), years)
        assert sorted((r["account_id"], r["year"], r["opening"], r["closing"], r["net"], r["n"]) for r in books.filter("year <> 2024").collect()) == [("a", 2023, 1000, 1050, 50, 1), ("a", 2025, 1107, 1157, 50, 1)]
        late = sorted((r["year"], r["kind"], r["status"]) for r in found.filter(F.col("kind").isin("prior_year_mismatch", "continuity") & (F.col("status") != "pass")).collect())
        # the seam lies inside 2024, whose two statements disagree there
        assert late == sorted([*first, (2024, "continuity", "fail")])
    moved = d.withColumn("doc_end", F.when(F.col("doc_id") == "d1", F.lit("2025-06-30").cast("date")).otherwise(F.col("doc_end"))).withColumn("doc_start", F.when(F.col("doc_id") == "d2", F.lit("2025-07-01").cast("date")).otherwise(F.col("doc_start")))
    books, found = merge.year_ledgers(t, moved, accounts.withColumn("prior_closing", F.lit(None).cast("bigint")), checks.all_checks(t, moved), years)
    assert [(r["year"], r["kind"]) for r in found.filter("kind = 'prior_year_mismatch'").collect()] == [(2025, "prior_year_mismatch")]
    assert sorted((r["year"], r["account_status"], r["opening"]) for r in books.collect()) == [(2023, "complete", 1000), (2024, "complete", 1050), (2025, "complete", 1107)]

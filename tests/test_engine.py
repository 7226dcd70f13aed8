"""Readers, sheets, merging, masking, geometry and matching on literal cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import checks, geometry, layout, masking, matching, merge, profiles, tabular
from ledgerlens.sources import statements

DAY = dt.date
PROFILE = profiles.profile("bank.v1", "csv", ["Date", "Amount"], {"date": "Date", "description": "What", "amount": "Amount", "balance": "Balance"}, ["d/M/yyyy"], "signed", skip=("^Total,",), patterns={"opening": r"Opening,(?P<value>.*)", "closing": r"Closing,(?P<value>[^\n]*)"}, valid_from=DAY(2020, 1, 1))


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("statements")
    sheet = 'Opening,100.00\nClosing,150.00\n"Date","What","Amount","Balance"\n1/7/2025,"Coffee, ""black""\nto go",-50.00,50.00\n,,,\n2/7/2025,Pay,100,150.00\nTotal,50\n2/7/2025\n'
    (folder / "b.csv").write_bytes(b"\xef\xbb\xbf" + sheet.encode())
    (folder / "a.CSV").write_bytes(b"\xef\xbb\xbf" + sheet.encode())
    (folder / "c.csv").write_bytes("Café,x".encode("cp1252"))
    (folder / "d.pdf").write_bytes(b"%PDF-1.7")
    (folder / "e.txt").write_bytes(b"no statement")
    return statements.files(spark, str(folder))


def test_files_are_numbered_by_name_and_repeats_are_marked(files):
    got = sorted((r["file_seq"], r["name"], r["container"], r["duplicate"]) for r in files.collect())
    assert got == [(1, "a.CSV", "csv", False), (2, "b.csv", "csv", True), (3, "c.csv", "csv", False), (4, "d.pdf", "pdf", False)]


def test_csv_rows_to_transactions(spark, files):
    rows = statements.csv_rows(files)
    by_name = {r["name"]: r["doc_id"] for r in files.filter("NOT duplicate").collect()}
    assert [r["cells"] for r in rows.filter(F.col("doc_id") == by_name["c.csv"]).collect()] == [["Café", "x"]]
    heads = {r["doc_id"]: r["head"] for r in statements.head_text(rows, 2).collect()}
    assert heads[by_name["a.CSV"]] == "Opening,100.00\nClosing,150.00"
    profile = table(spark, [PROFILE], profiles.PROFILE)
    docs = table(spark, [(by_name["a.CSV"], "bank.v1", "acc"), (by_name["c.csv"], "bank.v1", None)], "doc_id string, layout_id string, account_id string")
    documents, txns, lost = tabular.parse(rows, docs, profile)
    assert [(r["pos"], r["date"], r["amount"], r["balance_after"], r["description"]) for r in txns.orderBy("pos").collect()] == [(4, DAY(2025, 7, 1), -5000, 5000, 'Coffee, "black"\nto go'), (6, DAY(2025, 7, 2), 10000, 15000, "Pay")]
    assert [(r["locator"], r["reason"]) for r in lost.collect()] == [("row:8", tabular.NO_AMOUNT)]
    got = {r["doc_id"]: r for r in documents.collect()}
    one = got[by_name["a.CSV"]]
    assert (one["status"], one["s_opening"], one["s_closing"], one["doc_start"], one["doc_end"], one["unresolved"]) == ("ok", 10000, 15000, DAY(2025, 7, 1), DAY(2025, 7, 2), 1)
    assert got[by_name["c.csv"]]["status"] == "no_header"
    # the parts fit together: the proofs see the rows and the lost one
    found = {r["kind"]: r["status"] for r in checks.all_checks(txns, documents).filter(F.col("doc_id") == by_name["a.CSV"]).collect()}
    assert found == {"running_balance": "pass", "opening_closing": "pass", "unresolved_rows": "fail", "date_range": "warn"}


def test_columns_that_lack_or_repeat(spark):
    heads = table(spark, [(1, "bank.v1", 1, ["Date", "What", "Amount", "amount ", "Balance"]), (2, "bank.v1", 1, ["Date", "Amount"])], "doc_id int, layout_id string, header_row int, header array<string>").join(table(spark, [PROFILE], profiles.PROFILE), "layout_id")
    got = {r["doc_id"]: (r["mapping"], r["lacking"]) for r in tabular.map_columns(heads).collect()}
    assert got[1] == ({"date": 0, "description": 1, "amount": 3, "balance": 4}, []) and got[2][1] == ["balance", "description"]


def test_profile_selftest_and_validity(spark):
    p = table(spark, [PROFILE], profiles.PROFILE)
    cases = [("bank.v1", 1, ["Date", "What", "Amount"], ["1/7/2025", "x", "(2.50)"], DAY(2025, 7, 1), -250), ("bank.v1", 2, ["Date", "What", "Amount"], ["1/7/2025", "x", "2.50"], DAY(2025, 7, 1), -250)]
    df = table(spark, cases, "layout_id string, case_no int, header array<string>, cells array<string>, want_date date, want_amount bigint")
    assert {r["case_no"]: r["ok"] for r in tabular.selftest(df, p).collect()} == {1: True, 2: False}
    assert profiles.usable(p, tabular.selftest(df, p)).count() == 0 and profiles.usable(p, tabular.selftest(df.filter("case_no = 1"), p)).count() == 1
    on = lambda d: p.select(profiles.fits(F.lit("x date,AMOUNT"), F.lit(d).cast("date"))).first()[0]
    assert on("2020-01-01") and not on("2019-12-31")


def chain(doc, account, start, end, rows, opening, seq, running=True, container="csv"):
    """A statement: its docs row, and its rows with balances."""
    out, balance = [], opening
    for k, (day, amount) in enumerate(rows):
        balance += amount
        out.append((doc, k, day, amount, balance if running else None, f"t{k}"))
    return (doc, account, container, seq, start, end, start, end, opening, balance, None, None, 0, running), out


def ledger(spark, parts, anchor=None, prior=None, opened=None):
    docs = table(spark, [p[0] for p in parts], "doc_id string, account_id string, container string, file_seq int, doc_start date, doc_end date, s_start date, s_end date, s_opening bigint, s_closing bigint, s_credit bigint, s_debit bigint, unresolved int, running boolean")
    rows = table(spark, [r for p in parts for r in p[1]], "doc_id string, pos bigint, date date, amount bigint, balance_after bigint, description string")
    accounts = table(spark, [("a", opened, None, anchor, prior)], "account_id string, opened_on date, closed_on date, anchor bigint, prior_closing bigint")
    out, found = merge.ledgers(rows, docs, accounts, checks.all_checks(rows, docs), "2025-07-01", "2026-06-30")
    return out.first(), sorted((r["kind"], r["status"]) for r in found.collect() if r["kind"] not in checks.KINDS)


HALF = [(DAY(2025, 8, 1), 50), (DAY(2025, 11, 5), -20)]


def test_ledger_of_a_whole_year(spark):
    one = chain("x", "a", DAY(2025, 7, 1), DAY(2025, 12, 31), HALF, 1000, 1)
    two = chain("y", "a", DAY(2026, 1, 1), DAY(2026, 6, 30), [(DAY(2026, 2, 2), 5)], 1030, 2)
    got, found = ledger(spark, [one, two], prior=900)
    assert tuple(got)[1:] == ("complete", 1000, "printed", 1035, "printed", 35, 3)
    assert found == [("continuity", "pass"), ("gap", "pass"), ("prior_year_mismatch", "warn")]


def test_ledger_fails_where_statements_disagree_at_the_seam_or_in_an_overlap(spark):
    one = chain("x", "a", DAY(2025, 7, 1), DAY(2025, 12, 31), HALF, 1000, 1)
    torn = chain("y", "a", DAY(2026, 1, 1), DAY(2026, 6, 30), [(DAY(2026, 2, 2), 5)], 9999, 2)
    got, found = ledger(spark, [one, torn])
    assert got["account_status"] == "failed" and got["opening"] is None and ("continuity", "fail") in found
    same = chain("y", "a", DAY(2025, 11, 1), DAY(2026, 6, 30), [(DAY(2025, 11, 5), -20), (DAY(2026, 2, 2), 5)], 1050, 2)
    same[1][0] = (*same[1][0][:5], " T1 ")
    got, found = ledger(spark, [one, same])
    assert (got["account_status"], got["closing"], got["n"]) == ("complete", 1035, 3) and ("overlap", "pass") in found
    other = chain("y", "a", DAY(2025, 11, 1), DAY(2026, 6, 30), [(DAY(2025, 11, 6), -20), (DAY(2026, 2, 2), 5)], 1050, 2)
    got, found = ledger(spark, [one, other])
    assert got["account_status"] == "failed" and ("overlap", "fail") in found


def test_ledger_without_balances_or_rows(spark):
    wallet = chain("x", "a", DAY(2025, 7, 1), DAY(2026, 6, 30), HALF, 1000, 1, running=False)
    wallet = ((*wallet[0][:8], 1000, 1030, *wallet[0][10:]), wallet[1])
    got, found = ledger(spark, [wallet])
    assert (got["account_status"], got["opening_source"]) == ("incomplete", "unknown") and ("anchor_missing", "warn") in found
    got, _ = ledger(spark, [wallet], anchor=70)
    assert (got["account_status"], got["opening"], got["opening_source"], got["closing"], got["closing_source"]) == ("complete", 70, "anchor", 100, "computed")
    early = chain("x", "a", DAY(2025, 5, 1), DAY(2026, 6, 30), [(DAY(2025, 6, 1), 40)], 10, 1)
    got, _ = ledger(spark, [early])
    assert (got["opening"], got["closing"], got["opening_source"], got["n"]) == (50, 50, "computed", 0)
    part = chain("x", "a", DAY(2025, 7, 1), DAY(2025, 12, 31), HALF, 1000, 1)
    assert ledger(spark, [part])[0]["account_status"] == "incomplete"


def test_masking(spark):
    texts = {
        "Debit/Credit": "Debit/Credit", "Payoneer/AHMED": "Xxxxxxxx/XXXXX", "1,234.00Dr": "9,999.99Dr", "José Müller": "Xxxx Xxxxxx", "محمد": "xxxx", "Date,Description": "Date,Xxxxxxxxxxx", "Debit/": "Debit/", "Xyz/": "Xxx/", "A — B": "X — X", "ref-12": "xxx-99",
        "": "", "  two\n lines ": "  xxx\n xxxxx ",
    }
    allowed = F.array(*map(F.lit, ("DEBIT", "CREDIT", "DATE", "DR")))
    df = table(spark, [(t,) for t in [*texts, None]], "t string")
    got = {r["t"]: r["m"] for r in df.select("t", masking.mask_text(F.col("t"), allowed).alias("m")).collect()}
    assert got.pop(None) is None and got == texts
    big = table(spark, [("1234567.50",), ("12.00",), ("PKR",)], "t string").select(masking.mask_text(F.col("t"), allowed, hide_magnitude=True).alias("m"))
    assert [r["m"] for r in big.collect()] == ["9,999.99", "9,999.99", "XXX"]
    words = table(spark, [("# comment",), (" Debit ",), ("",), ("value_date",)], "value string")
    assert {r["word"] for r in masking.allowlist(words).collect()} == {"DEBIT", "VALUEDATE"}


def test_bands_of_a_header_and_words_between_them(spark):
    header = table(spark, [(1, k + 1, *w) for k, w in enumerate([("Value", 0.0, 20.0), ("Date", 22.0, 40.0), ("Narration", 60.0, 90.0), ("Debit", 200.0, 220.0), ("Credit", 240.0, 262.0)])], "doc_id int, word_no int, text string, x0 double, x1 double")
    labels = table(spark, [("date", "left", "value date"), ("description", "left", "Narration"), ("debit", "right", "Debit"), ("credit", "right", "CREDIT"), ("none", "right", "Narration Credit")], "role string, align string, label string")
    bands = geometry.build_bands(geometry.find_labels(header, labels))
    assert {r["role"]: (r["x0"], r["x1"]) for r in bands.collect() if r["role"] != "none"} == {"date": (0.0, 60.0), "description": (60.0, 200.0), "debit": (200.0, 220.0), "credit": (240.0, 262.0)}
    words = table(spark, [(1, 1, 61.0, 80.0), (1, 2, 120.0, 150.0), (1, 3, 205.0, 221.0), (1, 4, 300.0, 310.0)], "doc_id int, word_no int, w_x0 double, w_x1 double")
    assert {r["word_no"]: r["role"] for r in geometry.assign(words, bands.filter("role <> 'none'")).collect()} == {1: "description", 2: "description", 3: "debit", 4: None}


def test_lines_of_words(spark):
    r = random.Random(2)
    rows = [(1, p, k, r.choice([10.0, 11.9, 12.95, 13.04, 20.25, 20.35, 30.0]), float(r.randrange(50))) for p in (1, 2) for k in range(25)]
    want = {}
    for p in (1, 2):
        anchors = []
        for _, _, k, top, _ in sorted((w for w in rows if w[1] == p), key=lambda w: (round(w[3], 1), w[4], w[2])):
            line = next((n for n, a in enumerate(anchors) if abs(a - top) <= 3.0), None)
            if line is None:
                anchors.append(top)
                line = len(anchors) - 1
            want[p, k] = line + 1
    got = geometry.group_lines(table(spark, rows, "doc_id int, page int, word_no bigint, top double, x0 double"))
    assert {(x["page"], x["word_no"]): x["line"] for x in got.collect()} == want


def test_missing_accounts(spark):
    rows = [("a", True, None, None), ("b", True, None, DAY(2025, 6, 30)), ("c", True, DAY(2026, 7, 1), None), ("d", False, None, None), ("e", True, None, None)]
    accounts = table(spark, rows, "account_id string, statement_expected boolean, opened_on date, closed_on date")
    assert [r[0] for r in layout.missing_accounts(accounts, table(spark, [("e",)], "account_id string"), "2025-07-01", "2026-06-30").collect()] == ["a"]


def test_transfers_are_matched_by_tier_and_ties_between_accounts_are_ambiguous(spark):
    r = random.Random(6)
    cands = [(d, 500 + c, f"A{d % 3}", f"B{c % 4}", *r.choice([("strong", 0, 0, 1), ("possible", 0, 2, 0), ("possible", 7, 1, 1)])) for d in range(25) for c in range(25) if r.random() < 0.15]
    cands += [(900 + k // 2, 2000 + (k + 1) // 2, "L", "M", "possible", 0, 1, 0) for k in range(100)]  # a chain of forced steps
    used, want = (set(), set()), set()
    key = lambda x: (x[4] != "strong", x[5] > 0, x[6], -x[7])
    for level in sorted({key(x) for x in cands}):
        here = [x for x in cands if key(x) == level and x[0] not in used[0] and x[1] not in used[1]]
        many = lambda side, acc: {s for s in {x[side] for x in here} if len({x[acc] for x in here if x[side] == s}) > 1}
        d2, c2 = many(0, 3), many(1, 2)
        bad = [x for x in here if x[0] in d2 or x[1] in c2]
        rest = [x for x in here if x[0] not in {b[0] for b in bad} and x[1] not in {b[1] for b in bad}]
        want |= {(x[0], x[1], "ambiguous_pair") for x in bad}
        for x in bad:
            used[0].add(x[0])
            used[1].add(x[1])
        for x in sorted(rest):
            if x[0] not in used[0] and x[1] not in used[1]:
                want.add((x[0], x[1], "matched"))
                used[0].add(x[0])
                used[1].add(x[1])
    df = table(spark, cands, "debit_key bigint, credit_key bigint, debit_account string, credit_account string, tier string, fee bigint, gap bigint, signals bigint")
    assert {(x["debit_key"], x["credit_key"], x["status"]) for x in matching.match_tiers(df).collect()} == want and len([w for w in want if w[2] == "matched"]) >= 50
    assert matching.match_tiers(df.filter("false")).count() == 0


def test_matched_income_is_a_conflict(spark):
    pairs = table(spark, [(1, 2, "matched"), (3, 4, "matched"), (5, 6, "ambiguous_pair")], "debit_key bigint, credit_key bigint, status string")
    kinds = table(spark, [(2, "export_proceeds"), (4, "other_credit")], "key bigint, category string")
    got = {r["key"]: (r["category"], r["outcome"]) for r in matching.income_conflicts(pairs, kinds).collect()}
    assert got == {1: (None, "conflict"), 2: ("export_proceeds", "conflict"), 3: ("internal_transfer", "proposed"), 4: ("internal_transfer", "proposed")}


def positioned(doc, page, lines):
    """Words of lines: (top, [(text, x0, x1), ...])."""
    return [(doc, page, n, text, float(x0), float(x1), top) for n, (top, text, x0, x1) in enumerate((top, *w) for top, ws in lines for w in ws)]


def test_pages_to_transactions(spark):
    p = profiles.profile("pages.v1", "pdf", ["Date", "Debit"], {"date": "Date", "description": "Details", "debit": "Debit", "credit": "Credit", "balance": "Balance"}, ["d/M/yyyy"], "columns", skip=("^Page ",), footer=("^End of statement",), patterns={"opening": r"Opening (?P<value>\S+)"})
    head = (20.0, [("Date", 0, 20), ("Details", 60, 90), ("Debit", 180, 200), ("Credit", 240, 262), ("Balance", 300, 330)])
    one = [(5.0, [("Opening", 0, 30), ("1,000.00", 35, 70)]), head, (40.0, [("1/7/2025", 0, 40), ("Shop", 60, 80), ("one", 84, 95), ("50.00", 175, 200), ("950.00", 300, 330)]), (50.0, [("carried", 61, 90)]), (60.0, [("2/7/2025", 0, 40), ("Odd", 60, 80), ("9.00", 210, 225.5), ("x", 20, 22)]), (70.0, [("lost", 60, 80), ("5.00", 241, 262)]), (90.0, [("Page", 0, 10), ("1", 12, 14)])]
    two = [(10.0, [("more", 60, 80)]), (22.0, [("3/7/2025", 0, 40), ("Pay", 60, 80), ("100.00", 236, 261), ("1,050.00", 298, 331)]), (30.0, [("to", 60, 70), ("you", 72, 80)]), (40.0, [("31/31/2025", 0, 40), ("Bad", 60, 80), ("1.00", 180, 200)]), (60.0, [("End", 0, 20), ("of", 22, 30), ("statement", 32, 60)]), (70.0, [("hidden", 60, 90)])]
    words = positioned(1, 1, one) + positioned(1, 2, two) + positioned(2, 1, [(10.0, [("(cid:12)", 0, 10)])]) + positioned(3, 1, [(10.0, [("cover", 0, 10)])]) + positioned(4, 1, [(20.0, head[1][:1] + head[1][2:])])
    df = table(spark, words, "doc_id bigint, page int, word_no int, text string, x0 double, x1 double, top double")
    docs = table(spark, [(k, "pages.v1", "acc") for k in (1, 2, 3, 4)], "doc_id bigint, layout_id string, account_id string")
    from ledgerlens.operators import pages

    documents, txns, lost = pages.parse(df, docs, table(spark, [p], profiles.PROFILE))
    assert [(r["locator"], r["date"], r["amount"], r["balance_after"], r["description"]) for r in txns.orderBy("pos").collect()] == [("page:1,y:40", DAY(2025, 7, 1), -5000, 95000, "Shop one carried"), ("page:2,y:22", DAY(2025, 7, 3), 10000, 105000, "Pay to you")]
    assert {(r["locator"], r["reason"]) for r in lost.collect()} == {("page:1,y:60", pages.LOOSE), ("page:1,y:70", pages.UNDATED), ("page:2,y:40", tabular.BAD_DATE), ("page:2,y:60", pages.LOST_TAIL)}
    assert {r["doc_id"]: (r["status"], r["s_opening"], r["unresolved"]) for r in documents.collect()} == {1: ("ok", 100000, 4), 2: ("not_text", None, 0), 3: ("no_header", None, 0), 4: ("no_column", None, 0)}


def test_a_folder_of_files_becomes_ledgers(spark, tmp_path):
    from ledgerlens.plans import loading

    def sheet(account, opening, rows, period):
        balance, out = opening, [f"Account,{account}", f"Opening,{opening}.00", f"Period,{period[0]},{period[1]}", "Date,What,Amount,Balance"]
        for day, amount in rows:
            balance += amount
            out.append(f"{day},x,{amount}.00,{balance}.00")
        return "\n".join([*out[:2], f"Closing,{balance}.00", *out[2:]]) + "\n"

    year = ("1/7/2025", "30/6/2026")
    good = sheet("PK11", 100, [("1/8/2025", 5), ("2/9/2025", -7)], year)
    made = {"1.csv": good, "2.csv": good, "3.csv": sheet("PK22", 10, [("1/8/2025", 1)], year).replace("1.00,11.00", "2.00,11.00"), "4.csv": sheet("nobody", 10, [("1/8/2025", 1)], year), "5.csv": "just,text\n", "6.csv": sheet("nobody", 7, [("1/8/2025", 1)], year)}
    for name, content in made.items():
        (tmp_path / name).write_text(content)
    p = profiles.profile("bank.v1", "csv", ["Date", "Amount"], {"date": "Date", "description": "What", "amount": "Amount", "balance": "Balance"}, ["d/M/yyyy"], "signed", patterns={"opening": r"Opening,(?P<value>[^\n]*)", "closing": r"Closing,(?P<value>[^\n]*)", "account_id": r"Account,(?P<value>[^\n]*)", "period_from": r"Period,(?P<value>[^,\n]*)", "period_to": r"Period,[^,\n]*,(?P<value>[^\n]*)"})
    accounts = table(spark, [("a", ["PK 11"], True, None, None, None, None), ("b", ["PK22"], True, None, None, None, None), ("c", ["PK33"], True, None, None, None, None), ("d", ["PK44"], False, None, None, None, None)], "account_id string, identifiers array<string>, statement_expected boolean, opened_on date, closed_on date, anchor bigint, prior_closing bigint")
    files = statements.files(spark, str(tmp_path))
    run = loading.load_files(files, statements.csv_rows(files), table(spark, [p], profiles.PROFILE), accounts, "2025-07-01", "2026-06-30", table(spark, [("6.csv", "d"), ("4.csv", "unknown"), ("gone.csv", "a")], "name string, account_id string"))
    assert {r["name"]: (r["outcome"], r["account_id"], r["n_txns"]) for r in run.outcomes.collect()} == {"1.csv": ("ok", "a", 2), "2.csv": ("duplicate", None, 0), "3.csv": ("ok", "b", 1), "4.csv": ("unassigned", None, 0), "5.csv": ("unknown_layout", None, 0), "6.csv": ("ok", "d", 1)}
    assert {r["account_id"]: (r["account_status"], r["opening"], r["closing"], r["opening_source"]) for r in run.ledgers.collect()} == {"a": ("complete", 10000, 9800, "printed"), "b": ("failed", None, None, "unknown"), "d": ("complete", 700, 800, "printed")}
    assert [r[0] for r in run.missing.collect()] == ["c"]
    assert {(r["what"], r["name"]): r["n"] for r in loading.run_summary(run).collect()} == {("file", "ok"): 3, ("file", "duplicate"): 1, ("file", "unassigned"): 1, ("file", "unknown_layout"): 1, ("account", "complete"): 2, ("account", "failed"): 1, ("account", "missing"): 1}
    years = table(spark, [("TY1", DAY(2025, 7, 1), DAY(2026, 6, 30)), ("TY2", DAY(2025, 1, 1), DAY(2025, 12, 31))], "name string, period_start date, period_end date")
    assert {r["problem"] for r in loading.year_problems(years).collect()} == {"period_start must be 1 July", "period_end must be 30 June", "a tax year spans exactly one 1 July to 30 June"}


def test_summary_selftest_registry_and_cells(spark):
    from ledgerlens.operators import summary
    from ledgerlens.plans import loading

    p = table(spark, [PROFILE], profiles.PROFILE)
    samples = table(spark, [("bank.v1", "Opening,12.00\nother", {"opening": "13.00", "period_from": "x"})], "layout_id string, sample string, want map<string,string>")
    assert {(r["figure"], r["problem"]) for r in tabular.summary_selftest(samples, p).collect()} == {("opening", "captures something else"), ("closing", "pattern finds nothing"), ("period_from", "expected but not declared")}
    accounts = table(spark, [("a", "bank", ["1"], None, None), ("a", "wallet", ["2"], None, None), ("b", "safe", [" "], DAY(2025, 1, 2), DAY(2025, 1, 1))], "account_id string, kind string, identifiers array<string>, opened_on date, closed_on date")
    assert sorted((r["account_id"], r["problem"][:12]) for r in loading.registry_problems(accounts).collect()) == [("a", "the id is us"), ("b", "an account n"), ("b", "closed befor"), ("b", "unknown kind")]
    rows = table(spark, [("profit_on_debt", 700), ("tax_on_profit", -140), ("tax_on_cards", -9)], "category string, amount bigint")
    blank = table(spark, [], "source string, units bigint")
    got = {(r["code"], r["col"]): (r["units"], r["source"], r["differs"]) for r in summary.cells(rows, blank, 600).collect()}
    assert got[summary.PROFIT_TAX_ABOVE, 2] == (140, "statements", False) and got[summary.CARD_TAX, 2] == (9, "statements", False)
    none = {(r["code"], r["col"]): (r["units"], r["source"]) for r in summary.cells(rows.filter("category <> 'tax_on_cards'"), blank, 800).collect()}
    assert none[summary.CARD_TAX, 2] == (None, None) and none[summary.PROFIT_TAX, 2] == (140, "statements")

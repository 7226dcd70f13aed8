"""The log of decisions, and the cells of several years."""

from ledgerlens.operators import decisions, summary

TXNS, PAIRS = "key bigint, category string, outcome string", "debit_key bigint, credit_key bigint, status string"


def test_a_log_with_edits_repeats_and_broken_lines(spark):
    lines = [
        '{"txn": 1, "decision": "confirm"}', '{"txn": 1, "decision": "reclassify", "category": "zakat", "saw": "salary_net"}', '{"txn": 2, "decision": "reject"}', "", "  ", "not json", '{"txn": "x", "decision": "confirm"}',
        '{"debit": 5, "credit": 6, "decision": "reject"}', '{"debit": 5, "credit": 6, "decision": "confirm", "saw": "matched"}', '{"debit": 5, "decision": "confirm"}', '{"txn": 3, "debit": 5, "credit": 6, "decision": "confirm"}', '{"txn": 3, "decision": "maybe"}',
        '{"debit": 5, "credit": 6, "decision": "reclassify", "category": "zakat"}', '{"txn": 3, "decision": "reclassify"}', '{"txn": 99, "decision": "confirm"}', '{"debit": 7, "credit": 8, "decision": "confirm"}', '{"txn": 2, "decision": "reject"}', '{"txn": 4, "decision": "confirm", "saw": "zakat"}',
    ]
    known, broken = decisions.read_log(spark.createDataFrame(list(enumerate(lines)), "seq bigint, line string"))
    assert {r["seq"]: r["reason"] for r in broken.collect()} == {5: "not a line of JSON", 6: "not a line of JSON", 9: "about nothing", 10: "about a transaction and a match", 11: "unknown decision", 12: "a new category is for a transaction, and has to be told", 13: "a new category is for a transaction, and has to be told"}
    proposals = spark.createDataFrame([(1, "other_credit", "default"), (2, "salary_net", "proposed"), (3, "zakat", "proposed"), (4, "fee", "proposed")], TXNS)
    matches = spark.createDataFrame([(5, 6, "ambiguous_pair"), (50, 60, "matched")], PAIRS)
    txns, pairs, stale = decisions.apply(proposals, matches, known)
    assert {r["key"]: (r["category"], r["outcome"]) for r in txns.collect()} == {1: ("zakat", "decided"), 2: (None, "rejected"), 3: ("zakat", "proposed"), 4: ("fee", "decided")}
    assert {(r["debit_key"], r["status"]) for r in pairs.collect()} == {(5, "confirmed"), (50, "matched")}
    assert {(r["seq"], r["txn"], r["debit"], r["reason"]) for r in stale.collect()} == {(1, 1, None, "it was something else when it was seen"), (17, 4, None, "it was something else when it was seen"), (14, 99, None, "not there any more"), (15, None, 7, "not there any more"), (8, None, 5, "it was something else when it was seen")}
    assert decisions.apply(proposals, matches, known.filter("false"))[2].count() == 0


def test_cells_of_two_years_differ_by_data_only(spark):
    codes = [(y, "profit", 1, "profit_on_debt", 1, p, None, "institution", ["statements"], True) for y, p in ((2026, "500312"), (2027, "77"))]
    codes += [(y, "profit", 2, "tax_on_profit", -1, p, a, None, ["statements"], True) for y, p, a in ((2026, "64040052", "64040002"), (2027, "78", "79"))]
    codes += [(2026, "cards", 2, "tax_on_cards", -1, "64151905", None, None, ["rule_42", "certificate_236Y", "statements"], False), (2027, "cards", 2, "tax_on_cards", -1, "80", None, None, ["statements", "rule_42"], False)]
    rows = [(2026, "profit_on_debt", 700, "A"), (2026, "profit_on_debt", 50, "B"), (2026, "tax_on_profit", -140, "A"), (2026, "tax_on_cards", -9, "A"), (2027, "profit_on_debt", 5, "A"), (2026, "export_proceeds", 1000, "A"), (2026, "tax_on_exports", -4, "A")]
    typed = spark.createDataFrame([(2026, None, 8), (2027, 3, None)], "year int, rule_42 bigint, certificate_236Y bigint")
    terms = spark.createDataFrame([(2026, 600, 1), (2027, 600, 2)], summary.TERMS)
    got = summary.year_cells(spark.createDataFrame(rows, "year int, category string, amount bigint, institution string"), summary.entered(typed), spark.createDataFrame(codes, summary.CODES), terms)
    assert {(r["year"], r["line"], r["part"], r["col"]): (r["code"], r["units"], r["source"], r["differs"]) for r in got.collect()} == {
        (2026, "profit", "A", 1): ("500312", 700, "statements", False), (2026, "profit", "B", 1): ("500312", 50, "statements", False), (2026, "profit", None, 2): ("64040002", 140, "statements", False),
        (2026, "cards", None, 2): ("64151905", 8, "certificate_236Y", True), (2027, "profit", "A", 1): ("77", 5, "statements", False), (2027, "profit", None, 2): ("78", 0, "statements", False), (2027, "cards", None, 2): ("80", 3, "rule_42", False),
        (2026, "export_tax_expected", None, 2): (None, 10, "computed", False), (2026, "export_tax_shortfall", None, 2): (None, 6, "computed", False), (2027, "export_tax_expected", None, 2): (None, 0, "computed", False), (2027, "export_tax_shortfall", None, 2): (None, 0, "computed", False),
    }

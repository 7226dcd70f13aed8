"""Statement operators on literal vectors, and every catalogue query against its SQL."""

import datetime
import decimal
import os

import duckdb
import pandas as pd
import pytest

from ledgerlens.functions import money, text
from ledgerlens.operators import geometry, layout, matching, merge
from ledgerlens.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    if isinstance(x, pd.Timestamp):
        return x.date() if x.time() == datetime.time() else x
    if isinstance(x, (float, decimal.Decimal)) and x == int(x):
        return int(x)
    return x.item() if hasattr(x, "item") else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


AMOUNTS = {
    "1234.56": 123456, "1,234.56": 123456, "1,234": 123400, "0.01": 1, "0": 0, "12,34,567.89": 123456789, "PKR 1,234.56": 123456, "Rs. 1,234.56": 123456, "Rs1,234.56": 123456, "1,234.5": 123450, "  1,234.56  ": 123456,
    "1\u00a0234.56": 123456, "-1,234.56": -123456, "+1,234.56": 123456, "\u22121,234.56": -123456, "(1,234.56)": -123456, "1,234.56-": -123456, "99,999,999.99": 9999999999, "１，２３４．５６": 123456, "\u20a8 5": 500, "(+5)": -500,
    "": None, "   ": None, "abc": None, "1.2.3": None, "1,234.567": None, "1,23.456": None, "1,2345.00": None, "(1,234.56": None, "1,234.56)": None, "--1234": None, "1,234.56Dr": None, "1 234 56": None, "(-5)": None, "-5-": None, "a;b;c;d;e;f": None, "99999999999999999999": None,
}


def test_amounts(spark):
    df = spark.createDataFrame([(t,) for t in AMOUNTS], "t string")
    assert {r.t: r.u for r in df.select("t", money.parse(df.t).alias("u")).collect()} == AMOUNTS


def test_render_and_suffix(spark):
    df = spark.createDataFrame([(123456789, "1,200.00 Cr"), (-5, "3.00dr."), (0, "4.00")], "u bigint, t string")
    assert [r[0] for r in df.select(money.render(df.u)).collect()] == ["1,234,567.89", "-0.05", "0.00"]
    assert [r[0] for r in df.select(money.by_suffix(df.t, ("cr",), ("dr", "dr."))).collect()] == [120000, -300, None]


def test_description_uses_nfkc(spark):
    df = spark.createDataFrame([("  ﬁne  café ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalize_description(df.t)).collect()] == ["FINE CAFÉ", None]


def test_band_tie_is_null_and_text_falls_back(spark):
    bands = spark.createDataFrame([(1, "date", 0.0, 50.0, "left"), (1, "debit", 80.0, 100.0, "right"), (1, "credit", 90.0, 108.0, "right")], "doc_id int, role string, x0 double, x1 double, align string")
    words = spark.createDataFrame([(1, 1, 5.0, 30.0), (1, 2, 85.0, 101.0), (1, 3, 85.0, 104.0)], "doc_id int, word_no int, w_x0 double, w_x1 double")
    assert {r.word_no: r.role for r in geometry.assign(words, bands).collect()} == {1: "date", 2: "debit", 3: None}


def test_ambiguous_layout(spark):
    heads = spark.createDataFrame([(1, "Date,Debit", "csv"), (2, "Date,Amount", "csv"), (3, "x", "csv")], "doc_id int, head string, container string")
    profiles = spark.createDataFrame([("a", "csv", ["date"]), ("b", "csv", ["debit"])], "layout_id string, container string, tokens array<string>")
    assert {r.doc_id: (r.layout_id, r.status) for r in layout.detect(heads, profiles).collect()} == {1: (None, "ambiguous_layout"), 2: ("a", "ok"), 3: (None, "unknown_layout")}


def test_greedy_matching_is_one_to_one(spark):
    c = spark.createDataFrame([(1, 10, 0, 0), (1, 11, 0, 1), (2, 10, 0, 1), (2, 11, 5, 0)], "debit_key bigint, credit_key bigint, fee bigint, gap bigint")
    assert sorted((r.debit_key, r.credit_key) for r in matching.match_one_to_one(c).collect()) == [(1, 10), (2, 11)]


def test_greedy_matching_leaves_no_pair_of_ties_or_chains(spark):
    ties = [(d, 100 + c, 0, 0) for d in range(30) for c in range(30)]
    chain = [(1000 + k // 2, 2000 + (k + 1) // 2, k, 0) for k in range(80)]
    rows = ties + chain[::-1]
    want, used = [], (set(), set())
    for d, c, _, _ in sorted(rows, key=lambda x: (x[2], x[3], x[0], x[1])):
        if d not in used[0] and c not in used[1]:
            want.append((d, c))
            used[0].add(d)
            used[1].add(c)
    df = spark.createDataFrame(rows, "debit_key bigint, credit_key bigint, fee bigint, gap bigint")
    assert len(want) == 70
    assert sorted((r.debit_key, r.credit_key) for r in matching.match_one_to_one(df).collect()) == sorted(want)
    assert matching.match_one_to_one(df.filter("false")).count() == 0


def test_status_precedence(spark):
    c = spark.createDataFrame([("a", "gap", "warn"), ("a", "overlap", "fail"), ("b", "gap", "warn"), ("c", "continuity", "warn")], "account_id string, kind string, status string")
    assert {r.account_id: r.account_status for r in merge.account_status(c).collect()} == {"a": "failed", "b": "incomplete", "c": "complete"}

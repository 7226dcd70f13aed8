"""Cases that only larger tables have, by small tables of their own."""

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import geometry, layout, stored, tabular
from ledgerlens.plans import catalog, views


def orders(spark, folder, rows):
    """A folder with the orders (key, account, day); returns it and its SQL engine."""
    made = [(k, a, "F" if k % 2 else "O", 100.0 + k, dt.datetime.combine(day, dt.time()), "1-URGENT") for k, a, day in rows]
    spark.createDataFrame(made, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/orders.parquet/*.parquet')")
    return str(folder), con


def same(spark, con, folder, name):
    got = catalog.QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    return want


def test_an_account_without_printed_rows_has_no_ledger(spark, tmp_path):
    """The printed statements leave out every key that 97 divides."""
    folder, con = orders(spark, tmp_path, [(97, 1, dt.date(1995, 8, 1)), (98, 2, dt.date(1995, 8, 1)), (99, 2, dt.date(1996, 2, 1))])
    assert [r[0] for r in same(spark, con, folder, "account_ledger")] == [2]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_given_tables_are_made_once(spark, tmp_path):
    """What parsing reads several times is a written table, not a plan that is run again each time."""
    folder, _ = orders(spark, tmp_path, [(k, k % 4, dt.date(1995, 8, 1)) for k in range(1, 200)])
    for made in (*views.page_words(spark, folder), *views.sheets(spark, folder)):
        assert "Window" not in plan(made) and "Aggregate" not in plan(made)
    for name in ("parse_pages", "page_row_samples", "map_columns", "year_ledgers", "transfer_tiers", "transfer_candidates", "account_checks_told"):
        said = plan(catalog.QUERIES[name](spark, folder))
        assert "o_orderstatus" not in said, name


def test_words_keep_their_columns_and_lose_none(spark):
    words = spark.createDataFrame([("a", 1, 99.0, 100.0, "x"), ("b", 1, 0.0, 5.0, "y")], "doc_id string, word_no int, w_x0 double, w_x1 double, text string")
    bands = spark.createDataFrame([("a", "debit", "right", 90.0, 100.0)], "doc_id string, role string, align string, x0 double, x1 double")
    assert sorted(map(tuple, geometry.assign(words, bands, keep=("text",)).select("doc_id", "text", "role").collect())) == [("a", "x", "debit"), ("b", "y", None)]
    page = spark.createDataFrame([("a", 1, 2, 10.0, 5.0, "z"), ("a", 1, 1, 12.0, 0.0, "w")], "doc_id string, page int, word_no int, top double, x0 double, text string")
    got = geometry.group_lines(page, keep=("text", "top")).select("word_no", "line", "text", "top").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "w", 12.0), (2, 1, "z", 10.0)]


def test_written_tables_are_packed_and_leave_the_setting(spark):
    before = spark.conf.get(stored.CLEANUP, "false")
    df = stored.written(spark.range(100).groupBy("id").count())
    assert all(".zstd." in f for f in df.inputFiles()) and df.count() == 100
    assert spark.conf.get(stored.CLEANUP, "false") == before


def test_packed_tables_are_broadcast_by_their_size_in_memory(spark):
    """A million wide rows that repeat make a small file; year_ledgers broadcast such tables and ran out of the driver's memory."""
    wide, few = stored.written(spark.range(1_000_000).withColumn("said", F.lit("x" * 500))), stored.written(spark.range(10).withColumn("said", F.lit("y")))
    joined = lambda a, b: a.join(b, "id")._jdf.queryExecution().executedPlan().toString()
    other = stored.written(spark.range(2_000_000).withColumn("more", F.lit("z" * 500)))
    assert "BroadcastHashJoin" not in joined(other, wide) and "BroadcastHashJoin" in joined(other, few)


def test_headers_without_tokens_or_with_odd_cells(spark):
    """A row is found by its cells, however they are spaced and cased, and by no part of a cell."""
    rows = spark.createDataFrame([("a", 1, ["xDate", "Amount"]), ("a", 2, [None, " dAtE ", "AMOUNT"]), ("b", 1, ["any"])], "doc_id string, row_no long, cells array<string>")
    docs = spark.createDataFrame([("a", "two"), ("b", "none")], "doc_id string, layout_id string")
    profiles = spark.createDataFrame([("two", [" Date", "amount"]), ("none", [])], "layout_id string, tokens array<string>")
    assert {r["doc_id"]: r["header_row"] for r in tabular.headers(rows, docs, profiles).collect()} == {"a": 2, "b": 1}


@pytest.fixture
def one_partition(spark, monkeypatch):
    """A session whose shuffles make one partition, and tasks that should have 20 rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    monkeypatch.setattr(stored, "TASK_ROWS", 20, raising=False)
    monkeypatch.setattr(catalog, "TASK_ROWS", 20, raising=False)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_statements_are_made_in_bounded_tasks(spark, tmp_path, one_partition):
    """head_text, row_widths and all that reads sheets: no task makes more rows as the table grows, and none is lost."""
    folder, con = orders(spark, tmp_path, [(k, k % 50, dt.date(1995, 1 + k % 12, 1)) for k in range(1, 401)])
    rows = views.sheets(spark, folder)[0].filter("row_no BETWEEN 6 AND 999998")
    each = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert sum(each) == 400 and max(each) < 100
    same(spark, con, folder, "head_text")


def test_row_numbers_of_statements_are_those_of_their_windows(spark, tmp_path):
    """Also with equal days, and where an account or a day is missing."""
    folder, _ = orders(spark, tmp_path, [(k, None if k % 11 == 0 else k % 3, dt.date(1994 + k % 3, 1 + k % 12, 1)) for k in range(1, 200)])
    spark.read.parquet(f"{folder}/orders.parquet").withColumn("o_orderdate", F.expr("CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END")).write.parquet(f"{folder}/odd/orders.parquet")
    got = views.statement_txns(spark, f"{folder}/odd")
    want = views.txns(spark, f"{folder}/odd").withColumn("doc_row", F.expr("row_number() OVER (PARTITION BY account_id, doc_id ORDER BY pos)"))
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_widths_are_counted_in_bounded_tasks(spark, tmp_path, one_partition):
    folder, con = orders(spark, tmp_path, [(k, k % 50, dt.date(1995, 8, 1)) for k in range(1, 401)])
    assert catalog.row_widths(spark, folder).rdd.getNumPartitions() >= 9  # 750 rows by 80
    same(spark, con, folder, "row_widths")


def test_columns_are_mapped_in_bounded_tasks(spark, tmp_path, one_partition):
    folder, con = orders(spark, tmp_path, [(k, k % 200, dt.date(1995, 8, 1)) for k in range(1, 401)])
    assert catalog.map_columns(spark, folder).rdd.getNumPartitions() >= 10  # 200 documents by 20
    same(spark, con, folder, "map_columns")


def test_texts_are_not_sent_out_with_their_runs(spark):
    """Detection and resolution shuffled every text once for each of its runs, 7.7 GB for 0.6 million documents."""
    texts = [(k, "csv", f"text {k} of many words that no layout knows, IBAN pk{k:08d}, of the bank") for k in range(200)]
    heads = spark.createDataFrame(texts, "doc_id int, container string, head string").repartition(4)
    found = layout.detect(heads, spark.createDataFrame([("a", "csv", ["iban", "words"])], "layout_id string, container string, tokens array<string>"))
    docs = heads.select("doc_id", F.lit(None).cast("string").alias("printed"), F.col("head").alias("body"))
    own = layout.resolve_accounts(docs, spark.createDataFrame([(k, [f"PK{k:08d}"]) for k in range(100)] + [(777, ["7"])], "account_id int, identifiers array<string>"))
    said = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(container#\d+, gram#", said(found)) and re.search(r"BroadcastHashJoin \[substring\(run#.*LeftSemi", said(own))
    assert {r["layout_id"] for r in found.collect()} == {"a"}
    want = {k: k if k < 100 and "7" not in str(k) else 777 if k >= 100 and "7" in str(k) else None for k in range(200)}
    assert {r["doc_id"]: r["account_id"] for r in own.collect()} == want


def test_text_of_a_sheet_has_all_its_rows(spark, tmp_path):
    """An account of each layout; 60 rows in a half-year, of which the last are told as well as the first."""
    folder, con = orders(spark, tmp_path, [(k, k % 3, dt.date(1995, 7, 1) + dt.timedelta(days=k // 3)) for k in range(1, 181)])
    said = dict(same(spark, con, folder, "head_text"))
    assert len(said) == 3 and all(len(x.split("\n")) == 67 and x.endswith("\n ,\nTotal,1.00") for x in said.values())

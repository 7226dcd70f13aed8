"""Statement tables made from the order tables, with defects put in by rule so that every check has work."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import money
from ledgerlens.operators.profiles import PROFILE, profile
from ledgerlens.operators.stored import tasks, written

FIGURES = {
    "opening": r"(?i)Opening Balance,(?P<value>[^\n]+)", "closing": r"(?i)Closing Balance,(?P<value>[^\n]+)", "period_from": r"Period,(?P<value>[^,\n]+)", "period_to": r"Period,[^,\n]+,to,(?P<value>[^,\n]+)", "account_id": r"Statement of account,(?P<value>\d+)",
}
YEAR_START, YEAR_END = "1995-07-01", "1996-06-30"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, key, pos, date, amount, description, balance_after, doc_id: true rows, positions in printed order."""
    return _placed(_given(spark, sf_dir), "date", "key")


def statement_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txns`` and doc_row, a row's number in its statement, in tasks of bounded size.

    An account's half-years follow each other as its days do, so one sort serves the account's window and the statement's.
    """
    half = F.when(F.col("account_id").isNotNull(), F.year("date") * 2 + F.when(F.month("date") <= 6, 0).otherwise(1))  # null where doc_id is
    given = _given(spark, sf_dir)
    t = _placed(given.repartition(tasks(given), "account_id").withColumn("half", half), "half", "date", "key")
    return t.withColumn("doc_row", F.row_number().over(Window.partitionBy("account_id", "half").orderBy("date", "key"))).drop("half")


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return o.select(F.col("o_custkey").cast("bigint").alias("account_id"), F.col("o_orderkey").cast("bigint").alias("key"), F.col("o_orderdate").cast("date").alias("date"), (sign * F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("amount"), F.col("o_orderpriority").alias("description"))


def _placed(given: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy(*order)
    half = F.when(F.month("date") <= 6, 1).otherwise(2)
    t = given.withColumn("pos", F.row_number().over(w).cast("bigint")).withColumn("balance_after", F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("doc_id", F.concat(F.col("account_id").cast("string"), F.lit("-"), F.year("date").cast("string"), F.lit("H"), half.cast("string")))


def docs(true: DataFrame) -> DataFrame:
    """A half-year statement for each account, with its printed figures."""
    d = true.groupBy("account_id", "doc_id").agg(
        F.min_by(F.col("balance_after") - F.col("amount"), "pos").alias("opening"), F.max_by("balance_after", "pos").alias("s_closing"), F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), F.lit(0)).alias("s_credit"),
        F.coalesce(-F.sum(F.when(F.col("amount") < 0, F.col("amount"))), F.lit(0)).alias("s_debit"), F.min("date").alias("day"), F.count_if(F.col("key") % 89 == 0).cast("bigint").alias("unresolved"),
    )
    start = F.make_date(F.year("day"), F.when(F.month("day") <= 6, 1).otherwise(7), F.lit(1))
    end = F.date_sub(F.add_months(start, 6), 1)
    d = d.withColumn("s_start", start).withColumn("s_end", end).withColumn("s_opening", F.when(F.col("account_id") % 13 != 0, F.col("opening")))
    return d.drop("opening", "day")


def printed(true: DataFrame) -> DataFrame:
    """The rows as the statements print them: some are missing, some have the wrong sign."""
    return true.filter("key % 97 <> 0").withColumn("amount", F.when(F.col("key") % 101 == 0, -F.col("amount")).otherwise(F.col("amount")))


def sliding(stmt: DataFrame) -> DataFrame:
    """Statements whose periods reach 20 days into the next half-year, numbered as files; some come as pages."""
    w = Window.partitionBy("account_id").orderBy("doc_id")
    return stmt.select("account_id", "doc_id", F.col("s_start").alias("doc_start"), F.date_add("s_end", 20).alias("doc_end"), F.when(F.col("account_id") % 3 == 0, "pdf").otherwise("csv").alias("container"), F.row_number().over(w).cast("bigint").alias("file_seq"))


PROFILES = [
    profile("columns.v1", "csv", ["Date", "Debit", "Credit"], {"date": "Date", "description": ["Narration", "Particulars"], "debit": "Debit", "credit": "Credit", "balance": "Balance"}, ["d/M/yyyy"], "columns", skip=("^Total,",), patterns=FIGURES),
    profile("suffix.v1", "csv", ["Date", "Particulars", "Amount"], {"date": "Date", "description": "Particulars", "amount": "Amount", "balance": "Balance"}, ["yyyy-MM-dd", "d MMM yyyy"], "suffix", credit_tokens=("Cr.", "Cr"), debit_tokens=("Dr",), skip=("^Total,",), patterns=FIGURES),
    profile("signed.v1", "csv", ["booking date", "amount"], {"date": "Booking Date", "description": "Description", "amount": "Amount", "balance": "Balance", "reference": "Ref"}, ["d MMM yyyy"], "signed", summary=("^Total,",), patterns=FIGURES),
]


def sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, docs): the statements as ragged sheets of three layouts; some dates and amounts can't be read."""
    t = statement_txns(spark, sf_dir)
    d = written(docs(t)).withColumn("kind", F.col("account_id") % 3)
    layout = F.when(F.col("kind") == 0, "columns.v1").when(F.col("kind") == 1, "suffix.v1").otherwise("signed.v1")
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    cells = lambda *c: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    head = F.when(F.col("kind") == 0, cells("Date", " Debit ", "CREDIT", "Particulars", "Balance")).when(F.col("kind") == 1, cells("Date", "Particulars", "Amount", "Balance")).otherwise(cells("Booking Date", "Description", "Balance", "Amount", "Amount "))
    formats = lambda c: F.when(F.col("kind") == 0, day(c)).when(F.col("kind") == 1, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "d MMM yyyy"))
    top = F.array(
        cells("Statement of account", F.col("account_id").cast("string")), F.when(F.col("s_opening").isNull(), cells("Welcome")).otherwise(cells("Opening Balance", F.concat(F.when(F.col("s_opening") < 0, "-").otherwise(""), F.lit("PKR "), money.render(F.abs("s_opening"))))),
        cells("Closing Balance", money.render(F.col("s_closing"))), cells("Period", formats(F.col("s_start")), "to", formats(F.col("s_end"))), head,
    )
    above = d.select("doc_id", F.posexplode(top).alias("k", "cells")).select("doc_id", (F.col("k") + 1).cast("bigint").alias("row_no"), "cells")
    t = t.withColumn("row_no", (F.col("doc_row") + 5).cast("bigint")).withColumn("kind", F.col("account_id") % 3)
    when = F.when(F.col("key") % 89 == 0, "n/a").when(F.col("key") % 83 == 0, "31/31/1995").otherwise(formats("date"))
    size, balance = money.render(F.abs("amount")), money.render(F.col("balance_after"))
    size = F.when(F.col("key") % 79 == 0, "12.345").otherwise(size)
    sign = F.col("amount") < 0
    body = (
        F.when(F.col("kind") == 0, F.when(F.col("key") % 73 == 0, cells(when, size, size, F.col("description"), balance)).otherwise(cells(when, F.when(sign, size).otherwise("-"), F.when(sign, "").otherwise(size), F.col("description"), balance)))
        .when(F.col("kind") == 1, cells(when, F.col("description"), F.concat(size, F.when(F.col("key") % 71 == 0, "").when(sign, "Dr").otherwise(" Cr.")), balance))
        .otherwise(cells(when, F.col("description"), balance, "unused", F.concat(F.when(sign, "-").otherwise(""), size)))
    )
    end = d.select("doc_id", F.lit(1_000_000).cast("bigint").alias("row_no"), cells("Total", "1.00").alias("cells"))
    blank = d.select("doc_id", F.lit(999_999).cast("bigint").alias("row_no"), cells(" ", "").alias("cells"))
    rows = above.unionByName(t.select("doc_id", "row_no", body.alias("cells"))).unionByName(end).unionByName(blank)
    # tables, as they would be given; parsing reads them several times
    return written(rows), written(d.select("doc_id", "account_id", layout.alias("layout_id")))


PAGES = profile("pages.v1", "pdf", ["Date", "Debit"], {"date": "Date", "description": "Details", "debit": "Debit", "credit": "Credit", "balance": "Balance"}, ["d/M/yyyy"], "columns", skip=("^Page ",), footer=("^End of page",), patterns={"opening": r"Opening (?P<value>\S+)"})


def page_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(words, docs): the statements of every third account as positioned words, thirty rows a page; every fifth row has a second line."""
    t = statement_txns(spark, sf_dir).filter("account_id % 3 = 0")
    word = lambda text, x0, x1, top: F.struct((text if isinstance(text, Column) else F.lit(text)).alias("text"), F.lit(x0).cast("double").alias("x0") if not isinstance(x0, Column) else x0.cast("double").alias("x0"), F.lit(x1).cast("double").alias("x1") if not isinstance(x1, Column) else x1.cast("double").alias("x1"), top.cast("double").alias("top"))
    k = F.col("k")
    rows = t.withColumn("k", F.col("doc_row") - 1).withColumn("page", F.floor(k / 30).cast("int") + 1)
    top, size, sign = F.lit(100) + (k % 30) * 12, money.render(F.abs("amount")), F.col("amount") < 0
    said = F.transform(F.split("description", " "), lambda w, i: F.struct(w.alias("text"), (60 + 40 * i).cast("double").alias("x0"), (95 + 40 * i).cast("double").alias("x1"), top.cast("double").alias("top")))
    day = word(F.date_format("date", "dd/MM/yyyy"), 0, 40, top)
    amount = F.when(sign, word(size, 165, 200, top)).otherwise(word(size, 230, 262, top))
    more = F.when(F.col("key") % 5 == 0, F.array(word("more", 60, 80, top + 5))).otherwise(F.array(word("Page", 0, 20, top + 5)))
    # the first row of a page brings its footer along
    foot = F.when(k % 30 == 0, F.array(word("End", 0, 10, F.lit(900)), word("of", 12, 20, F.lit(900)), word("page", 22, 40, F.lit(900)))).otherwise(F.slice(more, 1, 0))
    body = rows.select("doc_id", "page", F.explode(F.concat(F.array(day), said, F.array(amount, word(money.render(F.col("balance_after")), 290, 330, top)), more, foot)).alias("w"))
    at = lambda y: F.lit(y)
    head = F.array(word("Opening", 0, 30, at(10)), word(money.render(F.col("s_opening")), 40, 80, at(10)), *[word(n, a, b, at(50)) for n, a, b in (("Date", 0, 20), ("Details", 60, 90), ("Debit", 180, 200), ("Credit", 240, 262), ("Balance", 300, 330))])
    d = written(docs(t).withColumn("layout_id", F.lit("pages.v1")))
    top_words = d.filter("s_opening IS NOT NULL").select("doc_id", F.lit(1).alias("page"), F.explode(head).alias("w"))
    bare = d.filter("s_opening IS NULL").select("doc_id", F.lit(1).alias("page"), F.explode(F.slice(head, 3, 5)).alias("w"))
    words = body.unionByName(top_words).unionByName(bare).select("doc_id", "page", "w.*")
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("top", "x0", "text"))
    # tables, as they would be given; parsing reads them several times
    return written(words.withColumn("word_no", number)), d.select("doc_id", "account_id", "layout_id")


def folder(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, rows, words, accounts, assigned): the statements as the files of one folder, each with its IBAN.

    Every third account comes as pages, others as sheets. Some files are there
    twice, some accounts are in no registry, some of their files are assigned by
    hand, one layout ends before some statements, and some pages hold glyphs only.
    """
    rows, sheet_docs = sheets(spark, sf_dir)
    words, _ = page_words(spark, sf_dir)
    iban = F.concat(F.lit("PK"), F.lpad(F.col("account_id").cast("string"), 8, "0"))
    rows = rows.join(sheet_docs.filter("account_id % 3 <> 0").select("doc_id"), "doc_id", "left_semi").unionByName(sheet_docs.filter("account_id % 3 <> 0").select("doc_id", F.lit(0).cast("bigint").alias("row_no"), F.array(F.lit("IBAN"), iban).alias("cells")))
    text = F.explode(F.array(F.struct(F.lit("IBAN").alias("text"), F.lit(0.0).alias("x0")), F.struct(iban.alias("text"), F.lit(40.0).alias("x0"))))
    stamp = sheet_docs.filter("account_id % 3 = 0").select("doc_id", F.lit(1).alias("page"), text.alias("t")).select("doc_id", "page", "t.text", "t.x0", (F.col("t.x0") + 30).alias("x1"), F.lit(2.0).alias("top"), (F.col("t.x0").cast("int") - 1000).alias("word_no"))
    words = words.unionByName(stamp)
    words = words.withColumn("text", F.when((F.substring_index("doc_id", "-", 1).cast("bigint") % 15 == 0) & (F.col("text") == "Details"), "(cid:7)").otherwise(F.col("text")))
    files = sheet_docs.select("doc_id", "account_id", F.when(F.col("account_id") % 3 == 0, "pdf").otherwise("csv").alias("container"), F.explode(F.when(F.col("account_id") % 10 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("copy"))
    files = files.select("doc_id", "account_id", "container", F.concat("doc_id", F.lit("."), F.col("copy")).alias("name"), (F.col("copy") == "b").alias("duplicate"))
    files = files.withColumn("file_seq", F.row_number().over(Window.partitionBy("account_id").orderBy("name")).cast("bigint"))
    known = sheet_docs.select("account_id").distinct()
    accounts = known.filter("account_id % 7 <> 0").select(F.col("account_id").cast("string").alias("account_id"), F.array(iban).alias("identifiers"))
    assigned = files.filter("account_id % 14 = 0").select("name", (F.col("account_id") - 1).cast("string").alias("account_id"))
    return files.drop("account_id"), rows, words, accounts, assigned


#: The layouts of ``folder``: one ended in 1996, one can't be used.
LAYOUTS = [PROFILES[0], (*PROFILES[1][:-1], date(1996, 6, 30)), PROFILES[2], PAGES, ("broken.v1", None, "csv", ["Date"], "(unclosed", *PROFILES[0][5:])]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE)


def twice_printed(true: DataFrame) -> DataFrame:
    """doc_id, account_id, key, pos, ...: rows of the first 20 days of a half-year are also printed by the half-year before, if it has a statement; some copies have another amount."""
    here = true.select("account_id", "doc_id").distinct()
    start = F.make_date(F.year("date"), F.when(F.month("date") <= 6, 1).otherwise(7), F.lit(1))
    before = F.date_sub(start, 1)
    name = F.concat(F.col("account_id").cast("string"), F.lit("-"), F.year(before).cast("string"), F.lit("H"), F.when(F.month(before) <= 6, "1").otherwise("2"))
    copies = true.filter(F.datediff("date", start) < 20).withColumn("doc_id", name).join(here, ["account_id", "doc_id"], "left_semi")
    copies = copies.withColumn("amount", F.when(F.col("key") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")))
    return true.unionByName(copies.select(*true.columns))


SQL = """
t0 AS (
  SELECT CAST(o_custkey AS BIGINT) AS account_id, CAST(o_orderkey AS BIGINT) AS key, CAST(o_orderdate AS DATE) AS date,
         (CASE o_orderstatus WHEN 'F' THEN -1 ELSE 1 END) * CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderpriority AS description FROM orders),
true_rows AS (
  SELECT *, CAST(row_number() OVER w AS BIGINT) AS pos, CAST(sum(amount) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after,
         account_id || '-' || year(date) || 'H' || (CASE WHEN month(date) <= 6 THEN 1 ELSE 2 END) AS doc_id
  FROM t0 WINDOW w AS (PARTITION BY account_id ORDER BY date, key)),
docs AS (
  SELECT account_id, doc_id, CASE WHEN account_id % 13 <> 0 THEN min_by(balance_after - amount, pos) END AS s_opening, max_by(balance_after, pos) AS s_closing,
         CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS BIGINT) AS s_credit, CAST(coalesce(-sum(amount) FILTER (amount < 0), 0) AS BIGINT) AS s_debit,
         CAST(count(*) FILTER (key % 89 = 0) AS BIGINT) AS unresolved,
         make_date(year(min(date)), CASE WHEN month(min(date)) <= 6 THEN 1 ELSE 7 END, 1) AS s_start,
         CAST(make_date(year(min(date)), CASE WHEN month(min(date)) <= 6 THEN 1 ELSE 7 END, 1) + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS s_end
  FROM true_rows GROUP BY account_id, doc_id),
txns AS (SELECT * REPLACE (CASE WHEN key % 101 = 0 THEN -amount ELSE amount END AS amount) FROM true_rows WHERE key % 97 <> 0),
slid AS (
  SELECT account_id, doc_id, s_start AS doc_start, CAST(s_end + INTERVAL 20 DAY AS DATE) AS doc_end, CASE WHEN account_id % 3 = 0 THEN 'pdf' ELSE 'csv' END AS container,
         CAST(row_number() OVER (PARTITION BY account_id ORDER BY doc_id) AS BIGINT) AS file_seq FROM docs),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY doc_start, container = 'pdf', -date_diff('day', doc_start, doc_end), file_seq) AS BIGINT) AS doc_rank FROM slid),
bal AS (
  SELECT *, balance_after <> coalesce(lag(balance_after) OVER (PARTITION BY doc_id ORDER BY pos), s_opening) + amount AS bad FROM txns JOIN docs USING (doc_id, account_id)),
rb AS (
  SELECT doc_id, CAST(count(*) FILTER (coalesce(bad, false)) AS BIGINT) AS breaks, min(pos) FILTER (bad) AS first_break,
         CASE WHEN count(*) FILTER (coalesce(bad, false)) > 0 THEN 'fail' WHEN max(s_opening) IS NULL THEN 'warn' ELSE 'pass' END AS status FROM bal GROUP BY doc_id),
f AS (
  SELECT d.*, n, net, credit, debit, first_day, last_day, coalesce(rb.status, 'warn') AS running_balance
  FROM docs d LEFT JOIN rb USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n, sum(amount) AS net, coalesce(sum(amount) FILTER (amount > 0), 0) AS credit, coalesce(-sum(amount) FILTER (amount < 0), 0) AS debit, min(date) AS first_day, max(date) AS last_day FROM txns GROUP BY doc_id) USING (doc_id)),
c1 AS (
  SELECT *, CASE WHEN s_opening IS NULL OR s_closing IS NULL THEN 'warn' WHEN s_opening + coalesce(net, 0) = s_closing THEN 'pass' ELSE 'fail' END AS opening_closing,
         CASE WHEN s_credit = coalesce(credit, 0) AND s_debit = coalesce(debit, 0) THEN 'pass' ELSE 'fail' END AS printed_totals,
         CASE WHEN unresolved = 0 THEN 'pass' ELSE 'fail' END AS unresolved_rows,
         CASE WHEN n IS NULL OR s_start IS NULL OR s_end IS NULL THEN 'warn' WHEN first_day >= s_start AND last_day <= s_end THEN 'pass' ELSE 'fail' END AS date_range FROM f),
c2 AS (SELECT *, CASE WHEN 'pass' NOT IN (running_balance, opening_closing, printed_totals) THEN 'fail' END AS nothing_verified FROM c1),
checks AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS check_seq, 'running_balance' AS kind, running_balance AS status FROM c2 UNION ALL SELECT doc_id, 2, 'opening_closing', opening_closing FROM c2
  UNION ALL SELECT doc_id, 3, 'printed_totals', printed_totals FROM c2 UNION ALL SELECT doc_id, 4, 'nothing_verified', nothing_verified FROM c2 WHERE nothing_verified IS NOT NULL
  UNION ALL SELECT doc_id, 5, 'unresolved_rows', unresolved_rows FROM c2 UNION ALL SELECT doc_id, 6, 'date_range', date_range FROM c2),
claims AS (
  SELECT x.doc_id, pos, min(e.doc_rank) AS claimed_by FROM true_rows x JOIN ranked r USING (doc_id, account_id)
  JOIN ranked e ON e.account_id = x.account_id AND e.doc_rank < r.doc_rank AND x.date BETWEEN e.doc_start AND e.doc_end AND x.date BETWEEN r.doc_start AND r.doc_end GROUP BY x.doc_id, pos)
"""

#: The rows of ``sheets`` and why each can't be read (null: it can).
SHEETS = """
sh AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) + 5 AS BIGINT) AS row_no,
         CASE WHEN key % 89 = 0 THEN 'row has no date' WHEN key % 83 = 0 THEN 'unreadable date' WHEN account_id % 3 = 0 AND key % 73 = 0 THEN 'row has amounts in both columns'
              WHEN account_id % 3 = 1 AND key % 71 = 0 THEN 'amount has no direction token' WHEN key % 79 = 0 THEN 'unreadable amount' END AS reason
  FROM true_rows)
"""
#: The rows of ``twice_printed`` under sliding periods, and which earlier statement claims each.
TWICE = """
tw AS (
  SELECT account_id, doc_id, key, pos, date, amount, balance_after, description FROM true_rows UNION ALL
  SELECT account_id, prev, key, pos, date, amount + CASE WHEN key % 7 = 0 THEN 1 ELSE 0 END, balance_after, description FROM (
    SELECT *, account_id || '-' || year(b) || 'H' || (CASE WHEN month(b) <= 6 THEN 1 ELSE 2 END) AS prev FROM (
      SELECT *, CAST(make_date(year(date), CASE WHEN month(date) <= 6 THEN 1 ELSE 7 END, 1) - INTERVAL 1 DAY AS DATE) AS b FROM true_rows) WHERE date_diff('day', b, date) <= 20) c
  WHERE prev IN (SELECT doc_id FROM docs)),
twc AS (
  SELECT x.*, r.doc_rank, r.doc_start, r.doc_end, cl.claimed_by FROM tw x JOIN ranked r USING (doc_id, account_id) LEFT JOIN (
    SELECT x.doc_id, x.pos, min(e.doc_rank) AS claimed_by FROM tw x JOIN ranked r USING (doc_id, account_id)
    JOIN ranked e ON e.account_id = x.account_id AND e.doc_rank < r.doc_rank AND x.date BETWEEN e.doc_start AND e.doc_end AND x.date BETWEEN r.doc_start AND r.doc_end GROUP BY 1, 2) cl ON cl.doc_id = x.doc_id AND cl.pos = x.pos)
"""

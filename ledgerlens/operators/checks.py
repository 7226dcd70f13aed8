"""Proofs of a statement: each returns rows (doc_id, kind, status) or a measure by document.

txns: doc_id, pos, date, amount, balance_after. docs: doc_id and printed
figures s_opening, s_closing, s_credit, s_debit, s_start, s_end, unresolved.
Every window orders by the printed position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import money

KINDS = ("running_balance", "opening_closing", "printed_totals", "nothing_verified", "unresolved_rows", "date_range")


def occurrence(txns: DataFrame, *keys: str) -> DataFrame:
    """Adds ``occurrence``: which one of equal rows of a document this is, in printed order."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return txns.withColumn("occurrence", F.row_number().over(w).cast("bigint"))


def running_balance(txns: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, breaks, first_break (position), status, at_break (expected, printed), last_balance: each balance against the one before plus the amount."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = txns.filter("balance_after IS NOT NULL").join(docs.select("doc_id", "s_opening"), "doc_id")
    before = F.coalesce(F.lag("balance_after").over(w), F.col("s_opening"))
    rows = rows.withColumn("bad", F.coalesce(before + F.col("amount") != F.col("balance_after"), F.lit(False)))
    rows = rows.withColumn("expected", before + F.col("amount"))
    found = rows.groupBy("doc_id").agg(
        F.count_if("bad").cast("bigint").alias("breaks"), F.min(F.when(F.col("bad"), F.col("pos"))).alias("first_break"), F.max("s_opening").alias("anchor"),
        F.min_by(F.struct("expected", F.col("balance_after").alias("printed")), F.when(F.col("bad"), F.col("pos"))).alias("at_break"), F.max_by("balance_after", "pos").alias("last_balance"),
    )
    status = F.when(F.col("breaks") > 0, "fail").when(F.col("anchor").isNull(), "warn").otherwise("pass")
    return found.select("doc_id", "breaks", "first_break", status.alias("status"), "at_break", "last_balance")


def sums(txns: DataFrame) -> DataFrame:
    amount = F.col("amount")
    return txns.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(amount).alias("net"), F.coalesce(F.sum(F.when(amount > 0, amount)), F.lit(0)).alias("credit"), F.coalesce(-F.sum(F.when(amount < 0, amount)), F.lit(0)).alias("debit"),
        F.min("date").alias("first_day"), F.max("date").alias("last_day"),
    )


def figures(txns: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each document with its sums, and with what each check says of it (null: no row)."""
    d = docs.join(sums(txns), "doc_id", "left").join(running_balance(txns, docs).select("doc_id", F.col("status").alias("running_balance"), "first_break", "at_break", "last_balance"), "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = F.col("s_opening").isNotNull() & F.col("s_closing").isNotNull()
    ok = lambda c: F.when(c, "pass").otherwise("fail")
    d = d.withColumn("opening_closing", F.when(~both, "warn").otherwise(ok(F.col("s_opening") + zero("net") == F.col("s_closing"))))
    totals = (F.col("s_credit").isNull() | (F.col("s_credit") == zero("credit"))) & (F.col("s_debit").isNull() | (F.col("s_debit") == zero("debit")))
    d = d.withColumn("printed_totals", F.when(F.col("s_credit").isNull() & F.col("s_debit").isNull(), None).otherwise(ok(totals)))
    passed = reduce(Column.__or__, [F.coalesce(F.col(k) == "pass", F.lit(False)) for k in KINDS[:3]])
    # a check that passed says so itself; only the lack of any proof is a row of its own
    d = d.withColumn("nothing_verified", F.when(~passed, "fail")).withColumn("running_balance", F.coalesce("running_balance", F.lit("warn")))
    if "running" in docs.columns:  # a layout without a balance column has no chain to prove
        d = d.withColumn("running_balance", F.when(F.col("running"), F.col("running_balance")))
    d = d.withColumn("unresolved_rows", ok(F.coalesce(F.col("unresolved"), F.lit(0)) == 0))
    inside = (F.col("first_day") >= F.col("s_start")) & (F.col("last_day") <= F.col("s_end"))
    return d.withColumn("date_range", F.when(F.col("s_start").isNull() | F.col("s_end").isNull() | F.col("n").isNull(), "warn").otherwise(ok(inside)))


def all_checks(txns: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, check_seq, kind, status in the fixed order of KINDS; checks that don't apply have no row."""
    pairs = F.array(*[F.struct(F.lit(k + 1).cast("bigint").alias("check_seq"), F.lit(name).alias("kind"), F.col(name).alias("status")) for k, name in enumerate(KINDS)])
    return figures(txns, docs).select("doc_id", F.inline(pairs)).filter("status IS NOT NULL")


def signs_from_balance(txns: DataFrame, per: str = "doc_id", opening: str | None = None) -> DataFrame:
    """txns whose amounts print no direction, with ``amount`` signed as the balance moves, ``sign_source`` (balance) and ``warning``.

    A row whose balance does not move by its amount, up or down, or that has no
    balance before it, keeps no amount and is warned about. ``opening``: a column
    with the balance before the first row.
    """
    w = Window.partitionBy(per).orderBy("pos")
    before = F.lag("balance_after").over(w) if opening is None else F.when(F.row_number().over(w) == 1, F.col(opening)).otherwise(F.lag("balance_after").over(w))
    moved = txns.withColumn("moved", F.col("balance_after") - before)
    fits = F.abs("moved") == F.abs("amount")
    warning = F.when(F.col("moved").isNull(), "no balance before it").when(~fits, "the balance does not move by the amount")
    return moved.withColumn("warning", warning).withColumn("amount", F.when(fits, F.col("moved"))).withColumn("sign_source", F.when(fits, "balance")).drop("moved")


def failed(checks: DataFrame) -> DataFrame:
    return checks.filter("status = 'fail'")


def warned(checks: DataFrame) -> DataFrame:
    return checks.filter("status = 'warn'")


def usable(checks: DataFrame) -> DataFrame:
    return checks.groupBy("doc_id").agg((~F.bool_or(F.col("status") == "fail")).alias("usable"))


def outside_period(txns: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, outside, first_outside (date), first_pos of the rows outside the printed period, in printed order."""
    rows = txns.join(docs.select("doc_id", "s_start", "s_end"), "doc_id").filter(~F.col("date").between(F.col("s_start"), F.col("s_end")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("outside"), F.min_by("date", "pos").alias("first_outside"), F.min("pos").alias("first_pos"))


def described(txns: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, kind, status, expected, actual, locator: the checks with what they compared, as text, and where they broke.

    Of several faults the first in printed order is told. ``first_unresolved``
    (reason, locator) of docs, if there, tells where the first unread row is.
    """
    d = figures(txns, docs).join(outside_period(txns, docs), "doc_id", "left")
    shown, at = money.render, lambda pos: F.concat(F.lit("row:"), pos.cast("string"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # a total that is not printed, or printed as zero, is told by what was read
    printed = lambda c, read: F.when(zero(c) != 0, F.col(c)).otherwise(zero(read))
    both = lambda credit, debit: F.concat(F.lit("credits "), shown(credit), F.lit(" / debits "), shown(debit))
    period = F.concat(F.col("s_start").cast("string"), F.lit(".."), F.col("s_end").cast("string"))
    lost = "first_unresolved" in docs.columns
    none, broke, dated = F.lit(None).cast("string"), F.col("running_balance") == "fail", F.col("date_range") != "warn"
    told = {
        "running_balance": (F.when(broke, shown(F.col("at_break.expected"))).otherwise(F.coalesce(shown(F.col("last_balance")), F.lit("a balance column"))), F.when(broke, shown(F.col("at_break.printed"))).otherwise(F.coalesce(shown(F.col("last_balance")), F.lit("none"))), F.when(broke, at(F.col("first_break")))),
        "opening_closing": (F.when(F.col("opening_closing") == "warn", "printed opening and closing").otherwise(shown(F.col("s_closing"))), F.when(F.col("opening_closing") == "warn", "not both printed").otherwise(shown(F.col("s_opening") + zero("net"))), none),
        "printed_totals": (both(printed("s_credit", "credit"), printed("s_debit", "debit")), both(zero("credit"), zero("debit")), none),
        "nothing_verified": (F.lit("running_balance, opening_closing or printed_totals to pass"), F.lit("none of them did"), none),
        "unresolved_rows": (F.lit("0"), zero("unresolved").cast("string"), F.col("first_unresolved.locator") if lost else none),
        "date_range": (F.when(dated, period).otherwise("a printed period"), F.when(F.col("date_range") == "fail", F.col("first_outside").cast("string")).when(dated, period).otherwise("not printed"), F.when(F.col("date_range") == "fail", at(F.col("first_pos")))),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("status"), *[c.alias(n) for c, n in zip(told[k], ("expected", "actual", "locator"), strict=True)]) for k in KINDS])
    return d.select("doc_id", F.inline(rows)).filter("status IS NOT NULL")

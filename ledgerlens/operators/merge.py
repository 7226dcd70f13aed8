"""Merging statements of an account: order, overlaps, gaps, continuity, boundaries, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import money
from ledgerlens.operators.stored import written


def _day(day: str | Column) -> Column:
    return day if isinstance(day, Column) else F.lit(day).cast("date")


def rank_statements(docs: DataFrame) -> DataFrame:
    """Adds ``doc_rank``: earlier start, then sheets before pages, then the longer period, then file order."""
    start = F.coalesce("doc_start", F.to_date(F.lit("0001-01-01")))
    kind = F.when(F.col("container") == "pdf", 1).otherwise(0)
    w = Window.partitionBy("account_id").orderBy(start, kind, F.datediff("doc_start", "doc_end"), "file_seq")
    return docs.withColumn("doc_rank", F.row_number().over(w).cast("bigint"))


def claim_overlaps(txns: DataFrame, ranked: DataFrame) -> DataFrame:
    """txns (with doc_rank, account_id) and ``claimed_by``: the lowest-ranked earlier statement that covers the row, else null.

    A range join inside the account; both periods must hold the day.
    """
    d = ranked.filter("doc_start IS NOT NULL AND doc_end IS NOT NULL")
    own = txns.join(ranked.select("doc_id", "account_id", "doc_rank", "doc_start", "doc_end"), "doc_id")
    earlier = d.select(F.col("account_id").alias("e_account"), F.col("doc_rank").alias("e_rank"), F.col("doc_start").alias("e_start"), F.col("doc_end").alias("e_end"))
    day = F.col("date")
    hit = (F.col("account_id") == F.col("e_account")) & (F.col("e_rank") < F.col("doc_rank")) & day.between(F.col("e_start"), F.col("e_end")) & day.between(F.col("doc_start"), F.col("doc_end"))
    claims = own.join(earlier, hit).groupBy("doc_id", "pos").agg(F.min("e_rank").alias("claimed_by"))
    return own.join(claims, ["doc_id", "pos"], "left")


def overlap_checks(claimed: DataFrame, ranked: DataFrame) -> DataFrame:
    """doc_id, claimed_by, lo, hi, existing, incoming, status: whether two statements tell the same of the days that both cover.

    claimed: rows of ``claim_overlaps``. The rows that a statement loses to an
    earlier one, in printed order, are held against the rows kept so far for
    these days; a row is its date, amount, balance and description. Both sides
    are numbered and joined by number, so no list of rows is built.
    """
    pair = ranked.select(F.col("account_id").alias("e_account"), F.col("doc_rank").alias("claimed_by"), F.col("doc_start").alias("e_start"), F.col("doc_end").alias("e_end"))
    lost = claimed.filter("claimed_by IS NOT NULL").select("doc_id", "claimed_by", "account_id", "doc_rank", "doc_start", "doc_end").distinct()
    windows = lost.join(pair, (F.col("account_id") == F.col("e_account")) & lost["claimed_by"].eqNullSafe(pair["claimed_by"])).select(
        "doc_id", lost["claimed_by"], "account_id", "doc_rank", F.greatest("doc_start", "e_start").alias("lo"), F.least("doc_end", "e_end").alias("hi")
    )
    key = F.struct("date", "amount", "balance_after", F.upper(F.trim("description")).alias("description")).alias("key")
    incoming = claimed.filter("claimed_by IS NOT NULL").select("doc_id", "claimed_by", F.lit(0).cast("bigint").alias("o_rank"), "pos", key, F.lit("in").alias("side"))
    kept = claimed.filter("claimed_by IS NULL").select(F.col("account_id").alias("k_account"), F.col("doc_rank").alias("o_rank"), "pos", "date", key)
    inside = (F.col("account_id") == F.col("k_account")) & (F.col("o_rank") < F.col("doc_rank")) & F.col("date").between(F.col("lo"), F.col("hi"))
    existing = windows.join(kept, inside).select("doc_id", "claimed_by", "o_rank", "pos", "key", F.lit("kept").alias("side"))
    number = Window.partitionBy("doc_id", "claimed_by", "side").orderBy("o_rank", "pos")
    both = incoming.unionByName(existing).withColumn("k", F.row_number().over(number))
    by_row = both.groupBy("doc_id", "claimed_by", "k").agg(F.count("*").alias("n"), F.min("key").eqNullSafe(F.max("key")).alias("same"), F.count_if(F.col("side") == "in").alias("i"))
    found = by_row.groupBy("doc_id", "claimed_by").agg(F.bool_and((F.col("n") == 2) & F.col("same")).alias("same"), F.sum("i").alias("incoming"), F.sum(F.col("n") - F.col("i")).alias("existing"))
    status = F.when(F.col("same"), "pass").otherwise("fail")
    return windows.join(found, ["doc_id", "claimed_by"]).select("doc_id", "account_id", "claimed_by", "lo", "hi", "existing", "incoming", status.alias("status"))


def gaps(docs: DataFrame, start: str | Column, end: str | Column, accounts: DataFrame | None = None) -> DataFrame:
    """account_id, gap_start, gap_end: days of the window that no statement covers.

    With accounts (account_id, opened_on, closed_on) the window of each is cut to the days it was open. start and end may
    be columns of accounts, for a window of each account's own.
    """
    first, last = _day(start), _day(end)
    d = docs.filter("doc_start IS NOT NULL AND doc_end IS NOT NULL").select("account_id", "doc_start", "doc_end", "doc_id")
    if accounts is not None:
        d = d.join(accounts, "account_id", "left")
        first, last = F.greatest(first, F.coalesce("opened_on", first)), F.least(last, F.coalesce("closed_on", last))
    d = d.select("account_id", "doc_start", "doc_end", "doc_id", first.alias("w_start"), last.alias("w_end"))
    w = Window.partitionBy("account_id").orderBy("doc_start", "doc_end", "doc_id")
    tail = d.groupBy("account_id").agg(F.first("w_start").alias("w_start"), F.first("w_end").alias("w_end")).select("account_id", F.date_add("w_end", 1).alias("doc_start"), F.date_add("w_end", 1).alias("doc_end"), F.lit("~").alias("doc_id"), "w_start", "w_end")
    rows = d.withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(tail)
    sofar = F.date_add(F.max("doc_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 1)
    rows = rows.withColumn("gap_start", F.greatest("w_start", sofar)).withColumn("gap_end", F.least(F.date_sub("doc_start", 1), F.col("w_end")))
    return rows.filter("gap_start <= gap_end").select("account_id", "gap_start", "gap_end")


def gap_checks(docs: DataFrame, start: str | Column, end: str | Column, accounts: DataFrame | None = None) -> DataFrame:
    """account_id, kind, status, gap_days: warn where days of the year lack a statement, or where no statement has a period."""
    lost = gaps(docs, start, end, accounts).groupBy("account_id").agg(F.sum(F.datediff("gap_end", "gap_start") + 1).alias("gap_days"))
    known = docs.groupBy("account_id").agg(F.bool_or(F.col("doc_start").isNotNull() & F.col("doc_end").isNotNull()).alias("dated"))
    out = known.join(lost, "account_id", "left")
    return out.select("account_id", F.lit("gap").alias("kind"), F.when(F.col("dated") & F.col("gap_days").isNull(), "pass").otherwise("warn").alias("status"), F.coalesce("gap_days", F.lit(0)).alias("gap_days"))


def seams(docs: DataFrame) -> DataFrame:
    """account_id, doc_id, next_doc, next_start, s_closing, next_opening: where a statement begins on the day after another ends."""
    w = Window.partitionBy("account_id").orderBy("doc_start", "doc_end", "doc_id")
    d = docs.filter("doc_start IS NOT NULL AND doc_end IS NOT NULL")
    d = d.withColumn("next_start", F.lead("doc_start").over(w)).withColumn("next_opening", F.lead("s_opening").over(w)).withColumn("next_doc", F.lead("doc_id").over(w)).filter(F.col("next_start") == F.date_add("doc_end", 1))
    return d.select("account_id", "doc_id", "next_doc", "next_start", "s_closing", "next_opening")


def _meets(closing: str = "s_closing", opening: str = "next_opening") -> Column:
    same = F.col(closing) == F.col(opening)
    return F.when(same.isNull(), "warn").when(same, "pass").otherwise("fail")


def balance_continuity(docs: DataFrame) -> DataFrame:
    """account_id, doc_id, next_start, status: a closing balance against the next statement's opening, where no day lies between."""
    return seams(docs).select("account_id", "doc_id", "next_start", _meets().alias("status"))


def described(docs: DataFrame, start: str, end: str, accounts: DataFrame | None = None, overlaps: DataFrame | None = None, ledgers: DataFrame | None = None) -> DataFrame:
    """account_id, doc_id, kind, status, expected, actual: the checks of accounts with what they compared, as text.

    overlaps: ``overlap_checks``. ledgers: account_id, opening, opening_source,
    closing_source, prior_closing. doc_id is the statement that a check starts
    from, null for checks of the whole account.
    """
    shown, none = money.render, F.lit(None).cast("string")
    row = lambda doc, kind, status, expected, actual: (F.col("account_id"), doc.cast("string").alias("doc_id"), F.lit(kind).alias("kind"), status.alias("status"), expected.alias("expected"), actual.alias("actual"))
    status = _meets()
    unknown = status == "warn"
    out = seams(docs).select(*row(F.col("doc_id"), "continuity", status, F.when(unknown, "a printed closing and opening balance").otherwise(shown(F.col("s_closing"))), F.when(unknown, "not both printed").otherwise(shown(F.col("next_opening")))))
    days = F.concat(F.col("gap_start").cast("string"), F.lit(".."), F.col("gap_end").cast("string"))
    # the holes of one account's year
    holes = gaps(docs, start, end, accounts).groupBy("account_id").agg(F.array_join(F.array_sort(F.collect_list(days)), "; ").alias("holes"))
    known = docs.groupBy("account_id").agg(F.bool_or(F.col("doc_start").isNotNull() & F.col("doc_end").isNotNull()).alias("dated")).join(holes, "account_id", "left")
    first, last = F.lit(start), F.lit(end)
    if accounts is not None:
        known = known.join(accounts.select("account_id", "opened_on", "closed_on"), "account_id", "left")
        first, last = F.greatest(first, F.coalesce(F.col("opened_on").cast("string"), first)), F.least(last, F.coalesce(F.col("closed_on").cast("string"), last))
    window = F.concat(first, F.lit(".."), last)
    out = out.unionByName(known.select(*row(none, "gap", F.when(F.col("dated") & F.col("holes").isNull(), "pass").otherwise("warn"), F.when(F.col("dated"), window).otherwise("a printed period"), F.when(~F.col("dated"), "none").otherwise(F.coalesce("holes", F.lit("covered"))))))
    if overlaps is not None:
        agree, days = F.col("status") == "pass", F.concat(F.col("lo").cast("string"), F.lit(".."), F.col("hi").cast("string"))
        out = out.unionByName(overlaps.select(*row(F.col("doc_id"), "overlap", F.col("status"), F.when(agree, "identical").otherwise(F.concat(F.col("existing").cast("string"), F.lit(" row(s) for "), days)), F.when(agree, "identical").otherwise(F.concat(F.col("incoming").cast("string"), F.lit(" row(s) from "), F.col("doc_id").cast("string"))))))
    if ledgers is not None:
        lost = ledgers.filter("opening_source = 'unknown' OR closing_source = 'unknown'")
        out = out.unionByName(lost.select(*row(none, "anchor_missing", F.lit("warn"), F.lit("a balance at both ends of the year"), F.lit("none printed, computed or told"))))
        moved = ledgers.filter("opening <> prior_closing")
        out = out.unionByName(moved.select(*row(none, "prior_year_mismatch", F.lit("warn"), shown(F.col("prior_closing")), shown(F.col("opening")))))
    return out


def boundaries(rows: DataFrame, docs: DataFrame, accounts: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """account_id, opening, opening_source, closing, closing_source, net, n: the balances at both ends of the year.

    rows: kept rows of all statements (account_id, doc_rank, pos, date, amount,
    balance_after), taken in printed order: statement by statement, then
    position. docs: account_id, file_seq, s_opening, s_closing, doc_start,
    doc_end, running. accounts: account_id, anchor (the owner's opening balance,
    null where none is known).

    With a balance column the year's first and last rows give both ends; a year
    without rows has the last balance before it, else the first printed opening;
    an account without any rows has its printed figures. Without a balance
    column, or where one end stays open, the other end and the year's rows give
    it, at last the anchor. Sources: printed, computed, anchor, unknown.
    """
    first, last = _day(start), _day(end)
    if isinstance(start, Column):
        rows, docs = (t.join(accounts.select("account_id", "start", "end"), "account_id") for t in (rows, docs))
    inside, before = F.col("date").between(first, last), F.col("date") < first
    at = F.struct("doc_rank", "pos")
    of_rows = rows.groupBy("account_id").agg(
        F.min_by(F.struct((F.col("balance_after") - F.col("amount")).alias("b")), F.when(inside, at)).alias("open"), F.max_by(F.struct(F.col("balance_after").alias("b")), F.when(inside, at)).alias("close"),
        F.max_by(F.struct(F.col("balance_after").alias("b")), F.when(before, at)).alias("earlier"), F.count_if(before).alias("n_before"),
        F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0)).alias("net"), F.count_if(inside).cast("bigint").alias("n"), F.count("*").alias("n_all"),
    )
    seq = F.col("file_seq")
    of_docs = docs.groupBy("account_id").agg(
        F.min_by("s_opening", F.when(F.col("s_opening").isNotNull(), seq)).alias("p_open"), F.max_by("s_closing", F.when(F.col("s_closing").isNotNull(), seq)).alias("p_close"),
        F.coalesce(F.bool_or(F.col("doc_start") == first), F.lit(False)).alias("from_first"), F.coalesce(F.bool_or(F.col("doc_end") == last), F.lit(False)).alias("to_last"), F.coalesce(F.bool_or("running"), F.lit(False)).alias("running"),
    )
    a = of_docs.join(of_rows, "account_id", "left").join(accounts.select("account_id", "anchor"), "account_id", "left").fillna(0, ["net", "n", "n_all", "n_before"])
    live, some = F.col("n") > 0, F.col("n_all") > 0
    dormant = F.when(F.col("n_before") > 0, F.col("earlier.b")).otherwise(F.col("p_open"))
    opening = F.when(live, F.col("open.b")).when(some, dormant).otherwise(F.col("p_open"))
    closing = F.when(live, F.col("close.b")).when(some, dormant).otherwise(F.coalesce("p_close", "p_open"))
    a = a.withColumn("opening", F.when(F.col("running"), opening)).withColumn("closing", F.when(F.col("running"), closing))
    kind = lambda value, at_edge, printed: F.when(value.isNull(), "unknown").when(live, F.when(at_edge & printed.isNotNull(), "printed").otherwise("computed")).when(some, "computed").otherwise("printed")
    a = a.withColumn("opening_source", kind(F.col("opening"), F.col("from_first"), F.col("p_open"))).withColumn("closing_source", kind(F.col("closing"), F.col("to_last"), F.col("p_close")))
    # one known end and the year's rows give the other; else the anchor gives both
    o, c, net, anchor = F.col("opening"), F.col("closing"), F.col("net"), F.col("anchor")
    open_none, both_none = o.isNull() & c.isNotNull(), o.isNull() & c.isNull()
    return a.select(
        "account_id", F.when(open_none, c - net).when(both_none, anchor).otherwise(o).alias("opening"),
        F.when(open_none, "computed").when(both_none & anchor.isNotNull(), "anchor").otherwise(F.col("opening_source")).alias("opening_source"),
        F.when(c.isNull() & o.isNotNull(), o + net).when(both_none, anchor + net).otherwise(c).alias("closing"),
        F.when((c.isNull() & o.isNotNull()) | (both_none & anchor.isNotNull()), "computed").otherwise(F.col("closing_source")).alias("closing_source"), "net", "n",
    )


def ledgers(rows: DataFrame, docs: DataFrame, accounts: DataFrame, statement_checks: DataFrame, start: str | Column, end: str | Column) -> tuple[DataFrame, DataFrame]:
    """(ledgers, checks) of accounts: statements proved, merged, joined at their seams, and cut to the year.

    rows: doc_id, pos, date, amount, balance_after, description. docs: doc_id,
    account_id, container, file_seq, doc_start, doc_end, s_opening, s_closing,
    running. accounts: account_id, opened_on, closed_on, anchor, prior_closing.
    statement_checks: doc_id, kind, status. A failed check empties its account.
    """
    ranked = rank_statements(docs)
    claimed = written(claim_overlaps(rows, ranked))  # read by the overlap checks, on both sides, and by the boundaries
    kept = claimed.filter("claimed_by IS NULL")
    found = statement_checks.join(docs.select("doc_id", "account_id"), "doc_id").select("account_id", "kind", "status")
    for kind, part in (("overlap", overlap_checks(claimed, ranked)), ("continuity", balance_continuity(docs)), ("gap", gap_checks(docs, start, end, accounts))):
        found = found.unionByName(part.select("account_id", F.lit(kind).alias("kind"), "status"))
    found = written(found)
    ends = boundaries(kept, docs, accounts, start, end).join(accounts.select("account_id", "prior_closing"), "account_id", "left")
    failed = found.groupBy("account_id").agg(F.bool_or(F.col("status") == "fail").alias("failed"))
    ends = written(ends).join(failed, "account_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    open_end = (F.col("opening_source") == "unknown") | (F.col("closing_source") == "unknown")
    late = F.filter(F.array(F.when(open_end, "anchor_missing"), F.when(F.col("opening") != F.col("prior_closing"), "prior_year_mismatch")), lambda x: x.isNotNull())
    found = found.unionByName(ends.filter("NOT failed").select("account_id", F.explode(late).alias("kind"), F.lit("warn").alias("status")))
    cut = lambda c: F.when(F.col("account_status") != "failed", F.col(c)).alias(c)
    source = lambda c: F.when(F.col("account_status") == "failed", "unknown").otherwise(F.col(c)).alias(c)
    out = ends.join(account_status(found), "account_id").select("account_id", "account_status", cut("opening"), source("opening_source"), cut("closing"), source("closing_source"), cut("net"), cut("n"))
    return out, found


def year_ledgers(rows: DataFrame, docs: DataFrame, accounts: DataFrame, statement_checks: DataFrame, years: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledgers, checks) as ``ledgers`` gives them, with ``year``, of all tax years at once; a year is held against the year before.

    years: year (a number), start, end, which follow on each other. A statement
    counts for each year that its period touches (without a period: for all), so
    accounts are cut by (account, year) and no year waits for another. A year's
    proved closing is the next year's prior closing; accounts' own anchor and
    prior_closing (null: none) hold for the first year that the account has.
    """
    own = F.coalesce(docs["doc_end"] >= F.col("start"), F.lit(True)) & F.coalesce(docs["doc_start"] <= F.col("end"), F.lit(True))
    # a row for each year: a handful
    dated = docs.join(F.broadcast(years.select("year", "start", "end")), own)
    named = lambda d: F.concat_ws("#", d, F.col("year").cast("string"))
    cut = dated.select(named(F.col("account_id").cast("string")).alias("slice"), F.col("account_id").alias("account"), "year", "start", "end", named(F.col("doc_id").cast("string")).alias("copy"), *docs.columns)
    cut = written(cut)
    mine = cut.select("slice", "account", "year", "start", "end").distinct()
    held = accounts.select(F.col("account_id").alias("account"), "opened_on", "closed_on", "anchor", "prior_closing")
    order = Window.partitionBy("account").orderBy("year")
    slices = mine.join(held, "account", "left").withColumn("k", F.row_number().over(order))
    first = lambda c: F.when(F.col("k") == 1, F.col(c)).alias(c)
    per = written(slices.select(F.col("slice").alias("account_id"), "account", "year", "start", "end", "opened_on", "closed_on", first("anchor"), first("prior_closing")))
    docs_of = cut.drop("account_id", "doc_id", "account").withColumnsRenamed({"slice": "account_id", "copy": "doc_id"})
    key = cut.select("doc_id", "copy")
    rows_of = rows.join(key, "doc_id").drop("doc_id").withColumnRenamed("copy", "doc_id")
    proved = statement_checks.join(key, "doc_id").select(F.col("copy").alias("doc_id"), "kind", "status")
    books, found = ledgers(rows_of, docs_of.drop("year", "start", "end"), per, proved, *(F.col(c) for c in ("start", "end")))
    label = per.select("account_id", "account", "year")
    books = written(books.join(label, "account_id"))
    before = F.lag("closing").over(order), F.lag("year").over(order)
    seam = books.select("account_id", "opening", "account_status", F.when(before[1] == F.col("year") - 1, before[0]).alias("closed")).filter("account_status <> 'failed' AND opening <> closed")
    found = found.unionByName(seam.select("account_id", F.lit("prior_year_mismatch").alias("kind"), F.lit("warn").alias("status")))
    told = lambda t: t.join(label, "account_id") if "year" not in t.columns else t
    rest = lambda t: [c for c in t.columns if c not in ("account_id", "account", "year")]
    return books.select(F.col("account").alias("account_id"), "year", *rest(books)), told(found).select(F.col("account").alias("account_id"), "year", *rest(found))


def account_status(account_checks: DataFrame) -> DataFrame:
    """failed before incomplete before complete; only gap and anchor_missing warnings make an account incomplete."""
    lacks = (F.col("status") == "warn") & F.col("kind").isin("gap", "anchor_missing")
    status = F.when(F.bool_or(F.col("status") == "fail"), "failed").when(F.bool_or(lacks), "incomplete").otherwise("complete")
    return account_checks.groupBy("account_id").agg(status.alias("account_status"))

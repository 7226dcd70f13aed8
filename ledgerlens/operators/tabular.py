"""Rows of sheets to transactions, by the labels of each document's layout profile.

rows: doc_id, row_no (from 1), cells. docs: doc_id, layout_id, account_id.
profiles: see ``profiles.PROFILE``. Columns are found by header name, never by
place. What can't be read becomes an unresolved row with a reason, never a zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import money, text
from ledgerlens.operators import checks
from ledgerlens.operators.profiles import ROLES
from ledgerlens.operators.stored import tasks, written

HEAD_ROWS = 30
#: Reasons of unresolved rows.
NO_DATE, BAD_DATE = "row has no date", "unreadable date"
NO_SIDE, BOTH_SIDES = "row has no amount in either the debit or credit column", "row has amounts in both columns"
NO_AMOUNT, BAD_AMOUNT, NO_DIRECTION, BAD_BALANCE = "row has no amount", "unreadable amount", "amount has no direction token", "unreadable balance"


def _low(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.lower(F.trim(c)))


def headers(rows: DataFrame, docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """docs with their profile's columns (null if there is no such profile), and header_row, header: the first of the head rows that has all tokens as cells (null: none)."""
    layouts = F.broadcast(profiles)  # a handful, and wide: they join last, so that no sort holds them once for each document
    # most rows hold no layout's first token, which costs little to see before rows and documents meet
    token = F.lower(F.trim(F.get("tokens", F.lit(0))))
    firsts = profiles.agg(F.collect_set(token).alias("firsts"), F.count_if(token.isNull()).alias("without"))
    near = money.bind(F.lower(F.array_join("cells", "\x1f")), lambda said: F.exists("firsts", lambda t: F.contains(said, t)))
    top = rows.filter(F.col("row_no") <= HEAD_ROWS).crossJoin(F.broadcast(firsts)).filter((F.col("without") > 0) | near)
    # a row's cells are lowered once, not once for each token
    hit = money.bind(_low(F.col("cells")), lambda low: F.forall("tokens", lambda t: F.array_contains(low, F.lower(F.trim(t)))))
    n = tasks(docs)
    docs = docs.repartition(n, "doc_id")
    whose = top.select("doc_id", "row_no", "cells").repartition(n, "doc_id").join(docs.select("doc_id", "layout_id"), "doc_id").join(layouts, "layout_id").filter(hit)
    first = whose.groupBy("doc_id").agg(F.min(F.struct("row_no", "cells")).alias("h")).select("doc_id", F.col("h.row_no").alias("header_row"), F.col("h.cells").alias("header"))
    order = [*docs.join(profiles, "layout_id", "left").columns, "header_row", "header"]
    return docs.join(first, "doc_id", "left").join(layouts, "layout_id", "left").select(*order)


def map_columns(heads: DataFrame, require_balance: bool = True) -> DataFrame:
    """heads plus ``mapping`` (role to cell number, from 0) and ``lacking`` (required roles without a column).

    Labels are tried in order; of equal headers the last one counts.
    """
    def places(back: Column) -> Column:
        at = lambda label: F.size(back) - F.nullif(F.array_position(back, F.lower(F.trim(label))), F.lit(0)).cast("int")
        return F.map_filter(F.transform_values("labels", lambda _, v: F.get(F.filter(F.transform(v, at), lambda k: k.isNotNull()), F.lit(0))), lambda _, k: k.isNotNull())

    found = money.bind(F.reverse(_low(F.col("header"))), places)
    required = F.concat(
        F.array(F.lit("date"), F.lit("description")), F.when(F.col("sign") == "columns", F.array(F.lit("debit"), F.lit("credit"))).otherwise(F.array(F.lit("amount"))),
        F.when(F.col("running") & F.lit(require_balance), F.array(F.lit("balance"))).otherwise(F.array().cast("array<string>")),
    )
    out = heads.withColumn("mapping", found)
    return out.withColumn("lacking", F.when(F.col("header").isNotNull(), F.array_sort(F.array_except(required, F.map_keys("mapping")))))


def cell(role: str) -> Column:
    """The trimmed cell of a role; empty where the row is too short or the layout has no such column."""
    return F.trim(F.coalesce(F.get("cells", F.try_element_at("mapping", F.lit(role))), F.lit("")))


def formats_of(profiles: DataFrame) -> tuple[str, ...]:
    """The date formats that profiles use; a handful."""
    return tuple(sorted(r[0] for r in profiles.select(F.explode("dates")).distinct().collect() if r[0] is not None))


def first_date(value: Column, formats: Column, known: tuple[str, ...] = ()) -> Column:
    """The date by the first of a column of formats that fits, else null. Formats that are ``known`` when the plan is made are not compiled for each row.

    A format that does not fit costs far more than one that does, so none is tried after a hit, nor on an empty text.
    """

    def read(flat: Column) -> Column:
        def by(f: Column) -> Column:
            day = F.try_to_timestamp(flat, f)
            for k in known:
                day = F.when(f == k, F.try_to_timestamp(flat, F.lit(k))).otherwise(day)
            return day.cast("date")

        first = F.aggregate(formats, F.lit(None).cast("date"), lambda found, f: F.coalesce(found, by(f)))
        return F.when(flat != "", first)

    return money.bind(F.trim(F.regexp_replace(value, r"\s+", " ")), read)


def suffix_amount(raw: Column, credit: Column, debit: Column) -> Column:
    """Struct (known, units): credit tokens first, in their order; the number before the token, without a sign of its own."""
    tokens = F.concat(F.transform(credit, lambda t: F.struct(t.alias("t"), F.lit(1).alias("s"))), F.transform(debit, lambda t: F.struct(t.alias("t"), F.lit(-1).alias("s"))))

    def with_token(x: Column) -> Column:
        hit = x["hit"]
        bare = F.btrim(F.substring(x["raw"], F.lit(1), F.length(x["raw"]) - F.length(hit["t"])), F.lit(" ."))
        return F.struct(hit.isNotNull().alias("known"), (hit["s"] * F.abs(money.parse(bare))).alias("units"))

    hit = lambda t: F.struct(t.alias("raw"), F.get(F.filter(tokens, lambda x: F.endswith(F.lower(t), F.lower(x["t"]))), F.lit(0)).alias("hit"))
    return money.bind(money.bind(F.trim(raw), hit), with_token)


def read_rows(rows: DataFrame, mapped: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, row_no, locator, raw, date, value_date, amount, balance_after, description, reference, sign_source, reason.

    All rows under the header that are neither blank nor furniture, in printed
    positions; ``reason`` tells why a row is unresolved, null if it was read.
    """
    good = mapped.filter("header_row IS NOT NULL AND size(lacking) = 0").select("doc_id", "header_row", "mapping", "dates", "sign", "credit_tokens", "debit_tokens", "running", "skip", "summary")
    body = rows.join(good, "doc_id").filter(F.col("row_no") > F.col("header_row")).withColumn("raw", F.array_join("cells", ","))
    furniture = reduce(Column.__or__, [F.coalesce(F.regexp_like("raw", F.col(p)), F.lit(False)) for p in ("skip", "summary")])
    body = body.filter(F.exists("cells", lambda c: F.trim(c) != "")).filter(~furniture)
    body = body.withColumns({f"c_{r}": cell(r) for r in ROLES}).withColumn("locator", F.concat(F.lit("row:"), F.col("row_no").cast("string")))
    return interpret(body, known)


def interpret(body: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """The rows (doc_id, row_no, locator, raw, c_<role>, and their profile's formats) as ``read_rows`` gives them."""
    debit, credit, amount, balance, day = (F.col(f"c_{r}") for r in ("debit", "credit", "amount", "balance", "date"))
    no_d, no_c, none = money.is_empty(debit), money.is_empty(credit), money.is_empty(amount)
    got = body.withColumn("date", first_date(day, F.col("dates"), known)).withColumn("by_suffix", F.when((F.col("sign") == "suffix") & ~none, suffix_amount(amount, F.col("credit_tokens"), F.col("debit_tokens"))))
    columns = F.when(no_c, -money.parse(debit)).otherwise(money.parse(credit))
    got = got.withColumn("amount", F.when(F.col("sign") == "columns", F.when(no_d != no_c, columns)).when(F.col("sign") == "suffix", F.col("by_suffix.units")).when(~none, money.parse(amount)))
    shown = F.col("running") & ~money.is_empty(balance)
    got = got.withColumn("balance_after", F.when(shown, money.parse(balance)))
    reason = (
        F.when(money.is_empty(day), NO_DATE).when(F.col("date").isNull(), BAD_DATE)
        .when((F.col("sign") == "columns") & no_d & no_c, NO_SIDE).when((F.col("sign") == "columns") & ~no_d & ~no_c, BOTH_SIDES)
        .when((F.col("sign") != "columns") & none, NO_AMOUNT).when((F.col("sign") == "suffix") & ~F.col("by_suffix.known"), NO_DIRECTION)
        .when(F.col("amount").isNull(), BAD_AMOUNT).when(shown & F.col("balance_after").isNull(), BAD_BALANCE)
    )
    source = F.when(F.col("sign") == "columns", "column").otherwise(F.col("sign"))
    return got.select(
        "doc_id", "row_no", "locator", "raw", "date", first_date(F.col("c_value_date"), F.col("dates"), known).alias("value_date"), "amount", "balance_after",
        F.col("c_description").alias("description"), F.nullif(F.col("c_reference"), F.lit("")).alias("reference"), source.alias("sign_source"), reason.alias("reason"),
    )


def _printed(body: Column, figure: str) -> Column:
    """What a text prints for a figure by its profile's pattern."""
    at = F.try_element_at("patterns", F.lit(figure))
    return F.when(F.regexp_like(body, at["pattern"]), F.call_function("regexp_extract", body, at["pattern"], at["at"]))


def period_of(body: Column) -> tuple[Column, Column]:
    """The first and last day of the period that a text prints by its profile's patterns."""
    return tuple(first_date(_printed(body, k), F.col("dates")) for k in ("period_from", "period_to"))


def figures_of(body: Column) -> list[Column]:
    """The figures that a text prints by its profile's patterns; what can't be converted stays null."""
    found = lambda k: _printed(body, k)
    days = [d.alias(f"s_{to}") for d, to in zip(period_of(body), ("start", "end"), strict=True)]
    sums = [money.parse(found(k)).alias(f"s_{to}") for k, to in (("opening", "opening"), ("closing", "closing"), ("total_credit", "credit"), ("total_debit", "debit"))]
    return [*sums, *days, F.trim(found("account_id")).alias("s_account")]


def read_summary(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """doc_id and the figures that the rows above the header print."""
    top = rows.join(heads.filter("header_row IS NOT NULL").select("doc_id", "header_row"), "doc_id").filter(F.col("row_no") < F.col("header_row"))
    lines = F.array_sort(F.collect_list(F.struct("row_no", F.array_join("cells", ",").alias("raw"))))  # fewer than HEAD_ROWS
    said = top.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["raw"]), "\n").alias("preamble"))
    both = heads.filter("header_row IS NOT NULL").join(said, "doc_id", "left")
    return both.select("doc_id", *figures_of(F.coalesce("preamble", F.lit(""))))


def read(rows: DataFrame, docs: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows as ``read_rows`` gives them, documents with status and printed figures).

    Document status: ok, no_profile, no_header, no_column (a required column is not in the header).
    """
    mapped = written(map_columns(headers(rows, docs, profiles)))  # all that follows reads it
    state = F.when(F.col("tokens").isNull(), "no_profile").when(F.col("header_row").isNull(), "no_header").when(F.size("lacking") > 0, "no_column").otherwise("ok")
    stated = mapped.select("doc_id", "layout_id", "account_id", "container", "running", state.alias("status")).join(read_summary(rows, mapped), "doc_id", "left")
    return read_rows(rows, mapped, formats_of(profiles)), stated


def parse(rows: DataFrame, docs: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, txns, unresolved) of the sheets.

    documents: doc_id, layout_id, account_id, status (as ``read`` tells it),
    printed figures, and doc_start, doc_end: the printed period, else the first
    and last row's date in printed order.
    """
    interpreted, stated = read(rows, docs, profiles)
    return assemble(written(interpreted), docs, stated)  # each of the three reads it


def assemble(interpreted: DataFrame, docs: DataFrame, stated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, txns, unresolved) from interpreted rows and from documents with status and printed figures."""
    fine = interpreted.filter("reason IS NULL").withColumn("pos", F.col("row_no")).join(docs.select("doc_id", "account_id"), "doc_id")
    norm = fine.withColumn("norm", text.normalize_description(F.col("description")))
    counted = checks.occurrence(norm, "doc_id", "date", "amount", "balance_after", "norm")
    account = F.coalesce(F.col("account_id").cast("string"), F.lit("unassigned"))
    txns = counted.withColumn("txn_id", text.txn_id(account, F.col("date"), F.col("amount"), F.col("balance_after"), F.col("norm"), F.col("occurrence"))).withColumn("tax_year", text.fiscal_year(F.col("date"))).drop("norm", "occurrence", "reason", "row_no")
    unresolved = interpreted.filter("reason IS NOT NULL").select("doc_id", "row_no", "locator", "raw", "reason")
    period = fine.groupBy("doc_id").agg(F.min_by("date", "pos").alias("first_day"), F.max_by("date", "pos").alias("last_day"))
    lost = unresolved.groupBy("doc_id").agg(F.count("*").alias("unresolved"), F.min_by(F.struct("reason", "locator"), "row_no").alias("first_unresolved"))
    documents = stated.join(period, "doc_id", "left").join(lost, "doc_id", "left")
    documents = documents.withColumn("doc_start", F.coalesce("s_start", "first_day")).withColumn("doc_end", F.coalesce("s_end", "last_day")).withColumn("unresolved", F.coalesce("unresolved", F.lit(0))).drop("first_day", "last_day")
    return documents, txns, unresolved


def selftest(cases: DataFrame, profiles: DataFrame) -> DataFrame:
    """(layout_id, case_no, ok): labelled rows (layout_id, case_no, header, cells, want_date, want_amount) read as the engine would."""
    keyed = cases.withColumn("doc_id", F.concat_ws("#", "layout_id", F.col("case_no").cast("string")))
    rows = keyed.select("doc_id", F.lit(2).alias("row_no"), "cells")
    heads = keyed.select("doc_id", "layout_id", F.lit(1).alias("header_row"), "header").join(profiles, "layout_id")
    got = read_rows(rows, map_columns(heads, require_balance=False)).select("doc_id", "date", "amount", "reason")
    same = F.col("reason").isNull() & F.col("date").eqNullSafe(F.col("want_date")) & F.col("amount").eqNullSafe(F.col("want_amount"))
    return keyed.join(got, "doc_id", "left").select("layout_id", "case_no", F.coalesce(same, F.lit(False)).alias("ok"))


def row_samples(rows: DataFrame, heads: DataFrame, count: int = 5) -> DataFrame:
    """doc_id, row_no, sample (header label to cell): the first rows under each header that are no blanks, as cases for a self-test."""
    below = rows.join(heads.filter("header_row IS NOT NULL").select("doc_id", "header_row", "header"), "doc_id").filter(F.col("row_no") > F.col("header_row")).filter(F.exists("cells", lambda c: F.trim(c) != ""))
    first = below.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no"))).filter(F.col("k") <= count)
    # of equal labels the last cell counts, as in ``map_columns``
    pairs = F.reverse(F.arrays_zip(F.transform("header", F.trim).alias("h"), F.slice("cells", 1, F.size("header")).alias("c")))
    once = F.filter(pairs, lambda x, i: (x["h"].isNotNull()) & (F.array_position(F.transform(pairs, lambda y: y["h"]), x["h"]) == i + 1))
    return first.select("doc_id", "row_no", F.map_from_entries(F.transform(once, lambda x: F.struct(x["h"], F.coalesce(x["c"], F.lit(""))))).alias("sample"))


def summary_selftest(samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """(layout_id, figure, problem) of profiles against sample texts (layout_id, sample, want: figure to captured text); none for a good profile.

    A pattern that finds nothing is dead; an expectation needs a pattern, and what it captures has to be exactly that.
    """
    both = samples.join(profiles.select("layout_id", "patterns"), "layout_id")
    figures = both.withColumn("figure", F.explode(F.array_union(F.map_keys("patterns"), F.map_keys("want")))).withColumn("p", F.try_element_at("patterns", F.col("figure"))).withColumn("w", F.try_element_at("want", F.col("figure")))
    found = F.when(F.regexp_like("sample", F.col("p.pattern")), F.trim(F.call_function("regexp_extract", F.col("sample"), F.col("p.pattern"), F.col("p.at"))))
    problem = F.when(F.col("p").isNull(), "expected but not declared").when(found.isNull(), "pattern finds nothing").when(F.col("w").isNotNull() & (found != F.col("w")), "captures something else")
    return figures.select("layout_id", "figure", problem.alias("problem")).filter("problem IS NOT NULL")

"""The run over a folder of statement files: detect, resolve, parse, prove, merge, and say what became of each file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import checks, layout, merge, pages, profiles, tabular
from ledgerlens.operators.stored import written
from ledgerlens.sources import statements


@dataclass(frozen=True)
class Parsed:
    """outcomes: a row for each file. documents, txns, unresolved: of the files that are ok, as ``tabular.parse`` gives them. rejected: (layout_id, problem) of profiles that were not used."""

    outcomes: DataFrame
    documents: DataFrame
    txns: DataFrame
    unresolved: DataFrame
    rejected: DataFrame


@dataclass(frozen=True)
class Run:
    """outcomes: a row for each file. ledgers, checks: by account. missing: accounts that should have had a statement. rejected: profiles that were not used."""

    outcomes: DataFrame
    ledgers: DataFrame
    checks: DataFrame
    missing: DataFrame
    txns: DataFrame
    rejected: DataFrame


def year_problems(years: DataFrame) -> DataFrame:
    """(name, problem) of tax years (name, period_start, period_end) that are not one 1 July to 30 June."""
    start, end = F.col("period_start"), F.col("period_end")
    rules = [
        ((F.month(start) != 7) | (F.dayofmonth(start) != 1), "period_start must be 1 July"),
        ((F.month(end) != 6) | (F.dayofmonth(end) != 30), "period_end must be 30 June"),
        (F.year(end) != F.year(start) + 1, "a tax year spans exactly one 1 July to 30 June"),
    ]
    found = F.filter(F.array(*[F.when(bad, said) for bad, said in rules]), lambda x: x.isNotNull())
    return years.select("name", F.explode(found).alias("problem"))


def registry_problems(accounts: DataFrame) -> DataFrame:
    """(account_id, problem) of accounts (account_id, kind, identifiers, opened_on, closed_on) that can't be used."""
    rules = [
        (~F.exists("identifiers", lambda i: F.trim(i) != "") | F.col("identifiers").isNull(), "an account needs an IBAN, an account number or a wallet number"),
        (~F.coalesce(F.col("kind").isin("bank", "wallet", "foreign"), F.lit(False)), "unknown kind"),
        (F.col("closed_on") < F.col("opened_on"), "closed before it was opened"),
    ]
    found = F.filter(F.array(*[F.when(bad, said) for bad, said in rules]), lambda x: x.isNotNull())
    twice = accounts.groupBy("account_id").agg(F.count("*").alias("n")).filter("n > 1").select("account_id", F.lit("the id is used twice").alias("problem"))
    return accounts.select("account_id", F.explode(found).alias("problem")).unionByName(twice)


def gate(table: DataFrame, cases: DataFrame | None = None, samples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(versions of profiles that may be used, (layout_id, problem) of the others).

    A profile is tried before any file is: its constraints and patterns, then (if
    given) labelled rows as for ``tabular.selftest``, one at least for each
    version and all read right, and sample texts as for ``tabular.summary_selftest``.
    """
    known = profiles.versions(table)
    bad = profiles.problems(table).join(known.select(F.col("base").alias("layout_id"), F.col("layout_id").alias("version")), "layout_id").select(F.col("version").alias("layout_id"), "problem").distinct()
    bad = written(bad)
    fine = written(known.join(bad.select("layout_id").distinct(), "layout_id", "left_anti"))
    if cases is not None:
        tried = written(tabular.selftest(cases, fine))
        bad = bad.unionByName(tried.filter("NOT ok").select("layout_id", F.lit("a labelled row is not read as it should be").alias("problem")).distinct())
        bad = bad.unionByName(fine.select("layout_id").join(tried, "layout_id", "left_anti").withColumn("problem", F.lit("no labelled row to try it on")))
    if samples is not None:
        bad = bad.unionByName(tabular.summary_selftest(samples, fine).select("layout_id", F.concat_ws(": ", "figure", "problem").alias("problem")))
    bad = written(bad)
    return written(fine.join(bad.select("layout_id").distinct(), "layout_id", "left_anti")), bad


def read_files(files: DataFrame, rows: DataFrame, table: DataFrame, accounts: DataFrame, assigned: DataFrame | None = None, words: DataFrame | None = None, cases: DataFrame | None = None, samples: DataFrame | None = None) -> Parsed:
    """Every file to its outcome, and the transactions of those that are ok.

    files: ``statements.files``, or any doc_id, name, file_seq, container,
    duplicate. rows: the sheets' rows. words: the positioned words of pages.
    accounts: account_id, identifiers. assigned: (name, account_id), the owner's
    choice for a file; it comes before what the file prints. cases, samples: see
    ``gate``.

    Sheets are detected and looked through by their first rows, pages by their
    first two pages; each kind is parsed by its own operator, once. Outcomes: ok,
    duplicate, not_text (pages without words, or with glyphs that are no
    characters), unknown_layout, no_valid_profile, ambiguous_layout, unreadable
    (a header or column is missing), unassigned.
    """
    usable, rejected = gate(table, cases, samples)
    named = files.select("doc_id", "name", "file_seq", "container", "duplicate")
    first = named.filter("NOT duplicate")
    told = statements.head_text(rows) if words is None else statements.head_text(rows).unionByName(pages.head_text(words))
    heads = written(first.select("doc_id", "container").join(told, "doc_id", "left"))
    found = written(layout.detect(heads.withColumn("head", F.coalesce("head", F.lit(""))), usable))
    known = found.filter("status = 'ok'").join(heads.select("doc_id", "container"), "doc_id").select("doc_id", "layout_id", "container", F.lit(None).cast("string").alias("account_id"))
    only = usable.drop("base")
    read, stated = tabular.read(rows, known.filter("container <> 'pdf'").drop("container"), only)
    if words is not None:
        page_docs = known.filter("container = 'pdf'").drop("container")
        page_read, page_stated = pages.read(words.join(page_docs.select("doc_id"), "doc_id", "left_semi"), page_docs, only)
        read, stated = read.unionByName(page_read), stated.unionByName(page_stated)
    read, stated = written(read), written(stated)

    body = stated.join(heads.select("doc_id", "head"), "doc_id").select("doc_id", F.col("s_account").alias("printed"), F.col("head").alias("body"))
    resolved = layout.resolve_accounts(body, accounts.select("account_id", "identifiers")).select("doc_id", F.col("account_id").alias("printed_account"))
    placed = first.join(heads.select("doc_id", F.col("head").isNull().alias("blank")), "doc_id").join(found, "doc_id").join(resolved, "doc_id", "left")
    placed = layout.assign(placed, accounts, assigned).join(stated.select("doc_id", F.col("status").alias("parsed")), "doc_id", "left")
    blank = (F.col("container") == "pdf") & F.col("blank")
    state = (
        F.when(blank | (F.col("parsed") == "not_text"), "not_text").when(F.col("status") != "ok", F.col("status")).when(F.col("parsed") != "ok", "unreadable")
        .when(F.col("account_id").isNull(), "unassigned").otherwise("ok")
    )
    placed = written(placed.withColumn("outcome", state))

    good = placed.filter("outcome = 'ok'").select("doc_id", "account_id")
    mine_only = lambda t: t.join(good, "doc_id", "left_semi")
    documents, txns, unresolved = tabular.assemble(mine_only(read), good, stated.drop("account_id").join(good, "doc_id"))
    documents, txns = written(documents.join(first.select("doc_id", "file_seq"), "doc_id")), written(txns)
    counted = txns.groupBy("doc_id").agg(F.count("*").alias("n_txns"))
    base = usable.select("layout_id", "base")
    told_all = placed.join(base, "layout_id", "left").select("doc_id", "name", "file_seq", F.col("base").alias("layout_id"), "account_id", "outcome").join(counted, "doc_id", "left")
    again = named.filter("duplicate").select("doc_id", "name", "file_seq", F.lit(None).cast("string").alias("layout_id"), F.lit(None).cast("string").alias("account_id"), F.lit("duplicate").alias("outcome"), F.lit(None).cast("bigint").alias("n_txns"))
    outcomes = told_all.unionByName(again).withColumn("n_txns", F.when(F.col("outcome") == "ok", F.coalesce("n_txns", F.lit(0))).otherwise(0))
    return Parsed(written(outcomes), documents, txns, unresolved, rejected)


def load_files(files: DataFrame, rows: DataFrame, table: DataFrame, accounts: DataFrame, start: str, end: str, assigned: DataFrame | None = None, words: DataFrame | None = None, cases: DataFrame | None = None, samples: DataFrame | None = None) -> Run:
    """``read_files``, then proofs and ledgers of one tax year.

    accounts: account_id, identifiers, statement_expected, opened_on, closed_on, anchor, prior_closing.
    """
    got = read_files(files, rows, table, accounts, assigned, words, cases, samples)
    proofs = written(checks.all_checks(got.txns, got.documents))
    books, found_checks = (written(t) for t in merge.ledgers(got.txns.drop("account_id"), got.documents, accounts, proofs, start, end))
    lost = layout.missing_accounts(accounts, books, start, end)
    absent = lost.select("account_id", F.lit("statement_missing").alias("kind"), F.lit("warn").alias("status"))
    return Run(got.outcomes, books, found_checks.unionByName(absent), lost, got.txns, got.rejected)


def run_summary(run: Run) -> DataFrame:
    """(what, name, n): files by outcome, accounts by status, missing accounts."""
    files = run.outcomes.groupBy(F.col("outcome").alias("name")).agg(F.count("*").alias("n")).select(F.lit("file").alias("what"), "name", "n")
    books = run.ledgers.groupBy(F.col("account_status").alias("name")).agg(F.count("*").alias("n")).select(F.lit("account").alias("what"), "name", "n")
    return files.unionByName(books).unionByName(run.missing.agg(F.count("*").alias("n")).select(F.lit("account").alias("what"), F.lit("missing").alias("name"), "n").filter("n > 0"))

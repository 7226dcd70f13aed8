"""Layout and account resolution over document heads; profiles and accounts are small tables joined by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import squash
from ledgerlens.operators import lookup, tabular
from ledgerlens.operators import profiles as profiles_of

PDF_MAGIC, ZIP_MAGIC = "25504446", "504B0304"
#: Letters by which a text's runs are told apart from all identifiers before they meet them.
START = 3


def sniff(content: Column) -> Column:
    """pdf, xlsx or csv by the first bytes; a file's name says nothing."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == PDF_MAGIC, "pdf").when(head == ZIP_MAGIC, "xlsx").otherwise("csv")


def detect(heads: DataFrame, profiles: DataFrame) -> DataFrame:
    """doc_id, layout_id, status: the one profile of the container whose tokens and title the head has and that is valid at the statement's date.

    Statuses: ok, unknown_layout, no_valid_profile (some fit, but none at that
    date), ambiguous_layout. heads: doc_id, container, head. profiles: layout_id,
    container, tokens, and where there are such columns title, valid_from,
    valid_to, patterns and dates; the date is the period's end (or start) that
    the head prints by the profile's own patterns, and without one any date is.

    Each profile is looked up by the rarest three letters of its tokens, so
    documents meet only profiles that may fit them; all the rest is asked of these.
    """
    have = set(profiles.columns)
    absent = {"title": "string", "valid_from": "date", "valid_to": "date"}
    p = profiles.select("layout_id", F.col("container"), "tokens", *(["patterns", "dates"] if {"patterns", "dates"} <= have else []), *[F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in absent.items()])
    needs = F.array_distinct(F.flatten(F.transform("tokens", lambda t: lookup.grams(F.lower(F.trim(t))))))
    p = p.withColumn("needs", needs)
    asked = lookup.asked(heads.select("doc_id", "container", "head"), F.lower("head"), p)
    # a handful; else each text would be sent out with each of its runs
    keyed = F.broadcast(lookup.by_rarest(p, asked, ["layout_id"]))
    met = asked.join(keyed, ["container", "gram"]).filter(profiles_of.fits(F.col("head")))
    if "patterns" in met.columns:
        printed = {c: v for c, v in zip(("s_start", "s_end"), tabular.period_of(F.col("head")), strict=True)}
        met = met.withColumn("on", F.coalesce(printed["s_end"], printed["s_start"]))
    else:
        met = met.withColumn("on", F.lit(None).cast("date"))
    valid = profiles_of.valid_at(F.col("on"))
    hits = met.groupBy("doc_id").agg(F.count_if(valid).alias("n"), F.min(F.when(valid, F.col("layout_id"))).alias("layout_id"))
    out = heads.select("doc_id").join(hits, "doc_id", "left")
    status = F.when(F.col("n").isNull(), "unknown_layout").when(F.col("n") == 0, "no_valid_profile").when(F.col("n") > 1, "ambiguous_layout").otherwise("ok")
    return out.select("doc_id", F.when(F.col("n") == 1, F.col("layout_id")).alias("layout_id"), status.alias("status"))


def resolve_accounts(docs: DataFrame, accounts: DataFrame) -> DataFrame:
    """doc_id, account_id: a printed identifier decides alone (one hit or null); else exactly one hit in the body text."""
    ids = accounts.select("account_id", F.explode("identifiers").alias("i")).select("account_id", squash(F.col("i")).alias("i")).filter("i <> ''")
    hay = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("tier"), squash(F.col("printed")).alias("hay")), F.struct(F.lit(2).alias("tier"), squash(F.col("body")).alias("hay")))).alias("h")).select("doc_id", "h.*").filter("hay <> ''")
    # identifiers have a few lengths; a text's runs of these lengths meet them by equality
    lengths = sorted(r["n"] for r in ids.select(F.length("i").alias("n")).distinct().collect())
    cuts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("hay") - n + 1, F.lit(1))), lambda k: F.substring(F.col("hay"), k, F.lit(n)))
    runs = [cuts(n) for n in lengths]
    cut = hay.select("doc_id", "tier", F.explode(F.array_distinct(F.flatten(F.array(*runs))) if runs else F.array().cast("array<string>")).alias("run"))
    # only runs that begin as some identifier does are sent out; of beginnings, letters and digits, there are 36 ** START at most
    starts = ids.select(F.substring("i", 1, START).alias("start")).distinct()
    cut = cut.join(F.broadcast(starts), F.substring("run", 1, START) == F.col("start"), "left_semi")
    hits = cut.join(ids, F.col("run") == F.col("i")).groupBy("doc_id").agg(*[f for k in (1, 2) for f in (F.countDistinct(F.when(F.col("tier") == k, F.col("account_id"))).alias(f"n{k}"), F.min(F.when(F.col("tier") == k, F.col("account_id"))).alias(f"a{k}"))])
    named = F.coalesce(squash(F.col("printed")), F.lit("")) != ""
    pick = F.when(named & (F.coalesce("n1", F.lit(0)) > 0), F.when(F.col("n1") == 1, F.col("a1"))).otherwise(F.when(F.col("n2") == 1, F.col("a2")))
    return docs.join(hits, "doc_id", "left").select("doc_id", pick.alias("account_id"))


def assign(files: DataFrame, accounts: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """files (name, printed_account) with ``account_id``: the owner's choice (name, account_id) if there is one, else the account that the file prints.

    A choice that names no account of ``accounts`` leaves the file without one.
    """
    if assigned is None:
        return files.withColumn("account_id", F.col("printed_account"))
    ids = accounts.select(F.col("account_id").alias("valid"))
    mine = files.join(assigned.select("name", F.col("account_id").alias("chosen")), "name", "left").join(ids, F.col("chosen") == F.col("valid"), "left")
    return mine.withColumn("account_id", F.when(F.col("chosen").isNotNull(), F.col("valid")).otherwise(F.col("printed_account"))).drop("chosen", "valid")


def find_header(rows: DataFrame, labels: tuple[str, ...], within: int = 30) -> DataFrame:
    """doc_id, header_row: the first row (of the first ``within``) whose cells hold all labels exactly."""
    hit = (F.col("row_no") <= within) & F.forall(F.array(*map(F.lit, labels)), lambda x: F.array_contains(F.transform("cells", lambda c: F.trim(c)), x))
    return rows.filter(hit).groupBy("doc_id").agg(F.min("row_no").cast("bigint").alias("header_row"))


def skip_rows(rows: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Rows that are neither blank nor furniture."""
    raw = F.array_join("cells", ",")
    for p in patterns:
        rows = rows.filter(~raw.rlike(p))
    return rows.filter(F.exists("cells", lambda c: F.trim(c) != ""))


def missing_accounts(accounts: DataFrame, ledgers: DataFrame, start: str, end: str) -> DataFrame:
    """Accounts that should have a statement in the year and have none."""
    live = F.col("statement_expected") & F.coalesce(F.col("closed_on") >= F.lit(start).cast("date"), F.lit(True)) & F.coalesce(F.col("opened_on") <= F.lit(end).cast("date"), F.lit(True))
    return accounts.filter(live).join(ledgers.select("account_id").distinct(), "account_id", "left_anti").select("account_id")

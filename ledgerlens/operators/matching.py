"""Classification, transfers and decisions over ledgers: equi-joined on day buckets, never all against all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlens.operators import pairing
from ledgerlens.operators.stored import written


def classify(txns: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Adds n_hits, category and outcome: one category proposed, several conflict, none other_debit or other_credit.

    rules: (category, pattern, direction) with direction debit, credit or any.
    """
    way = {"any": F.lit(True), "debit": F.col("amount") < 0, "credit": F.col("amount") > 0}
    hit = [F.when(F.col("description").rlike(p) & way[d], F.lit(c)) for c, p, d in rules]
    found = F.array_distinct(F.filter(F.array(*hit), lambda x: x.isNotNull()))
    out = txns.withColumn("__c", found).withColumn("n_hits", F.size("__c").cast("bigint"))
    category = F.when(F.col("n_hits") == 1, F.get("__c", F.lit(0))).when(F.col("n_hits") == 0, F.when(F.col("amount") < 0, "other_debit").otherwise("other_credit"))
    outcome = F.when(F.col("n_hits") == 1, "proposed").when(F.col("n_hits") > 1, "conflict").otherwise("default")
    return out.withColumn("category", category).withColumn("outcome", outcome).drop("__c")


@dataclass(frozen=True)
class Rule:
    """A category for rows whose description matches, of one direction, bank and range of sizes (minor units)."""

    category: str
    pattern: str
    direction: str = "any"
    institution: str | None = None
    least: int | None = None
    most: int | None = None


def classify_rows(txns: DataFrame, rules: tuple[Rule, ...], review_from: int) -> DataFrame:
    """Adds n_hits, category and outcome as ``classify`` does, by rules with bank and size; a credit from ``review_from`` on that no rule knows is an unclassified_credit.

    txns: description, amount, institution. Rules are part of the plan: one pass, no join.
    """
    size = F.abs("amount")
    fits = []
    for r in rules:
        hit = F.col("description").rlike(r.pattern) & {"any": F.lit(True), "debit": F.col("amount") < 0, "credit": F.col("amount") > 0}[r.direction]
        for bound in ([F.col("institution") == r.institution] if r.institution else []) + ([size >= r.least] if r.least is not None else []) + ([size <= r.most] if r.most is not None else []):
            hit = hit & bound
        fits.append(F.when(hit, F.lit(r.category)))
    out = txns.withColumn("hits", F.array_distinct(F.filter(F.array(*fits), lambda x: x.isNotNull()))).withColumn("n_hits", F.size("hits").cast("bigint"))
    none = F.when(F.col("amount") < 0, "other_debit").when(F.col("amount") >= review_from, "unclassified_credit").otherwise("other_credit")
    out = out.withColumn("category", F.when(F.col("n_hits") == 1, F.get("hits", F.lit(0))).when(F.col("n_hits") == 0, none))
    return out.withColumn("outcome", F.when(F.col("n_hits") == 1, "proposed").when(F.col("n_hits") > 1, "conflict").otherwise("default")).drop("hits")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.upper(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _spaced(text: Column) -> Column:
    """A text's words in capitals between single spaces, so that whole words can be looked for; null if there are none."""
    joined = F.array_join(_words(text), " ")
    return F.when(joined != "", F.concat(F.lit(" "), joined, F.lit(" ")))


def named_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, account_id): which accounts' hints stand in a text as whole words, by equal runs of as many words as hints have.

    texts: key, text. names: account_id, hint, of any number of words.
    """
    asked = names.select("account_id", _words(F.col("hint")).alias("w")).filter("size(w) > 0").select("account_id", F.size("w").alias("n"), F.array_join("w", " ").alias("run")).distinct()
    lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # hints have a few lengths
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda k: F.array_join(F.slice("w", k, n), " "))).otherwise(F.array().cast("array<string>"))
    runs = F.flatten(F.array(*[run(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    said = texts.select("key", _words(F.col("text")).alias("w")).select("key", F.explode(F.array_distinct(runs)).alias("run"))
    return said.join(asked.drop("n"), "run").select("key", "account_id").distinct()


def own_accounts(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """key, category: rows that name an own account without statements: a foreign one's credits are exports, all else is an unmatched own transfer.

    accounts: account_id, kind, statement_expected, hints. A row that names both kinds is taken as foreign.
    """
    names = accounts.filter("NOT statement_expected").select("account_id", "kind", F.explode("hints").alias("hint"))
    hits = named_in(txns.select("key", F.col("description").alias("text")), names).join(names.select("account_id", "kind").distinct(), "account_id")
    foreign = hits.groupBy("key").agg(F.bool_or(F.col("kind") == "foreign").alias("foreign"))
    category = F.when(F.col("foreign") & (F.col("amount") > 0), "export_proceeds").otherwise("own_transfer_unmatched")
    return txns.join(foreign, "key").select("key", category.alias("category"))


# Categories that are never one side of an own transfer.
NO_TRANSFER = ("tax_on_profit", "tax_on_cards", "tax_on_cash", "tax_on_exports", "zakat", "indirect_tax_charges")


def transfers(txns: DataFrame, accounts: DataFrame | None = None, days: int = 3, fee: int = 10_000, scale: int = 100_000) -> DataFrame:
    """debit_key, credit_key, fee, gap: a debit and a credit of different accounts of one owner within ``days``, equal or short by a small fee.

    accounts: account_id, owner; without it all accounts are one owner's. Rows
    whose ``category`` (if there is such a column) is in NO_TRANSFER are left
    out. Owner, day bucket and amount bucket (of ``scale``, or its neighbour)
    are the keys of an equi-join, so rows of other owners never meet.
    """
    rows = txns.filter(~F.coalesce(F.col("category").isin(*NO_TRANSFER), F.lit(False))) if "category" in txns.columns else txns
    rows = rows.withColumn("owner", F.lit("")) if accounts is None else rows.drop("owner").join(accounts.select("account_id", F.col("owner").cast("string")), "account_id")
    money = lambda c: F.floor(F.abs(c) / scale).cast("bigint")
    debit = pairing.side(rows.filter("amount < 0"), "l", "owner").withColumn("l_money", F.explode(F.array(money("l_amount"), money("l_amount") - 1)))
    credit = pairing.side(rows.filter("amount > 0"), "r", "owner").withColumn("r_money", money("r_amount"))
    short = -F.col("l_amount") - F.col("r_amount")
    found = pairing.near(debit, credit, ["owner", "money"], days, (F.col("l_account_id") != F.col("r_account_id")) & short.between(0, fee))
    return found.select(F.col("l_key").alias("debit_key"), F.col("r_key").alias("credit_key"), short.alias("fee"), F.abs(F.datediff("r_date", "l_date")).cast("bigint").alias("gap"))


def match_one_to_one(candidates: DataFrame) -> DataFrame:
    """Greedy one-to-one matching by (fee, gap, keys)."""
    return pairing.greedy(candidates, "debit_key", "credit_key", ["fee", "gap", "debit_key", "credit_key"])


def tiers(candidates: DataFrame, txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """candidates (debit_key, credit_key, fee, gap) plus debit_account, credit_account, signals, tier.

    Signals: a description names the other account by a hint, its owner, or its
    institution, as whole words. strong: exact, at most a day apart, with a
    signal. accounts: account_id, hints, owner, institution. Each candidate looks
    only for its own two accounts' names, within its row.
    """
    rows = lambda p: txns.select(F.col("key").alias(f"{p}_key"), F.col("account_id").alias(f"{p}_account"), _spaced(F.col("description")).alias(f"{p}_text"))
    names = lambda p: accounts.select(F.col("account_id").alias(f"{p}_account"), F.transform("hints", lambda h: _spaced(h)).alias(f"{p}_hints"), F.array(_spaced(F.col("owner"))).alias(f"{p}_owner"), F.array(_spaced(F.col("institution"))).alias(f"{p}_bank"))
    both = candidates.join(rows("debit"), "debit_key").join(rows("credit"), "credit_key").join(names("debit"), "debit_account", "left").join(names("credit"), "credit_account", "left")
    says = lambda text, of: F.coalesce(F.exists(of, lambda n: F.coalesce(F.contains(F.col(text), n), F.lit(False))), F.lit(False))
    signal = lambda kind: (says("debit_text", f"credit_{kind}") | says("credit_text", f"debit_{kind}")).cast("bigint")
    out = both.withColumn("signals", signal("hints") + signal("owner") + signal("bank"))
    strong = (F.col("fee") == 0) & (F.col("gap") <= 1) & (F.col("signals") > 0)
    return out.select(*candidates.columns, "debit_account", "credit_account", "signals", F.when(strong, "strong").otherwise("possible").alias("tier"))


def match_tiers(candidates: DataFrame) -> DataFrame:
    """debit_key, credit_key, status (matched, ambiguous_pair) of the candidates of ``tiers``; each transaction is matched once at most.

    Levels (tier, exact or not, days, signals) are settled one after the other.
    On a level, transactions whose candidates lead to different accounts are all
    flagged and stay out; the rest is taken in printed order. Parts of the
    candidates' graph are settled side by side, each in a streamed pass that
    holds one level of one part.
    """
    # one number for (tier, exact or not, days, signals), the best first
    level = (((F.col("tier") != "strong").cast("bigint") * 2 + (F.col("fee") > 0).cast("bigint")) * 100_000 + F.col("gap")) * 100 + 99 - F.col("signals")
    rows = written(candidates.select("debit_key", "credit_key", "debit_account", "credit_account", level.alias("level")))
    told = pairing.by_parts(rows, "debit_key", "credit_key")
    return told.repartition("part").sortWithinPartitions("part", "level", "debit_key", "credit_key").mapInArrow(_levels, StructType([*(told.schema[c] for c in ("debit_key", "credit_key")), StructField("status", StringType())]))


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, level and keys to (debit_key, credit_key, status)."""
    taken: tuple[set, set] = set(), set()
    part = None

    def settle(rows: list[tuple]) -> list[tuple]:
        here = [r for r in rows if r[0] not in taken[0] and r[1] not in taken[1]]
        leads: tuple[dict, dict] = {}, {}
        for debit, credit, debit_account, credit_account in here:
            leads[0].setdefault(debit, set()).add(credit_account)
            leads[1].setdefault(credit, set()).add(debit_account)
        bad = [r for r in here if len(leads[0][r[0]]) > 1 or len(leads[1][r[1]]) > 1]
        out = [(*r[:2], "ambiguous_pair") for r in bad]
        for r in bad:
            taken[0].add(r[0])
            taken[1].add(r[1])
        for debit, credit, *_ in here:
            if debit not in taken[0] and credit not in taken[1]:
                out.append((debit, credit, "matched"))
                taken[0].add(debit)
                taken[1].add(credit)
        return out

    for (at, _), rows in groupby(_rows(batches), key=lambda r: r[:2]):
        if at != part:
            part, taken = at, (set(), set())
        if found := settle([r[2:] for r in rows]):
            yield pa.RecordBatch.from_pylist([dict(zip(("debit_key", "credit_key", "status"), f, strict=True)) for f in found])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("part", "level", "debit_key", "credit_key", "debit_account", "credit_account")), strict=True)


def income_conflicts(matches: DataFrame, categories: DataFrame, income: tuple[str, ...] = ("export_proceeds", "profit_on_debt", "salary_net")) -> DataFrame:
    """key, category, outcome of matched transactions: a pair of which one side was proposed as income is a conflict, others are internal transfers."""
    pairs = matches.filter("status = 'matched'").select("debit_key", "credit_key")
    keys = pairs.select("debit_key", "credit_key", F.explode(F.array("debit_key", "credit_key")).alias("key")).join(categories, "key", "left")
    clash = keys.groupBy("debit_key", "credit_key").agg(F.coalesce(F.bool_or(F.col("category").isin(*income)), F.lit(False)).alias("clash"))
    judged = keys.join(clash, ["debit_key", "credit_key"])
    return judged.select("key", F.when(F.col("clash"), F.col("category")).otherwise("internal_transfer").alias("category"), F.when(F.col("clash"), "conflict").otherwise("proposed").alias("outcome"))


def decide(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decided, orphans): proposals (key, category, outcome) with the owner's decisions (key, category) put over them; decisions without a proposal are orphans."""
    d = decisions.select("key", F.col("category").alias("decided"))
    out = proposals.join(d, "key", "left").select("key", F.coalesce("decided", "category").alias("category"), F.when(F.col("decided").isNotNull(), "decided").otherwise(F.col("outcome")).alias("outcome"))
    return out, d.join(proposals, "key", "left_anti").select("key", F.col("decided").alias("category"))


# What the owner is asked first.
QUEUE = ("conflict", "strong", "possible", "income", "unclassified_credit", "unpaired", "missing")


def review_queue(items: DataFrame) -> DataFrame:
    """items (kind, key, amount) plus ``place``: the queue's order by kind, then the larger amount, then the key."""
    place = F.array_position(F.array(*map(F.lit, QUEUE)), F.col("kind"))
    return items.withColumn("place", place.cast("int"))

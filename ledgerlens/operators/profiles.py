"""Layout profiles as a table: one row tells how a bank prints its statements.

``PROFILE`` is the schema; ``profile`` fills a row from keywords. Patterns are
regular expressions with a group named ``value``; the row keeps the group's
number, because Spark extracts by number.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The roles of columns and the figures that a preamble may print.
ROLES = ("date", "value_date", "description", "reference", "debit", "credit", "amount", "balance", "type")
FIGURES = ("opening", "closing", "total_credit", "total_debit", "period_from", "period_to", "account_id")
SIGNS = ("columns", "suffix", "signed")
PROFILE = (
    "layout_id string, institution string, container string, tokens array<string>, title string, labels map<string,array<string>>, dates array<string>, sign string, credit_tokens array<string>, debit_tokens array<string>, "
    "decimals int, running boolean, skip string, summary string, footer string, patterns map<string,struct<pattern:string,at:int>>, valid_from date, valid_to date"
)


def one_of(patterns: list[str]) -> str | None:
    """One pattern that finds what any of them finds; None if there is none."""
    return "|".join(f"(?:{p})" for p in patterns) or None


def profile(
    layout_id: str, container: str, tokens: list[str], labels: dict[str, str | list[str]], dates: list[str], sign: str, *, institution: str | None = None, title: str | None = None, credit_tokens: tuple[str, ...] = (), debit_tokens: tuple[str, ...] = (),
    decimals: int = 2, running: bool = True, skip: tuple[str, ...] = (), summary: tuple[str, ...] = (), footer: tuple[str, ...] = (), patterns: dict[str, str] | None = None, valid_from: date | None = None, valid_to: date | None = None,
) -> tuple:
    """A row of PROFILE. ``dates`` are Spark date patterns; a label may have alternatives."""
    found = {k: (p.replace("(?P<", "(?<"), re.compile(p).groupindex.get("value", 0)) for k, p in (patterns or {}).items()}
    several = {k: [v] if isinstance(v, str) else list(v) for k, v in labels.items()}
    return (layout_id, institution, container, tokens, title, several, dates, sign, list(credit_tokens), list(debit_tokens), decimals, running, one_of(list(skip)), one_of(list(summary)), one_of(list(footer)), found, valid_from, valid_to)


def compiles(pattern: Column) -> Column:
    """Whether a regular expression can be used; tried where the row is, so that a bad one is a row's fault and not the job's."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def is_date_format(pattern: Column) -> Column:
    """Whether dates can be read by a pattern: days, months and years with what stands between them."""
    return pattern.rlike(r"^(?:[dMyE]+|[^A-Za-z'#{}\[\]]|'[^']*')+$") & F.try_reflect(F.lit("java.time.format.DateTimeFormatter"), F.lit("ofPattern"), pattern).isNotNull()


def version_id(layout_id: Column, valid_from: Column) -> Column:
    """One name for each version of a layout; a layout without a first day has one version of its own name."""
    return F.when(valid_from.isNull(), layout_id).otherwise(F.concat(layout_id, F.lit("@"), valid_from.cast("string")))


def versions(profiles: DataFrame) -> DataFrame:
    """``profiles`` with ``base``, the layout's name, and the version's name as layout_id."""
    return profiles.withColumn("base", F.col("layout_id")).withColumn("layout_id", version_id(F.col("base"), F.col("valid_from")))


def problems(profiles: DataFrame) -> DataFrame:
    """(layout_id, problem): what makes a profile unusable; a good one has no row. Versions of a layout share its id and start on different days."""
    needs = F.when(F.col("sign") == "columns", F.array(F.lit("debit"), F.lit("credit"))).otherwise(F.array(F.lit("amount")))
    lacking = F.array_except(F.concat(F.array(F.lit("date"), F.lit("description")), needs, F.when(F.col("running"), F.array(F.lit("balance"))).otherwise(F.array().cast("array<string>"))), F.map_keys("labels"))
    unknown = F.array_except(F.map_keys("labels"), F.array(*map(F.lit, ROLES)))
    figures = F.array_except(F.map_keys("patterns"), F.array(*map(F.lit, FIGURES)))
    rules = [
        (F.coalesce(F.size("tokens"), F.lit(0)) < 1, F.lit("no header labels to detect it by")),
        (~F.coalesce(F.col("sign").isin(*SIGNS), F.lit(False)), F.lit("unknown sign mode")),
        ((F.col("sign") == "suffix") & ((F.size("credit_tokens") == 0) | (F.size("debit_tokens") == 0)), F.lit("sign by suffix without tokens")),
        (F.coalesce(F.size("dates"), F.lit(0)) < 1, F.lit("no date formats")),
        (F.exists("dates", lambda f: ~F.contains(f, F.lit("y"))), F.lit("a date format has no year")),
        (F.col("footer").isNotNull() & (F.col("container") != "pdf"), F.lit("a footer on a layout without pages")),
        (F.col("decimals") != 2, F.lit("only two decimals are supported")),
        (F.size(lacking) > 0, F.concat(F.lit("no column for "), F.array_join(lacking, ", "))),
        (F.size(unknown) > 0, F.concat(F.lit("unknown role "), F.array_join(unknown, ", "))),
        (F.size(figures) > 0, F.concat(F.lit("unknown figure "), F.array_join(figures, ", "))),
        (F.exists(F.map_values("patterns"), lambda p: p["at"] < 1), F.lit("a pattern has no group named value")),
        (F.col("valid_to") < F.col("valid_from"), F.lit("valid_to lies before valid_from")),
        (~F.coalesce(F.forall("dates", is_date_format), F.lit(True)), F.lit("a date format can't be read")),
        *[(F.col(c).isNotNull() & ~compiles(F.col(c)), F.lit(f"the pattern of {c} can't be read")) for c in ("title", "skip", "summary", "footer")],
        (F.exists(F.map_values("patterns"), lambda p: ~compiles(p["pattern"])), F.lit("the pattern of a figure can't be read")),
    ]
    own = profiles.select("layout_id", F.explode(F.filter(F.array(*[F.when(bad, said) for bad, said in rules]), lambda x: x.isNotNull())).alias("problem"))
    twice = profiles.groupBy("layout_id", "valid_from").agg(F.count("*").alias("n")).filter("n > 1").select("layout_id", F.lit("the id is used twice").alias("problem"))
    return own.unionByName(twice)


def usable(profiles: DataFrame, selftest: DataFrame | None = None) -> DataFrame:
    """The profiles without problems. With self-test results (layout_id, ok) each needs one case at least, and all passed."""
    bad = problems(profiles).select("layout_id")
    if selftest is not None:
        bad = bad.unionByName(selftest.filter("NOT ok").select("layout_id")).unionByName(profiles.select("layout_id").join(selftest, "layout_id", "left_anti"))
    return profiles.join(bad.distinct(), "layout_id", "left_anti")


def fits(head: Column, on: Column | None = None) -> Column:
    """Whether a profile's row describes a document's head: all tokens and the title; with a day, whether it holds then, too."""
    low = F.lower(head)
    found = F.forall("tokens", lambda t: F.contains(low, F.lower(F.trim(t)))) & (F.col("title").isNull() | F.regexp_like(head, F.col("title")))
    return found if on is None else found & valid_at(on)


def valid_at(on: Column) -> Column:
    """Whether a profile's row holds on a day; a null day is any."""
    return F.coalesce(F.col("valid_from") <= on, F.lit(True)) & F.coalesce(on <= F.col("valid_to"), F.lit(True))

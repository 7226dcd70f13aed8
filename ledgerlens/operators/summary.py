"""The cells of a tax summary, from classified rows, certificates and what the owner typed in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codes of the cells; two of them depend on the year's gross profit.
EXPORTS, PROFIT, PROFIT_TAX, PROFIT_TAX_ABOVE, CARD_TAX, CASH_TAX = "64060285", "500312", "64040052", "64040002", "64151905", "64100101"
CERTIFIED = ("rule_42", "certificate_236Y", "statements")


def cells(rows: DataFrame, other: DataFrame, profit_final_max: int) -> DataFrame:
    """code, col, units, source, differs: the summary's cells.

    rows: category, amount. other: source (CERTIFIED but the last), units: what
    certificates and the owner say of tax on card payments; a blank is no row,
    not zero. The first source that is there counts; ``differs`` tells that the
    statements say something else. Above ``profit_final_max`` of gross profit
    the tax on it goes to another cell.
    """
    of = lambda c, sign: F.coalesce(F.sum(F.when(F.col("category") == c, sign * F.col("amount"))), F.lit(0)).cast("bigint")
    sums = rows.agg(of("export_proceeds", 1).alias("exports"), of("tax_on_exports", -1).alias("export_tax"), of("profit_on_debt", 1).alias("profit"), of("tax_on_profit", -1).alias("profit_tax"), of("tax_on_cash", -1).alias("cash"), F.sum(F.when(F.col("category") == "tax_on_cards", -F.col("amount"))).alias("cards"))
    told = other.groupBy().agg(*[F.sum(F.when(F.col("source") == s, F.col("units"))).alias(s) for s in CERTIFIED[:2]])
    one = sums.crossJoin(told)  # a row each
    card = F.coalesce("rule_42", "certificate_236Y", "cards")
    source = F.when(F.col("rule_42").isNotNull(), CERTIFIED[0]).when(F.col("certificate_236Y").isNotNull(), CERTIFIED[1]).when(F.col("cards").isNotNull(), CERTIFIED[2])
    cell = lambda code, col, units, src=None, differs=None: F.struct(code.alias("code"), F.lit(col).alias("col"), units.cast("bigint").alias("units"), (src if src is not None else F.lit(CERTIFIED[2])).alias("source"), (differs if differs is not None else F.lit(False)).alias("differs"))
    above = F.when(F.col("profit") > profit_final_max, PROFIT_TAX_ABOVE).otherwise(PROFIT_TAX)
    made = F.array(
        cell(F.lit(EXPORTS), 1, F.col("exports")), cell(F.lit(EXPORTS), 2, F.col("export_tax")), cell(F.lit(PROFIT), 1, F.col("profit")), cell(above, 2, F.col("profit_tax")),
        cell(F.lit(CARD_TAX), 2, card, source, F.coalesce(card != F.col("cards"), F.lit(False))), cell(F.lit(CASH_TAX), 2, F.col("cash")),
    )
    return one.select(F.inline(made))


#: One row for each cell of a year's summary. ``sources`` in order of precedence; ``per`` is "institution" for one cell a
#: bank; ``zero`` tells whether no rows mean zero, or a blank; ``code_above`` is the code above the year's ``profit_final_max``.
CODES = "year int, line string, col int, category string, sign int, code string, code_above string, per string, sources array<string>, zero boolean"
TERMS = "year int, profit_final_max bigint, export_percent int"


def entered(wide: DataFrame) -> DataFrame:
    """(year, source, units) of what was typed in or certified, a column for each source; blanks are no rows, not zeros."""
    names = [c for c in wide.columns if c != "year"]
    return wide.select("year", *[F.col(c).cast("bigint").alias(c) for c in names]).unpivot("year", names, "source", "units").filter("units IS NOT NULL").groupBy("year", "source").agg(F.sum("units").alias("units"))


def year_cells(rows: DataFrame, other: DataFrame, codes: DataFrame, terms: DataFrame) -> DataFrame:
    """year, line, part, col, code, units, source, differs: the cells of every year, by the years' own tables of codes.

    rows: year, category, amount, institution. other: ``entered``. codes: CODES.
    terms: TERMS. The first of a cell's sources that says something counts;
    ``differs`` tells that the statements say something else. Two lines more a
    year: what was to be deducted of exports, and how much of that was not. Codes
    and terms are a few rows a year; rows are summed before they meet them.
    """
    sums = rows.groupBy("year", "category", "institution").agg(F.sum("amount").alias("amount"))
    cells_of = codes.withColumn("by_bank", F.coalesce(F.col("per") == "institution", F.lit(False)))
    met = cells_of.join(sums, ["year", "category"], "left").withColumn("part", F.when(F.col("by_bank"), F.col("institution")))
    stated = met.groupBy("year", "line", "col", "part").agg((F.first("sign") * F.sum("amount")).cast("bigint").alias("stated"), F.first("zero").alias("zero"), F.first("sources").alias("sources"), F.first("code").alias("code"), F.first("code_above").alias("code_above"))
    stated = stated.withColumn("stated", F.when(F.col("zero"), F.coalesce("stated", F.lit(0))).otherwise(F.col("stated")))
    told = F.explode_outer(F.transform("sources", lambda x, i: F.struct(i.alias("rank"), x.alias("source"))))
    asked = stated.withColumn("s", told).select("*", "s.rank", "s.source").drop("s").join(other, ["year", "source"], "left")
    units = F.when(F.col("source") == CERTIFIED[2], F.col("stated")).otherwise(F.col("units"))
    best = asked.withColumn("units", units).groupBy("year", "line", "col", "part", "code", "code_above", "stated").agg(F.min(F.when(F.col("units").isNotNull(), F.struct("rank", "source", "units"))).alias("b"))
    gross = sums.filter("category = 'profit_on_debt'").groupBy("year").agg(F.sum("amount").alias("gross"))
    full = best.join(terms, "year").join(gross, "year", "left")
    code = F.when(F.col("code_above").isNotNull() & (F.col("gross") > F.col("profit_final_max")), F.col("code_above")).otherwise(F.col("code"))
    out = full.select("year", "line", "part", "col", code.alias("code"), F.col("b.units").alias("units"), F.col("b.source").alias("source"), F.coalesce(F.col("b.units") != F.col("stated"), F.lit(False)).alias("differs"))
    of = lambda c, sign: F.coalesce(F.sum(F.when(F.col("category") == c, sign * F.col("amount"))), F.lit(0)).cast("bigint")
    exports = terms.join(sums, "year", "left").groupBy("year", "export_percent").agg(of("export_proceeds", 1).alias("got"), of("tax_on_exports", -1).alias("paid"))
    due = F.expr("got * export_percent div 100")
    more = exports.select("year", F.inline(F.array(*[F.struct(F.lit(line).alias("line"), v.cast("bigint").alias("units")) for line, v in (("export_tax_expected", due), ("export_tax_shortfall", F.greatest(due - F.col("paid"), F.lit(0))))])))
    none = F.lit(None).cast("string")
    return out.unionByName(more.select("year", "line", none.alias("part"), F.lit(2).alias("col"), none.alias("code"), "units", F.lit("computed").alias("source"), F.lit(False).alias("differs")))

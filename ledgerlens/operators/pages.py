"""Positioned words of pages to transactions, by the bands of each page's header.

words: doc_id, page, word_no, text, x0, x1, top. docs and profiles as in
``tabular``. A page without a header of its own goes on in the bands of the last
one before it; pages before the first header are a cover. A line that can't be
placed is unresolved with a reason and closes the row above it; a line with a
description only is carried on to that row, over pages too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import money
from ledgerlens.operators import geometry, tabular
from ledgerlens.operators.profiles import ROLES
from ledgerlens.operators.stored import written

#: Lines of a page that may be; only makes one number of page and line.
LINES = 100_000
MONEY = ("debit", "credit", "amount", "balance")
LOST_TAIL, NOT_TEXT = "lines follow the footer", "unreadable glyphs"
LOOSE, UNDATED = "a word is outside every column or between two", "row has no date but figures or loose words"


def lines_of(words: DataFrame) -> DataFrame:
    """words with ``line`` (from 1 on each page) and ``in_line`` (from 1, left to right)."""
    at = geometry.group_lines(words, keep=tuple(c for c in words.columns if c not in ("doc_id", "page", "word_no")))
    return at.withColumn("in_line", F.row_number().over(Window.partitionBy("doc_id", "page", "line").orderBy("x0", "word_no")))


def texts_of(placed: DataFrame) -> DataFrame:
    """doc_id, page, line, raw, y: each line's text, and the height of its first word, half to even."""
    made = F.array_sort(F.collect_list(F.struct("in_line", "text", "top")))  # the words of one line
    return placed.groupBy("doc_id", "page", "line").agg(made.alias("w")).select("doc_id", "page", "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("raw"), F.bround(F.get("w", F.lit(0))["top"], 0).cast("long").alias("y"))


def labels_of(profiles: DataFrame, aligns: dict[str, str] | None = None) -> DataFrame:
    """layout_id, role, align, label: the first label of each role; text roles are left, money roles right unless told."""
    align = F.create_map(*[x for r in ROLES for x in (F.lit(r), F.lit((aligns or {}).get(r, "right" if r in MONEY else "left")))])
    return profiles.select("layout_id", F.explode("labels").alias("role", "names")).select("layout_id", "role", F.element_at(align, F.col("role")).alias("align"), F.get("names", F.lit(0)).alias("label"))


def head_text(words: DataFrame, count: int = 2) -> DataFrame:
    """(doc_id, head): the lines of the first ``count`` pages; what layouts are detected and accounts looked for by."""
    top = texts_of(lines_of(words.filter(F.col("page") <= count)))
    lines = F.array_sort(F.collect_list(F.struct("page", "line", "raw")))  # of two pages
    return top.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["raw"]), "\n").alias("head"))


def parse(words: DataFrame, docs: DataFrame, profiles: DataFrame, aligns: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, txns, unresolved) as ``tabular.parse`` gives them; locators are page:P,y:Y."""
    interpreted, stated = read(words, docs, profiles, aligns)
    return tabular.assemble(interpreted, docs, stated)


def read(words: DataFrame, docs: DataFrame, profiles: DataFrame, aligns: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, documents) as ``tabular.read`` gives them.

    Document status: ok, no_profile, no_header, no_column (a label is not in the header), not_text (no words, or glyphs
    without characters). Only documents that are ok have rows.
    """
    known = docs.join(profiles, "layout_id", "left")
    bad = words.groupBy("doc_id").agg(F.bool_or(F.contains("text", F.lit("(cid:"))).alias("glyphs"))
    words = words.join(bad.filter("glyphs").select("doc_id"), "doc_id", "left_anti")
    placed = written(lines_of(words))
    texts = written(texts_of(placed).join(known.select("doc_id", "layout_id", "tokens", "skip", "summary", "footer"), "doc_id"))
    low = F.lower("raw")
    heads = texts.filter(F.forall("tokens", lambda t: F.contains(low, F.lower(F.trim(t))))).groupBy("doc_id", "page").agg(F.min("line").alias("head_line"))
    pages = texts.select("doc_id", "page").distinct().join(heads, ["doc_id", "page"], "left")
    last = F.max(F.when(F.col("head_line").isNotNull(), F.col("page"))).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    pages = pages.withColumn("head_page", last)

    unit = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("page").cast("string"))
    head_words = placed.join(heads, ["doc_id", "page"]).filter("line = head_line").join(docs.select("doc_id", "layout_id"), "doc_id").select(unit.alias("doc_id"), "layout_id", F.col("in_line").alias("word_no"), "text", "x0", "x1")
    asked = labels_of(profiles, aligns)
    found = geometry.find_labels(head_words, asked, ("layout_id",))
    found = written(found)
    bands = geometry.build_bands(found)

    body = texts.join(pages, ["doc_id", "page"]).filter("head_page IS NOT NULL AND (head_line IS NULL OR line > head_line)")
    seen = lambda c: F.coalesce(F.regexp_like("raw", F.col(c)), F.lit(False))
    body = body.withColumn("is_footer", seen("footer")).withColumn("furniture", seen("skip") | seen("summary") | F.col("is_footer"))
    page = Window.partitionBy("doc_id", "page")
    body = body.withColumn("cut", F.min(F.when(F.col("is_footer"), F.col("line"))).over(page)).withColumn("tail", F.count_if((F.col("line") > F.col("cut")) & ~F.col("furniture")).over(page))
    ends = body.filter("line = cut AND tail > 0").select("doc_id", "page", "line", "raw", "y")
    live = body.filter("(cut IS NULL OR line < cut) AND NOT furniture").select("doc_id", "page", "line", "raw", "y", "head_page")

    own = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("head_page").cast("string"))
    mine = placed.join(live.select("doc_id", "page", "line", "head_page"), ["doc_id", "page", "line"]).withColumn("unit", own).withColumn("w", F.concat_ws(":", F.col("page").cast("string"), F.col("word_no").cast("string")))
    here = mine.select(F.col("unit").alias("doc_id"), F.col("w").alias("word_no"), F.col("x0").alias("w_x0"), F.col("x1").alias("w_x1"), F.col("doc_id").alias("of"), "page", "line", "in_line", "text")
    told = geometry.assign(here, bands, keep=("of", "page", "line", "in_line", "text")).drop("doc_id").withColumnRenamed("of", "doc_id")
    parts = F.array_sort(F.collect_list(F.struct("in_line", "text", "role")))  # the words of one line
    cells = told.groupBy("doc_id", "page", "line").agg(parts.alias("p"))
    cells = cells.select("doc_id", "page", "line", F.exists("p", lambda x: x["role"].isNull()).alias("loose"), *[F.array_join(F.transform(F.filter("p", _is(r)), lambda x: x["text"]), " ").alias(f"c_{r}") for r in ROLES])
    rows = live.join(cells, ["doc_id", "page", "line"]).join(known.select("doc_id", "dates", "sign", "credit_tokens", "debit_tokens", "running"), "doc_id")
    number = F.col("page").cast("long") * LINES + F.col("line")
    locator = F.concat(F.lit("page:"), F.col("page").cast("string"), F.lit(",y:"), F.col("y").cast("string"))
    rows = rows.withColumn("row_no", number).withColumn("locator", locator)
    undated = money.is_empty(F.col("c_date"))
    figures = F.lit(False)
    for r in MONEY:
        figures = figures | ~money.is_empty(F.col(f"c_{r}"))
    state = F.when(undated & (figures | F.col("loose")), UNDATED).when(undated, "carried").when(F.col("loose"), LOOSE)
    rows = written(rows.withColumn("state", state))
    got = tabular.interpret(rows.filter("state IS NULL"), tabular.formats_of(profiles))
    none = {c: F.lit(None).cast(got.schema[c].dataType) for c in ("date", "value_date", "amount", "balance_after", "description", "reference", "sign_source")}
    odd = rows.filter("state IS NOT NULL AND state <> 'carried'").select("doc_id", "row_no", "locator", "raw", F.col("state").alias("reason")).unionByName(ends.select("doc_id", number.alias("row_no"), locator.alias("locator"), "raw", F.lit(LOST_TAIL).alias("reason")))
    got = written(got.unionByName(odd.withColumns(none)))
    kinds = got.select("doc_id", F.col("row_no").alias("pos"), F.when(F.col("reason").isNull(), "row").otherwise("bad").alias("kind"), F.coalesce("description", F.lit("")).alias("text"))
    more = rows.filter("state = 'carried' AND c_description <> ''").select("doc_id", F.col("row_no").alias("pos"), F.lit("cont").alias("kind"), F.col("c_description").alias("text"))
    joined = geometry.join_continuations(kinds.unionByName(more)).select("doc_id", F.col("pos").alias("row_no"), F.trim("text").alias("whole"))
    got = got.join(joined, ["doc_id", "row_no"], "left").withColumn("description", F.coalesce("whole", "description")).drop("whole")

    above = F.array_sort(F.collect_list(F.struct("page", "line", "raw")))
    said = texts.join(heads, ["doc_id", "page"]).filter("line < head_line").groupBy("doc_id").agg(F.array_join(F.transform(above, lambda x: x["raw"]), "\n").alias("preamble"))
    need = asked.groupBy("layout_id").agg(F.count("*").alias("n_labels"))
    have = found.groupBy("doc_id").agg(F.count("*").alias("n")).select(F.regexp_replace("doc_id", "#[^#]*$", "").alias("key"), "n").groupBy("key").agg(F.min("n").alias("n"))
    first = heads.groupBy("doc_id").agg(F.min("page").alias("first_page"))
    stated = known.join(bad, "doc_id", "left").join(first, "doc_id", "left").join(need, "layout_id", "left").join(have, F.col("doc_id").cast("string") == F.col("key"), "left").join(said, "doc_id", "left")
    status = F.when(F.col("tokens").isNull(), "no_profile").when(F.coalesce("glyphs", F.lit(True)), "not_text").when(F.col("first_page").isNull(), "no_header").when(F.coalesce("n", F.lit(0)) < F.col("n_labels"), "no_column").otherwise("ok")
    stated = written(stated.select("doc_id", "layout_id", "account_id", "container", "running", status.alias("status"), *tabular.figures_of(F.coalesce("preamble", F.lit("")))))
    return got.join(stated.filter("status = 'ok'").select("doc_id"), "doc_id", "left_semi"), stated


def row_samples(txns: DataFrame, profiles: DataFrame, count: int = 5) -> DataFrame:
    """doc_id, pos, sample (header label to cell): the first rows of each document as its layout would print them, as cases for a self-test.

    txns: rows of ``parse`` with layout_id. Dates are in the layout's first
    format; figures stand under debit or credit, or are signed.
    """
    first = txns.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).filter(F.col("k") <= count).join(profiles.select("layout_id", "labels", "dates", "sign"), "layout_id")
    amount, size = F.col("amount"), money.render(F.abs("amount"))
    by_column = F.col("sign") == "columns"
    day = F.lit(None).cast("string")
    for f in tabular.formats_of(profiles):
        day = F.when(F.get("dates", F.lit(0)) == f, F.date_format("date", f)).otherwise(day)
    cell = {
        "date": day, "description": F.col("description"), "debit": F.when(by_column & (amount <= 0), size).otherwise(""), "credit": F.when(by_column & (amount > 0), size).otherwise(""),
        "balance": F.when(by_column & F.col("balance_after").isNotNull(), money.render(F.col("balance_after"))).otherwise(""), "amount": F.when(by_column, "").otherwise(F.concat(F.when(amount > 0, "+").otherwise("-"), size)),
    }
    of_role = lambda e: reduce(lambda out, r: F.when(e["key"] == r, cell[r]).otherwise(out), cell, F.lit(None).cast("string"))
    shown = F.transform(F.filter(F.map_entries("labels"), lambda e: e["key"].isin(*cell)), lambda e: F.struct(F.get(e["value"], F.lit(0)).alias("label"), of_role(e).alias("cell")))
    return first.select("doc_id", "pos", F.map_from_entries(shown).alias("sample"))


def _is(role: str):
    return lambda x: x["role"] == role

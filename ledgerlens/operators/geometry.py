"""Positioned words of pages: bands, assignment to columns, footers, continuation lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_labels(header: DataFrame, labels: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, role, align, x0, x1: where a label's words stand next to each other in the header; the first place counts.

    header: doc_id, word_no (from 1, without holes), text, x0, x1. labels: role,
    align, label. on: columns of both that must agree, such as the layout.
    """
    words = labels.select(*on, "role", "align", F.split(F.lower(F.trim("label")), r"\s+").alias("parts"))
    asked = words.select(*[F.col(c).alias(f"on_{c}") for c in on], "role", "align", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    same = reduce(Column.__and__, [F.col(c) == F.col(f"on_{c}") for c in on], F.lower(F.trim("text")) == F.col("part"))
    met = header.join(asked, same).withColumn("begin", F.col("word_no") - F.col("k"))
    whole = met.groupBy("doc_id", "role", "align", "n", "begin").agg(F.count("*").alias("c"), F.min_by("x0", "k").alias("x0"), F.max_by("x1", "k").alias("x1")).filter("c = n")
    return whole.groupBy("doc_id", "role", "align").agg(F.min(F.struct("begin", "x0", "x1")).alias("b")).select("doc_id", "role", "align", "b.x0", "b.x1")


def build_bands(header: DataFrame) -> DataFrame:
    """doc_id, role, align, x0, x1: a text column's band reaches from its label to the next label (the last one without end)."""
    end = F.coalesce(F.lead("x0").over(Window.partitionBy("doc_id").orderBy("x0")), F.lit(float("inf")))
    return header.withColumn("x1", F.when(F.col("align") == "left", end).otherwise(F.col("x1")))


def assign(words: DataFrame, bands: DataFrame, tolerance: float = 6.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, word_no, role: the numeric band whose edge is nearest, within tolerance (a tie: null), else the first text band that holds the word's left edge.

    A right band is matched by right edges, a center band by middles. A header's
    few bands are one array, so a word is placed within its row. Words of
    documents without bands have no row. With columns to ``keep`` these come
    along, and words of documents without bands have no role.
    """
    few = bands.groupBy("doc_id").agg(F.collect_list(F.struct("role", "align", "x0", "x1")).alias("bands"))
    both = words.join(few, "doc_id", "left" if keep else "inner")
    middle = (F.col("w_x0") + F.col("w_x1")) / 2

    def far(b: Column) -> Column:
        return F.when(b["align"] == "center", F.abs(middle - (b["x0"] + b["x1"]) / 2)).otherwise(F.abs(F.col("w_x1") - b["x1"]))

    near = F.array_sort(F.transform(F.filter("bands", lambda b: (b["align"] != "left") & (far(b) <= tolerance)), lambda b: F.struct(far(b).alias("d"), b["role"].alias("role"))))
    text = F.array_min(F.transform(F.filter("bands", lambda b: (b["align"] == "left") & (F.col("w_x0") >= b["x0"] - tolerance) & (F.col("w_x0") < b["x1"])), lambda b: F.struct(b["x0"].alias("x0"), b["role"].alias("role"))))
    best = both.select("doc_id", "word_no", *keep, near.alias("near"), text.alias("textual"))
    tie = F.coalesce(F.abs(F.get("near", F.lit(1))["d"] - F.get("near", F.lit(0))["d"]) < 1e-9, F.lit(False))
    return best.select("doc_id", "word_no", *keep, F.when(F.size("near") > 0, F.when(~tie, F.get("near", F.lit(0))["role"])).otherwise(F.col("textual.role")).alias("role"))


def footer_cut(lines: DataFrame) -> DataFrame:
    """Lines before their page's first footer."""
    first = F.min(F.when(F.col("is_footer"), F.col("line_no"))).over(Window.partitionBy("doc_id", "page"))
    return lines.withColumn("__f", first).filter("__f IS NULL OR line_no < __f").drop("__f")


def join_continuations(lines: DataFrame) -> DataFrame:
    """doc_id, pos, text: each ``row`` line with the ``cont`` lines after it; any other kind closes the row."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max(F.when(F.col("kind") != "cont", F.struct("pos", "kind"))).over(w)
    rows = lines.withColumn("o", opened).filter(F.col("o.kind") == "row")
    return rows.groupBy("doc_id", F.col("o.pos").alias("pos")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(lines["pos"].alias("p"), "text"))), lambda x: x["text"]), " ").alias("text"))


def group_lines(words: DataFrame, tolerance: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page, word_no, line, and the columns to ``keep``: words by (top, x0), each on the first line whose first word is within tolerance.

    An ordered fold, which no window frame expresses; over a page's distinct
    heights only, as words of one height share a line.
    """
    page = words.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct(F.bround("top", 1).alias("t"), "x0", "word_no", "top", *[c for c in keep if c not in ("x0", "top")]))).alias("w"))
    page = page.withColumn("tops", F.array_distinct(F.transform("w", lambda x: x["top"])))
    empty = F.struct(F.array().cast("array<double>").alias("anchors"), F.array().cast("array<bigint>").alias("lines"))

    def place(acc, top):
        near = F.array_position(F.transform(acc["anchors"], lambda a: F.abs(a - top) <= tolerance), F.lit(True))
        line = F.when(near > 0, near).otherwise(F.size(acc["anchors"]) + 1).cast("bigint")
        anchors = F.when(near > 0, acc["anchors"]).otherwise(F.concat(acc["anchors"], F.array(top)))
        return F.struct(anchors.alias("anchors"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    page = page.withColumn("lines", F.aggregate("tops", empty, place)["lines"])
    line_of = lambda x: F.get("lines", F.array_position("tops", x["top"]).cast("int") - 1)
    return page.select("doc_id", "page", F.inline(F.transform("w", lambda x: F.struct(x["word_no"].cast("bigint").alias("word_no"), line_of(x).alias("line"), *[x[c].alias(c) for c in keep]))))

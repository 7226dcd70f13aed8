"""Texts without what could identify anyone: words off a list of layout words become shapes.

A token is a run without blanks and breakers; a comma stays inside before a
digit. Tokens on the allowlist stay, compounds of allowed parts too; of a number
with a short allowed suffix the number is masked. Native functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Punctuation that ends a token (all ASCII punctuation but . _ / -), a token, a number with a glued suffix.
BREAKERS = r"!\"#$%&'()*+,:;<=>?@\[\\\]^`{|}~"
TOKEN = rf"(?U)[^\W_](?:[^\s{BREAKERS}]|,(?=\d))*"
GLUED = r"^([0-9][0-9,]*(?:\.[0-9]+)?)(\s*)([A-Za-z]{1,3})(\.?)$"
NUMERIC = r"^[0-9][0-9,]*(\.[0-9]+)?$"


def folded(token: Column) -> Column:
    """What a token is looked up by: letters and digits of any script, upper case."""
    return F.upper(F.regexp_replace(token, r"(?U)[\W_]", ""))


def allowlist(lines: DataFrame, line: str = "value") -> DataFrame:
    """(word): the folded words of a vocabulary file; blank lines and # comments are skipped."""
    t = F.trim(line)
    return lines.filter((t != "") & ~F.startswith(t, F.lit("#"))).select(folded(t).alias("word")).filter("word <> ''").distinct()


def allowlists(*files: DataFrame, line: str = "value") -> DataFrame:
    """(word): the words of several vocabulary files, the shared one and personal ones, each once."""
    return reduce(DataFrame.unionByName, [allowlist(f, line) for f in files]).distinct()


def shape(token: Column, hide_magnitude: bool = False) -> Column:
    """Digits to 9, capitals to X, small letters and everything else outside ASCII to x; ASCII punctuation stays."""
    out = token
    for pattern, to in ((r"\p{Nd}", "9"), (r"\p{Lu}", "X"), (r"\p{Ll}", "x"), (r"[^\x00-\x7F]", "x")):
        out = F.regexp_replace(out, pattern, to)
    if not hide_magnitude:
        return out
    # the first number's whole part gets one width, so that its digits don't tell its size
    return F.when(token.rlike(r"\p{Nd}"), F.regexp_replace(out, r"^([^9]*)9[9,]*(?=(?:\.99)?(?!9))", "$19,999")).otherwise(out)


def mask_token(token: Column, allowed: Column, hide_magnitude: bool = False) -> Column:
    """A token as it may be shown. ``allowed``: array of folded words."""
    parts = F.transform(F.split(token, "[/-]"), folded)
    free = F.array_contains(allowed, folded(token)) | ((F.size(parts) > 1) & F.forall(parts, lambda p: (p != "") & F.array_contains(allowed, p)))
    number, suffix = F.regexp_extract(token, GLUED, 1), F.regexp_extract(token, GLUED, 3)
    glued = token.rlike(GLUED) & F.array_contains(allowed, folded(suffix))
    rest = F.concat(F.regexp_extract(token, GLUED, 2), suffix, F.regexp_extract(token, GLUED, 4))
    return F.when(free, token).when(glued, F.concat(shape(number, hide_magnitude), rest)).otherwise(shape(token, hide_magnitude))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def mask_text(text: Column, allowed: Column, hide_magnitude: bool = False) -> Column:
    """The text with every token masked; what stands between tokens stays."""
    gaps = F.split(F.regexp_replace(text, TOKEN, "\x00"), "\x00")
    masked = F.transform(tokens(text), lambda t: mask_token(t, allowed, hide_magnitude))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), masked.alias("m")), lambda x: F.array(F.coalesce(x["g"], F.lit("")), F.coalesce(x["m"], F.lit(""))))), "")


def candidates(texts: DataFrame, text: str, allowed: Column, top: int = 200) -> DataFrame:
    """(word, n): the folded words that masking changed most often, without plain numbers; what an allowlist may lack."""
    each = texts.select(F.explode(tokens(F.col(text))).alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    changed = each.filter((mask_token(F.col("t"), allowed) != F.col("t")) & ~F.col("t").rlike(NUMERIC))
    return changed.groupBy(folded(F.col("t")).alias("word")).agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def shape_histogram(cells: DataFrame, allowed: Column, top: int = 4) -> DataFrame:
    """(col, shape, n): the most frequent masked forms of each column; ties by first row. cells: col, row_no, cell."""
    g = cells.groupBy("col", mask_text(F.col("cell"), allowed).alias("shape")).agg(F.count("*").alias("n"), F.min("row_no").alias("f"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "f"))).filter(F.col("r") <= top).select("col", "shape", "n")


def edges(rows: DataFrame, count: int) -> DataFrame:
    """The first and last ``count`` rows of each document (doc_id, row_no)."""
    size = rows.groupBy("doc_id").agg(F.max("row_no").alias("n_rows"))
    return rows.join(size, "doc_id").filter((F.col("row_no") <= count) | (F.col("row_no") > F.col("n_rows") - count))


def masked_lines(words: DataFrame, allowed: Column, hide_magnitude: bool = False) -> DataFrame:
    """doc_id, page, y, line: positioned words (doc_id, page, text, x0, top) masked and put together by rounded height, left to right; a word shows where it begins."""
    shown = F.concat(F.round("x0", 0).cast("int").cast("string"), F.lit(":"), mask_text(F.col("text"), allowed, hide_magnitude))
    made = F.array_sort(F.collect_list(F.struct("x0", shown.alias("w"))))  # the words of one line
    return words.groupBy("doc_id", "page", F.bround("top", 0).cast("int").alias("y")).agg(made.alias("w")).select("doc_id", "page", "y", F.array_join(F.transform("w", lambda x: x["w"]), " ").alias("line"))


def dump(rows: DataFrame, folder: str, allowed: Column, hide_magnitude: bool = False) -> None:
    """Write rows (doc_id, row_no, raw) masked, as text files in a folder for each document, in order."""
    masked = rows.select("doc_id", "row_no", mask_text(F.col("raw"), allowed, hide_magnitude).alias("value"))
    masked.repartition("doc_id").sortWithinPartitions("doc_id", "row_no").select("doc_id", "value").write.partitionBy("doc_id").text(folder)

"""Rule bitmask ledger: measure a text once, store failure bits, decide and ablate later.

``ledger`` evaluates every rule once for each row. ``apply_policy`` turns bits
into decisions under a versioned policy (a bit mask). ``ablation`` says what
each rule costs under a policy, from one aggregation over distinct bit masks.

Everything happens within a row with built-in functions, so there is no
shuffle, no key can be hot, and repeated rows or ids change nothing.

Defined cases: a null or empty text has no words, fails ``too_short`` and only
that rule; a null id stays null; extra input columns are ignored by ``ledger``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANKS, fence, table, words

SYMBOLS = "#*$%&|<>"
#: A window position takes the low 20 bits of a sort key; longer texts use the exact keys.
POSITION_BITS = 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A row fails the rule where ``fails`` (SQL over the measures) is true."""

    name: str
    fails: str


#: The position of a rule is its bit. Append only: stored ledgers keep their meaning.
RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 16 * n_words)"),
)
#: Policy versions: the bits that reject a document.
POLICIES = {"base-1": 0b00011, "full-1": 0b11111}


def _covered(flagged: Column) -> Column:
    """Words under the three-word windows that start at these sorted positions."""
    gaps = F.transform(flagged, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(flagged, i - 1))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the MEASURES (long) of its text, under ``prefix``.

    Three-word windows are sorted by a long that holds 44 hash bits and the
    position, so equal windows are neighbours. Should two different windows
    share the hash bits, or the text outgrow the position bits, the row is redone
    with the windows' own text as the key; the result is exact either way.
    """
    mask, p = (1 << POSITION_BITS) - 1, prefix
    low = F.lit(mask).cast("long")
    t, kept = F.coalesce(F.col(text), F.lit("")), docs.columns
    w, s, n = F.col("__w"), F.col("__s"), F.col("__n")
    out = docs.withColumn("__w", words(F.col(text))).withColumn("__n", F.size("__w"))
    three, short = n >= 3, F.array().cast("array<bigint>")
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~mask).cast("long")).bitwiseOR(i.cast("long")))
    out = out.withColumn("__s", F.when(three, F.sort_array(packed)).otherwise(short))
    same = F.filter(F.sequence(F.lit(0), n - 4), lambda j: F.shiftright(F.get(s, j), POSITION_BITS) == F.shiftright(F.get(s, j + 1), POSITION_BITS))
    out = out.withColumn("__d", F.when(n >= 4, same).otherwise(F.array().cast("array<int>")))
    d, at = F.col("__d"), lambda j: F.get(s, j).bitwiseAND(low).cast("int")
    differ = lambda j: (F.get(w, at(j)) != F.get(w, at(j + 1))) | (F.get(w, at(j) + 1) != F.get(w, at(j + 1) + 1)) | (F.get(w, at(j) + 2) != F.get(w, at(j + 1) + 2))
    exact_needed = (n > mask) | F.exists(d, differ)
    fast = F.sort_array(F.array_distinct(F.flatten(F.transform(d, lambda j: F.array(at(j), at(j + 1))))))
    out = out.withColumn("__f", F.when(~exact_needed, fast))
    keys = F.when(F.col("__f").isNull(), F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i")))))
    out = out.withColumn("__k", keys)
    k = F.col("__k")
    slow = F.sort_array(F.transform(F.filter(k, lambda x, j: F.coalesce(x["k"] == F.get(k, j + 1)["k"], F.lit(False)) | F.coalesce(x["k"] == F.get(k, j - 1)["k"], F.lit(False))), lambda x: x["i"]))
    out = out.withColumn("__f", F.coalesce(F.col("__f"), slow))
    out = out.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{BLANKS}]")))
    made = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(t, f"[{BLANKS}]+", "")),
        "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.when(F.size("__f") == 0, F.lit(0)).otherwise(_covered(F.col("__f"))),
    }
    return out.select(*[F.col(f"`{c}`") for c in kept], *[fence(c.cast("long")).alias(p + name) for name, c in made.items()])


def bits(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """The failure bits of a row that holds the measures under ``prefix``."""
    total = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        fails = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"{prefix}\1", rule.fails)
        total = total.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return total


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its id, the measures and ``bits``."""
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    return measure(bare, "__text").withColumn("bits", bits(rules)).drop("__text")


def apply_policy(ledger: DataFrame, policy: int) -> DataFrame:
    """The ledger with ``kept``: false where a bit of the policy is set."""
    return ledger.withColumn("kept", F.col("bits").bitwiseAND(F.lit(policy).cast("long")) == 0)


def keep(docs: DataFrame, policy: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns, whatever their names."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("__text"))
    measured = measure(wrapped, "__text").withColumn("bits", bits(rules))
    return measured.filter(F.col("bits").bitwiseAND(F.lit(policy).cast("long")) == 0).select("row.*")


def ablation(ledger: DataFrame, policy: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the policy without it rejects."""
    masks = ledger.groupBy("bits").agg(F.count("*").alias("n"))
    mine = [(k, r.name) for k, r in enumerate(rules) if policy >> k & 1]
    rows = masks.select("n", F.col("bits").bitwiseAND(F.lit(policy).cast("long")).alias("b"), F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in mine])).alias("r"))
    has = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    without = F.col("b").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(count(has).alias("failed"), count(has & (without == 0)).alias("failed_alone"), count(without != 0).alias("rejected_without"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES["full-1"])
    base = F.col("bits").bitwiseAND(F.lit(POLICIES["base-1"]).cast("long")) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "bits")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c >= 2),
n AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN n USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words
            OR (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)
            OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 16 * n_words))) AS kept,
       CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
            + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)::INT + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 16 * n_words))::INT AS BIGINT) AS bits
FROM m
"""

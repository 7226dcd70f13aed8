"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

``water_fill`` gives each source its share of a budget by weight, clamps
sources at ``max_epochs`` times their size and shares the excess out again
until no source is above its clamp. ``repeat`` then takes every document of a
source a whole number of times and adds one more repetition for the documents
below a cut in a seeded hash order. The cut is found digit by digit (256 bins
for each source and round), so a source with a third of all rows is summed up
where its rows lie and never sorted in one place.

Defined cases: a null source is a source of its own, after all others; a null
or empty text has size 0 and is taken whenever its place in the order is; rows
with equal ids (null ids: equal texts) fall on the same side of the cut; weights that are
null, negative or missing count as 0; with no words or no weight nothing is
taken; an empty table gives an empty result; other columns pass through ``repeat``
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANKS, fence, materialize, table

#: Rounds of the cut's search and bits of each: 2**32 places in the order.
ROUNDS, BITS = 4, 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's place in the seeded order, 0 to 2**32 - 1; without an id the text tells it apart."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 8), 16, 10).cast("long")


def source_rank(sizes: DataFrame) -> DataFrame:
    """``__source, __null`` with ``rank``: 0, 1, ... by code point, null last.

    A range sort; each range counts its own sources, and what lies before a
    range is a sum over as many rows as there are ranges. No task needs the
    whole list of sources.
    """
    ordered = sizes.select("__source", "__null").repartitionByRange("__null", "__source").sortWithinPartitions("__null", "__source")
    placed = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()), "ranks")
    part, low = F.shiftright("__at", 33), F.lit((1 << 33) - 1)
    ranges = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__count"))
    before = ranges.select("__part", (F.sum("__count").over(Window.orderBy("__part")) - F.col("__count")).alias("__before"))
    joined = placed.withColumn("__part", part).join(before, "__part")
    return joined.select("__source", "__null", (F.col("__before") + F.col("__at").bitwiseAND(low)).cast("long").alias("rank"))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``sources`` (with source_size and weight) with ``target``: the capped shares of ``budget``."""
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(F.lit(0.0))
    now = sources.withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("__w", weight).withColumn("target", F.lit(None).cast("double"))
    while True:
        free = F.col("target").isNull()
        sums = now.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("used"), F.coalesce(F.sum(F.when(free, F.col("__w"))), F.lit(0.0)).alias("weight"), F.count(F.when(free & (F.col("__w") > 0), 1)).alias("free")).first()
        level = max(0.0, budget - sums["used"]) / sums["weight"] if sums["weight"] else 0.0
        share = F.col("__w") * F.lit(level)
        over = now.filter(free & (share > F.col("__cap"))).limit(1).count()
        if not over:
            return now.withColumn("target", F.coalesce("target", F.least(share, F.col("__cap")))).drop("__cap", "__w")
        now = materialize(now.withColumn("target", F.when(free & (share > F.col("__cap")), F.col("__cap")).otherwise(F.col("target"))), "water")


def cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with ``__whole`` repetitions and ``__cut``: a document below it gets one repetition more."""
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    begun = sources.withColumn("__whole", F.floor(epochs).cast("long"))
    need = F.greatest(F.lit(0.0), F.col("target") - F.col("__whole") * F.col("source_size"))
    state = begun.withColumn("__need", need).withColumn("__cut", F.when(need > 0, F.lit(0)).otherwise(F.lit(-1)).cast("long")).withColumn("__bin", F.lit(0).cast("long"))
    state = materialize(state, "cut")
    for k in range(ROUNDS):
        left = 32 - BITS * k
        open_ = state.filter("__cut >= 0").select("__source", "__null", "__need", F.col("__cut").alias("__at"))
        rows = sized.join(open_, ["__source", "__null"]).filter(F.shiftright("__place", left) == F.col("__at"))
        bins = rows.groupBy("__source", "__null", "__need", "__at", F.shiftright("__place", left - BITS).alias("__b")).agg(F.sum("size").alias("__s"))
        sofar = bins.withColumn("__sum", F.sum("__s").over(Window.partitionBy("__source", "__null").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)))
        chosen = sofar.filter("__sum >= __need").groupBy("__source", "__null").agg(F.min(F.struct("__b", "__s", "__sum")).alias("__x"))
        joined = state.join(chosen, ["__source", "__null"], "left")
        found = F.col("__x").isNotNull()
        state = materialize(
            joined.withColumn("__need", F.when(found, F.col("__need") - (F.col("__x.__sum") - F.col("__x.__s"))).otherwise(F.col("__need")))
            .withColumn("__bin", F.when(found, F.col("__x.__s")).otherwise(F.col("__bin")))
            .withColumn("__cut", F.when(found, F.col("__x.__b")).when(F.col("__cut") >= 0, (F.col("__cut") + 1) * (1 << BITS)).otherwise(F.col("__cut")))
            .drop("__x"),
            "cut",
        )
    closer = F.when((F.col("__cut") >= 0) & (2 * F.col("__need") > F.col("__bin")), 1).otherwise(0)
    return state.withColumn("__cut", F.greatest(F.lit(0).cast("long"), F.col("__cut") + closer)).drop("__need", "__bin")


def _keyed(docs: DataFrame, source: str) -> DataFrame:
    return docs.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("__null", F.col(source).isNull())


def plan(measured: DataFrame, pattern: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """A row for each source of ``measured`` (as ``sizes`` writes it): its size, target, whole repetitions and cut.

    pattern: weights given to the sources in code point order, repeating.
    share: the mix's words as a part of all words.
    """
    per = measured.groupBy("__source", "__null").agg(F.sum("size").alias("source_size"))
    per = materialize(per, "sources")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in pattern]), (F.col("rank") % len(pattern) + 1).cast("int"))
    weighed = materialize(per.join(source_rank(per), ["__source", "__null"]).withColumn("weight", weight), "weighed")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    return cuts(measured, water_fill(weighed, share * total, max_epochs)).select("__source", "__null", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__whole", "__cut")


def sizes(docs: DataFrame, seed: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The written table that the rounds read instead of the texts."""
    return materialize(_keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")), "source").select("doc_id", "__source", "__null", n_words(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text"), seed).alias("__place")), "sizes")


def times() -> Column:
    return F.col("__whole") + F.when(F.col("__place") < F.col("__cut"), 1).otherwise(0)


#: What the query op4 and the pipeline's mixing stage ask for.
PATTERN, SHARE, MAX_EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 7


def ledger(docs: DataFrame, pattern: tuple[float, ...] = PATTERN, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    measured = sizes(docs, seed)
    out = measured.join(plan(measured, pattern, share, max_epochs), ["__source", "__null"])
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.round("__target", 6).alias("target"), (F.col("size") * times()).alias("taken"))


def repeat(docs: DataFrame, pattern: tuple[float, ...] = PATTERN, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    rates = plan(sizes(docs, seed), pattern, share, max_epochs)
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("__own"), place(F.col("doc_id"), F.col("text"), seed).alias("__place"))
    rows = _keyed(wrapped, "__own").join(rates, ["__source", "__null"]).withColumn("__times", fence(times()))
    return rows.filter("__times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))).alias("__k")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS sn,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 8) AS BIGINT) AS place
  FROM documents),
src AS (
  SELECT s, sn, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY sn, s) - 1) % 3] AS DOUBLE) AS w
  FROM d GROUP BY s, sn),
fill(k, s, sn, source_size, w, target, used, weight) AS (
  SELECT 0, s, sn, source_size, w, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), (SELECT sum(w) FROM src) FROM src
  UNION ALL
  SELECT k + 1, s, sn, source_size, w, target, coalesce(sum(target) OVER (), 0), sum(CASE WHEN target IS NULL THEN w END) OVER ()
  FROM (SELECT k, s, sn, source_size, w,
               CASE WHEN target IS NULL AND w * ((SELECT 1.5 * sum(source_size) FROM src) - used) / weight > 2.0 * source_size
                    THEN 2.0 * source_size ELSE target END AS target
        FROM fill WHERE k < 30)),
t AS (SELECT s, sn, source_size, coalesce(target, w * (((SELECT 1.5 * sum(source_size) FROM src) - used) / weight)) AS target FROM fill WHERE k = 30),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
b AS (SELECT s, sn, place, sum(size) AS z FROM d GROUP BY s, sn, place),
c AS (SELECT b.*, target - whole * source_size AS need, sum(z) OVER (PARTITION BY b.s, b.sn ORDER BY place) AS upto FROM b JOIN n ON b.s = n.s AND b.sn = n.sn),
e AS (SELECT s, sn, min(place) AS place, min_by(z, place) AS z, min_by(need - (upto - z), place) AS rest FROM c WHERE upto >= need AND need > 0 GROUP BY s, sn)
SELECT doc_id, size, n.source_size, round(n.target, 6) AS target,
       CAST(size * (whole + CASE WHEN e.place IS NULL THEN 0 WHEN d.place < e.place OR (d.place = e.place AND 2 * rest > z) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN n ON d.s = n.s AND d.sn = n.sn LEFT JOIN e ON d.s = e.s AND d.sn = e.sn
"""

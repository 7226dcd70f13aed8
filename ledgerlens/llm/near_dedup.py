"""Near-duplicate documents by bottom-k sketches and inverted lists, confirmed on full sets.

1. One hash function turns a text into its set of five-word shingles. The sets'
   values are put in one order: by hash, but values that a sample finds
   frequent come last, by frequency (told by a table of fixed size). A set's sketch holds its first n // 4 + 1
   values, so k grows with the set. Two sets at the threshold always share a
   value of both sketches (prefix filter), so no link is lost. Texts with equal
   sets are one class.
2. Retained values that two classes have make inverted lists. A value at places
   a and b of two sets that is their first common one bounds their overlap by
   what follows it, so most rows of a list never pair.
3. A list never expands to all pairs. First each list's members are compared
   with one of them, its pivot, and links merge classes. Then members that are
   still in different components are paired, each pair with the overlap its
   lists count. The union of the two sketches gives a sure bound of the sets'
   overlap instead of an estimate, because a sketch whose frequent values come
   last is no random sample; an estimate could lose links, a bound can't. Two
   members that have a list's value late, after a seventh of their sets, can't
   reach the threshold if it is their first common one, so late members only
   meet early ones: documents that share a boilerplate below the threshold have
   its values late, and such a list, however long, is not paired with itself.
   Only comparisons inside one component are left out, and those can't change
   the components.
4. What the bound allows is confirmed by the exact Jaccard similarity of the
   full sets, which are made only for classes in such pairs.

Class ids are 64-bit digests of the sets.

Defined cases: a null, empty or blank text has no shingles and is alone; fewer
than five words are one shingle; equal sets are always linked; a null id never
names a component unless all ids in it are null; rows that repeat an id are
judged row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, release, small, table
from ledgerlens.llm.graph import components
from ledgerlens.llm.tokens import combine, word_hashes

WORDS, PERCENT = 5, 75
#: Order only, never which pairs are found: values are counted in every SAMPLE-th text, and a table of BUCKETS bytes
#: keeps the counts' logarithms.
SAMPLE, SEEN, BUCKETS = 5, 3, 2**23
#: Texts whose sets a task holds at once.
AT_ONCE = 250
#: A frequent value's rows are dealt to so many parts while values of one class are sorted out.
SALT = 64


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = word_hashes(texts)
    n = max(0, len(h) - WORDS + 1)
    grams = combine([h[k : k + n] for k in range(WORDS)], WORDS).view(np.int64) if n else np.zeros(0, dtype=np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(grams[a : b - WORDS + 1])
        elif b > a:
            yield combine([h[k : k + 1] for k in range(a, b)], b - a).view(np.int64)
        else:
            yield grams[:0]


def class_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, dtype=np.int64)))


def retained(n: np.ndarray) -> np.ndarray:
    """How many values a set of n keeps: one more than it may lack of a set at the threshold."""
    return np.where(n > 0, n - -(-n * PERCENT // 100) + 1, 0)


def ordered(values: np.ndarray, row: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values' places in the common order of each row, and whether they count as frequent."""
    weight = weights[values.view(np.uint64) % np.uint64(len(weights))]
    return np.lexsort((values, weight, row)), weight > 0


def sketches(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, t (the text's hash), class, n (set size), sketch, often (of the sketch's values) of every row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(at, AT_ONCE)
                sets = list(shingle_sets([t or "" for t in b.column("text").to_pylist()]))
                n = np.array([len(s) for s in sets], dtype=np.int64)
                flat, row = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
                order, often = ordered(flat, row, weights)
                keep = order[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) < retained(n)[row]]
                offsets = pa.array(np.concatenate([[0], np.cumsum(retained(n))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[keep])) for x in (flat, often)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array([class_of(s) for s in sets], pa.int64()), pa.array(n), *lists], ["doc_id", "t", "class", "n", "sketch", "often"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return hashed.mapInArrow(rows, f"doc_id {kind}, t long, class long, n long, sketch array<bigint>, often array<boolean>")


def frequencies(docs: DataFrame) -> np.ndarray:
    """By hash bucket, how often a sample's most frequent value comes up (a logarithm; 0: hardly). It only sets the order of values."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                v, c = np.unique(np.concatenate(list(shingle_sets([t or "" for t in batch.slice(at, AT_ONCE).column("text").to_pylist()]))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(c)], ["v", "c"])

    part = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(rows, "v long, c long")
    seen = part.groupBy("v").agg(F.sum("c").alias("c")).filter(F.col("c") >= SEEN)
    steps = F.least(F.floor(8 * F.log2("c")), F.lit(255)).cast("short")
    found = materialize(seen.groupBy(F.pmod("v", F.lit(BUCKETS)).cast("int").alias("b")).agg(F.max(steps).alias("w")), "seen")
    top = found.toArrow()  # at most BUCKETS small rows
    release(found)
    weights = np.zeros(BUCKETS, dtype=np.uint8)
    weights[top.column("b").to_numpy()] = top.column("w").to_numpy().astype(np.uint8)
    return weights


def inverted(sketched: DataFrame) -> DataFrame:
    """(value, class, n, place): the inverted lists' rows, of values that more than one class retains."""
    one = sketched.filter("n > 0").groupBy("class").agg(F.first(F.struct("n", "sketch", "often")).alias("s"))
    rows = one.select("class", "s.n", F.posexplode(F.arrays_zip("s.sketch", "s.often")).alias("place", "v")).select(F.col("v.sketch").alias("value"), "class", "n", F.col("place").cast("long").alias("place"), F.col("v.often").alias("often"))
    # values that the sample calls frequent have many classes and pass uncounted, so no window holds a long list
    part = Window.partitionBy("value", F.when(F.col("often"), F.pmod("class", F.lit(SALT))).otherwise(0))
    return rows.withColumn("c", F.count("*").over(part)).filter("often OR c > 1").select("value", "class", "n", "place")


def may_reach(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets of these sizes reach the threshold if they share ``overlap`` values."""
    return (100 + PERCENT) * overlap >= PERCENT * (n_a + n_b)


def from_here(n_a: Column, place_a: Column, n_b: Column, place_b: Column) -> Column:
    """Whether two sets may reach the threshold if their first common value has these places."""
    return may_reach(F.least(n_a - place_a, n_b - place_b), n_a, n_b)


def early(n: Column, place: Column) -> Column:
    """Whether a set has a value early enough to reach the threshold with one that has it late; of two late ones neither has."""
    return (100 + PERCENT) * place <= (100 - PERCENT) * n


def pivot_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): each list's members with its pivot, the member that has the value first."""
    pivots = lists.groupBy("value").agg(F.min(F.struct("place", "class", "n")).alias("p"))
    both = lists.join(pivots.select("value", F.col("p.class").alias("pivot"), F.col("p.n").alias("n_p"), F.col("p.place").alias("place_p")), "value")
    near = both.filter((F.col("class") != F.col("pivot")) & from_here(F.col("n"), F.col("place"), F.col("n_p"), F.col("place_p")))
    return near.select(F.least("pivot", "class").alias("a"), F.greatest("pivot", "class").alias("b")).distinct()


def pairs_across(lists: DataFrame, merged: DataFrame) -> DataFrame:
    """(a, b): classes of different components whose sketches' union allows the threshold.

    Members outside a list's largest component meet all others of the list.
    """
    placed = lists.join(merged.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("root", F.coalesce("component", "class")).drop("component")
    placed = materialize(placed, "placed")
    top = placed.groupBy("value", "root").agg(F.count("*").alias("c")).groupBy("value").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1").select("value", "top")
    live = materialize(placed.join(top, "value"), "live")
    release(placed)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("class", "root", "n", "place")]
    one, other = live.filter("root <> top").select("value", "top", *side("a")), live.select("value", *side("b"))
    once = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("top")) | (F.col("class_a") < F.col("class_b")))
    soon = one.filter(early(F.col("n_a"), F.col("place_a"))).join(other, "value")
    late = one.filter(~early(F.col("n_a"), F.col("place_a"))).join(other.filter(early(F.col("n_b"), F.col("place_b"))), "value")
    met = soon.unionByName(late).filter(once & from_here(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b")))
    low = F.col("class_a") < F.col("class_b")
    way = lambda c, k: F.when(low == k, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    met = met.select(*[way(c, k).alias(f"{to}{x}") for c, to in (("class", ""), ("n", "n_"), ("place", "place_")) for x, k in (("a", True), ("b", False))])
    counted = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"), (F.max("place_a") + 1).alias("seen_a"), (F.max("place_b") + 1).alias("seen_b"))
    bound = F.col("shared") + F.least(F.col("n_a") - F.col("seen_a"), F.col("n_b") - F.col("seen_b"))
    out = materialize(counted.filter(may_reach(bound, F.col("n_a"), F.col("n_b"))).select("a", "b"), "across")
    release(live)
    return out


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, set) of the texts with the wanted hashes ``t``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                sets = list(shingle_sets([t or "" for t in batch.slice(at, AT_ONCE).column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), _lists(sets)], ["class", "set"])

    texts = docs.select("text", F.xxhash64("text").alias("t")).join(small(wanted), "t", "left_semi").select("text")
    return texts.mapInArrow(rows, "class long, set array<bigint>").groupBy("class").agg(F.first("set").alias("set"))


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""
    names = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = materialize(classes.join(names, "class", "left_semi").select("t"), "wanted")
    full = materialize(full_sets(docs, wanted), "full")
    side = lambda x: full.select(F.col("class").alias(x), F.col("set").alias(f"set_{x}"))
    sets = pairs.join(side("a"), "a").join(side("b"), "b")
    linked = may_reach(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a"), F.size("set_b"))
    found = materialize(sets.filter(linked).select("a", "b"), "found")
    release(wanted, full)
    return found


def links(docs: DataFrame, sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) for the classes that links between different sets join; others are not in it."""
    lists = materialize(inverted(sketched), "lists")
    first = materialize(pivot_pairs(lists), "pairs")
    found = confirmed(first, docs, classes)
    merged = materialize(components(found), "merged")
    across = pairs_across(lists, merged)
    release(lists)
    more = confirmed(across.join(first, ["a", "b"], "left_anti"), docs, classes)
    release(first, across)
    joined = merged.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    return components(joined)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``."""
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketched = materialize(sketches(bare, frequencies(bare)), "sketches")
    classes = materialize(sketched.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("id"), F.min("t").alias("t")), "classes")
    rows = materialize(sketched.select("doc_id", "n", "class"), "rows")
    roots = links(bare, sketched, classes)
    release(sketched)
    rooted = classes.join(roots, classes["class"] == roots["node"], "left").select("class", "id", F.coalesce("component", "class").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of = rooted.join(least, "root").select(F.col("class").alias("of"), "component_id")
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(of, F.col("class") == F.col("of"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) of which each group keeps one."""
    # the id and the text's hash name a row, null ids after all others, so a dropped row takes no other text of its id along
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    keyed = docs.select(key.alias("doc_id"), "text")
    judged = materialize(deduplicate(keyed).groupBy(F.col("doc_id").alias("k")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "judged")
    gone = judged.filter("NOT kept").select(F.struct(F.col("k.id").alias("id"), F.col("k.h").alias("h")).alias("gone"))
    here = F.struct(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("h"))
    out = docs.join(small(gone), here.eqNullSafe(F.col("gone")), "left_anti")
    # rows that repeat an id and a text are told apart by nothing, so only then one is picked
    return out.dropDuplicates(["doc_id", "text"]) if judged.filter("kept AND n > 1").limit(1).count() else out


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, md5(unnest(g)) AS k FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT n.doc_id, n AS n_shingles, least(n.doc_id, coalesce(m.b, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(m.b, n.doc_id)) AS kept
FROM n LEFT JOIN m ON n.doc_id = m.a
"""

"""Phrase collocation mining: word-id suffix arrays for each shard, n-gram counts from their LCP intervals, one global count by key.

A shard is a block of the words that a task has read. ``suffixes`` sorts its
suffixes by their first words with numpy prefix doubling; a run of suffixes
whose neighbours share k words is an LCP interval, and its length is the count
of that n-gram in the block. Counts of all blocks are added up by key.

Three passes over the texts keep the keys few: words first; then pairs of words
that are frequent; then longer phrases whose pairs are all frequent. A phrase
cannot be more frequent than a part of it, so nothing is lost. Both filters are
bitmaps over 64-bit hashes, of a size set by what they hold and bounded by
``BITS``: hashes that clash, or a full bitmap, only let more keys through. The
last pass counts phrases by their own text, so the result is exact.

Defined cases: a null text is empty, a null language is ``und``; repeated rows
count each time; an empty table gives no phrases; texts of any length are cut
into blocks that see the first words of the next one, so no n-gram is lost at a
cut; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, release, table
from ledgerlens.llm.tokens import combine

#: A character that ends a piece; also the token that stands between pieces, as no word can hold it.
STOP = "."
ENDS = r"[.,;:!?\n\x0b\x0c\r]"
LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of a block, bytes of texts that are split at once, and counts that are sent at once.
BLOCK, AT_ONCE, SENT = 1 << 19, 3 << 20, 1 << 16
#: A filter has 16 bits for each key it holds, but no more than this.
BITS = 1 << 28
#: Phrases that may be broadcast (a phrase is some 40 bytes).
BROADCAST_PHRASES = 500_000
KEYED = "lang string, key bigint, n bigint"
SPELLED = "lang string, phrase string, words int, n bigint"


def _tokens(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    """Of texts in a row: word ids (0: end of a piece), language ids, the words by id, the languages by id."""
    text = pc.binary_join_element_wise(pc.ascii_lower(texts), pa.scalar(STOP, texts.type), pa.scalar(" ", texts.type))
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(text, pattern=ENDS, replacement=f" {STOP} "))
    flat, lang = pc.dictionary_encode(pc.list_flatten(split)), pc.dictionary_encode(langs)
    spelled = flat.dictionary.to_pylist()
    end = spelled.index(STOP)  # each text ends with one
    ids = flat.indices.to_numpy().astype(np.int64) + 1
    ids[(ids == end + 1) | (ids == (spelled.index("") + 1 if "" in spelled else 0))] = 0  # blanks around a text split off empty strings
    return ids, np.repeat(lang.indices.to_numpy().astype(np.int64), pc.list_value_length(split).to_numpy()), ["", *spelled], lang.dictionary.to_pylist()


def suffixes(first: np.ndarray, longest: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp): suffixes that start before place ``own`` (default: all), sorted by their first ``longest`` ids; lcp[k] is what suffix k shares with the one before it, up to ``longest``."""

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[: max(0, len(x) - by)] = x[by:]
        return out

    rank, width = first, 1
    while width < longest:
        step = min(width, longest - width)  # the two windows may overlap
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + shifted(rank, step), return_inverse=True)
        width += step
    order = np.argsort(rank[:own], kind="stable")
    lcp, same = np.zeros(len(order), dtype=np.int8), np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(longest):
        x = shifted(first, k)[order]
        same &= x[1:] == x[:-1]
        lcp[1:] += same
    return order, lcp


def intervals(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each n-gram of k ids, its count). left: for each place the ids up to the end of its piece, 0 where no n-gram may start."""
    starts = np.flatnonzero(lcp < k)
    counts = np.diff(np.append(starts, len(order)))
    at = order[starts]
    return at[left[at] >= k], counts[left[at] >= k]


def _left(ids: np.ndarray) -> np.ndarray:
    """Ids from each place to the end of its piece."""
    ends = np.append(np.flatnonzero(ids == 0), len(ids))
    return ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, lang ids, words, langs, own): blocks of about BLOCK words; from place ``own`` on the words belong to the next block."""

    def parts(of: pa.Table) -> Iterator[tuple]:
        ids, lang, spelled, langs = _tokens(of["text"].combine_chunks(), of["lang"].combine_chunks())
        for at in range(0, len(ids), BLOCK):
            to = min(len(ids), at + BLOCK)
            yield ids[at : to + LONGEST - 1], lang[at : to + LONGEST - 1], spelled, langs, to - at

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        rows = pa.Table.from_batches([batch]).select(["text", "lang"])
        rows = pa.table({"text": pc.fill_null(rows["text"], "").cast(pa.large_string()), "lang": pc.fill_null(rows["lang"], "und")})
        sizes = np.cumsum(pc.binary_length(rows["text"]).to_numpy()) if len(rows) else np.zeros(0, dtype=np.int64)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE - size, side="right")))
            held.append(rows.slice(at, to - at))
            size += int(sizes[to - 1] - (sizes[at - 1] if at else 0))
            at = to
            if size >= AT_ONCE:
                yield from parts(pa.concat_tables(held))
                held, size = [], 0
    if held:
        yield from parts(pa.concat_tables(held))


def _hashes(first: np.ndarray, spelled: list[str], langs: list[str]) -> np.ndarray:
    """A 64-bit hash of the word and language of each id of ``first`` (1 + word + words x language)."""
    word = pd.util.hash_array(np.array(spelled, dtype=object), categorize=False)
    tongue = pd.util.hash_array(np.array(langs, dtype=object), categorize=False)
    at = np.maximum(first - 1, 0)
    return combine([tongue[at // len(spelled)], word[at % len(spelled)]], 1)


def _may_be(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key."""
    if bits is None:
        return np.ones(len(keys), dtype=bool)
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _prepared(block: tuple, frequent: np.ndarray | None, pairs: np.ndarray | None) -> tuple:
    """(ids that tell languages apart, their hashes, words up to the next end or rare pair)."""
    ids, lang, spelled, langs, own = block
    first = np.where(ids > 0, 1 + ids + len(spelled) * lang, 0)
    keys = _hashes(first, spelled, langs)
    alive = (ids > 0) & _may_be(frequent, keys)
    left = _left(np.where(alive, first, 0))
    if pairs is not None:  # a phrase ends where a pair is rare
        pair = combine([keys[:-1], keys[1:]], 2)
        cut = np.append(~_may_be(pairs, pair), True) | (left == 1)
        ends = np.append(np.flatnonzero(cut), len(first))
        left = np.minimum(left, ends[np.searchsorted(ends, np.arange(len(first)))] - np.arange(len(first)) + 1)
    left[~alive] = 0
    left[own:] = 0
    return first, keys, left


def _sent(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    rows = pa.record_batch(columns)
    for at in range(0, len(rows), SENT):
        yield rows.slice(at, SENT)


def _counter(k: int, frequent: Broadcast | None) -> Callable:
    """Counts of words (k = 1) or of pairs of frequent words (k = 2) of each block, by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            first, keys, left = _prepared(block, frequent and frequent.value, None)
            _, lang, _, langs, own = block
            at, n = intervals(*suffixes(first, k, own), left, k)
            key = keys[at] if k == 1 else combine([keys[at], keys[at + 1]], 2)
            yield from _sent({"lang": pa.array(langs).take(pa.array(lang[at])), "key": pa.array(key.view(np.int64)), "n": pa.array(n, pa.int64())})

    return count


def _speller(frequent: Broadcast, pairs: Broadcast, longest: int) -> Callable:
    """Counts of phrases of 1 to ``longest`` frequent words whose pairs are frequent, of each block, by text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            first, _, left = _prepared(block, frequent.value, pairs.value)
            ids, lang, spelled, langs, own = block
            # words outside of any such phrase may be one and the same
            order, lcp = suffixes(np.where(_reached(left), first, 0), longest, own)
            words = pa.array(spelled)
            for k in range(1, longest + 1):
                at, n = intervals(order, lcp, left, k)
                phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[at + j])) for j in range(k)], pa.scalar(" ")) if k > 1 else words.take(pa.array(ids[at]))
                yield from _sent({"lang": pa.array(langs).take(pa.array(lang[at])), "phrase": phrase, "words": pa.array(np.full(len(at), k, dtype=np.int32)), "n": pa.array(n, pa.int64())})

    return count


def _reached(left: np.ndarray) -> np.ndarray:
    """Places that a phrase of ``left`` words may cover."""
    far = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)) + left, 0))
    return far > np.arange(len(left))


def _filter(counts: DataFrame) -> Broadcast:
    """A bitmap of the keys (hashes) of ``counts``; built by parts of 64 bits, at most BITS of them reach the driver."""
    spark = counts.sparkSession
    size = 1 << 16
    while size < min(BITS, 16 * counts.count()):
        size *= 2
    place = counts.select(F.expr(f"key & {size - 1}L").alias("at"))
    parts = place.selectExpr("shiftright(at, 6) AS part", "shiftleft(1L, CAST(at & 63 AS INT)) AS bit").groupBy("part").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[parts["part"].to_numpy()] = parts["bits"].to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint8))


def ngrams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases of 1 to ``longest`` words found ``least`` times or more: lang, phrase, words, n; languages: lang, total of all words)."""
    read = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    added = lambda k, known: materialize(read.mapInArrow(_counter(k, known), KEYED).groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= (least if k > 1 else 0)), f"grams{k}")
    words = added(1, None)
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    frequent = _filter(words.filter(F.col("n") >= least))
    pairs = added(2, frequent)
    paired = _filter(pairs)
    release(words, pairs)
    spelled = read.mapInArrow(_speller(frequent, paired, longest), SPELLED)
    return materialize(spelled.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases"), totals


def _known(grams: DataFrame) -> DataFrame:
    """``grams`` as a side of a join: broadcast if few (counted here)."""
    return F.broadcast(grams) if grams.count() <= BROADCAST_PHRASES else grams


def scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase of two or more words with a, l, r, n, score and cut (words before the cut) of its lowest-scoring cut; ties go to the shortest first part."""
    whole = grams.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    parts = whole.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - words)").alias("tail"))
    known = _known(grams.select("lang", "phrase", "n"))
    side = lambda part, n: known.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    met = parts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).join(F.broadcast(totals), "lang")  # a row for each language
    product = lambda *names: " * ".join(f"CAST({x} AS DECIMAL(38, 0))" for x in names)
    score = F.expr(f"({product(1000, 'a', 'total')}) DIV ({product('l', 'r')})")
    cuts = met.withColumn("score", score).groupBy("lang", "phrase", "words", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return cuts.select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score", "best.cut")


def maximal(phrases: DataFrame) -> DataFrame:
    """``phrases`` without those that a longer one holds as often: then one longer by a word does, as counts never grow with length."""
    longer = phrases.filter("words > 2")
    held = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    most = longer.select("lang", held.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("__most"))
    return phrases.join(most, ["lang", "phrase"], "left").filter(F.coalesce(F.col("__most") < F.col("a"), F.lit(True))).drop("__most")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score, then count (both descending), then text; first those of each partition, then of all."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = phrases.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("__rank", place("lang", "__part")).filter(F.col("__rank") <= top).drop("__part", "__rank")
    return few.withColumn("rank", place("lang").cast("bigint")).filter(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """The top phrases of each language: lang, rank, phrase, words, a, l, r, n, score, cut."""
    grams, totals = ngrams(docs, least, longest, text, lang)
    return ranked(maximal(materialize(scored(grams, totals), "scored")), top)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
spans AS (SELECT lang, w, i, unnest(range(0, 5)) AS more FROM places),
f AS (SELECT lang, array_to_string(w[i:i + more], ' ') AS phrase, more + 1 AS words, count(*) AS f FROM spans WHERE i + more <= len(w) GROUP BY ALL),
c AS (SELECT lang, phrase, words, f AS a FROM f WHERE words > 1 AND f >= 100),
cuts AS (
  SELECT lang, phrase, words, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
s AS (
  SELECT c.lang, c.phrase, c.words, a, k, h.f AS l, t.f AS r, n.n,
         CAST((1000::HUGEINT * a * n.n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = head AND h.words = k
  JOIN f t ON t.lang = c.lang AND t.phrase = tail AND t.words = c.words - k JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.words > b.words AND 100 * c.a >= 100 * b.a
                    AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

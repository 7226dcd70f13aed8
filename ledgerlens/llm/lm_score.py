"""LM scoring with a weighted backoff automaton over all n-grams of the training texts.

States are n-grams, the empty one being the root. An arc carries
log10 p(word | state) = (c(state word) + PRIOR p(word | shorter state)) / (c(state) + PRIOR);
a state without an arc for the next word falls through its failure arc, of
weight PRIOR / (c(state) + PRIOR), to the shorter state. At the root a known
word has (c - DISCOUNT) / N and the unknown words share DISCOUNT V / N evenly,
as many as the counts say are unseen (Chao's estimate from the words seen once
and twice), so that each state's probabilities sum to one. One left-to-right
traversal of a text carries the state and adds up the weights passed.

The counts cover every training text and grow with them, so no task holds the
automaton. Texts are packed into blocks; for one order after the other, a block
asks for the n-grams it has, with its own counts, in slices of the hash range.
The slices are grouped and summed (each block occurs once in a slice, however
frequent an n-gram is), and every block gets back the totals in its own order:
the part of the automaton that its texts can reach. A slice's rows are dropped
before the next order asks. Blocks times slices are the rows that meet: one for
each BLOCK_CHARS by SLICE_CHARS, so few against the documents up to some TB.
n-grams are known by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; a null id trains
and is not held out; repeated ids or rows count as often as they come; without
training tokens every token is unknown at the root and has probability 1 there
(the base formula still holds); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import fold, materialize, table
from ledgerlens.llm.tokens import combine, word_hashes

ORDER, PRIOR, DISCOUNT = 3, 64.0, 0.5
HELD_OUT_FOLD = 1
BLOCK_CHARS, SLICE_CHARS = 3_000_000, 16_000_000
#: The end token's hash.
END = np.uint64(0x5DEECE66D1234567)


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame) -> DataFrame:
    """A written row for each block: block, chars, ids, train (arrays), texts (compressed)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids, train, texts = zip(*held, strict=True)
            raw = [t.encode() for t in texts]
            data = zstandard.ZstdCompressor(level=1).compress(np.array([len(r) for r in raw], dtype=np.int64).tobytes() + b"".join(raw))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(schema)), pa.array([train], pa.list_(pa.bool_())), pa.array([data], pa.binary())], ["block", "chars", "ids", "train", "texts"])

        schema = None
        for batch in batches:
            schema = batch.schema.field("doc_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "train", "text")), strict=True):
                held.append((row[0], row[1], row[2] or ""))
                size += len(held[-1][2])
                if size >= BLOCK_CHARS:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return materialize(docs.mapInArrow(rows, f"block long, chars long, ids array<{kind}>, train array<boolean>, texts binary"), "blocks")


def texts_of(data: bytes, n: int) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw[: 8 * n], dtype=np.int64)) + 8 * n
    return [raw[a:b].decode() for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@dataclass
class Grams:
    """The n-grams of one order in a block."""

    keys: np.ndarray  # distinct, ascending
    local: np.ndarray  # training count inside the block
    at: np.ndarray  # by position: index into keys, -1 where a text is too young
    end: np.ndarray  # by key: a position where it ends


def grams(texts: list[str], train: np.ndarray, orders: range) -> tuple[list[Grams], np.ndarray]:
    """The n-grams of each order, and the texts' offsets; every text ends with END."""
    words, offsets = word_hashes(texts)
    n = np.diff(offsets) + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    h = np.full(int(bounds[-1]), END, dtype=np.uint64)
    last = np.zeros(len(h), dtype=bool)
    last[bounds[1:] - 1] = True
    h[~last] = words
    age = np.arange(len(h)) - np.repeat(bounds[:-1], n)
    trained = np.repeat(train, n)
    out = []
    for j in orders:
        where = np.flatnonzero(age >= j - 1)
        hashed = combine([h[where - k] for k in range(j - 1, -1, -1)], j)
        by = np.argsort(hashed)
        hashed, where = hashed[by], where[by]
        new = np.concatenate([[True], hashed[1:] != hashed[:-1]])[: len(hashed)]
        number = np.cumsum(new) - 1
        at = np.full(len(h), -1, dtype=np.int64)
        at[where] = number
        out.append(Grams(hashed[new], np.bincount(number[trained[where]], minlength=int(new.sum())), at, where[new]))
    return out, bounds


def slices(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal parts of the hash range begins in sorted keys, and the end."""
    edges = np.array([k * 2**64 // n for k in range(n)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def requests(packed: DataFrame, order: int, n: int) -> DataFrame:
    """part, block, keys, counts: what each block has in each slice of one order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, train, data = (batch.column(c)[k].as_py() for c in ("block", "train", "texts"))
                g = grams(texts_of(data, len(train)), np.array(train), range(order, order + 1))[0][0]
                cuts = slices(g.keys, n)
                full = np.flatnonzero(np.diff(cuts))
                part = [g.keys[cuts[x] : cuts[x + 1]] for x in full]
                count = [g.local[cuts[x] : cuts[x + 1]].astype(np.int32) for x in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(np.full(len(full), block), pa.int64()), pa.array([pack_sorted(p) for p in part], pa.binary()), pa.array([pack(c) for c in count], pa.binary())], ["part", "block", "keys", "counts"])

    return packed.select("block", "train", "texts").mapInArrow(rows, "part long, block long, keys binary, counts binary")


def answers(asked: DataFrame, order: int) -> DataFrame:
    """order, part, block, extra (what other blocks add to its counts); and for each part a row without block: what its n-grams count together."""

    def total(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        keys = [unpack_sorted(x) for x in rows.column("keys").to_pylist()]
        counts = [unpack(x, np.int32) for x in rows.column("counts").to_pylist()]
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
        at = np.cumsum([0] + [len(k) for k in keys])
        extra = [pack((sums[inverse[a:b]] - c).astype(np.int64)) for a, b, c in zip(at, at[1:], counts, strict=False)]
        none = [None] * len(extra)
        seen = {"known": (sums > 0).sum(), "once": (sums == 1).sum(), "twice": (sums == 2).sum(), "tokens": sums.sum()}
        return pa.table(
            {"order": pa.array([order] * (len(extra) + 1), pa.int32()), "part": pa.array([rows.column("part")[0].as_py()] * (len(extra) + 1), pa.int64()), "block": pa.array(rows.column("block").to_pylist() + [None], pa.int64()), "extra": pa.array([*extra, None], pa.binary())}
            | {k: pa.array([*none, int(v)], pa.int64()) for k, v in seen.items()}
        )

    return materialize(asked.groupBy("part").applyInArrow(total, "order int, part long, block long, extra binary, known long, once long, twice long, tokens long"), "answers")


def unseen_words(once: int, twice: int) -> float:
    """Chao's estimate of how many words the training texts lack, one at least."""
    return max(1.0, once * once / (2 * twice) if twice else once * (once - 1) / 2)


class Automaton:
    """The part of the automaton that a block's texts can reach.

    The state of depth d before a position is the n-gram of the d words before
    it, so position and depth name a state, and its failure arc leads to the
    next depth below at the same position. ``weight[d][at]`` is the arc out of
    it for the word there (MISSING where there is none), ``fail[d][at]`` its
    failure arc, ``deep[d]`` the depth that an arc out of depth d leads to.
    """

    MISSING = 1.0

    def __init__(self, found: list[Grams], totals: list[np.ndarray], tokens: int, known: int, unseen: float, prior: float, discount: float):
        first, top = totals[0], len(totals) - 1
        p = np.where(first > 0, (first - discount) / max(tokens, 1), discount * known / tokens / unseen if tokens else 1.0)
        self.weight, self.fail = [np.log10(p)[found[0].at]], [np.zeros(0)]
        self.known = ((first > 0) & (top > 0))[found[0].at]
        for j in range(1, top + 1):
            g, c, below = found[j], totals[j], totals[j - 1]
            context, suffix = found[j - 1].at[g.end - 1], found[j - 1].at[g.end]
            p = (c + prior * p[suffix]) / (below[context] + prior)
            arc = (g.at >= 0) & (c[g.at] > 0) if len(c) else np.zeros(len(g.at), dtype=bool)
            self.weight.append(np.where(arc, np.log10(p)[g.at], self.MISSING) if len(c) else np.full(len(g.at), self.MISSING))
            before = np.concatenate([[-1], found[j - 1].at[:-1]])
            self.fail.append(np.log10(prior / (below[before] + prior)))
        self.deep = [1, *(min(j + 1, top) for j in range(1, top + 1))]

    def traverse(self, start: int, end: int) -> float:
        """log10 of the probability of the text at these positions."""
        weight, fail = [w[start:end].tolist() for w in self.weight], [f[start:end].tolist() for f in self.fail]
        deep, missing, known = self.deep, self.MISSING, self.known[start:end].tolist()
        total, depth = 0.0, 0
        for at in range(end - start):
            w = weight[depth][at]
            while w == missing:
                total += fail[depth][at]
                depth -= 1
                w = weight[depth][at]
            total += w
            depth = deep[depth] if depth or known[at] else 0
        return total


def score(docs: DataFrame, train, order: int = ORDER, prior: float = PRIOR, discount: float = DISCOUNT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every row; ``train`` is a boolean column over ``docs``."""
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text).alias("text"))
    packed = blocks(bare)
    chars = packed.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    n = 1 + chars // SLICE_CHARS
    totals = [answers(requests(packed, j, n), j) for j in range(1, order + 1)]
    sums = totals[0].filter("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "once", "twice", "tokens")]).first()
    known, tokens, unseen = sums["known"], sums["tokens"], unseen_words(sums["once"], sums["twice"])
    back = reduce(DataFrame.unionByName, totals).filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("order", "part", "extra")).alias("extra"))
    kind = bare.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, train_, data, extra = (batch.column(c)[k].as_py() for c in ("ids", "train", "texts", "extra"))
                found, bounds = grams(texts_of(data, len(train_)), np.array(train_), range(1, order + 1))
                more = sorted((x["order"], x["part"], x["extra"]) for x in extra)
                full = []
                for j, g in enumerate(found):
                    mine = [unpack(v, np.int64) for o, _, v in more if o == j + 1]
                    full.append(g.local + np.concatenate(mine) if mine else g.local)
                auto = Automaton(found, full, tokens, known, unseen, prior, discount)
                path = found[0].at
                base = np.log10((full[0] + 0.5) / (tokens + 0.5 * (known + 1)))[path]
                seen = (full[0] > 0)[path].astype(np.int64)
                edge = bounds.tolist()
                del found, full
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, batch.schema.field("ids").type.value_type), pa.array(train_, pa.bool_()), pa.array(np.diff(bounds), pa.int64()), pa.array(np.add.reduceat(seen, bounds[:-1]), pa.int64()),
                        pa.array(np.full(len(ids), tokens), pa.int64()), pa.array(np.add.reduceat(base, bounds[:-1]), pa.float64()), pa.array([auto.traverse(a, b) for a, b in zip(edge, edge[1:], strict=False)], pa.float64()),
                    ],
                    ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    joined = packed.join(back, "block").select("ids", "train", "texts", "extra")
    return joined.mapInArrow(rows, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fold(F.col("doc_id")) != HELD_OUT_FOLD)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

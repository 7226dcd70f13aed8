"""BPE encoding and decoding with a pair occurrence index.

A partition is taken in runs of rows of at most CHUNK_CHARS characters (one
longer text is a run by itself). The distinct space-separated words of a run
are pre-tokenized once, and their pieces merged together: ``PairIndex`` maps
every adjacent pair that has a rank to all its positions in the run, takes the
lowest active rank, merges it everywhere, and files the new pairs that arise
at its neighbours. Texts are then looked up word by word. There is no shuffle
and no key; memory follows the run, not the partition.

The vocabulary file is a parameter: a byte-level BPE with word ends, lower
case, NFC, white space dropped. Special tokens inside a text become their ids.

Defined cases: a null text is empty, an empty text has no ids and decodes to
the empty string; ids may repeat or be null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import few_rows, table

CHUNK_CHARS = 2_000_000
#: What the file format calls for beyond the vocabulary.
WORD_END = "</w>"
#: White space as the tokenizer's patterns see it; str.split() also splits at \x1c to \x1f.
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
ODD = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def check_format(spec: dict) -> None:
    """Refuse tokenizer files that ask for anything else than what is built here."""
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [x.get("type") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    model = spec["model"]
    odd = [k for k in ("unk_token", "dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    lax = [t["content"] for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
    if steps != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or spec.get("decoder") or spec.get("post_processor") or model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or odd or lax:
        raise ValueError("not a byte-level BPE with word ends, NFC, lower case and no decoder")


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_format(spec)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: what all special tokens begin with
        self.mark = os.path.commonprefix(list(self.special)) if self.special else ""
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        size = 1 + max([*self.ids.values(), *self.special.values()])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a, b = (np.array([self.ids[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        into = np.array([self.ids[x + y] for x, y in merges], dtype=np.int64)
        self.size = size
        keys = a * size + b
        # the same pair twice: the later rank holds, as in a map that is filled in order
        last = {int(k): r for r, k in enumerate(keys)}
        self.keys = np.array(sorted(last), dtype=np.int64)
        self.ranks = np.array([last[int(k)] for k in self.keys], dtype=np.int64)
        self.left, self.right, self.into = a, b, into
        self.byte_id = [self.ids[c] for c in self.letters]
        self.end_id = [self.ids[c + WORD_END] for c in self.letters]
        self.strings = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = token

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """All positions of each ranked pair over many pieces at once."""

    def __init__(self, vocab: Vocabulary, symbols: np.ndarray, ends: np.ndarray):
        """symbols: the pieces' symbols in a row. ends: true at a piece's last symbol."""
        n = len(symbols)
        self.vocab, self.sym = vocab, symbols.copy()
        at = np.arange(n)
        self.next = np.where(ends, -1, at + 1)
        self.prev = np.where(np.concatenate([[True], ends[:-1]]) if n else ends, -1, at - 1)
        self.alive = np.ones(n, dtype=bool)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.file(np.flatnonzero(self.next >= 0))

    def file(self, at: np.ndarray) -> None:
        """Enter the pairs that begin at these positions."""
        if not len(at):
            return
        rank = self.vocab.rank(self.sym[at], self.sym[self.next[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            if r not in self.lists:
                self.lists[r] = []
                heapq.heappush(self.heap, r)
            self.lists[r].append(part)

    def run(self) -> np.ndarray:
        """Merge by ascending rank until no pair is left; the positions that are still alive."""
        v, sym = self.vocab, self.sym
        while self.heap:
            r = heapq.heappop(self.heap)
            at = np.concatenate(self.lists.pop(r))
            a, b, c = int(v.left[r]), int(v.right[r]), int(v.into[r])
            follow = self.next[at]
            at = at[self.alive[at] & (sym[at] == a) & (follow >= 0) & (sym[follow] == b)]
            if a == b:  # aaa: the left pair first
                at = np.unique(at)
                taken, last = [], -1
                for p in at.tolist():
                    if p != last:
                        taken.append(p)
                        last = int(self.next[p])
                at = np.array(taken)
            if not len(at):
                continue
            # a position may be filed twice under one rank, each time with the same outcome
            gone = self.next[at]
            sym[at] = c
            self.alive[gone] = False
            after = self.next[gone]
            self.next[at] = after
            self.prev[after[after >= 0]] = at[after >= 0]
            before = self.prev[at]
            self.file(np.unique(np.concatenate([before[before >= 0], at[after >= 0]])))
        return np.flatnonzero(self.alive)


def encode_words(vocab: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of each space-separated word, one after another."""
    piece_no: dict[str, int] = {}
    plans: list[list[int]] = []  # of piece numbers; a special token is -1 - id
    for word in words:
        low = word.lower()
        if low.isascii() and low[:-1].isalpha() and (low[-1] in ".," or low[-1].isalpha()):  # the usual words, without the patterns
            parts = [low[:-1], low[-1]] if low[-1] in ".," else [low]
            plans.append([piece_no.setdefault(p, len(piece_no)) for p in parts])
            continue
        plan = []
        for part in vocab.split_special.split(word) if vocab.split_special and vocab.mark in word else [word]:
            if part in vocab.special:
                plan.append(-1 - vocab.special[part])
            elif part:
                text = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                plan += [piece_no.setdefault(p, len(piece_no)) for p in ([text] if text.isalpha() else vocab.pieces.findall(text))]
        plans.append(plan)
    raw = [p.encode() for p in piece_no]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.zeros(len(flat), dtype=bool)
    ends[np.cumsum(size) - 1] = True
    symbols = np.where(ends, np.array(vocab.end_id)[flat], np.array(vocab.byte_id)[flat]) if len(flat) else np.zeros(0, dtype=np.int64)
    index = PairIndex(vocab, symbols, ends)
    alive = index.run()
    merged = index.sym[alive]
    owner = np.repeat(np.arange(len(raw)), size)[alive] if len(raw) else np.zeros(0, dtype=np.int64)
    starts = np.searchsorted(owner, np.arange(len(raw) + 1))
    # words as runs of pieces: specials follow the pieces' ids in one array
    special = sorted(set(vocab.special.values()))
    place = {i: len(raw) + k for k, i in enumerate(special)}
    begin = np.concatenate([starts[:-1], len(merged) + np.arange(len(special))]).astype(np.int64)
    length = np.concatenate([np.diff(starts), np.ones(len(special), dtype=np.int64)])
    pool = np.concatenate([merged, np.array(special, dtype=np.int64)])
    count = np.fromiter(map(len, plans), dtype=np.int64, count=len(plans))
    used = np.fromiter((p if p >= 0 else place[-1 - p] for plan in plans for p in plan), dtype=np.int64, count=int(count.sum()))
    ids, piece_ends = gather(pool, begin[used], length[used])
    offsets = np.concatenate([[0], piece_ends])[np.concatenate([[0], np.cumsum(count)])]
    return ids, offsets


def gather(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices pool[begin : begin + length] one after another, and where each ends."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(begin - (ends - length), length)
    return pool[at], ends


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def split_words(text: str) -> list[str]:
    return [w for w in SPACE.split(text) if w] if ODD.search(text) else text.split()


def encode_texts(vocab: Vocabulary, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text."""
    number = Numbers()
    rows = [np.fromiter(map(number.__getitem__, split_words(t)), dtype=np.int64) for t in texts]
    ids, offsets = encode_words(vocab, list(number))
    begin, length = offsets[:-1], np.diff(offsets)
    for row in rows:
        yield gather(ids, begin[row], length[row])[0]


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """Tokens joined by spaces: the format's file names no decoder, so the word ends stay. Ids outside the vocabulary give nothing."""
    return " ".join([t for i in ids if 0 <= i < vocab.size and (t := vocab.strings[i])])


def runs(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of at most ``limit`` characters, or one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int): every text encoded."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for run in runs(batches, "text", CHUNK_CHARS):
            ids = list(encode_texts(vocab, [t or "" for t in run.column("text").to_pylist()]))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))], ["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, decoded: the texts of ids; null ids (whole or single ones) give nothing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [decode_ids(vocab, [i for i in x or [] if i is not None]) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(rows, f"doc_id {kind}, decoded string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for): texts encoded, their ids decoded, both digested where they are made."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for run in runs(batches, "text", CHUNK_CHARS):
            n, a, b, held = [], [], [], []
            for ids in encode_texts(vocab, [t or "" for t in run.column("text").to_pylist()]):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(decode_ids(vocab, ids.tolist()).encode()).hexdigest())
                held += [ids.astype(np.int32)] * with_ids
            out = [run.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(held))))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows(spark)
    return digests(table(spark, sf_dir, "documents"), default_path())

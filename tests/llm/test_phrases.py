"""Phrase mining against brute force: blocks cut anywhere, hot phrases, nulls, ties, repeated rows, clashing columns."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import phrases
from ledgerlens.llm.common import table

DOCS = "doc_id bigint, text string, lang string, n bigint, phrase string, words int"


def pieces(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def counted(rows, longest=5):
    """(lang -> phrase -> count, lang -> words)"""
    found, total = {}, Counter()
    for text, lang in rows:
        mine = found.setdefault(lang or "und", Counter())
        for w in pieces(text):
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                mine.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return found, total


def brute(rows, least, top):
    found, total = counted(rows)
    out = []
    for lang, f in found.items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        mine = []
        for p, a in many.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in many.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def corpus(seed=3, n=80):
    r = random.Random(seed)
    common = ["The", "of", "new", "york", "times", "é", "a\x1cb", "x y"]
    text = lambda: "".join(r.choice(common) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " !"]) for _ in range(r.randrange(1, 60)))
    rows = [(text(), r.choice(["en", "en", "de", None])) for _ in range(n)]
    return [*rows, rows[0], rows[0], (None, "en"), ("", None), (" \t ", "fr"), ("hot phrase here " * 3000, "en"), ("Hot phrase here. " * 500, "en")]


@pytest.mark.parametrize(("least", "top"), [(20, 2000), (3, 7)])
def test_same_as_brute_force(spark, least, top):
    rows = corpus()
    docs = spark.createDataFrame([(None, t, lang, 1, "p", 2) for t, lang in rows], DOCS).repartition(3)
    got = phrases.mine(docs, least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


@pytest.mark.parametrize(("block", "at_once"), [(7, 40), (1, 1), (64, 10_000)])
def test_blocks_lose_no_phrase(monkeypatch, block, at_once):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "AT_ONCE", at_once)
    rows = [(t[:400] if t else t, lang) for t, lang in corpus(n=12)]
    found = {}
    for ids, lang, spelled, langs, own in phrases._blocks(iter([pa.record_batch({"text": pa.array([t for t, _ in rows[k : k + 5]]), "lang": pa.array([x for _, x in rows[k : k + 5]], pa.string())}) for k in range(0, len(rows), 5)])):
        first, _, left = phrases._prepared((ids, lang, spelled, langs, own), None, None)
        order, lcp = phrases.suffixes(first, 5, own)
        for k in range(1, 6):
            for at, n in zip(*phrases.intervals(order, lcp, left, k), strict=True):
                found.setdefault(langs[lang[at]], Counter())[tuple(spelled[x] for x in ids[at : at + k])] += int(n)
    want, _ = counted(rows)
    assert found == {lang: f for lang, f in want.items() if f}


def test_suffixes_are_sorted():
    r = random.Random(5)
    first = np.array([r.randrange(3) for _ in range(200)], dtype=np.int64)
    order, lcp = phrases.suffixes(first, 5)
    keys = [tuple(first[k : k + 5]) + (0,) * (5 - len(first[k : k + 5])) for k in order]
    assert keys == sorted(keys)
    for a, b, n in zip(keys, keys[1:], lcp[1:], strict=False):
        assert n == next((k for k in range(5) if a[k] != b[k]), 5)


def test_full_filters_let_all_through():
    keys = np.array([1, 5, 1 << 63], dtype=np.uint64)
    assert phrases._may_be(np.full(8, 255, dtype=np.uint8), keys).all() and not phrases._may_be(np.zeros(8, dtype=np.uint8), keys).any()


def test_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], DOCS)).collect() == []


def test_scores_past_64_bits(spark):
    big = 10**14
    grams = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, words int, n bigint")
    totals = spark.createDataFrame([("en", 10**16)], "lang string, total bigint")
    assert phrases.scored(grams, totals).first()["score"] == 1000 * (big - 7) * 10**16 // (big * (big - 1))


def test_query_is_the_operator(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang) for r in table(spark, sf, "documents").select("text", "lang").collect()]
    got = phrases.op12_phrases(spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 100, 2000)

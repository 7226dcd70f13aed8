"""Corpus operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, chat_format, embedding_dedup, graph, license_scan, lm_score, mixing, near_dedup, quality_classifier, quality_rules, url_filters

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, bits int, __w string"
SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def texts(n=60, seed=1):
    r = random.Random(seed)
    pool = ["alpha", "beta", "the", "of", "Gamma", "delta.", "é", "ñandú", "x|y"]
    out = [" ".join(r.choice(pool) + str(r.randrange(40)) for _ in range(r.randrange(1, 120))) for _ in range(n)]
    for k in range(0, n, 4):  # near copies
        w = out[k].split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [*out, out[0], None, "", " \n\t", "one", "a a a a a a", "a\nb\na\n\na", "q " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None, [None, "b", "a"][k % 3], None, 1, "w") for k, t in enumerate(texts())]
    rows += [(None, "null id " * 20, None, "a", None, 1, "w"), (3, texts()[3], None, "b", None, 1, "w")]
    return spark.createDataFrame(rows, DOCS)


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_rules(docs):
    for r, d in zip(collected(quality_rules.ledger(docs)), docs.collect(), strict=True):
        w = words(d.text)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        lines = [x for x in (d.text or "").split("\n") if words(x)]
        covered = {k + j for k, g in enumerate(grams) if g in twice for j in range(3)}
        assert (r["doc_id"], r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (d.doc_id, len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert bool(r["bits"] & 1) == (len(w) < 50)


def test_rules_redo_rows_whose_hash_bits_clash(docs, monkeypatch):
    before = collected(quality_rules.ledger(docs))
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 58)  # six hash bits are left
    assert collected(quality_rules.ledger(docs)) == before


def test_ablation(docs):
    led = quality_rules.ledger(docs)
    bits = [r["bits"] for r in collected(led)]
    for r in collected(quality_rules.ablation(led, 3)):
        bit = 1 << [x.name for x in quality_rules.RULES].index(r["rule"])
        assert r["failed_alone"] == sum(b & 3 == bit for b in bits) and r["rejected_without"] == sum(b & 3 & ~bit != 0 for b in bits)


def test_near_dedup(docs):
    rows = docs.collect()
    sets = []
    for d in rows:
        w = words(lower(d.text))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    want = sorted((str(d.doc_id), len(sets[k]), str(min((rows[j].doc_id for j in range(len(rows)) if find(j) == find(k) and rows[j].doc_id is not None), default=None))) for k, d in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in collected(near_dedup.deduplicate(docs))) == want


def test_keep_one_keeps_one_row_of_a_group_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, b), (5, a), (5, b + " more"), (None, c), (None, c + " more"), (7, a + " more"), (None, a + " again"), (8, "")]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x["doc_id"], x["text"]) for x in got if x["doc_id"] is not None) == [(3, b), (5, a), (8, "")]
    assert len([x for x in got if x["doc_id"] is None]) == 1 and all(x["text"] in (c, c + " more") for x in got if x["doc_id"] is None)


def test_near_dedup_of_large_sets_hubs_and_shared_passages(spark):
    """Sets of hundreds of shingles: copies around the threshold, a hub with many branches, a passage that unlike texts share."""
    r = random.Random(8)
    prose = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, hub, rows = prose(120), prose(300), []
    for base in [hub, *[prose(r.randrange(150, 900)) for _ in range(12)]]:
        for _ in range(60 if base is hub else 8):
            w = list(base)
            for _ in range(r.randrange(1, max(2, len(w) // 18))):  # each change costs up to five shingles
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += [" ".join(prose(40) + passage + prose(r.randrange(10, 200))) for _ in range(80)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, rows)]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert len(set(root[:60])) not in (1, 60) and len(set(root)) < len(rows) - 50
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in collected(near_dedup.deduplicate(df))} == {k: (len(s), root[k], root[k] == k) for k, s in enumerate(sets)}


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        assert got[node] == min(seen)


def test_lm_score(docs, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(lm_score, "SLICE_CHARS", 9000)
    rows = [d for d in docs.collect() if len(d.text or "") < 9000]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = [[*words(lower(d.text)), None] for d in rows]
    c = [Counter() for _ in range(4)]
    for d, w in zip(rows, toks, strict=True):
        for j in (1, 2, 3) if not held(d.doc_id) else ():
            c[j].update(tuple(w[k : k + j]) for k in range(len(w) - j + 1))
    n, v, seen = sum(c[1].values()), len(c[1]), Counter(c[1].values())
    unseen = max(1, seen[1] ** 2 / (2 * seen[2]) if seen[2] else seen[1] * (seen[1] - 1) / 2)
    base = lambda w: sum(math.log10((c[1][(x,)] + 0.5) / (n + 0.5 * (v + 1))) for x in w)

    def p(g):
        if len(g) == 1:
            return (c[1][g] - lm_score.DISCOUNT) / n if c[1][g] else lm_score.DISCOUNT * v / n / unseen
        return (c[len(g)][g] + lm_score.PRIOR * p(g[1:])) / (c[len(g) - 1][g[:-1]] + lm_score.PRIOR)

    want = sorted((str(d.doc_id), len(w), sum(c[1][(x,)] > 0 for x in w), n, round(base(w), 6), round(sum(math.log10(p(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w))), 6)) for d, w in zip(rows, toks, strict=True))
    few = docs.filter("length(coalesce(text, '')) < 9000")
    got = collected(lm_score.score(few, lm_score.fold(F.col("doc_id")) != 1))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_lm_score_of_random_letters_is_below_prose(spark):
    r = random.Random(3)
    pool = [f"{a}{b}" for a in ("ri", "sto", "wal", "nor", "the") for b in ("ver", "ne", "ked", "th", "se", "n")]
    prose = [" ".join(r.choices(pool, range(len(pool), 0, -1), k=80)) for _ in range(200)]
    prose = [f"{t} odd{k % 150} rare{k}" for k, t in enumerate(prose)]
    junk = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=400)) for _ in range(10)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(prose + junk)], "doc_id bigint, text string")
    got = {x["doc_id"]: x["score"] / x["n_tokens"] for x in collected(lm_score.score(df, F.col("doc_id") < 150))}
    assert max(got[k] for k in range(200, 210)) < min(got[k] for k in range(200)) - 1


def test_bpe_is_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_padding()
    lib.no_truncation()
    odd = ["don't 'S <|startoftext|>Hi<|endoftext|>", "aaa aaaa aaaaa", "ΣΑΣ İß ﬁ １２ ½", "a\x1cb é ́x", "日本語 🎉🎉", "<|ENDOFTEXT|>"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id bigint, text string"))
    rows = df.collect()
    for r, d in zip(collected(bpe.encode(df, bpe.default_path())), rows, strict=True):
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["ids"]) == (d.doc_id, ids)
    encoded = bpe.encode(df, bpe.default_path())
    for r, e in zip(collected(bpe.decode(encoded, bpe.default_path())), encoded.collect(), strict=True):
        assert r["decoded"] == lib.decode(e.ids, skip_special_tokens=False)
    r = collected(bpe.digests(df.limit(1), bpe.default_path()))[0]
    assert r["decoded_sha256"] == hashlib.sha256(lib.decode(lib.encode(rows[0].text, add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()
    with pytest.raises(ValueError):
        bpe.check_format({"model": {"type": "BPE", "end_of_word_suffix": "</w>"}, "added_tokens": [], "normalizer": None})
    assert r["ids_sha256"] == hashlib.sha256(np.array(lib.encode(rows[0].text, add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest()


def test_mixing(docs):
    rows = collected(mixing.ledger(docs))
    by = {}
    for r in rows:
        by.setdefault(r["target"], []).append(r)
        assert r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-6
    for target, part in by.items():
        assert abs(sum(r["taken"] for r in part) - target) <= max(r["size"] for r in part)
    assert sorted(map(str, rows)) == sorted(map(str, collected(mixing.ledger(docs))))
    assert mixing.repeat(docs).columns == docs.columns
    assert sum(len(words(r["text"])) for r in collected(mixing.repeat(docs))) == sum(r["taken"] for r in rows)


def test_working_names_may_be_the_documents_own(spark):
    names = ("doc_id", "text", "source", "__k", "__cut", "__w", "bits", "row", "__text")
    df = spark.createDataFrame([(k, f"{k} " * 60 if k % 2 else " ".join(f"w{j}" for j in range(60)), "s", 7, 8, "w", 9, "r", "t") for k in range(6)], "doc_id int, text string, source string, __k int, __cut int, __w string, bits int, row string, __text string")
    mixed, kept = mixing.repeat(df), quality_rules.keep(df, quality_rules.POLICIES["full-1"])
    assert tuple(mixed.columns) == tuple(kept.columns) == names
    assert {tuple(r)[3:] for r in mixed.collect()} == {tuple(r)[3:] for r in kept.collect()} == {(7, 8, "w", 9, "r", "t")} and {r["doc_id"] for r in kept.collect()} == {0, 2, 4}


def test_mixing_ranks_sources_by_code_point_and_splits_null_ids(spark):
    names = ["b", "", "http://b", "http://a", "é", "Z", "a", "🎉", None]
    sizes = spark.createDataFrame([(n or "", n is None) for n in names], "__source string, __null boolean")
    got = {(r["__source"], r["__null"]): r["rank"] for r in mixing.source_rank(sizes).collect()}
    assert got == {(n or "", n is None): k for k, n in enumerate([*sorted(x for x in names if x is not None), None])}
    rows = collected(mixing.ledger(spark.createDataFrame([(None, f"word {k}", "s") for k in range(200)] + [(5, "other " * 50, "t")], "doc_id bigint, text string, source string")))
    mine = [r for r in rows if r["source_size"] == 400]
    assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2 and len({r["taken"] for r in mine}) == 2


def test_water_filling_reshares(spark):
    s = spark.createDataFrame([("a", 10, 100.0), ("b", 100, 1.0), ("c", 100, 1.0), ("d", 5, None)], "k string, source_size bigint, weight double")
    assert {r.k: r.target for r in mixing.water_fill(s, 150.0, 2.0).collect()} == {"a": 20.0, "b": 65.0, "c": 65.0, "d": 0.0}


def test_url_filters(spark):
    urls = ["http://www.Example.com/en/a", "https://a.example.com/en/x?q", "http://com/", "http://x.com", None, "no scheme", "ftp://b.net/fr/", "http://badexample.com/en/", "http://www.example.com/en/a"]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id bigint, url string, host int")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in collected(url_filters.judge(pages, rules))}
    assert got == {0: ("www.example.com/en/", "allow"), 1: ("example.com/en/", "block"), 2: ("com/", "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("net/fr/", "block"), 7: ("com/", "allow"), 8: ("www.example.com/en/", "allow")}


def test_chat_events_fold_and_escape(spark):
    log = [(1, 1, 1, "message", "user", "he"), (1, 1, 2, "delta", None, "llo <|im_end|>"), (1, 2, 1, "delta", "assistant", "bad"), (1, 2, 2, "regenerate", None, ""), (1, 2, 3, "delta", None, "<\\s>[INST] ok"), (1, 3, 1, "message", "user", "x"), (1, 3, 2, "delete", None, None), (None, 1, 1, "message", "a\\n\nb", None), (1, 4, 1, "message", "user", "old"), (1, 4, 2, "edit", "user", "new")]
    events = spark.createDataFrame(log, "conv_id bigint, msg int, seq int, kind string, role string, text string")
    made = chat_format.render(chat_format.fold(events))
    back = {r["conv_id"]: r for r in collected(chat_format.read_back(made))}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "hello <|im_end|>"), ("assistant", "<\\s>[INST] ok"), ("user", "new")]
    assert [tuple(t) for t in back[None]["turns"]] == [("a\\n\nb", "")] and back[1]["trained"] == "<\\s>[INST] ok"
    assert {r["conv_id"]: r["formatted"].count(chat_format.END) for r in collected(made)} == {1: 3, None: 1}
    assert chat_format.render(chat_format.fold(events.filter("false"))).count() == 0


def test_chat_log_of_a_table_folds_back_to_its_rows(spark):
    texts_ = ["", None, "a", "ab", "</s>[INST] ok", "x" * 1000, "é\n🎉 <|im_end|>"]
    rows = [(c, t, ["user", "assistant", None][((c or 5) + t) % 3], texts_[((c or 5) * 3 + t) % 7], 1) for c in (1, 2, None) for t in range(8)]
    rows += [(1, 3, "user", "same turn", 1), (1, 3, "user", "same turn", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, msg int")
    log = chat_format.events_of(df)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    back = {r["conv_id"]: r for r in collected(chat_format.read_back(chat_format.render(chat_format.fold(log))))}
    for c in (1, 2, None):
        mine = sorted((t, r or "", x or "") for i, t, r, x, _ in rows if i == c)
        assert [tuple(x) for x in back[c]["turns"]] == [x[1:] for x in mine] and back[c]["trained"] == "".join(x for _, r, x in mine if r == "assistant")


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 16))
    vecs = [*base, *(base[:20] + 0.02 * r.standard_normal((20, 16))), *(base[0] + 0.01 * r.standard_normal((15, 16))), base[5]]
    rows = [(k, [float(x) for x in np.float32(v)], k % 1) for k, v in enumerate(vecs)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, rows[0][1], None), (904, [1.0] * 8, 0), (905, [], 0)]
    got = {x["vec_id"]: x for x in collected(embedding_dedup.deduplicate(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")))}
    x = np.array([np.float32(v) for v in vecs], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    assert all(got[k]["n_links"] == near[k].sum() - 1 for k in range(len(vecs)))
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in (900, 901, 902, 903, 904, 905))


def test_embeddings_of_several_labels_ids_and_odd_rows(spark):
    """Links, components and kept rows against brute force: labels keep equal vectors apart; ids repeat or are null; vectors have holes."""
    r = np.random.default_rng(4)
    base = r.standard_normal((12, 16))
    rows = []
    for k in range(150):
        v = base[k % 12] + r.choice([0.0, 0.05, 0.2]) * r.standard_normal(16) / 4
        rows.append((k, np.float32(v).tolist(), [0, 1, 7, None][k % 4]))
    rows += [(20, np.float32(base[3]).tolist(), 1), (None, np.float32(base[3]).tolist(), 1), (None, np.float32(base[5]).tolist(), 1), (300, [1.0, None] + [0.5] * 14, 1), (301, [float("inf")] + [0.5] * 15, 1), (302, [0.0] * 16, 1)]
    df = spark.createDataFrame([(*x, "n", 1.5) for x in rows], "vec_id bigint, embedding array<float>, label int, node string, sim double")
    fine = [x is not None and all(c is not None and np.isfinite(c) for c in x) and any(x) for _, x, _ in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and fine[i] and fine[j]:
                x, y = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[i] += 1
                    if root[i] != root[j]:
                        root = [min(root[i], root[j]) if z in (root[i], root[j]) else z for z in root]
    want = []
    for k, (i, _, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None), default=None)
        want.append((str(i), links[k], str(least)))
    got = embedding_dedup.deduplicate(df)
    assert sorted((str(x["vec_id"]), x["n_links"], str(x["component_id"])) for x in collected(got)) == sorted(want)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in collected(got))
    assert embedding_dedup.deduplicate(df.filter("false")).count() == 0


def linked_halves(groups, size, dim=64, seed=3):
    """Vectors of two tight halves a group; across the halves all cosines are near 0.985, inside them near 0.999."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base, turn = np.linalg.qr(r.standard_normal((dim, 2)))[0].T
        for angle in (0.0, np.arccos(0.986)):
            x = base * np.cos(angle) + turn * np.sin(angle) + 0.02 * r.standard_normal((size, dim)) / np.sqrt(dim)
            out += (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()
    return out


def brute_links(vecs):
    x = np.array(vecs, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    root = np.arange(len(vecs))
    while True:
        least = np.where(near, root[None, :], len(vecs)).min(axis=1)
        new = np.minimum(root, least)
        if (new == root).all():
            return near.sum(axis=1), root
        root = new


def test_embeddings_of_linked_groups_with_full_lists(spark):
    vecs = linked_halves(3, 40)
    n, root = brute_links(vecs)
    assert len(set(root.tolist())) == 3 and n.min() > 40
    rows = [(k, v, 1) for k, v in enumerate(vecs)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in collected(embedding_dedup.deduplicate(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")))}
    assert got == {k: (n[k], root[k], root[k] == k) for k in range(len(vecs))}


def test_embeddings_are_compared_exactly_when_the_audit_fails(spark, monkeypatch):
    """A first graph without any list: all links, of pairs too, come from the exact comparison."""
    r = np.random.default_rng(9)
    x = r.standard_normal((60, 16))
    vecs = np.concatenate([x, x + 0.01 * r.standard_normal(x.shape)]).astype(np.float32).tolist() + linked_halves(1, 20, dim=16)
    n, root = brute_links(vecs)
    empty = spark.createDataFrame([], "a long, b long, sim double")
    monkeypatch.setattr(embedding_dedup, "neighbour_graph", lambda nodes, seed: empty)
    rows = [(k, v, 1) for k, v in enumerate(vecs)]
    got = collected(embedding_dedup.deduplicate(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")))
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got} == {k: (n[k], root[k]) for k in range(len(vecs))}
    assert {x["audited_recall"] for x in got} == {1.0}
    assert embedding_dedup.signs(10) == 14 and embedding_dedup.signs(3_000_000) == 22


def test_classifier_on_held_out_rows(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["river", "stone", "of", "the", "walks", "slowly"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY!!", "$$$", "CLICK", "###", "NOW!!"]) for _ in range(60))
    rows = [(k, good() if k % 2 else bad(), 0.5) for k in range(400)] + [(1000, "", 0.1), (1001, None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id bigint, quality int")
    got = {x["doc_id"]: x["score"] for x in collected(quality_classifier.score(docs, quality_classifier.fit(docs, labels)))}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.3) == bool(k % 2) for k in held) / len(held) > 0.95 and 0 <= got[1000] <= 1
    none = quality_classifier.fit(docs, labels.filter("false"))
    assert {x["score"] for x in collected(quality_classifier.score(docs, none))} == {1.0}


def test_classifier_scores_are_compressed_sizes_and_hold_out_of_its_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    import zstandard

    sizes = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]

    def brute(text):
        raw = (text or "").encode()
        cut = [raw[k : k + 512] for k in range(0, len(raw), 512)]
        good, bad = (sum(len(c.compress(x)) for x in cut) for c in sizes)
        return float(np.interp((bad - good) / max(len(raw), 1), model.at, model.value))

    scored = quality_classifier.score(docs, model).collect()
    assert all(r.score == brute(r.text) for r in scored)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= quality_classifier.CUT) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.9
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    twice = named.unionByName(named.select("doc_id", F.concat("text", F.lit(" again")).alias("text"))).orderBy(F.rand(4))
    labelled = labels.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "quality")
    assert quality_classifier.fit(twice, labelled) == quality_classifier.fit(twice.orderBy(F.rand(5)), labelled)


def test_licenses_are_the_best_aligned_cosine(spark):
    """Against every run of every template's length at every place, without anchors."""
    r = random.Random(1)
    prose = lambda n: " ".join(r.choice(["the", "of", "work", "river", "under", "stone", "may", "terms"]) for _ in range(n))
    mit, gpl = ((license_scan.FULL_TEXTS / f"{n}.txt").read_text() for n in ("MIT", "GPL-3.0"))
    bsd = (license_scan.FULL_TEXTS / "BSD-3-Clause.txt").read_text().replace("copyright holder", "Example Corp").replace("\n", "\n# ")
    texts_ = [f"{prose(30)} Released under the MIT License. {prose(30)}", f"MIT License\n\nCopyright (c) 2024 Jane Doe\n\n{mit}", bsd, gpl[:6000], "// SPDX-License-Identifier: Apache-2.0\nint main", f"{prose(400)}\nLicensed under CC BY 4.0.", "licensed  under\nCC BY-NC\n4.0", prose(200), "the license of the work", "", None, f"{prose(60)} MIT License"]
    df = spark.createDataFrame([(k, f"d/{k}", t) for k, t in enumerate(texts_)], "doc_id int, path string, text string")
    known = license_scan.templates()
    short = tuple(t for t in known if len(license_scan.terms_of(t.text)) < 300)
    bags = [set(license_scan.terms_of(t or "")) for t in texts_]
    vocabulary = {x for t in short for x in license_scan.terms_of(t.text)}
    idf = {x: math.log((1 + len(bags)) / (1 + sum(x in b for b in bags))) + 1 for x in vocabulary if any(x in b for b in bags)}
    top = math.log(1 + len(bags)) + 1
    want = {}
    for k, t in enumerate(texts_):
        words_, best = license_scan.terms_of(t or ""), (0.0, "")
        for x in short:
            unit = license_scan.unit(x.text, idf | {"": top})
            n = len(license_scan.terms_of(x.text))
            for at in range(min(len(words_), license_scan.TOP + 1 if x.top else len(words_))):
                v = {w: c * idf.get(w, top) for w, c in Counter(words_[at : at + n]).items()}
                cosine = sum(y * unit.get(w, 0) for w, y in v.items()) / math.sqrt(sum(y * y for y in v.values()))
                best = min(best, (-round(cosine, 6), x.license)) if cosine >= license_scan.THRESHOLD else best
        if best[0]:
            want[k] = (best[1], -best[0])
    got = {r["id"]: (r["license"], r["cosine"]) for r in collected(license_scan.scan(df, short))}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
    assert {0, 1, 2, 4, 5, 6} <= want.keys() and 7 not in want
    full = {r["id"]: r["license"] for r in collected(license_scan.scan(df.unionByName(spark.createDataFrame([(20, "d/20", gpl), (21, "d/21", (license_scan.FULL_TEXTS / "Apache-2.0.txt").read_text())], df.schema))))}
    assert full[20] == "GPL-3.0" and full[21] == "Apache-2.0" and full[1] == "MIT"


def test_licenses_inherit_from_the_nearest_directory(spark):
    files = [(1, "r/LICENSE", "intro\nReleased under the MIT License."), (2, "r/a/b/x.py", "code"), (3, "r/a/COPYING", "Licensed under the Apache License, Version 2.0."), (4, "r/y.py", "# Licensed under CC BY-NC 4.0."), (5, "q/z.py", "the license of the work"), (6, None, None), (7, "ra/x.py", "")]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    got = {x["doc_id"]: (x["license"], x["origin"], x["license_dir"]) for x in collected(license_scan.inherit(df, license_scan.scan(df)))}
    assert got == {1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "r/a"), 3: ("Apache-2.0", "own", None), 4: ("CC-BY-NC-4.0", "own", None), 5: (None, "none", None), 6: (None, "none", None), 7: (None, "none", None)}


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    assert quality_rules.ledger(none).count() == mixing.ledger(none).count() == near_dedup.deduplicate(none).count() == 0
    assert lm_score.score(none, F.lit(True)).count() == bpe.digests(none, bpe.default_path()).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert license_scan.scan(none.withColumn("path", F.lit("a/b"))).count() == 0
    assert quality_classifier.score(none.select("doc_id", "text"), quality_classifier.fit(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id bigint, quality int"))).count() == 0
    assert url_filters.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).count() == 0

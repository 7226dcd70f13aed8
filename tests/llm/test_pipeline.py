"""The corpus pipeline against a brute-force version of every stage, each judged on its own input."""

import random
import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm import bpe, quality_classifier

BLANK = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(BLANK, text or "")


def fixture(spark, folder):
    r = random.Random(12)
    good = lambda n: " ".join(r.choice(["river", "stone", "of", "the", "walks", "slowly", "under", "bridge"]) + str(r.randrange(60)) for _ in range(n))
    bad = lambda n: " ".join(r.choice(["BUY", "CLICK", "WIN", "NOW", "FREE"]) + str(r.randrange(60)) for _ in range(n))
    rows, labels = [], []
    for k in range(160):
        rows.append((k, good(r.randrange(60, 300)) if k % 4 else bad(r.randrange(60, 200)), "en", ["a", "b", None][k % 3], None))
        labels.append((k, int(k % 4 > 0), 0))
    for k in range(0, 40, 2):  # near and exact copies
        w = rows[k + 1][1].split()
        w[k % len(w)] = "changed"
        rows.append((1000 + k, " ".join(w) if k % 4 else rows[k + 1][1], "en", "b", None))
    rows += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (2002, "too short", "en", "a", 9), (2003, "same " * 80, "en", "a", 9), (None, good(90), "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def kept_by_rules(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols, chars = len(re.findall(r"[#*$%&|<>]", text or "")), sum(map(len, w))
    return not (len(w) < 50 or 2 * len(covered) > len(w) or 100 * symbols > 30 * len(w) or (len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 40 * len(lines)) or chars < 2 * len(w) or chars > 16 * len(w))


def kept_of_copies(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(t.lower()) for _, t, *_ in rows)]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return sorted((rows[min((j for j in range(len(rows)) if root[j] == g), key=order)] for g in set(root)), key=str)


def test_every_stage_is_brute_force(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    rules, classifier, copies, mix, encode = (f for _, f in corpus_pipeline.STAGES)

    one = rules(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and plain(one) == sorted((tuple(r) for r in docs.collect() if kept_by_rules(r.text)), key=str)

    two = classifier(spark, one, str(tmp_path))
    model = quality_classifier.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scorer = quality_classifier.Scorer(model)
    want = [r for r in plain(one) if scorer.score(r[1]) >= quality_classifier.CUT]
    assert two.columns == docs.columns and plain(two) == want
    truth = [(r[0] % 4 > 0) for r in want if r[0] is not None and r[0] < 1000]
    assert sum(truth) / len(truth) > 0.95

    three = copies(spark, spark.createDataFrame(want, docs.schema), str(tmp_path))
    assert three.columns == docs.columns and plain(three) == kept_of_copies(want) and three.count() < len(want)

    four = mix(spark, three, str(tmp_path))
    per = Counter()
    for r in three.collect():
        per[r.source] += len(words(r.text))
    total, weight = sum(per.values()), dict(zip([*sorted(s for s in per if s is not None), *[s for s in per if s is None]], (3.0, 1.0, 2.0), strict=False))
    target = {}
    while len(target) < len(per):  # capped shares of what is left
        left = 1.5 * total - sum(target.values())
        level = left / sum(w for s, w in weight.items() if s not in target)
        over = {s: 2.0 * per[s] for s, w in weight.items() if s not in target and w * level > 2.0 * per[s]}
        target |= over or {s: w * level for s, w in weight.items() if s not in target}
    got, times = Counter(), Counter()
    for r in four.collect():
        got[r.source] += len(words(r.text))
        times[r.doc_id, r.text] += 1
    assert four.columns == docs.columns and max(times.values()) <= 2 and times.keys() <= {(r.doc_id, r.text) for r in three.collect()}
    assert all(abs(got[s] - target[s]) <= 300 for s in per)

    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_padding()
    lib.no_truncation()
    five = encode(spark, four, str(tmp_path))
    ids = sorted((str(r.doc_id), r.ids) for r in five.collect())
    assert ids == sorted((str(r.doc_id), lib.encode(r.text, add_special_tokens=False).ids) for r in four.collect())
    assert all(r.n_tokens == len(r.ids) for r in five.collect())


def test_run_is_the_stages_in_order_and_repeats(spark, tmp_path):
    fixture(spark, tmp_path)
    rows = lambda: sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    first = rows()
    assert first == rows() and 50 < len(first) < 300
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None

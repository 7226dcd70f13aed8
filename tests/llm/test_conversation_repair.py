"""Conversation repair against brute force: every script of edits, planted faults, nulls, ties, hot and very long conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import conversation_repair as cr

ROWS = "conv_id bigint, turn bigint, role string, text string, present int, signature string"
GAPS = ["", "u", "a", "us", "ua", "au", "uu", "aa"]


def every_script(signature):
    """The least (cost, audit) over all choices for each turn and all insertions of up to two turns between them."""
    best = None
    choices = [["D"] if x == "x" else ["K", "U", "A", "D"] for x in signature]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(signature) + 1):
            roles, cost, audit = "", 0, ""
            for k, gap in enumerate(inserts):
                roles, cost, audit = roles + gap, cost + 3 * len(gap), audit + "I" * len(gap)
                if k < len(signature):
                    x, e = signature[k], edits[k]
                    roles += {"K": x.lower(), "U": "u", "A": "a", "D": ""}[e]
                    cost += {"K": 0, "U": 3, "A": 3, "D": 4}[e] + (3 if e != "D" and x.isupper() else 0)
                    audit += "R" if e in "UA" else e
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_solutions_are_the_cheapest():
    r = random.Random(2)
    letters = "suaoSUAOx"
    some = ["", *letters, *("".join(p) for p in itertools.product(letters, repeat=2)), *("".join(r.choice(letters) for _ in range(3)) for _ in range(25))]
    for signature in some:
        cost, audit, edits = cr.solve(signature)
        assert (cost, audit) == every_script(signature)
        assert re.sub("[UA]", "R", re.sub("[ua]", "I", edits)) == audit


def test_long_signatures():
    r = random.Random(4)
    long = "".join(r.choice("uaSx") for _ in range(50_000))
    cost, audit, _ = cr.solve(long)
    assert sum(c != "I" for c in audit) == len(long) and cost >= 4 * long.count("x")
    assert cr.solve("ua" * 20_000)[:2] == (0, "K" * 40_000)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            out += [(conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    return out


def brute(rows, solve):
    out = {}
    broken = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in broken if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        starts = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:], strict=False))
        letters = [s if s in ("s", "u", "a") else "o" for s in starts]
        signature = "".join("x" if f in ("b", "d") else x.upper() if f == "t" else x for f, x in zip(faults, letters, strict=True))
        cost, audit = solve(signature)
        lines, todo, led = [], list(mine), False
        for op in audit:
            turn = todo.pop(0) if op != "I" else None
            if op != "D":
                led = led or (not lines and op == "K" and turn[1][:1] == "s")
                role = turn[1] if op == "K" else ("user", "assistant")[(len(lines) - led) % 2]
                lines.append(f"{role}:{turn[2] if turn else ''}")
        counts = [faults.count(f) for f in "bdt"]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user"], ["Yes.", "No!", "so what", " \t", "", None, "Why?\n", "é…", "a. b"]
    out = [(c, r.choice([None, *range(6)]), r.choice(roles), r.choice(texts)) for c in range(150) for _ in range(r.randrange(1, 7))]
    out += [(None, 1, "user", "Hm?"), (None, 2, "assistant", "Oh."), (-1, None, None, None), *[(200 + c, t, "user" if t % 2 == 0 else "assistant", "Hi.") for c in range(100) for t in range(4)]]
    return [*out, *out[:40]]


def test_same_as_brute_force(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(*x, 7, "s") for x in rows], ROWS).repartition(5).write.parquet(f"{path}/conversations.parquet")
    got = cr.op13_conversation_repair(spark, path)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = brute(rows, lambda s: cr.solve(s)[:2])
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want and got.count() == len(want)


def test_shares_give_the_same(spark, rows, monkeypatch):
    turns = spark.createDataFrame([(*x, 7, "s") for x in rows], ROWS)
    before = {r["conv_id"]: r for r in cr.repair(turns).collect()}
    monkeypatch.setattr(cr, "BROADCAST_LETTERS", -1)
    assert {r["conv_id"]: r for r in cr.repair(turns).collect()} == before


def test_repaired_turns_alternate(spark, rows):
    out = cr.repair(spark.createDataFrame([(*x, 7, "s") for x in rows], ROWS))
    starts = F.array_join(F.transform("repaired", lambda x: F.substring(x["role"], 1, 1)), "")
    assert out.filter(~starts.rlike(r"^(s?(ua)+)?\z")).count() == 0


def test_one_long_conversation(spark):
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    row = cr.repair(turns).first()
    assert (row["cost"], row["audit"], len(row["repaired"])) == (0, "K" * 20_000, 20_000) and row["repaired"][19_999]["text"] == "19999."


def test_empty_and_dropped(spark):
    assert cr.repair(spark.createDataFrame([], ROWS)).collect() == []
    gone = cr.repair(spark.createDataFrame([(1, 2, "user", "Hi.", 0, "s")], ROWS), present=F.col("present") == 1).first()
    assert gone.asDict() == {"conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired": []}

"""Conversation structure repair: faults of each turn as a letter, one solution for each distinct signature, audits joined back, edits replayed.

A signature spells a conversation's turns: the role's initial (s, u, a; o for
any other), in upper case where the text is truncated, x where the turn must go
(blank, or a repeat). Real corpora have few distinct signatures, so the cheapest
edits are searched once for each by memoised recursion and joined back.

Turns stand by ``turn`` (nulls first), then role and text, so ties are settled
and repeated rows are neighbours. One conversation is one output row; its turns
are put in order by a window, which spills, before they meet.

Defined cases: a null role or text counts as one space; turns with a null
conversation make one conversation of their own; a conversation without turns
has zero faults, no edits and no text; roles with another initial than s, u, a
are never kept as they are; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANKS, materialize, table

#: Costs of edits; a kept turn that is truncated costs TRUNCATED on top.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Automaton of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. A conversation may end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS, FAR = (START, ASSISTANT), 1 << 60
#: Where the role that a state asks for leads to, and that role's letter.
AFTER, ASKS = (USER, USER, ASSISTANT, USER), "uuau"
#: Turns whose tails are found by one descent.
STRIDE = 200
#: Letters of all distinct signatures that may be broadcast with their solutions.
BROADCAST_LETTERS = 4_000_000
#: Shares that a signature's conversations are dealt to beyond that.
SHARES = 32
SOLVED = "signature string, cost bigint, audit string, edits string"


def _kept(letter: str, state: int) -> int | None:
    """Where a turn that is kept leads to, if it may be."""
    if letter.lower() == "s" and state == START:
        return SYSTEM
    return AFTER[state] if letter.lower() == ASKS[state] else None


def solve(signature: str) -> tuple[int, str, str]:
    """(cost, audit, edits) of the cheapest edits, of the least audit among those.

    audit has an initial for each edit (Keep, Rerole, Delete, Insert). edits
    tells roles as well: K and D as in audit, U and A for turns that become user
    or assistant, u and a for inserted ones. Linear in the signature's length.
    """
    known: dict[int, tuple[int, ...]] = {len(signature): (0, 2 * INSERT, INSERT, 0)}

    def tail(at: int) -> tuple[int, ...]:
        """The least cost of the turns from ``at`` on, for each state."""
        if at not in known:
            letter, rest = signature[at], tail(at + 1)
            costs = []
            for state in range(4):
                cost = DELETE + rest[state]
                if letter != "x":
                    fault = TRUNCATED * letter.isupper()
                    cost = min(cost, REROLE + fault + rest[AFTER[state]])
                    if (to := _kept(letter, state)) is not None:
                        cost = min(cost, fault + rest[to])
                costs.append(cost)
            user = min(costs[USER], INSERT + costs[ASSISTANT])
            known[at] = (min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, min(costs[ASSISTANT], INSERT + user))
        return known[at]

    for at in range(len(signature), -1, -STRIDE):  # from the end, so that no descent is deep
        tail(at)
    at, state, audit, edits, left = 0, START, [], [], tail(0)[START]
    total = left
    while at < len(signature) or left:  # the first letter of the alphabet whose cost fits
        letter = signature[at] if at < len(signature) else "x"
        fault, to = TRUNCATED * letter.isupper(), _kept(letter, state)
        choices = [("I", ASKS[state], INSERT, at, AFTER[state])]
        if at < len(signature):
            choices.append(("D", "D", DELETE, at + 1, state))
            if to is not None:
                choices.append(("K", "K", fault, at + 1, to))
            if letter != "x":
                choices.append(("R", ASKS[state].upper(), REROLE + fault, at + 1, AFTER[state]))
        initial, edit, cost, at, state = min(x for x in choices if x[2] + tail(x[3])[x[4]] == left)
        left -= cost
        audit.append(initial)
        edits.append(edit)
    return total, "".join(audit), "".join(edits)


def _solve_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([(x, *solve(x)) for x in part["signature"]], columns=["signature", "cost", "audit", "edits"])


def solutions(signatures: DataFrame) -> DataFrame:
    """``signature`` of each row with cost, audit and edits, each distinct one solved once."""
    return signatures.select("signature").distinct().mapInPandas(_solve_all, SOLVED)


def _last(text: Column) -> Column:
    """The last character that is no blank."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)


def diagnose(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, signature and ``turns`` (role, text) in order.

    Rows where ``present`` is false only tell that a conversation exists.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), there.alias("there")).repartition("conv_id")
    group = ["conv_id", "there"]
    order = Window.partitionBy(*group).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("turn").over(order)).withColumn("pair", F.concat(F.lag(F.substring("role", 1, 1)).over(order), F.substring("role", 1, 1)))
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy(*group, "role", "text").orderBy("place")) > 1)
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    fault = F.when(blank, "blank").when(F.col("seen"), "duplicate").when(~_last(F.col("text")).isin(".", "!", "?"), "truncated").otherwise("none")
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    rows = rows.withColumn("fault", fault).withColumn("letter", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain))
    new = F.col("turn").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("turn")))
    n = lambda c: F.sum(F.when(F.col("there") & c, 1).otherwise(0)).cast("bigint")
    mine = lambda c: F.when(F.col("there"), F.col(c))
    grouped = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(mine("turn")).cast("bigint") - F.min(mine("turn")).cast("bigint") + 1 - n(new), F.lit(0).cast("bigint")).alias("gaps"),
        *[n(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        n(F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(F.col("there"), F.struct("place", "letter", "role", "text")))).alias("all"),
    )
    return grouped.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.array_join(F.transform("all", lambda x: x["letter"]), "").alias("signature"), F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def replay(turns: Column, edits: Column) -> Column:
    """The turns (role, text) after the edits of ``solve``."""
    inserted = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    steps = F.regexp_extract_all(edits, F.lit(r"[ua]*[KDUA]|[ua]+\z"), F.lit(0))  # what is inserted before a turn, then what happens to it

    def done(step: Column, at: Column) -> Column:
        edit, old = F.substring(step, -1, 1), F.get(turns, at)
        became = F.when(edit == "U", "user").when(edit == "A", "assistant").otherwise(old["role"])
        one = F.array(F.struct(became.alias("role"), old["text"].alias("text")))
        return F.concat(inserted(F.regexp_extract(step, "^[ua]*", 0)), F.when(edit.isin("K", "U", "A"), one).otherwise(F.slice(one, 1, 0)))

    return F.flatten(F.transform(steps, done))


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """A row for each conversation: what ``diagnose`` found, cost, audit, and ``repaired`` (role, text), whose roles are ``(s?(ua)+)?`` by initials."""
    found = materialize(diagnose(turns, conv_id, turn, role, text, present), "conversations")
    solved = materialize(solutions(found), "solved")
    if (solved.agg(F.sum(F.length("signature"))).first()[0] or 0) <= BROADCAST_LETTERS:
        met = found.join(F.broadcast(solved), "signature")
    else:  # many conversations may share one signature
        shared = solved.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        met = found.withColumn("share", F.pmod(F.xxhash64("conv_id"), F.lit(SHARES)).cast("int")).join(shared, ["signature", "share"])
    return met.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", replay(F.col("turns"), F.col("edits")).alias("repaired"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults: conv_id, turn, role, text, and ``present``: false for turns that are dropped."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("key") == 1, "").when(F.col("key") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(F.col("key") == 4, "user").otherwise(spaced("role"))
    twice = F.explode(F.when(F.col("key") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.withColumn("key", key).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("key") != 0).alias("present"), twice.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), present=F.col("present"))
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return out.withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).drop("repaired")


def _plus(cost: str, edit: str, rest: str) -> str:
    return f"printf('%09d', CAST(substr({rest}, 1, 9) AS BIGINT) + {cost}) || '{edit}' || substr({rest}, 10)"


def _best(state: int) -> str:
    """The least of nine digits of cost and an audit, over the edits of one turn."""
    asked, to = ASKS[state], f"c{AFTER[state]}"
    kept = f"WHEN lower(x) = '{asked}' THEN {_plus('t', 'K', to)}" + (f" WHEN lower(x) = 's' THEN {_plus('t', 'K', 'c1')}" if state == START else "")
    return f"least({_plus('4', 'D', f'c{state}')}, CASE WHEN x <> 'x' THEN {_plus('3 + t', 'R', to)} END, CASE {kept} END)"


OP13_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(0, 256)) AS n)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT))),
                         lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS k
  FROM conversations, crc),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM rows_),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
spelled AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE
              CASE WHEN fault = 'truncated' THEN upper(CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END)
                   WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END END AS x FROM faulty),
convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, string_agg(x, '' ORDER BY i) AS sig FROM spelled GROUP BY conv_id),
tails AS (
  SELECT DISTINCT sig, len(sig) AS pos, '000000000' AS c0, '000000006II' AS c1, '000000003I' AS c2, '000000000' AS c3 FROM convs
  UNION ALL
  SELECT sig, pos - 1, least(b0, {_plus("3", "I", "u")}), least(b1, {_plus("3", "I", "u")}), u, least(b3, {_plus("3", "I", "u")})
  FROM (
    SELECT *, least(b2, {_plus("3", "I", "b3")}) AS u
    FROM (
      SELECT sig, pos, {_best(0)} AS b0, {_best(1)} AS b1, {_best(2)} AS b2, {_best(3)} AS b3
      FROM (SELECT *, sig[pos] AS x, CASE WHEN sig[pos] IN ('S', 'U', 'A', 'O') THEN 3 ELSE 0 END AS t FROM tails WHERE pos > 0)))),
solved AS (SELECT sig, CAST(substr(c0, 1, 9) AS BIGINT) AS cost, substr(c0, 10) AS audit FROM tails WHERE pos = 0),
ops AS (
  SELECT conv_id, op, p, count(*) FILTER (op <> 'I') OVER w AS i, count(*) FILTER (op <> 'D') OVER w AS o
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS op, unnest(range(1, len(audit) + 1)) AS p FROM convs JOIN solved USING (sig) WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
outs AS (
  SELECT ops.conv_id, o, op, r.role, coalesce(CASE WHEN op <> 'I' THEN r.text END, '') AS text,
         bool_or(o = 1 AND op = 'K' AND r.role[1] = 's') OVER (PARTITION BY ops.conv_id) AS led
  FROM ops LEFT JOIN placed r ON r.conv_id IS NOT DISTINCT FROM ops.conv_id AND r.i = ops.i WHERE op <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (o - CAST(led AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o) AS text
  FROM outs GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN convs c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN solved s ON s.sig = c.sig
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""

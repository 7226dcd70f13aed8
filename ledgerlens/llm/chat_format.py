"""Chat formatting from event logs: fold deltas, edits and regenerations into messages, then render.

Events are (conv_id, msg, seq, kind, role, text). Within a message they are
taken by ``seq``: ``message``, ``edit`` and ``regenerate`` (text may be empty)
start the text over, ``delta`` appends, ``delete`` empties the message out of
the conversation. The last role that is not null counts. Messages are folded
in a first grouping by (conversation, message), so only finished messages meet
in the second grouping, whose result is one string for each conversation
anyway.

Template: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line
feed. Control strings inside a role or text are escaped by a backslash after
their first character; one that already has backslashes there gets one more,
so ``unescape`` restores every text. ``loss`` holds [start, end) spans, in
code points, of the assistant texts.

Defined cases: null text, role or kind count as empty text, empty role and
``delta``; rows of a message with the same seq are taken by kind, then text;
repeated rows count as often as they come; a null conversation id is a
conversation of its own; an empty log gives an empty result; other columns are
ignored. A role's line feeds are escaped, so a role can't end its line early.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import table

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
#: Control strings of common chat templates, this one's first.
CONTROL = (START, END, "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in "|[]/" else c for c in text)


_TAILS = "|".join(sorted({_quoted(c[1:]) for c in CONTROL}, key=lambda x: (-len(x), x)))
_FIRST = "[" + "".join(sorted({_quoted(c[0]) for c in CONTROL})) + "]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({_FIRST})(\\*)({_TAILS})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({_FIRST})(\\*)\\({_TAILS})", r"$1$2$3")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(lines, F.lit("\\\\"), F.lit("\\")))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, msg, role, text: a row for each message that is left.

    What the last event that starts the text over and the deltas after it say;
    no list grows event by event, so a message of very many deltas is linear.
    """
    kind = F.coalesce("kind", F.lit("delta"))
    e = events.select("conv_id", "msg", F.struct("seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"))
    log = e.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list("e")).alias("log"))
    begin = F.coalesce(F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i))), F.lit(0))
    parts = F.transform(F.slice("log", begin + 1, F.size("log")), lambda x: F.when(x["kind"] == "delete", "").otherwise(x["text"]))
    role = F.try_element_at(F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull()), F.lit(-1))
    left = log.filter(F.element_at("log", -1)["kind"] != "delete")
    return left.select("conv_id", "msg", F.coalesce(role, F.lit("")).alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted (string), loss (array of start, end): a row for each conversation."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = messages.select("conv_id", "msg", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == TRAINED).alias("trained"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(f"{END}\n")))
    # where each turn begins, by a running sum over the conversation, whose rows meet here anyway
    upto = F.sum(F.length("turn")).over(Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, 0))
    start = upto - F.length("turn") + F.length("head")
    placed = turns.withColumn("span", F.when(F.col("trained"), F.struct(start.cast("int").alias("start"), (start + F.length("body")).cast("int").alias("end"))))
    convs = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("msg", "turn", "span"))).alias("t"))
    return convs.select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), trained (the unescaped text under the loss mask), formatted_chars."""
    rows = F.filter(F.split("formatted", _quoted(START)), lambda x: x != "")
    cut = F.length(F.lit(f"{END}\n"))
    turn = lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - 1 - cut)).alias("text"),
    )
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", F.transform(rows, turn).alias("turns"), F.array_join(under, "").alias("trained"), F.length("formatted").cast("long").alias("formatted_chars"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A log that a chat client could have left of a conversation table, rows of a conversation by turn.

    Assistant texts come as a draft, its regeneration and three deltas; other
    texts as a message and a delta, every third (by hash) as a draft and an
    edit. Rows that share a turn are messages of their own, by role and text.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select("conv_id", row.alias("msg")).groupBy("conv_id", "msg").agg(F.count("*").alias("n"))
    each = rows.select("conv_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"), "msg.turn", "msg.role", "msg.text")
    text, size, third = F.col("text"), F.length("text"), F.length("text") / 3
    cut = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    one, two = third.cast("int"), (2 * third).cast("int")
    event = lambda seq, kind, said, role=None: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), (role if role is not None else F.lit(None).cast("string")).alias("role"), said.alias("text"))
    none, draft, role = F.lit(None).cast("string"), F.concat(F.lit("draft of "), F.length("text").cast("string")), F.col("role")
    streamed = F.array(event(1, "message", draft, role), event(2, "regenerate", none), event(3, "delta", cut(F.lit(0), one)), event(4, "delta", cut(one, two)), event(5, "delta", cut(two, size)))
    edited = F.array(event(1, "message", draft, F.lit("unknown")), event(2, "delta", F.lit("...")), event(3, "edit", text, role))
    plain = F.array(event(1, "message", cut(F.lit(0), one), role), event(2, "delta", cut(one, size)))
    log = F.when(role == TRAINED, streamed).when(F.pmod(F.xxhash64("text"), F.lit(3)) == 0, edited).otherwise(plain)
    return each.select("conv_id", F.struct("turn", "role", "text", "k").alias("msg"), F.explode(log).alias("e")).select("conv_id", "msg", "e.seq", "e.kind", "e.role", "e.text")


#: The conversation that the query op3 adds, to show that texts can't forge turns.
PROBE = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    back = read_back(render(fold(events_of(rows))))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|im_sep\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS safe FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(safe)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

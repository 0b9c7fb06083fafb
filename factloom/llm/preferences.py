"""Preference formatting: a shared prompt once, and two masked completions, as DataFrame expressions only.

Chosen and rejected conversations are turn tables. Turns are compared at equal turn numbers by a 64-bit hash of their
messages, so texts don't move for it; the longest common prefix ends before the first number where the two differ or one
has no turn. Then each text meets, by its own conversation and turn, the parts of pairs that show it, in the only join that
moves texts. Output is a row for each rendered message, so that no conversation, however long, is gathered in one task;
:func:`joined` puts the strings of a pair together.

Defined results: null roles and texts are empty. Rows of one conversation and turn number are one turn of several
messages, ordered by role and text, equal ones once. A null turn number comes after all others. A null ``pair_id`` or
``conv_id`` is an id of its own. A pair with an empty completion is no preference and gives no rows: one whose sides are
equal, or where one side has no turn from the first difference on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import frames

LAST = (1 << 63) - 1
#: Copies of a pair's one border, so that the turns of a very long conversation meet it in several tasks, by runs of turns.
SALT, RUN = 8, 64
PARTS = ("prompt", "chosen", "rejected")


def _header(role: str) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _body(text: str) -> Column:
    return F.concat(text, F.lit("<|end|>\n"))


def _messages(df: DataFrame, key: str, side: int) -> DataFrame:
    """``df`` as ``src, side, src_turn, role, text``, without nulls."""
    id_, turn = (F.coalesce(F.col(c).cast("bigint"), F.lit(v)) for c, v in ((key, frames.NULL_ID), ("turn", LAST)))
    return df.select(id_.alias("src"), F.lit(side).alias("side"), turn.alias("src_turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _turns(messages: DataFrame) -> DataFrame:
    """One row for each turn: a hash of its distinct messages that doesn't see their order, and whether one is an assistant's."""
    key = ["src", "side", "src_turn"]
    once = messages.select(*key, F.xxhash64("role", "text").alias("h"), (F.col("role") == "assistant").alias("a")).groupBy(*key, "h").agg(F.bool_or("a").alias("a"))
    return once.groupBy(*key).agg(F.bit_xor(F.xxhash64("h")).alias("h"), F.bool_or("a").alias("assistant"))


def _salt(turn: Column) -> Column:
    """Which of the copies of a conversation's one row a turn meets: runs of ``RUN`` turns take turns."""
    return F.pmod(F.floor(turn / RUN), F.lit(SALT)).cast("int")


def _salted(df: DataFrame, least: str = "least", most: str = "most") -> DataFrame:
    """``df`` once for each copy that the turns from ``least`` to ``most`` may ask for: one where they are few."""
    last = F.when((F.col(least) < 0) | (F.col(most) >= RUN * SALT), SALT - 1).otherwise(_salt(F.col(most)))
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop(least, most)


def _routes(turns: DataFrame) -> DataFrame:
    """``(src, side, src_turn, pair_id, part, turn)``: the part of each pair that shows a turn.

    ``turns(pair_id, salt, turn, c, r, r_src, r_side, r_turn)``: hashes of both sides' turns, null where a side has none, and
    where the rejected one stands; the chosen one stands under the pair's id on side 0.
    """
    differ = ~F.col("c").eqNullSafe(F.col("r"))
    border = turns.groupBy("pair_id").agg(F.min(F.when(differ, F.col("turn"))).alias("border"), *(F.max(F.when(F.col(x).isNotNull(), F.col("turn"))).alias(f"{x}_last") for x in "cr"), F.min("turn").alias("least"), F.max("turn").alias("most"))
    border = _salted(border.where("border <= c_last AND border <= r_last").select("pair_id", "border", "least", "most"))
    met = turns.join(border, ["pair_id", "salt"])
    early = F.col("turn") < F.col("border")
    shown = lambda src, side, turn, part: F.struct(src.alias("src"), side.alias("side"), turn.alias("src_turn"), part.alias("part"))
    chosen = F.when(F.col("c").isNotNull(), shown(F.col("pair_id"), F.lit(0), F.col("turn"), F.when(early, "prompt").otherwise("chosen")))
    rejected = F.when(~early & F.col("r").isNotNull(), shown(F.col("r_src"), F.col("r_side"), F.col("r_turn"), F.lit("rejected")))
    return met.select("pair_id", "turn", F.explode(F.array_compact(F.array(chosen, rejected))).alias("x")).select("x.src", "x.side", "x.src_turn", "pair_id", "x.part", "turn")


def _rendered(messages: DataFrame, routes: DataFrame) -> DataFrame:
    shown = messages.join(routes, ["src", "side", "src_turn"])
    inside = Window.partitionBy("src", "side", "src_turn", "pair_id", "part").orderBy("role", "text")
    m = F.struct("role", "text")
    rows = shown.withColumns({"message": F.dense_rank().over(inside) - 1, "again": F.coalesce(F.lag(m).over(inside) == m, F.lit(False))}).where("NOT again")
    learnt = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    return rows.select(
        F.nullif("pair_id", F.lit(frames.NULL_ID)).alias("pair_id"), "part", F.nullif("turn", F.lit(LAST)).alias("turn"), "message", F.concat(_header("role"), _body("text")).alias("rendered"),
        F.when(learnt, F.length(_header("role"))).otherwise(0).alias("mask_start"), F.when(learnt, F.length(_body("text"))).otherwise(0).alias("mask_length"),
    )


def segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id, part, turn, message, rendered, mask_start, mask_length`` from ``(pair_id, turn, role, text)`` tables.

    ``part`` is prompt, chosen or rejected. In a completion the content and end mark of assistant messages count for the
    loss: ``mask_length`` characters of ``rendered`` from ``mask_start`` on (0 and 0 elsewhere).
    """
    messages = _messages(chosen, "pair_id", 0).unionByName(_messages(rejected, "pair_id", 1))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("h")))
    both = _turns(messages).groupBy(F.col("src").alias("pair_id"), F.col("src_turn").alias("turn")).agg(of(0).alias("c"), of(1).alias("r"))
    turns = frames.cut(both.select("pair_id", _salt(F.col("turn")).alias("salt"), "turn", "c", "r", F.col("pair_id").alias("r_src"), F.lit(1).alias("r_side"), F.col("turn").alias("r_turn")))
    return _rendered(messages, _routes(turns))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """The segments of pairs made from plain conversations ``(conv_id, turn, role, text)``: chosen is a conversation,
    rejected the same one up to its last assistant turn, which is that of its partner instead, the conversation whose id
    differs in the lowest bit. No partner, no assistant turn or equal last turns: no pair."""
    messages = _messages(conversations, "conv_id", 0)
    turns = frames.cut(_turns(messages))
    answer = F.max(F.when(F.col("assistant"), F.struct("src_turn", "h"))).alias("x")
    last = turns.where(F.col("src") != frames.NULL_ID).groupBy("src").agg(answer, F.min("src_turn").alias("least"), F.max("src_turn").alias("most")).where("x IS NOT NULL").select("src", F.col("x.src_turn").alias("last"), F.col("x.h").alias("h"), "least", "most")
    partner = last.select(F.col("src").bitwiseXOR(F.lit(1)).alias("src"), F.col("src").alias("other"), F.col("last").alias("other_last"), F.col("h").alias("other_h"))
    pairs = frames.cut(last.join(partner, "src").where("h <> other_h").select("src", "last", "other", "other_last", "other_h", "least", "most"))
    own = turns.select("src", _salt(F.col("src_turn")).alias("salt"), "src_turn", "h").join(_salted(pairs), ["src", "salt"])
    swapped = F.col("src_turn") == F.col("last")
    both = own.select(
        F.col("src").alias("pair_id"), "salt", F.col("src_turn").alias("turn"), F.col("h").alias("c"), F.when(swapped, F.col("other_h")).when(F.col("src_turn") < F.col("last"), F.col("h")).alias("r"),
        F.when(swapped, F.col("other")).otherwise(F.col("src")).alias("r_src"), F.lit(0).alias("r_side"), F.when(swapped, F.col("other_last")).otherwise(F.col("src_turn")).alias("r_turn"),
    )
    return _rendered(messages, _routes(both))


def joined(parts: DataFrame) -> DataFrame:
    """One row for each pair: ``prompt, chosen, rejected`` strings, and ``chosen_mask, rejected_mask`` as arrays of ``(start, length)``.

    A pair's strings are one value each, so a task holds as much as the longest conversation.
    """
    turn = F.struct(F.coalesce("turn", F.lit(LAST)).alias("turn"), "message", "rendered", "mask_start", "mask_length")
    lists = parts.groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("part") == p, turn))).alias(p) for p in PARTS))

    def masks(c: str) -> Column:
        begin = lambda acc: acc["at"]
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
        step = lambda acc, x: F.struct((acc["at"] + F.length(x["rendered"])).alias("at"), F.when(x["mask_length"] > 0, F.concat(acc["spans"], F.array(F.struct((begin(acc) + x["mask_start"]).alias("start"), x["mask_length"].alias("length"))))).otherwise(acc["spans"]).alias("spans"))
        return F.aggregate(c, zero, step, lambda acc: acc["spans"])

    text = lambda c: F.concat_ws("", F.transform(c, lambda x: x["rendered"]))
    return lists.select("pair_id", *(text(c).alias(c) for c in PARTS), *(masks(c).alias(f"{c}_mask") for c in PARTS[1:]))


ORACLE = """
WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
a AS (SELECT pair_id, max(turn) AS last, 'assistant' AS role, arg_max(text, turn) AS text FROM t WHERE role = 'assistant' GROUP BY pair_id),
k AS (SELECT a.pair_id, a.last, b.role, b.text FROM a JOIN a b ON b.pair_id = xor(a.pair_id, 1) WHERE a.text <> b.text),
s AS (SELECT t.pair_id, turn, CASE WHEN turn < last THEN 'prompt' ELSE 'chosen' END AS part, t.role, t.text FROM t JOIN k USING (pair_id)
  UNION ALL SELECT pair_id, last, 'rejected', role, text FROM k)
SELECT pair_id, part, turn, 0 AS message, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END AS mask_start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(text) + 8 ELSE 0 END AS mask_length FROM s
"""

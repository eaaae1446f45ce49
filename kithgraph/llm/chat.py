"""Chat formatting with the collapse of cumulative snapshots, in DataFrame operations only.

Chat logs often hold a conversation again and again as it grows. A rolling hash stands
for every prefix of a conversation: the exclusive or of hashes of (place, role, text) of
its turns, twice over for 128 bits. A conversation whose last hash is a prefix hash of a
longer one is dropped by an anti-join; of equal ones the smallest id stays. The rest is
rendered: a row is a turn with its place and where it starts in the conversation's text,
whatever the conversation's length, so no conversation gathers in one task or cell; the
rows' texts in the order of their places are the conversation.

Places, prefix hashes and starts are computed on hashes and lengths of the turns, dealt
by ranges of (conversation, turn): a conversation with a third of all turns lies in many
partitions, and one row for each conversation and partition carries the sums on.

Defined results: rows that repeat a turn (id, number, role and text) count once; turns
with equal numbers stand in the order of a hash of role and text; null numbers come
first; a null id is a conversation of its own; a null role is "unknown" and a null text
is empty when rendered; ids of any type that can be ordered; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.llm import shared


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def _hashed(turns: DataFrame) -> DataFrame:
    """With _conv and _turn, which hold id and number so that nulls are equal, and two hashes of role and text."""
    known = [F.col("role").isNull(), F.col("text").isNull(), F.col("role"), F.col("text")]
    return turns.select(F.struct("conv_id").alias("_conv"), F.struct("turn").alias("_turn"), F.xxhash64(*known)
        .alias("_a"), F.xxhash64(F.lit("b"), *reversed(known)).alias("_b"), "role", "text")


_TURN = ["_conv", "_turn", "_a", "_b"]


def prefixes(turns: DataFrame) -> DataFrame:
    """_conv, _turn, _a, _b, place (from 1), turns (of the conversation), start (characters before) and the prefix hashes p and q."""
    rows = _hashed(turns).select(*_TURN, F.length(rendered_turn(F.col("role"), F.col("text"))).cast("long").alias("_len")).distinct()
    order = _TURN[1:]
    dealt = shared.staged(rows.repartitionByRange(*_TURN).withColumn("_part", F.spark_partition_id()), "chat-dealt")
    here = Window.partitionBy("_conv", "_part").orderBy(*order)
    sizes = dealt.groupBy("_conv", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_off": F.coalesce(F.sum("n").over(before), F.lit(0)), "turns": F.sum("n")
        .over(Window.partitionBy("_conv"))}).drop("n")
    placed = dealt.withColumn("_nth", F.row_number().over(here)).join(sizes, ["_conv", "_part"])
    placed = placed.withColumn("place", (F.col("_off") + F.col("_nth")).cast("long")).drop("_off", "_nth")
    placed = shared.staged(placed.withColumns({"_g": F.xxhash64("place", "_a", "_b"), "_h": F.xxhash64("_b", "place", "_a")}), "chat-placed")
    carried = placed.groupBy("_conv", "_part").agg(F.bit_xor("_g").alias("_g0"), F.bit_xor("_h").alias("_h0"), F.sum("_len").alias("_len0"))
    carried = carried.select("_conv", "_part", *(F.coalesce(f(c).over(before), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "_g0"), (F.bit_xor,
        "_h0"), (F.sum, "_len0"))))
    along = Window.partitionBy("_conv", "_part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumns({"p": F.bit_xor("_g").over(along), "q": F.bit_xor("_h").over(along), "start": F.sum("_len")
        .over(along) - F.col("_len")}).join(carried, ["_conv", "_part"])
    return running.select(*_TURN, "place", "turns", (F.col("start") + F.col("_len0")).alias("start"), F.col("p")
        .bitwiseXOR(F.col("_g0")).alias("p"), F.col("q").bitwiseXOR(F.col("_h0")).alias("q"))


def maximal(prefixed: DataFrame) -> DataFrame:
    """_conv, turns and copies of the conversations that are prefix of no longer one, one of equal ones."""
    last = F.col("place") == F.col("turns")
    known = F.struct(F.col("_conv.conv_id").isNull().alias("none"), "_conv")
    whole = prefixed.where(last).groupBy("turns", "p", "q").agg(F.min(known).alias("_first"), F.count("*").alias("copies"))
    inner = prefixed.where(~last).select(F.col("place").alias("turns"), "p", "q").distinct()
    return whole.join(inner, ["turns", "p", "q"], "left_anti").select("_first._conv", "turns", "copies")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, place, n_turns, n_copies, start and rendered for every turn of the conversations that stay, of turns (conv_id, turn, role, text)."""
    turns = turns.select("conv_id", "turn", "role", "text")
    known = shared.staged(prefixes(turns), "chat-prefixes")
    stay = shared.staged(maximal(known), "chat-maximal")
    places = known.join(stay.select("_conv", "copies"), "_conv").select(*_TURN, "place", "turns", "copies", "start")
    told = _hashed(turns).dropDuplicates(_TURN).join(places, _TURN)
    return told.select(F.col("_conv.conv_id").alias("conv_id"), "place", F.col("turns").alias("n_turns"), F.col("copies")
        .alias("n_copies"), "start", rendered_turn(F.col("role"), F.col("text")).alias("rendered"))

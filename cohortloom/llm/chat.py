"""Chat transcripts as training windows of bounded length.

The running sum of turn tokens cuts a conversation into spans of whole turns; each
window repeats the system turn and as many earlier turns as fit in the history
budget, and only assistant turns that are new in a window are targets. A running
sum assigns each turn by its own end, without waiting for the turns before it: with
a stride of half the room for new turns, the turns that end within one stride take
at most two strides, unless one turn alone is longer; such a turn gets a window of
its own. All of it is DataFrame expressions.

Template: ``<|role|>text</s>`` for each turn, ``<|role|again|>`` for repeated ones.
Inside roles and texts ``%``, ``<``, ``[`` and ``|`` are written ``%25``, ``%3C``,
``%5B`` and ``%7C``, so no control string of this or a bracket template can stand
there, and reading them back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
#: Turns of a conversation that are ordered together.
BLOCK_TURNS = 64
_CODES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("|", "%7C"))


def escape(text: Column) -> Column:
    for plain, code in _CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turn_tokens(text: Column) -> Column:
    """Tokens a turn is counted as: four for its marks and one for every four bytes begun."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of every conversation: conv_id, cell, rest (their order), text, loss.

    ``text`` is the formatted window, ``loss`` its target spans as (start, length) in
    characters. Every turn is new in exactly one window.

    A NULL text or role is empty, a NULL turn number comes first, NULL conv_ids are one
    conversation. Turns with equal numbers are ordered by role and text and all kept. Other
    columns are not read; an empty table gives no windows.
    """
    t = turns.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", turn_tokens(F.col("text"))).withColumn(
        "block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK_TURNS))
    # Running sums in two steps: over blocks of turns, then inside a block.
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("key", "block").agg(F.sum("tokens").alias("bt"), F.count(F.lit(1)).alias("bn")).select(
        "key", "block", F.coalesce(F.sum("bt").over(earlier), F.lit(0)).alias("bt"),
        F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("bn"))
    inside = Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.join(sums, ["key", "block"]).select(
        "key", "conv_id", "role", "text", "tokens",
        (F.col("bt") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("end"),
        (F.col("bn") + F.row_number().over(inside)).alias("pos"))

    system = t.where("pos = 1 and role = 'system'").select(
        "key", F.col("text").alias("system"), F.col("tokens").alias("system_tokens"))
    t = t.join(system, "key", "left").withColumn(
        "stride", F.greatest(F.lit(1), F.floor((budget - history - F.coalesce("system_tokens", F.lit(0))) / 2)))
    t = t.select(
        "key", "conv_id", "role", "text", "tokens", "end", "pos", "system", "stride",
        F.floor((F.col("end") - 1) / F.col("stride")).alias("cell"),
        (F.col("tokens") <= F.col("stride")).cast("int").alias("rest"))

    opened = t.groupBy("key", "conv_id", "cell", "rest").agg(
        F.min(F.col("end") - F.col("tokens")).alias("begin"), F.min("pos").alias("first"),
        F.first("system").alias("system"), F.first("stride").alias("stride"))
    later = opened.where("first > 1")
    seen = (
        later.where(F.col("begin") > 0)
        .select("key", "cell", "rest", "begin", "first", F.explode(F.sequence(
            F.floor(F.greatest(F.col("begin") - history, F.lit(0)) / F.col("stride")),
            F.floor((F.col("begin") - 1) / F.col("stride")))).alias("old"))
        .join(t.select("key", F.col("cell").alias("old"), "role", "text", "pos", "tokens", "end", "system"), ["key", "old"])
        .where((F.col("pos") < F.col("first")) & (F.col("end") - F.col("tokens") >= F.col("begin") - history)
               & ~((F.col("pos") == 1) & F.col("system").isNotNull()))
        .select("key", "cell", "rest", "pos", F.lit(True).alias("again"), "role", "text"))
    kept = later.where(F.col("system").isNotNull()).select(
        "key", "cell", "rest", F.lit(1).cast("long").alias("pos"), F.lit(True).alias("again"),
        F.lit("system").alias("role"), F.col("system").alias("text"))
    new = t.select("key", "cell", "rest", F.col("pos").cast("long").alias("pos"), F.lit(False).alias("again"), "role", "text")
    rows = new.unionByName(seen).unionByName(kept).groupBy("key", "cell", "rest").agg(
        F.sort_array(F.collect_list(F.struct("pos", "again", "role", "text"))).alias("turns"))

    def head(x):
        return F.concat(F.lit("<|"), escape(x["role"]), F.when(x["again"], F.lit("|again")).otherwise(F.lit("")), F.lit("|>"))

    parts = rows.select("key", "cell", "rest", F.transform("turns", lambda x: F.struct(
        head(x).alias("head"), escape(x["text"]).alias("body"), (~x["again"] & (x["role"] == "assistant")).alias("target")
    )).alias("p"))
    end_mark = "</s>"
    placed = F.aggregate(
        "p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["head"]) + F.length(x["body"]) + len(end_mark)).alias("at"),
            F.when(x["target"], F.array_append(s["loss"], F.struct(
                (s["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))
                   ).otherwise(s["loss"]).alias("loss")))
    formatted = parts.select(
        "key", "cell", "rest",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(end_mark))), "").alias("text"),
        placed["loss"].alias("loss"))
    return formatted.select(
        F.when(F.col("key") != "", F.col("key").cast(turns.schema["conv_id"].dataType)).alias("conv_id"),
        "cell", "rest", "text", "loss")


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations as their windows say: conv_id, n_turns, turns (role, line feed, text, line
    feed for each), loss_text, formatted_chars."""
    pattern = F.lit(r"<\|([^|]*)(\|again)?\|>([^<]*)</s>")
    found = windows.select(
        "conv_id", "cell", "rest", "text", "loss",
        F.arrays_zip(*[F.regexp_extract_all("text", pattern, F.lit(k)).alias(n)
                       for k, n in ((1, "role"), (2, "again"), (3, "body"))]).alias("all"))
    found = found.select(
        "conv_id", "cell", "rest", F.filter("all", lambda x: x["again"] == "").alias("new"),
        F.length("text").cast("long").alias("chars"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"]))), "")
        .alias("loss"))
    told = F.array_join(F.transform("new", lambda x: F.concat(
        unescape(x["role"]), F.lit("\n"), unescape(x["body"]), F.lit("\n"))), "")
    ordered = F.sort_array(F.collect_list(F.struct("cell", "rest", told.alias("turns"), "loss")))
    return found.groupBy("conv_id").agg(
        F.sum(F.size("new").cast("long")).alias("n_turns"), ordered.alias("w"), F.sum("chars").alias("formatted_chars")
    ).select("conv_id", "n_turns", F.array_join("w.turns", "").alias("turns"), F.array_join("w.loss", "").alias("loss_text"),
             "formatted_chars")

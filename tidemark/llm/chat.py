"""Chat formatting in budgeted windows, in DataFrame operations only.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans.
Every span becomes one window: the system turn, a limited stretch of the turns
before, and the span's own turns. Only the span's own assistant texts carry
loss, so each is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 512, 2, 128
TURN_TOKENS = 4  # control marks and role of a turn
TOKEN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    r"""Double every backslash, then write ``<|`` as ``<\|``: no control string is left, and unescape() restores the text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As escape(); a line break, which ends the role in the template, becomes ``<\n|``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """Tokens of a text for the budget: letter runs, digits and other marks."""
    return F.regexp_count(text, F.lit(TOKEN))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
                   history_tokens: int = HISTORY_TOKENS, target_role: str = "assistant") -> DataFrame:
    """(conv_id, window, formatted, context_turns, fresh_turns, tokens, loss_spans), one row per window.

    context_turns counts the repeated turns at the start (system and history,
    without loss); loss_spans are (start, length) in code points of
    ``formatted``. A system turn is the first turn if its role is ``system``.
    The fresh part of a window holds at most budget - system - history tokens
    (a quarter of the budget at least), unless one turn alone is longer: it
    then is a window of its own. History is the last ``history_turns`` turns
    that fit in ``history_tokens``.

    Turns are ordered by (turn, role, text), null turns first; null texts and
    roles count as empty; rows with a null conv_id are one conversation; equal
    rows are turns of their own; a conversation without a target has no loss;
    an empty table gives an empty result. Other columns are not read.
    """
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto, before = conv.rowsBetween(Window.unboundedPreceding, 0), conv.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    turns = (conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                  F.coalesce("text", F.lit("")).alias("text"))
             .withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
             .withColumn("body", escape(F.col("text")))
             .withColumn("tok", (tokens(F.col("text")) + TURN_TOKENS).cast("long"))
             .withColumn("len", (F.char_length("head") + F.char_length("body") + len(END)).cast("long"))
             .withColumn("rn", F.row_number().over(conv))
             .withColumn("sys", (F.col("rn") == 1) & (F.col("role") == "system"))
             .withColumn("cost", F.when(F.col("sys"), zero).otherwise(F.col("tok"))))
    # the system turn is the first row: a running maximum carries its cost to every later row
    turns = (turns.withColumn("sys_tok", F.max(F.when(F.col("sys"), F.col("tok")).otherwise(zero)).over(upto))
             .withColumn("fresh", F.greatest(F.lit(budget) - F.col("sys_tok") - history_tokens, F.lit(budget // 4)))
             .withColumn("cum", F.coalesce(F.sum("cost").over(before), zero))
             .withColumn("at", F.coalesce(F.sum("len").over(before), zero))
             # spans of half the fresh part by prefix sum; with the turn that crosses the end they fit the whole,
             # and a turn of over half starts a span of its own
             .withColumn("long", F.col("cost") * 2 > F.col("fresh"))
             .withColumn("span", F.floor(2 * F.col("cum") / F.col("fresh")).cast("long"))
             .withColumn("longs", F.sum(F.col("long").cast("int")).over(upto))
             .withColumn("opens", F.coalesce((F.col("span") != F.lag("span").over(conv))
                                             | (F.col("longs") != F.lag("longs").over(conv)), F.lit(True))
                         & ~F.coalesce(F.lag("sys").over(conv), F.lit(False)))
             .withColumn("window", F.sum(F.col("opens").cast("int")).over(upto) - 1))
    past = F.collect_list(F.struct("cum", "sys", "head", "body", "tok")).over(conv.rowsBetween(-history_turns, -1))
    block = lambda x: F.concat(x["head"], x["body"], F.lit(END))
    system = F.first(F.struct("sys", "head", "body", "tok")).over(upto)
    turns = (turns.withColumn("past", F.when(F.col("opens"), past))
             .withColumn("first", F.when(F.col("opens"), system)))
    rows = turns.groupBy("conv_id", "window").agg(
        F.min("cum").alias("cum"), F.min("at").alias("at"),
        F.max("past").alias("past"), F.max("first").alias("first"), F.sum("tok").alias("own_tok"),
        # at most a window's turns: bounded by the budget, or one long turn
        F.array_sort(F.collect_list(F.struct("rn", "role", "at", "head", "body"))).alias("own"))
    history = F.when(F.col("window") > 0, F.filter(
        "past", lambda x: ~x["sys"] & (F.col("cum") - x["cum"] <= history_tokens))).otherwise(F.array())
    kept = (F.col("window") > 0) & F.col("first")["sys"]
    rows = (rows.withColumn("past", F.coalesce(history, F.slice("past", 1, 0)))
            .withColumn("context", F.concat(F.when(kept, block(F.col("first"))).otherwise(F.lit("")),
                                            F.array_join(F.transform("past", block), "")))
            .withColumn("base", F.char_length("context") - F.col("at")))
    mine = F.filter("own", lambda x: x["role"] == target_role)
    return rows.select(
        "conv_id", "window",
        F.concat("context", F.array_join(F.transform("own", block), "")).alias("formatted"),
        (F.size("past") + kept.cast("int")).alias("context_turns"),
        F.size("own").alias("fresh_turns"),
        (F.col("own_tok") + F.when(kept, F.col("first")["tok"]).otherwise(zero)
         + F.aggregate("past", zero, lambda a, x: a + x["tok"])).alias("tokens"),
        F.transform(mine, lambda x: F.struct(
            (F.col("base") + x["at"] + F.char_length(x["head"])).cast("long").alias("start"),
            F.char_length(x["body"]).cast("long").alias("length"))).alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the formatted windows and their loss spans alone.

    A conversation's text is put together for its hash, which has no form that
    adds parts; nothing else gathers a conversation.
    """
    parsed = F.transform(
        F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.col("context_turns") + 1, F.col("fresh_turns")),
        lambda x: F.concat(unescape_role(F.regexp_extract(x, r"^<\|im_start\|>([^\n]*)\n", 1)), F.lit("\n"),
                           unescape(F.regexp_replace(x, r"^<\|im_start\|>[^\n]*\n", "")), F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(
        (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    parts = windows.select("conv_id", "window", F.size(parsed).alias("n"),
                           F.array_join(parsed, "").alias("turns"), F.array_join(loss, "").alias("loss"),
                           F.char_length("formatted").alias("chars"))
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"),
        F.sum("chars").cast("long").alias("formatted_chars"))
    text, target = F.array_join("parts.turns", ""), F.array_join("parts.loss", "")
    return whole.select("conv_id", "n_turns", F.sha2(text, 256).alias("turns_sha256"),
                        F.char_length(target).cast("long").alias("loss_chars"),
                        F.sha2(target, 256).alias("loss_sha256"), "formatted_chars")

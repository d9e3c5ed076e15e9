"""Chat formatting by prefix-target expansion, in DataFrame functions only.

``format_turns`` renders conversations with the template

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

in blocks of ``BLOCK`` turn numbers, so that a conversation of any length is spread over many rows.
``expand`` explodes every assistant turn into an example of its own: its context is everything the
conversation has before the reply (a prefix of the formatted text, written out), and only the
reply is trainable. The contexts of one conversation grow with the square of its turns by nature. They are made row by row
behind the last exchange, so a task holds a conversation's text and one context at a time, and exchanges carry the text once;
the time of a very long conversation, and the disk of examples that are written, still grow with the square.

Control strings inside texts are escaped: ``<`` and ``|`` with k backslashes in between get k + 1 of
them, so no text can hold a control string, and taking one away restores the text. A line feed in a
role becomes ``<|n|>``, which no escaped text contains.

Turns are in order of (turn, role, text), null first, so ties and repeated rows have a defined place
and stay. A null text or role is empty; null conversation ids form one conversation. An empty text is
a turn with nothing to train on. A text may be as long as a string of Spark (2 GB with its block). Only the four named columns are read; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BLOCK = "<|im_start|>", "<|im_end|>\n", 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, block, formatted, replies (array of start and chars of the trainable spans in it)."""
    turns = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = turns.groupBy("conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), _escape_role(t.role), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct((t.role == "assistant").alias("reply"), head(t).alias("head"), escape(t.text).alias("body")))
    blocks = blocks.withColumn("parts", parts)
    none = F.array().cast("array<struct<start:int,chars:int>>")
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda s, p: F.struct(
            (s.at + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["reply"], F.array_append(s.spans, F.struct((s.at + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("chars")))).otherwise(s.spans).alias("spans"),
        ),
        lambda s: s.spans,
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return blocks.select("conv_id", "block", text.alias("formatted"), spans.alias("replies"))


def expand(formatted: DataFrame, rest: bool = False) -> DataFrame:
    """One example per assistant turn: conv_id, block, start (of the reply in the block), context (all that the conversation has
    before the reply), new_bytes (how much of its end no earlier example has, in UTF-8), context_chars, target_chars, target.
    With ``rest``, also a row without a target for what each block has after its last reply."""
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = formatted.withColumn("earlier", F.array_join(F.collect_list("formatted").over(earlier), "")).withColumn("block_start", F.length("earlier").cast("long"))
    end = lambda r: r["start"] + r["chars"]
    replies = F.transform("replies", lambda r, i: F.struct(r["start"].alias("start"), r["chars"].alias("chars"), F.coalesce(end(F.get("replies", i - 1)), F.lit(0)).alias("since")))
    if rest:
        last = F.struct(F.length("formatted").alias("start"), F.lit(None).cast("int").alias("chars"), F.coalesce(end(F.try_element_at("replies", F.lit(-1))), F.lit(0)).alias("since"))
        replies = F.array_append(replies, last)
    rows = rows.withColumn("r", F.explode(replies))
    context = F.concat("earlier", F.substring("formatted", F.lit(1), F.col("r.start")))
    new = F.octet_length(F.substring("formatted", F.col("r.since") + 1, F.col("r.start") - F.col("r.since")))
    target = F.when(F.col("r.chars").isNotNull(), F.substring("formatted", F.col("r.start") + 1, F.col("r.chars")))
    return rows.select("conv_id", "block", F.col("r.start").alias("start"), context.alias("context"), new.alias("new_bytes"), (F.col("block_start") + F.col("r.start")).alias("context_chars"), F.col("r.chars").alias("target_chars"), target.alias("target"))


def with_context(examples: DataFrame, formatted: DataFrame) -> DataFrame:
    """conv_id, context_chars, prompt, completion: the examples under the names of a trainer's columns."""
    return examples.where("target IS NOT NULL").select("conv_id", "context_chars", F.col("context").alias("prompt"), F.col("target").alias("completion"))


def _turns(text: Column) -> Column:
    parts = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: p != "")
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(parts, lambda p: F.struct(_unescape_role(F.substring(head(p), F.lit(len(START) + 1), F.length(p))).alias("role"), unescape(F.substring(p, F.length(head(p)) + 2, F.length(p))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, block, turns (array of role and text), parsed from the formatted text alone."""
    return formatted.select("conv_id", "block", _turns(F.col("formatted")).alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation: digests of the turns and of the trainable text, read from the examples. What each context adds to
    the one before, each target, and what follows the last one make the conversation again."""
    new = F.substring(F.col("context").cast("binary"), -F.col("new_bytes"), F.col("new_bytes")).cast("string")  # bytes are not counted through
    pieces = expand(formatted, rest=True).select("conv_id", F.struct("block", "start", F.coalesce("target_chars", F.lit(0)).alias("chars"), F.concat(new, F.coalesce("target", F.lit(""))).alias("piece")).alias("p"))
    made = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    loss = F.array_join(F.transform("ps", lambda p: unescape(F.right(p["piece"], p["chars"]))), "")
    made = made.select("conv_id", F.array_join("ps.piece", "").alias("text"), loss.alias("loss")).withColumn("turns", _turns(F.col("text")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))

r"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Template: "### {role}: {text}</turn>\n". Inside role and text a backslash becomes \\, a
number sign \#, "</" becomes <\/ (in a role also ":" becomes \:), so neither mark can
occur there, and dropping each backslash but keeping what follows undoes it.

Each assistant turn is an example of its own: its context is all of the conversation
before its text, and that text alone is trainable. As examples of one conversation share
their contexts, a segment is stored once, with its place in the conversation; an example
is the two spans [0, loss_start) and [loss_start, loss_start + loss_chars). That keeps the
output in proportion to the input, however long one conversation is; ``rendered`` gives
the examples' own texts.

Rows go by turn, then role and text; null turn first; null role or text counts as empty;
rows with a null conv_id form one conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
#: A formatted turn, with role and text as groups.
TURN = r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)</turn>\n$"


def escaped(c: Column, role: bool = False) -> Column:
    for a, b in [("\\", "\\\\"), ("#", "\\#"), ("</", "<\\/")] + [(":", "\\:")] * role:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), segment, seg_start, trainable, loss_start, loss_chars, example.

    Places count the characters of the conversation's formatted text from 0.
    """
    c = conversations
    rows = c.select("conv_id", "turn", F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit(SEP))
    rows = rows.select("conv_id", "turn", "role", "text", (F.col("role") == ASSISTANT).alias("trainable"), F.char_length(head).alias("head"), F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("segment"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "conv_id",
        F.row_number().over(w).alias("pos"),
        "segment",
        F.coalesce(F.sum(F.char_length("segment").cast("long")).over(before), F.lit(0)).alias("seg_start"),
        "trainable",
        "head",
        F.when(F.col("trainable"), F.count_if("trainable").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("example"),
    )
    loss = F.char_length("segment") - F.col("head") - len(CLOSE)
    return rows.select("conv_id", "pos", "segment", "seg_start", "trainable", F.when(F.col("trainable"), F.col("seg_start") + F.col("head")).alias("loss_start"), F.when(F.col("trainable"), loss.cast("long")).alias("loss_chars"), "example")


def expand_targets(turns: DataFrame) -> DataFrame:
    """An example for each assistant turn: its context's span, and its target's text as formatted."""
    target = F.substring("segment", F.col("loss_start") - F.col("seg_start") + 1, F.col("loss_chars").cast("int"))
    return turns.where("trainable").select("conv_id", "example", "pos", F.lit(0).cast("long").alias("context_start"), F.col("loss_start").alias("context_chars"), target.alias("target"))


def rendered(turns: DataFrame) -> DataFrame:
    """The examples as prompt and target texts. Grows with the square of a conversation's
    length, as any format with whole prompts does."""
    examples = expand_targets(turns)
    t = turns.select(F.col("conv_id").alias("of"), F.col("pos").alias("at"), "segment", F.col("seg_start").alias("seg"))
    both = examples.join(t, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("at") <= F.col("pos")))
    part = F.when(F.col("at") == F.col("pos"), F.substring("segment", F.lit(1), (F.col("context_chars") - F.col("seg")).cast("int"))).otherwise(F.col("segment"))
    parts = F.array_sort(F.collect_list(F.struct("at", part.alias("part"))))
    return both.groupBy("conv_id", "example").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("prompt"), F.first("target").alias("target"))


def digest(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted output: turns from their segments, loss
    text from the examples. An example counts (n_examples, context_chars) only if its context is
    all of the conversation's segments before its turn and that turn up to its text."""
    turns = format_turns(conversations)
    examples = expand_targets(turns).select(F.col("conv_id").alias("of"), F.col("pos").alias("at"), "context_start", "context_chars", "target")
    before = F.sum(F.char_length("segment").cast("long")).over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    head = F.char_length(F.regexp_extract("segment", TURN, 1)) + len(OPEN + SEP)
    placed = turns.select("conv_id", "pos", "segment", (F.coalesce(before, F.lit(0)) + head).alias("text_at"))
    both = placed.join(examples, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("at")), "left")
    good = F.coalesce((F.col("context_start") == 0) & (F.col("context_chars") == F.col("text_at")), F.lit(False))
    read = both.select(
        "conv_id",
        "pos",
        F.char_length("segment").cast("long").alias("chars"),
        F.concat(unescaped(F.regexp_extract("segment", TURN, 1)), F.lit("\n"), unescaped(F.regexp_extract("segment", TURN, 2)), F.lit("\n")).alias("turn"),
        F.when(good, unescaped(F.col("target"))).otherwise("").alias("loss"),
        F.when(good, F.col("context_chars")).alias("context"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "turn", "loss")))
    whole = read.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), ordered.alias("of"), F.sum(F.char_length("loss").cast("long")).alias("loss_chars"), F.sum("chars").alias("formatted_chars"),
        F.count("context").alias("n_examples"), F.coalesce(F.sum("context"), F.lit(0)).alias("context_chars"),
    )
    joined = lambda field: F.sha2(F.array_join(F.transform("of", lambda x: x[field]), "").cast("binary"), 256)
    return whole.select("conv_id", "n_turns", joined("turn").alias("turns_sha256"), "loss_chars", joined("loss").alias("loss_sha256"), "formatted_chars", "n_examples", "context_chars")

"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Each assistant turn becomes an example of its own: all turns before it as context, and its
text alone under the loss mask. Turns after the last assistant turn (or a conversation
without one) end in an example without loss, so that no turn is dropped.

Template of a turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles and texts ``%`` is
written ``%25`` and ``<|`` as ``%3C|``; roles also write a line feed as ``%0A``. The
template's marks can thus come from the template only, and the escapes can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("%0A"), F.lit("\n")), F.lit("%3C|"), F.lit("<|"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def expand_replies(conversations: DataFrame) -> DataFrame:
    """(conv_id, example_no, context, reply, closing, loss_start, loss_chars), one row for each assistant turn.

    The formatted example is ``context || reply || closing``; the loss mask is the
    ``loss_chars`` code points from ``loss_start`` (0-based), that is ``reply``. ``context``
    ends with the header of the reply's turn. The example without loss has a null reply and
    mask. Input columns: conv_id, turn, role, text; others are ignored. Null role or text:
    empty. Turns are ordered by turn (nulls first), then role and text; repeated rows stay.
    All rows with a null conv_id are one conversation; like any other it is held in one row, so
    give such rows ids first where they are many. Only the role ``assistant`` is trained on.
    """
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    by_conv = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = by_conv.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == "assistant").alias("target"),
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )
    last = F.size("turns") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("turns", i)["target"] | (i == last))
    each = turns.select("conv_id", "turns", F.posexplode(targets).alias("example_no", "at"))
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("at")), whole), "")
    own = F.get("turns", F.col("at"))
    made = each.select(
        "conv_id",
        "example_no",
        F.when(own["target"], F.concat(before, own["head"])).otherwise(F.concat(before, whole(own))).alias("context"),
        F.when(own["target"], own["body"]).alias("reply"),
        F.when(own["target"], F.lit(END)).otherwise(F.lit("")).alias("closing"),
    )
    return made.select("*", F.when(F.col("reply").isNotNull(), F.length("context")).cast("long").alias("loss_start"), F.length("reply").cast("long").alias("loss_chars"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from a formatted example."""
    cut = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(cut, F.lit(2), F.size(cut) - 1)
    head = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substring(x, F.length(head(x)) + 2, F.length(x) - F.length(head(x)) - 1 - len(END))
    return F.transform(parts, lambda x: F.struct(unescape(head(x)).alias("role"), unescape(body(x)).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted examples alone."""
    formatted = F.concat("context", F.coalesce("reply", F.lit("")), "closing")
    e = examples.select(
        "conv_id",
        "example_no",
        formatted.alias("formatted"),
        F.when(F.col("loss_start").isNotNull(), unescape(F.substring(formatted, F.col("loss_start") + 1, F.col("loss_chars")))).alias("loss"),
    )
    per = e.groupBy("conv_id").agg(
        F.max_by("formatted", "example_no").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example_no", "loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.count("*").cast("long").alias("n_examples"),
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    turns = read_turns(F.col("longest"))
    return per.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )

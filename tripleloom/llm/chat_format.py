r"""Operator 9, chat formatting: prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it are the context and only its own text is trainable. A
conversation whose last turn is another role's gets one more example without a trainable part, so that the output holds
every turn. Turns read `<|turn|>role<|text|>text<|end|>`. Inside roles and texts a backslash is doubled and every control
string gets one after its first character, so that none can stand there; dropping the backslash from every pair
`\x` undoes it.

Defined cases: null roles and texts are empty; turns order by turn (null first), then role, then text; repeated rows are
turns of their own; every row without a conversation id is a conversation of its own, told apart by `lone`, which is null
elsewhere. Other columns are ignored. Empty in, empty out. A conversation is one row while it is expanded, as each of its
examples must be one anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and other templates.
CONTROL = (TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand_prefixes(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_id, lone, example (from 0), n_context (turns), text, loss_start, loss_length (characters of text, from 0)."""
    one = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("lone"),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        ).alias("t"),
    )
    whole = one.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shown = whole.select(
        "conv_id",
        "lone",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"))).alias("turns"),
    )
    ends = F.filter(F.transform("turns", lambda t, i: F.when((t["role"] == "assistant") | (i == F.size("turns") - 1), i)), lambda i: i.isNotNull())
    each = shown.select("conv_id", "lone", "turns", F.posexplode(ends).alias("example", "last"))
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("last")), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    each = each.select("conv_id", "lone", "example", "last", F.col("turns")[F.col("last")].alias("t"), context.alias("context"))
    start = F.length("context") + F.length("t.head")
    return each.select(
        "conv_id",
        "lone",
        F.col("example").cast("long").alias("example"),
        F.col("last").cast("long").alias("n_context"),
        F.concat("context", "t.head", "t.body", F.lit(END)).alias("text"),
        start.cast("long").alias("loss_start"),
        F.when(F.col("t.role") == "assistant", F.length("t.body")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from the examples alone."""
    loss = unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    is_last = F.row_number().over(_by_size()) == 1
    each = examples.withColumn("is_last", is_last).select(
        "conv_id", "lone", F.length("text").cast("long").alias("chars"), F.struct("example", loss.alias("loss")).alias("l"), F.when(F.col("is_last"), F.col("text")).alias("all")
    )
    conv = each.groupBy("conv_id", "lone").agg(
        F.sum("chars").alias("formatted_chars"), F.max("all").alias("all"), F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["loss"]), "").alias("loss")
    )
    parts = F.filter(F.split("all", r"<\|turn\|>"), lambda p: p != "")
    turns = F.transform(
        parts,
        lambda p: F.struct(F.substring_index(p, TEXT, 1).alias("role"), F.regexp_extract(p, r"(?s)^.*?<\|text\|>(.*)<\|end\|>$", 1).alias("text")),
    )
    said = F.array_join(F.transform(turns, lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["text"]), F.lit("\n"))), "")
    return conv.select(
        "conv_id",
        F.size(parts).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _by_size():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id", "lone").orderBy(F.desc("example"))

r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is
trained on.  The template writes a turn as `### role: text</turn>` and a line break.  Inside texts and
roles a backslash is written `\e`, `</turn>` as `\l/turn>`, `### ` as `\h## `, and in roles a colon as
`\c`; reading reverses that exactly.  Turns after the last assistant turn go into one more example, which
has nothing to train on, so that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_END = "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for plain, coded in [("\\", "\\e"), ("</turn>", "\\l/turn>"), ("### ", "\\h## "), *[(":", "\\c")] * role]:
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    for coded, plain in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\e", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars, last): one row for each assistant turn.

    `loss_start` and `loss_chars` mark the trained code points of `text` (as escaped, without the end
    mark); `last` is the example that holds the whole conversation.  Turns are put in order by turn, then
    role and text; nulls come first and are written as empty.  Repeated rows are turns of their own.  A null
    conv_id is a conversation like any other, other columns play no part, an empty table gives no example.
    A conversation, like each example made of it, is one value and must fit a row.
    """
    said = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"))
    written = said.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": ")).alias("head"), escape(F.col("text")).alias("body"))
    whole = written.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("said"))
    count = F.size("said")
    targets = F.filter(F.sequence(F.lit(1), count), lambda i: (F.get(F.col("said"), i - 1)["role"] == ASSISTANT) | (i == count))
    one = whole.select("conv_id", "said", F.posexplode_outer(targets).alias("example", "upto"))
    target = F.get("said", F.col("upto") - 1)
    before = F.array_join(F.transform(F.slice("said", 1, F.col("upto") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(_END))), "")
    trained = target["role"] == ASSISTANT
    made = one.select("conv_id", "example", F.size("said").alias("n"), "upto", before.alias("before"), target.alias("target"), trained.alias("trained"))
    return made.select(
        "conv_id", "example",
        F.concat("before", "target.head", "target.body", F.lit(_END)).alias("text"),
        F.when(F.col("trained"), F.char_length("before") + F.char_length("target.head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.char_length("target.body")).otherwise(0).cast("long").alias("loss_chars"),
        F.col("trained").alias("trained"), (F.col("upto") == F.col("n")).alias("last"),
    )


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted example."""
    parts = F.slice(F.split(text, _END), 1, F.size(F.split(text, _END)) - 1)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, ": ", 1), 5, 1 << 30)).alias("role"),
        unescape(F.substring(p, F.char_length(F.substring_index(p, ": ", 1)) + 3, F.lit(1 << 30))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its examples say: turns, digests of turns and of trained text, lengths."""
    turns = read_turns(F.col("text"))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = formatted.select(
        "conv_id", "example", F.char_length("text").cast("long").alias("chars"),
        F.when(F.col("trained"), unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))).otherwise("").alias("loss"),
        F.when(F.col("last"), F.size(turns)).cast("long").alias("n_turns"), F.when(F.col("last"), F.sha2(spoken, 256)).alias("turns_sha256"))
    return rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")

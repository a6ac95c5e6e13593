"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its
context, and only that reply is under the loss mask. What follows the last
reply (or a conversation without any reply) makes one more example with an
empty mask, so no turn is lost.

Template, per turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. In role and text a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control
string; a line feed in a role becomes ``<\\n``. As a ``<`` that is followed by
exactly one backslash arises from no other text, undoing it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<|im_start|>"
END = "<|im_end|>\n"
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of turns -> (conv, example, n_turns, complete, formatted, loss_start, loss_length).

    ``formatted`` holds the turns 1..n_turns (all of them where complete); the
    code points from loss_start (0-based) on, loss_length of them, are trained on. Turns are ordered by
    turn, equal ones by role and text, null first; null roles and texts are
    empty. Rows with a null conversation are one conversation. A conversation is
    gathered in one row, as its examples need; nothing else is.
    """
    role = F.coalesce(turns[role_col].cast("string"), F.lit(""))
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    one = F.struct(turns[turn_col].alias("turn"), role.alias("role"), text.alias("text"))
    gathered = turns.select(turns[conv_col].alias("conv"), one.alias("one")).groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    formatted = gathered.select(
        "conv",
        F.transform("turns", lambda t: t["role"] == TRAINABLE).alias("trained"),
        F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: F.concat(escape(t["text"]))).alias("bodies"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("trained")), lambda i: F.element_at("trained", i) | (i == F.size("trained")))
    expanded = formatted.select("conv", "trained", "heads", "bodies", F.posexplode(ends).alias("example", "n_turns"))
    pieces = F.zip_with(
        F.slice("heads", F.lit(1), F.col("n_turns")),
        F.slice("bodies", F.lit(1), F.col("n_turns")),
        lambda head, body: F.concat(head, body, F.lit(END)),
    )
    expanded = expanded.withColumn("formatted", F.array_join(pieces, ""))
    masked = F.element_at("trained", F.col("n_turns"))
    length = F.length(F.element_at("bodies", F.col("n_turns")))
    return expanded.select(
        F.col("conv").alias(conv_col),
        "example",
        "n_turns",
        (F.col("n_turns") == F.size("trained")).alias("complete"),
        "formatted",
        F.when(masked, F.length("formatted") - len(END) - length).otherwise(F.length("formatted")).alias("loss_start"),
        F.when(masked, length).otherwise(0).alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text)."""
    parts = F.split(formatted, r"\Q" + START + r"\E", -1)

    def turn(part):
        head = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(head) + 2, F.length(part) - F.length(head) - 1 - len(END))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def digest_chat(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted examples say, read back from them: one row per conversation.

    The complete example holds all of a conversation; the mask of
    each example holds one reply. Examples of a conversation are already in one
    partition, so nothing is shuffled again.
    """
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    reply = unescape(F.substr(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    read = examples.select(
        conv_col,
        F.col("n_turns").cast("long").alias("n_turns"),
        F.when(F.col("complete"), F.sha2(F.array_join(turns, "").cast("binary"), 256)).alias("turns_sha256"),
        F.struct("example", reply.alias("reply")).alias("reply"),
        F.length("formatted").cast("long").alias("chars"),
    )
    replies = F.array_join(F.transform(F.sort_array(F.collect_list("reply")), lambda r: r["reply"]), "")
    return (
        read.groupBy(conv_col)
        .agg(
            F.max("n_turns").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            replies.alias("_wm_replies"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            conv_col,
            "n_turns",
            "turns_sha256",
            F.length("_wm_replies").cast("long").alias("loss_chars"),
            F.sha2(F.col("_wm_replies").cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


"""Chat formatting with Spark expressions only: sorted turn structs, same-role turns merged, one string a conversation.

A turn is ``<|im_start|>role \\n text <|im_end|> \\n``; adjacent turns of one role share a block, with ``<|im_sep|>`` between
their texts. Control strings inside roles and texts are broken by a backslash code, which ``unescape`` undoes.

Handling of odd input: a null text is empty and a null role is the empty role; a null conversation id is a conversation of
its own; ties on the turn go by role and text; repeated rows are repeated turns; very long texts and conversations are
formatted whole, in time linear in their length; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: First characters of what a chat template may treat as control, by what follows them.
_ANGLE = r"<(?=\|[A-Za-z0-9_]*\|>|/?s>|</?SYS>>)"
_SQUARE = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, r"\\1"), _SQUARE, r"\\2")


def unescape(text: Column) -> Column:
    for code, char in (("\\1", "<"), ("\\2", "["), ("\\3", "\n"), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Rows (id_col, formatted, segments): ``segments`` is the text again as array<struct<text, loss>>, ``loss`` the mask."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role = F.replace(escape(text(role_col)), F.lit("\n"), F.lit("\\3"))
    rows = turns.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), escape(text(text_col)).alias("text")).alias("t"))
    chats = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    roles = F.transform("ts", lambda t: t["role"])
    chats = chats.select("id", "ts", F.zip_with(roles, F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, 1, F.size("ts") - 1)), lambda own, last: own.eqNullSafe(last)).alias("goes_on"))
    head = lambda t, same, i: F.when(same, F.lit(SEP)).otherwise(F.concat(F.when(i > 0, END).otherwise(""), F.lit(START), t["role"], F.lit("\n")))
    pair = lambda x, i: F.array(F.struct(head(x["ts"], x["goes_on"], i).alias("text"), F.lit(0).alias("loss")), F.struct(x["ts"]["text"].alias("text"), (x["ts"]["role"] == loss_role).cast("int").alias("loss")))
    last = F.array(F.struct(F.lit(END).alias("text"), F.lit(0).alias("loss")))
    segments = F.concat(F.flatten(F.transform(F.arrays_zip("ts", "goes_on"), pair)), last)
    chats = chats.select("id", segments.alias("segments"))
    return chats.select(F.col("id").alias(id_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b, i: i > 0)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"] == 1), lambda s: unescape(s["text"])), "")

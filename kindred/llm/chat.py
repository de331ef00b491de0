"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn is a list of parts: text, image, audio or document. A visitor (one case a type, over the list) flattens the parts
into one text with a placeholder for each attachment, in order, and records the attachment's reference and how many
tokens its placeholder will expand to. A template then joins a conversation's turns, and can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template is <|turn|>role\\n<|body|>text<|end|> for each turn. In a role or text each control string has a
#: backslash before it, so "\\n<|body|>" and "<|end|><|turn|>" without one are the template's own.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Also escaped, so that no text can pose as another template's control string.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
CONTROL = "|".join(rf"\Q{c}\E" for c in (TURN, BODY, END, *PLACEHOLDERS.values(), *FOREIGN))

PART = "struct<type:string,text:string,ref:string,units:long>"
#: Tokens for a unit of an attachment: an image tile, a second of audio, a page.
TOKENS_A_UNIT = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    r"""``text`` with one backslash more before each control string (and the backslashes that precede it already)."""
    return F.regexp_replace(text, F.lit(rf"(\\*)({CONTROL})"), F.lit(r"\\$1$2"))


def unescape(text: Column) -> Column:
    r"""The inverse of ``escape``: one backslash less before each control string."""
    return F.regexp_replace(text, F.lit(rf"\\(\\*)({CONTROL})"), F.lit("$1$2"))


def visit(part: Column) -> Column:
    """A part as ``(text, type, ref, tokens)``: escaped text, or a placeholder with the attachment's figures.

    A part of unknown type is text; a null text is empty, and units below 1 or null count as 1.
    """
    attached = part["type"].isin(*PLACEHOLDERS)
    text = F.when(~attached | part["type"].isNull(), escape(F.coalesce(part["text"], F.lit(""))))
    tokens = F.lit(None).cast("long")
    for kind, mark in PLACEHOLDERS.items():
        text = F.when(part["type"] == kind, F.lit(mark)).otherwise(text)
        tokens = F.when(part["type"] == kind, TOKENS_A_UNIT[kind] * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))).otherwise(tokens)
    return F.struct(text.alias("text"), F.when(attached, part["type"]).alias("type"), F.when(attached, part["ref"]).alias("ref"), tokens.alias("tokens"))


def flatten(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, body, attachments)`` for rows ``(conv_id, turn, role, parts)``.

    ``attachments`` lists ``(type, ref, tokens)`` in the order of the body's placeholders. A null list is no parts.
    """
    seen = F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visit)
    return turns.select("conv_id", "turn", "role", seen.alias("seen")).select(
        "conv_id",
        "turn",
        "role",
        F.array_join(F.transform("seen", lambda s: s["text"]), "").alias("body"),
        F.transform(F.filter("seen", lambda s: s["type"].isNotNull()), lambda s: F.struct(s["type"].alias("type"), s["ref"].alias("ref"), s["tokens"].alias("tokens"))).alias("attachments"),
    )


def of_text(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as turns of one text part each."""
    part = F.struct(F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return rows.select("conv_id", "turn", "role", F.array(part.cast(PART)).alias("parts"))


def formatted(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, attachments)``: each conversation as one string, turns in order.

    Turns with one number are ordered by role, then body; a null number comes first. A null role is empty. Rows with a
    null conv_id make up a conversation. A conversation is one row of output, so its turns meet in one task.
    """
    turn = F.struct(
        "turn", "role", "body", F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit("\n" + BODY), F.col("body"), F.lit(END)).alias("string"), "attachments"
    )
    every = F.array_sort(F.collect_list(turn))
    return (
        flatten(turns)
        .groupBy("conv_id")
        .agg(every.alias("turns"))
        .select("conv_id", F.array_join(F.col("turns.string"), "").alias("formatted"), F.flatten(F.col("turns.attachments")).alias("attachments"))
    )


def read_back(column: str = "formatted") -> Column:
    """The ``(role, text)`` list that a formatted string holds; placeholders of attachments stay in the text."""
    inner = F.substring(F.col(column), F.lit(len(TURN) + 1), F.length(column) - len(TURN) - len(END))
    return F.transform(F.split(inner, rf"\Q{END}{TURN}\E"), _turn)


def _turn(string: Column) -> Column:
    halves = F.split(string, rf"\n\Q{BODY}\E", 2)
    return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))


def digest(formatted_rows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, attachment_tokens)``,
    read back from ``formatted``; the last two are how many placeholders there are and how many tokens they expand to.

    The loss mask covers the text of assistant turns, once each and in order.
    """
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"])
    rows = formatted_rows.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), tokens.alias("attachment_tokens"), read_back().alias("turns")
    )
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return rows.select("conv_id", "formatted_chars", "n_attachments", "attachment_tokens", F.size("turns").cast("long").alias("n_turns"), every.alias("every"), loss.alias("loss")).select(
        "conv_id",
        "n_turns",
        F.sha2("every", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_attachments",
        "attachment_tokens",
    )

"""Chat formatting: a finite-state machine over roles, a declarative template, text segments with loss flags.

Template: each turn is ``### Role: `` + text + ``</turn>``. Inside texts and roles a backslash and the control strings
are escaped, so what a text says can never be taken for a mark, and unescape() gives the text back.
Everything here is built from SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """The marks of a turn, their escapes, who is trained on, and the machine's moves."""

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>"
    # In this order when escaping and in the opposite order when reading; the backslash comes first.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
    role_escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), (":", "\\c"))
    loss_roles: tuple[str, ...] = ("assistant",)
    # State before -> roles that may follow; the state is the last role, "" at the start. Valid ends are in ends.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escape(text: Column, escapes: tuple[tuple[str, str], ...] = CHAT.escapes) -> Column:
    for control, safe in escapes:
        text = F.replace(text, F.lit(control), F.lit(safe))
    return text


def unescape(text: Column, escapes: tuple[tuple[str, str], ...] = CHAT.escapes) -> Column:
    for control, safe in reversed(escapes):
        text = F.replace(text, F.lit(safe), F.lit(control))
    return text


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (array of text, loss), valid.

    Rows go by turn; a null turn comes first, ties go by role and text. Null roles and texts are empty. The segments
    joined are the formatted text. valid is the machine's verdict; a conversation that it does not accept is formatted
    all the same. A null conv_id is a conversation of its own. Other columns are ignored; no rows give no rows.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.open), escape(t["role"], template.role_escapes), F.lit(template.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template.escapes).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    def step(state: Column, t: Column) -> Column:
        # "!" is the machine's trap: nothing leaves it.
        out = F.lit("!")
        for was, roles in template.moves.items():
            out = F.when((state == was) & t["role"].isin(*roles), t["role"]).otherwise(out)
        return out

    chats = chats.withColumn("segments", F.flatten(F.transform("turns", segments)))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.aggregate("turns", F.lit(""), step, lambda s: s.isin(*template.ends)).alias("valid"),
    )


def read_chats(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Read conversations back from the formatted text alone: conv_id, turns (array of role, text, loss text), formatted."""
    parts = F.split("formatted", f"\\Q{template.close}\\E")
    turns = F.transform(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(template.open) + 1)), template.after_role[0], 1), template.role_escapes).alias("role"),
            unescape(F.substr(p, F.instr(p, template.after_role) + len(template.after_role)), template.escapes).alias("text"),
        ),
    )
    return formatted.withColumn("turns", turns)


def summary(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Digests of what the formatted texts and their loss flags give back."""
    back = read_chats(formatted, template)
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template.escapes)), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )

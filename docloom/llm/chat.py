"""Operator 1: chat formatting, in DataFrame functions only.

A declarative template names the strings around a turn, which roles are trained
on, and the moves of a finite-state machine over roles. A conversation becomes
text segments, each with a loss flag; control strings inside texts are escaped,
reversibly, so that turns can be read back from the formatted text.

A conversation is one row of the result, so its turns are gathered in one place;
its size is that of one string. Conversations are spread by their number.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Strings around a turn: open + role + head, the text, close. open and close begin with `<` and hold it nowhere else."""

    open: str = "<turn "
    head: str = ">\n"
    close: str = "</turn>\n"
    mark: str = "</turn>"  # of the close: what a text mustn't hold
    trained: frozenset[str] = frozenset(["assistant"])
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "tool"): "tool",
            ("tool", "assistant"): "assistant",
        }
    )
    accepting: frozenset[str] = frozenset(["assistant"])


TEMPLATE = Template()


def _escaped(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(template.open), F.lit("\\o"))
    return F.replace(out, F.lit(template.mark), F.lit("\\c"))


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column, template: Template = TEMPLATE) -> Column:
    """The text before it was escaped: pieces between doubled backslashes hold the other marks whole."""

    def piece(x: Column) -> Column:
        for mark, meaning in (("\\o", template.open), ("\\c", template.mark), ("\\l", "<"), ("\\g", ">")):
            x = F.replace(x, F.lit(mark), F.lit(meaning))
        return x

    whole = F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, segments, formatted, end_state, valid) for each conversation (conv_id, turn, role, text).

    Rows are ordered by turn, then role and text; null sorts first, and null role
    and text count as empty. Rows with a null conv_id are one conversation.
    segments: (text, loss) in order, loss only on the texts of trained roles;
    formatted joins them. valid: the machine ends in an accepting state; an
    order that it doesn't know leads to `invalid`, and is formatted all the same.
    Repeated rows are turns each. A conversation's formatted text is one string,
    so it can't be longer than one can be. An empty table gives an empty result.
    Other columns are ignored.
    """
    moves = F.create_map(*chain.from_iterable((F.lit(f"{a}\x00{r}"), F.lit(b)) for (a, r), b in template.moves.items()))
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))

    def segments(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(template.open), _escaped_role(t["role"]), F.lit(template.head)), F.lit(False)),
            piece(_escaped(t["text"], template), t["role"].isin(*sorted(template.trained))),
            piece(F.lit(template.close), F.lit(False)),
        )

    gathered = conversations.groupBy("conv_id").agg(turns.alias("turns"))
    step = lambda state, t: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\x00"), t["role"])), F.lit("invalid"))
    done = gathered.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), F.aggregate("turns", F.lit(template.start), step).alias("end_state"))
    return done.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "end_state", F.col("end_state").isin(*sorted(template.accepting)).alias("valid"))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """Array of (role, text) from a formatted conversation."""
    parts = F.split(formatted, template.close.replace("\n", "\\n"))
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(x: Column) -> Column:
        inner = F.substr(x, F.lit(len(template.open) + 1))
        at = F.instr(inner, template.head)
        return F.struct(unescaped(F.substr(inner, F.lit(1), at - 1), template).alias("role"), unescaped(F.substr(inner, at + len(template.head)), template).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")

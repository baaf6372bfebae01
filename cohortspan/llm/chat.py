"""Chat formatting from a declarative template, in DataFrame operations only.

A template names the control strings around each turn, what replaces them inside
texts, the moves between roles and the roles that are learned. A conversation's
turns pass through the template's finite-state machine and become segments, each
with a loss flag: header, text and footer of every turn. The formatted text is
all segments in a row; it can be read back, as no text holds a control string.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How conversations are written.

    ``escapes`` are applied to texts from first to last and undone from last to
    first. The first one frees the escape character itself; every replacement
    begins with it, so what an escape puts in cannot be mistaken for another.
    """

    before_role: str = "### "
    after_role: str = ": "
    after_text: str = " </turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"))
    role_escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"), (": ", "\\c"))
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    ends: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def escape(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), escapes, text)


def unescape(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[1]), F.lit(pair[0])), escapes[::-1], text)


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per conversation with its ``turns`` in order, NULL role or text as empty."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _state_after(turns: Column, template: Template) -> Column:
    """State of the machine after all turns; NULL once a move is not allowed."""
    moves = F.create_map(
        *[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)]
    )
    step = lambda state, t: F.try_element_at(moves, F.concat(state, F.lit("\n"), t["role"]))
    return F.aggregate(turns, F.lit(template.start), step)


def _segments(turns: Column, template: Template) -> Column:
    def of(turn: Column) -> Column:
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        header = F.concat(
            F.lit(template.before_role), escape(turn["role"], template.role_escapes), F.lit(template.after_role)
        )
        return F.array(
            segment(header, F.lit(False)),
            segment(escape(turn["text"], template.escapes), turn["role"].isin(*template.learned)),
            segment(F.lit(template.after_text), F.lit(False)),
        )

    return F.flatten(F.transform(turns, of))


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss), ``formatted`` and ``valid``.

    ``valid`` says whether the roles obey the template's moves and stop in one of
    its ends; conversations that do not are formatted all the same. Turns are
    ordered by number, then role and text, so ties and repeated rows have one
    order; a missing number comes first. A NULL conv_id is one conversation, NULL
    texts and roles are empty, an empty table gives no rows, and other columns
    are not looked at. A conversation is one document, so its rows meet in one
    task; its texts travel once.
    """
    state = F.coalesce(_state_after(F.col("turns"), template), F.lit(""))
    return (
        turns_of(conversations)
        .select("conv_id", _segments(F.col("turns"), template).alias("segments"), state.isin(*template.ends).alias("valid"))
        .select(
            "conv_id", "segments", "valid",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted conversation."""
    ended = F.split(formatted, r"\Q" + template.after_text + r"\E")
    parts = F.slice(ended, F.lit(1), F.size(ended) - 1)

    def turn(part: Column) -> Column:
        cut = F.instr(part, template.after_role)
        first = len(template.before_role)
        return F.struct(
            unescape(F.substring(part, F.lit(first + 1), cut - first - 1), template.role_escapes).alias("role"),
            unescape(F.substring(part, cut + len(template.after_role), F.length(part)), template.escapes).alias("text"),
        )

    return F.transform(parts, turn)


def learned_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, as it was before formatting."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"], template.escapes)), "")

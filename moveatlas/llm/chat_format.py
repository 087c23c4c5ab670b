"""Chat formatting: a role state machine and reversible, loss-flagged segments.

A declarative template names the control strings, the roles whose text is trained
on and the allowed order of roles. Every conversation becomes one row: its
formatted text, the segments it consists of with a loss flag each, and the verdict
of the state machine. Texts are escaped so that no control string can occur inside
them, and ``parse_turns`` gets the original turns back.

Defined cases: a null text or role is empty; turns are ordered by turn, role and
text, null turns first; repeated rows are repeated turns; a null conversation id is
a conversation of its own; a role the template does not know is formatted and makes
the conversation invalid. One conversation is one training example and has to fit
in a row; hot first turns or equal conversations stay apart under their ids.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas.llm.text import present

BEGIN = "(begin)"


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings (all ``<|name|>``), trained roles and allowed role order."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            BEGIN: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    last: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for control in (self.start, self.end):
            if not re.fullmatch(r"<\|\w+\|>", control):
                raise ValueError(f"control strings look like <|name|>, not {control!r}")
        if self.start == self.end:
            raise ValueError("start and end have to differ")


def escape(text: Column) -> Column:
    """Break every control opening: one backslash more between ``<`` and ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    one_line = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return escape(one_line)


def _unescape_role(role: Column) -> Column:
    plain = unescape(role)
    return F.replace(F.replace(plain, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _verdict(turns: Column, template: ChatTemplate) -> Column:
    """Run the state machine: number of turns read before the first error, or null."""
    moves = [
        F.lit(f"{state}\n{role}") for state, roles in template.follows.items() for role in roles
    ]
    allowed = F.array(*moves)
    begin = F.struct(F.lit(BEGIN).alias("state"), F.lit(0).alias("read"), F.lit(True).alias("ok"))

    def step(at: Column, turn: Column) -> Column:
        ok = at["ok"] & F.array_contains(allowed, F.concat(at["state"], F.lit("\n"), turn["role"]))
        return F.struct(
            turn["role"].alias("state"),
            (at["read"] + ok.cast("int")).alias("read"),
            ok.alias("ok"),
        )

    def finish(at: Column) -> Column:
        return F.when(~(at["ok"] & at["state"].isin(*template.last)), at["read"])

    return F.aggregate(turns, begin, step, finish)


def format_chats(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``formatted``, ``segments`` (text, loss) and
    ``first_error``, the number of turns before the order breaks (null when valid)."""
    template = template or ChatTemplate()
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            present(F.col(role)).alias("role"),
            present(F.col(text)).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments_of(t: Column) -> Column:
        def part(value: Column, loss: Column) -> Column:
            return F.struct(value.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(template.start), _escape_role(t["role"]), F.lit("\n"))
        return F.array(
            part(head, F.lit(False)),
            part(escape(t["text"]), t["role"].isin(*template.loss_roles)),
            part(F.lit(template.end + "\n"), F.lit(False)),
        )

    made = grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", segments_of)).alias("segments"),
        _verdict(F.col("turns"), template).alias("first_error"),
    )
    return made.withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def parse_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) read back from a formatted text."""
    template = template or ChatTemplate()
    pieces = F.filter(F.split(formatted, re.escape(template.start)), lambda p: p != "")

    def turn_of(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(head) + 2)
        return F.struct(
            _unescape_role(head).alias("role"),
            unescape(F.substring_index(body, template.end, 1)).alias("text"),
        )

    return F.transform(pieces, turn_of)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    flagged = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(flagged, lambda s: unescape(s["text"])), "")


def chat_digest(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the output."""
    read = formatted.select(
        "conv_id",
        "formatted",
        "first_error",
        parse_turns(F.col("formatted"), template).alias("turns"),
        loss_text(F.col("segments")).alias("loss"),
    )
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("first_error").isNull().alias("valid"),
    )

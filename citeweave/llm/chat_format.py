"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names the states and transitions of the machine, the strings that mark a
turn, and the roles under the loss. ``format_conversations`` walks the machine over the
ordered turns of a conversation and emits text segments, each with a loss flag; texts are
escaped, by rules derived from the template, so that no control string can occur inside one. ``read_back`` undoes it. Everything
is a DataFrame expression: no Python runs on the executors.

Rows may come in any order. Null text counts as empty and a null role as the empty role;
both are formatted. Rows that repeat a turn number stay, ordered by role, then text. A
conversation that breaks the machine's rules is still formatted whole, with ``valid`` false
and the first offending position in ``error_at``. Rows with a null conversation id form one
conversation. An empty table gives an empty result. Other input columns are ignored.
A conversation becomes one row, since its digests are over its whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters that may stand in a URL-encoded role.
_ROLE_CHARS = re.compile(r"[A-Za-z0-9.*_+%-]")


@dataclass(frozen=True)
class ChatTemplate:
    """``{role}`` in ``opening`` takes the URL-encoded role, which cannot hold a control string.

    The control strings are what stands before the role, and ``closing``. A template is refused
    if turns could not be told apart in its output.
    """

    opening: str = "### {role}: "
    closing: str = "</turn>\n"
    start: str = "start"
    #: state -> roles that may follow; the state after a role is the role.
    transitions: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepting: tuple = ("user", "assistant")
    loss_roles: tuple = ("assistant",)

    def __post_init__(self):
        if self.opening.count("{role}") != 1:
            raise ValueError("opening needs {role} once")
        after = self.opening.split("{role}")[1]
        if not after or _ROLE_CHARS.match(after):
            raise ValueError("what follows {role} must begin with a character that no encoded role holds")
        if any(len(c) < 2 for c in self.controls):
            raise ValueError("control strings need two characters")
        if any(self.closing.startswith(self.closing[k:]) for k in range(1, len(self.closing))):
            raise ValueError("closing must not overlap itself")

    @property
    def controls(self) -> tuple[str, ...]:
        """What no formatted text may hold: without white space around, if anything is left."""
        before = self.opening.split("{role}")[0]
        return tuple(c.strip() or c for c in (before, self.closing) if c or c is self.closing)

    @property
    def mark(self) -> str:
        """The escape character: one that no control string holds."""
        return next(c for c in "\\~^`\x1b\x1a\x10" if not any(c in x for x in (*self.controls, self.closing)))


def _literal(text: str) -> str:
    """``text`` as a regular expression of the JVM."""
    return re.sub(r"([^A-Za-z0-9\s])", r"\\\1", text)


def escape(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    r"""Double each mark, then put one behind the first character of each control string: ``#\##``, ``<\/turn>``."""
    mark = template.mark
    text = F.replace(text, F.lit(mark), F.lit(mark * 2))
    for control in template.controls:
        text = F.regexp_replace(text, f"{_literal(control[0])}(?={_literal(control[1:])})", (_literal(control[0]) if control[0] in "\\$" else control[0]) + _literal(mark))
    return text


def unescape(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    return F.regexp_replace(text, f"(?s){_literal(template.mark)}(.)", "$1")


def _turns(conversations: DataFrame) -> DataFrame:
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _walk(roles: Column, template: ChatTemplate) -> Column:
    """Position (from 1) of the first turn that the machine rejects; 0 if it accepts all."""
    allowed = F.create_map(*[x for state, roles_ in template.transitions.items() for x in (F.lit(state), F.array(*map(F.lit, roles_)))])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(0).alias("error_at"))

    def step(acc: Column, role: Column) -> Column:
        at = acc["at"] + 1
        fits = F.coalesce(F.array_contains(F.try_element_at(allowed, acc["state"]), role), F.lit(False))
        return F.struct(role.alias("state"), at.alias("at"), F.when(acc["error_at"] > 0, acc["error_at"]).when(fits, F.lit(0)).otherwise(at).alias("error_at"))

    def finish(acc: Column) -> Column:
        ends = acc["state"].isin(*template.accepting)
        return F.when(acc["error_at"] > 0, acc["error_at"]).when(ends, F.lit(0)).otherwise(acc["at"] + 1)

    return F.aggregate(roles, begin, step, finish)


def format_conversations(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, valid, error_at, segments array<struct<text, loss>>; the segments joined are the formatted text."""
    before, after = template.opening.split("{role}")

    def segments(turn: Column) -> Column:
        marked = F.concat(F.lit(before), F.url_encode(turn["role"]), F.lit(after))
        return F.array(
            F.struct(marked.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"], template).alias("text"), turn["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
        )

    turns = _turns(conversations)
    error_at = _walk(F.transform("turns", lambda t: t["role"]), template)
    return turns.select(
        "conv_id",
        error_at.alias("error_at"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).select("conv_id", (F.col("error_at") == 0).alias("valid"), "error_at", "segments")


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, formatted, turns array<struct<role, text>> parsed from the formatted text, loss_text from the flags."""
    before, after = template.opening.split("{role}")

    joined = formatted.select("conv_id", "valid", "error_at", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    parts = F.split(F.col("formatted"), F.lit(_literal(template.closing)), -1)
    body = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        at = F.instr(part, F.lit(after))
        role = F.url_decode(F.substring(part, F.lit(len(before) + 1), at - len(before) - 1))
        text = F.substring(part, at + len(after), F.length(part))
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    return joined.select("conv_id", "valid", "error_at", "formatted", F.transform(body, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digests(read: DataFrame) -> DataFrame:
    """What the contract asks of a formatted conversation, from what was read back."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "error_at",
    )

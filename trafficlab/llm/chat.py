"""Chat formatting: a role state machine and a declarative template.

Each conversation becomes an ordered array of segments (text, loss flag); the
formatted conversation is their concatenation.  The template gives each role's
opening marker and loss flag, the closing marker, and the allowed transitions.
The machine walks the roles from ``start``; a conversation is valid when every
transition is allowed and the last state is final.  Invalid conversations are
formatted too and marked.  DataFrame operations only.

Escaping is reversible: the escape character and the first character of every
control string are replaced by the escape character and a letter, so an
escaped text cannot contain a control string, whatever it says.

Cases: turns are ordered by turn (nulls first), role and text, so ties and
repeated rows have a defined order; a null text is empty; an unknown or null
role gets the ``other`` marker, which carries its UTF-8 bytes in hex, and makes
the conversation invalid; a null conv_id is a conversation of its own; an
empty table gives no rows; extra columns are ignored.  A conversation is one
output row by definition, so it must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TEMPLATE = {
    "roles": {
        "system": {"label": "System", "loss": False},
        "user": {"label": "User", "loss": False},
        "assistant": {"label": "Assistant", "loss": True},
    },
    "other": "Other",
    "open": "### {label}: ",
    "close": "</turn>\n",
    "transitions": {
        "start": ["system", "user"],
        "system": ["user"],
        "user": ["assistant"],
        "assistant": ["user"],
    },
    "final": ["assistant"],
}
ESCAPE = "\\"


def _codes(template: dict) -> list[tuple[str, str]]:
    """Characters that are escaped, each with its letter; the escape character first."""
    heads = sorted({template["open"][0], template["close"][0]} - {ESCAPE})
    return [(c, "abcdefgh"[i]) for i, c in enumerate([ESCAPE, *heads])]


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    for c, letter in _codes(template):
        text = F.replace(text, F.lit(c), F.lit(ESCAPE + letter))
    return text


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    for c, letter in reversed(_codes(template)):
        text = F.replace(text, F.lit(ESCAPE + letter), F.lit(c))
    return text


def _case(value: Column, mapping: dict, default: Column) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(default)


def format_conversations(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<text, loss>>, n_turns, valid."""
    roles = template["roles"]
    before, after = template["open"].split("{label}")

    def segments(t: Column) -> Column:
        other = F.concat(F.lit(template["other"] + " "), F.coalesce(F.lower(F.hex(t["role"].cast("binary"))), F.lit("-")))
        label = _case(t["role"], {k: F.lit(v["label"]) for k, v in roles.items()}, other)
        loss = _case(t["role"], {k: F.lit(v["loss"]) for k, v in roles.items()}, F.lit(False))
        return F.array(
            F.struct(F.concat(F.lit(before), label, F.lit(after)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(F.coalesce(t["text"], F.lit("")), template).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template["close"]).alias("text"), F.lit(False).alias("loss")),
        )

    allowed = [f"{a}>{b}" for a, bs in template["transitions"].items() for b in bs]

    def step(state: Column, t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        return F.when(F.concat(state, F.lit(">"), role).isin(allowed), role).otherwise(F.lit("invalid"))

    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return (
        rows.groupBy("conv_id").agg(turns.alias("turns"))
        .select(
            "conv_id",
            F.flatten(F.transform("turns", segments)).alias("segments"),
            F.size("turns").cast("long").alias("n_turns"),
            F.aggregate("turns", F.lit("start"), step).isin(template["final"]).alias("valid"),
        )
    )


def formatted(segments: str | Column = "segments") -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: dict = TEMPLATE) -> Column:
    """Turns array<struct<role, text>> parsed from a formatted conversation."""
    before, after = template["open"].split("{label}")
    parts = F.filter(F.split(text, f"\\Q{template['close']}\\E", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        rest = F.substring(p, F.lit(len(before) + 1), F.length(p))
        at = F.instr(rest, after)
        label = F.substring(rest, F.lit(1), at - 1)
        code = F.substring(label, F.lit(len(template["other"]) + 2), F.length(label))
        other = F.when(code == "-", F.lit(None)).otherwise(F.decode(F.unhex(code), "UTF-8"))
        role = _case(label, {v["label"]: F.lit(k) for k, v in template["roles"].items()}, other)
        body = F.substring(rest, at + len(after), F.length(rest))
        return F.struct(role.alias("role"), unescape(body, template).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: str | Column = "segments", template: dict = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")

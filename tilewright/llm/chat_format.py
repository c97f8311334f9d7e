"""Chat formatting from a declarative template, with a state machine over roles and loss flags per segment.

Control strings begin with `<|`. Inside roles and texts a backslash becomes
two and `<|` becomes `<\\|` (in roles, a newline becomes `<\\n>`), so no text
can hold a control string, and `unescape` gives the text back: a backslash of
the text always has a twin, so `<\\|` with a single one is only ever an escape.
Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    turn: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    #: state -> roles that may follow; each role is the next state.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("<\\n>"), F.lit("\n")))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, formatted, segments, valid), a row per conversation.

    segments are array<struct<role, text, loss>> in order; their texts joined
    are `formatted`. valid: the roles are a path of the template's machine from
    its start to a final state; a conversation that isn't is formatted all the
    same. Rows go by turn (null first), then role and text, so repeated turns
    have a fixed order; null roles and texts are empty; rows with null conv_id
    are one conversation. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    loss = role.isin(*template.loss_roles)
    row = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("plain"), escape_role(role).alias("r"), escape(text).alias("t"), loss.alias("loss"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def segment(role: Column, text: Column, loss: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"), loss.alias("loss"))

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(template.turn), t["r"], F.lit(template.role_end))
        return F.array(segment(t["role"], head, F.lit(False)), segment(t["role"], t["t"], t["loss"]), segment(t["role"], F.lit(template.turn_end), F.lit(False)))

    segments = F.flatten(F.transform("rows", parts))
    arrows = [x for state, roles in template.moves.items() for r in roles for x in (F.lit(f"{state}\n{r}"), F.lit(r))]
    machine = F.create_map(*arrows)
    end = F.aggregate(F.transform("rows", lambda t: t["role"]), F.lit(template.start), lambda s, r: F.coalesce(F.element_at(machine, F.concat(s, F.lit("\n"), r)), F.lit("")))
    return chats.select("conv_id", segments.alias("segments"), end.isin(*template.final).alias("valid")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def parse_chats(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read from a formatted conversation."""
    pieces = F.filter(F.split(formatted, _quoted(template.turn)), lambda x, i: i > 0)
    size = len(template.turn_end)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, template.role_end, 1)
        begin = F.length(role) + len(template.role_end)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(p, begin + 1, F.length(p) - begin - size)).alias("text"))

    return F.transform(pieces, turn)


def _quoted(x: str) -> str:
    return "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def chat_digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, segments, valid) -> (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid), read back from the formatted text and the segments."""
    read = chats.select("conv_id", "formatted", "valid", parse_chats(F.col("formatted"), template).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("learnt"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )

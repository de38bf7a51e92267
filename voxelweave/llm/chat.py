"""Chat formatting from a declarative template, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a conversation is written.

    A turn is ``open`` role ``close`` text ``end``. Characters that could form
    a mark are escaped in roles and texts, so ``</s>`` or ``[INST]`` in a text
    stay text and come back when read. Texts of ``loss`` roles are trained on.
    ``allowed`` holds the transitions of the turn machine, whose states are
    the roles and "" at the start; ``ends`` the states it may stop in.
    """

    open: str = "<|"
    close: str = "|>\n"
    end: str = "</s>\n"
    loss: tuple[str, ...] = ("assistant",)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    #: The first pair is undone last.
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("|", "&vert;"))


CHAT = Template()


def escaped(text: Column, t: Template = CHAT) -> Column:
    for a, b in t.escapes:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column, t: Template = CHAT) -> Column:
    for a, b in reversed(t.escapes):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def format_conversations(turns: DataFrame, t: Template = CHAT) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``(conv_id, segments, valid, bad_turn)``.

    ``segments``: array of (text, loss) in order of turn (null last; ties by
    role and text); joined they are the formatted conversation, and the
    segments with ``loss`` are the escaped texts of ``t.loss`` roles. Null role
    or text counts as empty; rows with a null conv_id are one conversation; repeated
    rows are turns of their own; no rows give no rows; other columns are ignored.
    ``valid``: the machine of ``t.allowed`` and ``t.ends`` accepts the roles.
    ``bad_turn``: the place, from 0, of the first turn that it refuses; the number of
    turns if it stops in a state that is no end; null if valid. Conversations that it
    refuses are formatted all the same. A conversation becomes one row, so
    it must fit one; nothing else is gathered.
    """
    order = F.struct(F.col("turn").isNull().alias("n"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = turns.select("conv_id", order.alias("o")).groupBy("conv_id").agg(F.array_sort(F.collect_list("o")).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                part(F.concat(F.lit(t.open), escaped(x["role"], t), F.lit(t.close)), no),
                part(escaped(x["text"], t), x["role"].isin(*t.loss)),
                part(F.lit(t.end), no),
            ),
        )
    )
    # the machine: one state after the other; where a step is refused, its place stays
    steps = sorted(f"{x}\n{y}" for x, then in t.allowed.items() for y in then)
    start = F.struct(F.lit("").alias("state"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("bad"))

    def step(m: Column, turn: Column) -> Column:
        may = F.concat(m["state"], F.lit("\n"), turn["role"]).isin(*steps)
        return F.struct(turn["role"].alias("state"), (m["at"] + 1).alias("at"), F.coalesce(m["bad"], F.when(~may, m["at"])).alias("bad"))

    bad = F.aggregate("turns", start, step, lambda m: F.coalesce(m["bad"], F.when(~m["state"].isin(*t.ends), m["at"])))
    return conv.select("conv_id", pieces.alias("segments"), bad.alias("bad_turn")).select("conv_id", "segments", F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def read_back(formatted: DataFrame, t: Template = CHAT) -> DataFrame:
    """``(conv_id, segments, ...)`` -> ``(conv_id, turns, loss_text, formatted, ...)``, parsed from the output; other columns stay."""
    more = [c for c in formatted.columns if c not in ("conv_id", "segments")]
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    split_at = lambda text, mark: F.split(text, "\\Q" + mark + "\\E", -1)
    one = formatted.select("conv_id", *more, whole.alias("formatted"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "").alias("loss_text"))
    turns = F.filter(split_at(F.col("formatted"), t.end), lambda x: F.length(x) > 0)
    parsed = F.transform(
        turns,
        lambda x: F.struct(
            unescaped(F.substr(F.split_part(x, F.lit(t.close), F.lit(1)), F.lit(len(t.open) + 1)), t).alias("role"),
            unescaped(F.substr(x, F.instr(x, t.close) + F.lit(len(t.close))), t).alias("text"),
        ),
    )
    return one.select("conv_id", parsed.alias("turns"), "loss_text", "formatted", *more)


def chat_digests(turns: DataFrame, t: Template = CHAT) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, bad_turn."""
    back = read_back(format_conversations(turns, t), t)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )

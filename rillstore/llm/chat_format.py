"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A template gives each role the strings before and after its text and whether its text is trained on, and the machine's
transitions (state, role) -> state. Control strings are escaped inside texts: the mark stands after their first
character, and the mark itself is doubled, so that texts come back exactly. All of it is DataFrame functions.

A conversation is one output row by its contract (its digests run over all turns), so one conversation's turns meet in
one row; rows are dealt by conv_id and a conversation must fit in Spark's 2 GB limit of an array.

Cases: null text is empty; a null role is a role of its own, like any role that the template does not list: written by
the template's fallback, which carries the escaped name, and an invalid turn for the machine. Turns are ordered by
(turn, role, text), nulls first; repeated rows are turns of their own. A null conv_id is a conversation. Extra columns
are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A private-use character: rare in texts, and doubled by its own escape where it occurs.
MARK = "\ue000"


@dataclass(frozen=True)
class Template:
    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<<SYS>> ", " <</SYS>>", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s> ", " </s>", True)})
    fallback: tuple[str, str, str] = ("<<ROLE>> ", " <<TEXT>> ", " <</ROLE>>")
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: tuple[str, ...] = ("answered", "asked")

    @property
    def controls(self) -> list[str]:
        return sorted({x.strip() for a, b, _ in self.roles.values() for x in (a, b)} | {x.strip() for x in self.fallback}, key=lambda x: (-len(x), x))


def escape(text: Column, t: Template) -> Column:
    text = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    pattern = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in t.controls)
    return F.regexp_replace(text, f"({pattern})", f"$1{MARK}1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + "1"), F.lit("")), F.lit(MARK + "0"), F.lit(MARK))


def format_chats(df: DataFrame, t: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss) whose texts join to formatted, valid, bad_turn (first turn that the machine refuses, from 0), end_state."""
    raw = F.coalesce(F.col(text), F.lit(""))
    turns = F.struct(F.col(turn).alias("o"), F.col(role).alias("r"), raw.alias("t"), escape(raw, t).alias("e"))
    got = df.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(turns), _by_turn).alias("x"))
    before, after, loss = F.lit(t.fallback[0]), F.lit(t.fallback[2]), F.lit(False)

    def parts(s: Column) -> Column:
        name = escape(F.coalesce(s["r"], F.lit("")), t)
        a, b, c = F.concat(before, name, F.lit(t.fallback[1])), after, loss
        for k, (x, y, z) in t.roles.items():
            hit = s["r"] == k
            a, b, c = F.when(hit, F.lit(x)).otherwise(a), F.when(hit, F.lit(y)).otherwise(b), F.when(hit, F.lit(z)).otherwise(c)
        seg = lambda v, f: F.struct(v.alias("text"), f.alias("loss"))
        return F.array(seg(a, F.lit(False)), seg(s["e"], c), seg(b, F.lit(False)))

    moves = F.create_map(*(F.lit(v) for (s, r), to in t.moves.items() for v in (f"{s}\n{r}", to)))
    first = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("i"), F.lit(-1).alias("bad"))

    def step(acc: Column, s: Column) -> Column:
        to = F.element_at(moves, F.concat(acc["state"], F.lit("\n"), F.coalesce(s["r"], F.lit("\n"))))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["i"] + 1).alias("i"), F.when((acc["bad"] < 0) & to.isNull(), acc["i"]).otherwise(acc["bad"]).alias("bad"))

    out = got.select("conv_id", F.flatten(F.transform("x", parts)).alias("segments"), F.aggregate("x", first, step).alias("m"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", ((F.col("m.bad") < 0) & F.col("m.state").isin(*t.final)).alias("valid"), F.when(F.col("m.bad") >= 0, F.col("m.bad")).alias("bad_turn"), F.col("m.state").alias("end_state"))


def _by_turn(a: Column, b: Column) -> Column:
    def cmp(x: Column, y: Column, rest: Column) -> Column:
        less = F.coalesce(x < y, x.isNull() & y.isNotNull())
        more = F.coalesce(x > y, x.isNotNull() & y.isNull())
        return F.when(less, F.lit(-1)).when(more, F.lit(1)).otherwise(rest)

    return cmp(a["o"], b["o"], cmp(a["r"], b["r"], cmp(a["t"], b["t"], F.lit(0))))


def read_back(formatted: Column, t: Template = Template()) -> Column:
    """Turns (role, text) from the formatted text alone. Each closing string ends a turn; escapes keep all of them out of texts."""
    ends = sorted({b for _, b, _ in t.roles.values()} | {t.fallback[2]}, key=lambda x: (-len(x), x))
    opens = {k: a for k, (a, _, _) in t.roles.items()}
    # a closing string is cut off with what it closes; the split keeps the opening string, which names the role
    pieces = F.filter(F.split(formatted, "|".join(map(re.escape, ends)), -1), lambda p: F.length(p) > 0)

    def turn(p: Column) -> Column:
        inner = F.substr(p, F.lit(len(t.fallback[0]) + 1))
        cut = F.locate(t.fallback[1], inner) if isinstance(inner, str) else F.instr(inner, t.fallback[1])
        r = F.substr(inner, F.lit(1), cut - 1)
        x = F.substr(inner, cut + len(t.fallback[1]))
        for k, a in opens.items():
            hit = F.startswith(p, F.lit(a))
            r, x = F.when(hit, F.lit(k)).otherwise(r), F.when(hit, F.substr(p, F.lit(len(a) + 1))).otherwise(x)
        return F.struct(unescape(r).alias("role"), unescape(x).alias("text"))

    return F.transform(pieces, turn)


def loss_text(turns: Column, t: Template = Template()) -> Column:
    """All text under the loss mask, in order, of turns as read_back() gives them."""
    trained = [k for k, (_, _, loss) in t.roles.items() if loss]
    return F.array_join(F.transform(F.filter(turns, lambda s: s["role"].isin(*trained)), lambda s: s["text"]), "")


def masked_text(segments: Column) -> Column:
    """The same from the segments and their loss flags."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))

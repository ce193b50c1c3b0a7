"""Chat formatting: a finite-state machine over roles and a declarative template, in Spark SQL functions only.

A conversation's turns are put in order, checked against the transitions, and laid out as segments of
text, each with a flag that says whether it counts for the loss.  The text of a turn is escaped, so that
no control string of the template can stand inside it, and can be read back without loss.

A conversation is one row of the result, so all its turns meet in one task: it must fit that task's memory, and its text 2 GB.

Defined cases: a null text or role is empty; turns with equal numbers are ordered by role and text, a
null turn comes first.  An unknown role is formatted, and makes the conversation invalid.  Repeated rows
are turns of their own.  A row without a conversation id belongs to no other: it is a conversation of one turn.  An empty
table gives an empty result.  A long text is escaped whole.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles count for the loss, and which role may follow which.

    ``open``, ``mid`` and ``close`` surround role and text.  ``escapes`` are pairs of a character and its
    replacement; the first is the escape character, and every control string must contain another of
    the characters.  ``moves`` maps a state to the states it may go to; the states are the roles.
    """

    open: str = "<turn:"
    mid: str = ">"
    close: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
    loss: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("start", ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user",)),
    )

    def escape(self, text: Column) -> Column:
        for plain, safe in self.escapes:
            text = F.replace(text, F.lit(plain), F.lit(safe))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, safe in reversed(self.escapes):
            text = F.replace(text, F.lit(safe), F.lit(plain))
        return text

    def step(self, state: Column, role: Column) -> Column:
        """The state after ``role``; an error once no move fits."""
        allowed = F.lit(False)
        for before, after in self.moves:
            allowed = allowed | ((state == before) & role.isin(*after))
        return F.when(allowed, role).otherwise(F.lit("error"))


def format_conversations(rows: DataFrame, template: Template | None = None, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id, ``n_turns, segments, formatted, final_state, valid``.

    ``segments`` is an array of text and loss flag whose texts, put together, are ``formatted``.
    ``final_state`` is the machine's last state, ``error`` if the order of roles is invalid.
    """
    t = template or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where(F.col(conv_col).isNotNull()).groupBy(conv_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = known.unionByName(rows.where(F.col(conv_col).isNull()).select(conv_col, F.array(turn).alias("turns")))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def laid_out(x: Column) -> Column:
        head = F.concat(F.lit(t.open), t.escape(x["role"]), F.lit(t.mid))
        return F.array(segment(head, F.lit(False)), segment(t.escape(x["text"]), x["role"].isin(*t.loss)), segment(F.lit(t.close), F.lit(False)))

    segments = F.flatten(F.transform("turns", laid_out))
    state = F.aggregate("turns", F.lit("start"), lambda acc, x: t.step(acc, x["role"]))
    out = turns.select(conv_col, F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), state.alias("final_state"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.withColumn("formatted", text).withColumn("valid", F.col("final_state") != "error")


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: an array of role and text, unescaped."""
    t = template or Template()
    whole = F.filter(F.split(formatted, re.escape(t.close)), lambda p: p != "")

    def turn(p: Column) -> Column:
        parts = F.split(p, re.escape(t.mid))
        return F.struct(
            t.unescape(F.substring(parts[0], len(t.open) + 1, 1 << 30)).alias("role"), t.unescape(parts[1]).alias("text")
        )

    return F.transform(whole, turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss flags, unescaped, in order."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")

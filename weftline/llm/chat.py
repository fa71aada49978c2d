"""Chat formatting: a finite-state machine over roles and a declarative template.

Each conversation becomes a list of text segments, each with a flag that says whether it is
trained on. Control strings of the template inside texts are escaped so that the formatted text
can be read back whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.text import let, whole


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles are trained on, and which role may follow which.

    ``moves`` maps a state to the roles it allows; the role is the next state. A role that is not
    allowed is a violation, after which the machine goes on from that role. A conversation is
    valid without violations if the last turn leaves it in a state of ``final``. Marks start
    with a character that is not a backslash and have two characters at least.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    trained: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)),
    )
    final: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.open, self.close)))


CHATML = Template()
_BREAK = ("\n", "<\\n>")


def escape(text: Column, template: Template, name: bool = False) -> Column:
    """Double backslashes, then part every mark after its first character by one; in a name also its line breaks."""
    swaps = [("\\", "\\\\"), *((m, m[0] + "\\" + m[1:]) for m in template.marks), *([_BREAK] if name else [])]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), swaps, text)


def unescape(text: Column, template: Template, name: bool = False) -> Column:
    """The reverse of :func:`escape`: an odd backslash can only come from it."""
    swaps = [*([_BREAK[::-1]] if name else []), *((m[0] + "\\" + m[1:], m) for m in template.marks), ("\\\\", "\\")]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), swaps, text)


def run_machine(turns: Column, template: Template) -> Column:
    """What the machine does at each turn: ``(state, role, text, allowed, loss)``.

    It moves from ``state``, the role before it (empty at the start), to ``role``; the output of
    the move is whether it was allowed and whether the text is trained on.
    """
    may = lambda state, role: reduce(lambda other, m: F.when(state == m[0], role.isin(*m[1])).otherwise(other), template.moves, F.lit(False))

    def move(t: Column, k: Column) -> Column:
        state = F.coalesce(F.get(turns, k - 1).role, F.lit(""))
        return F.struct(state.alias("state"), t.role.alias("role"), t.text.alias("text"), may(state, t.role).alias("allowed"), t.role.isin(*template.trained).alias("loss"))

    return F.transform(turns, move)


def format_conversations(turns: DataFrame, template: Template = CHATML, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, n_turns, valid, violations, segments)``; a segment is ``(text, loss)``, three to a turn.

    Rows are taken by turn (null first; equal turns by role, then text); repeated rows are turns
    of their own. A null role or text is empty, texts are taken whole, a null id is an id, an
    empty table gives an empty result, other columns are not read. A conversation's turns have
    to meet, as they are one output row; nothing else is grouped. Segments and their flags are
    emitted by the machine as it moves; invalid conversations are formatted too and say so:
    ``violations`` counts moves that are not allowed, and an end in a state that is not final.
    """
    one = F.struct(F.col(turn_col).alias("turn"), whole(role_col).alias("role"), whole(text_col).alias("text"))
    talks = turns.select(F.col(id_col).alias("id"), one.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    run = talks.select("id", run_machine(F.col("turns"), template).alias("moves"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    parts = F.flatten(F.transform("moves", lambda m: F.array(
        segment(F.concat(F.lit(template.open), escape(m.role, template, True), F.lit(template.after_role)), no),
        segment(escape(m.text, template), m.loss),
        segment(F.lit(template.close + template.after_turn), no),
    )))
    ended = F.coalesce(F.try_element_at("moves", F.lit(-1)).role, F.lit("")).isin(*template.final)
    wrong = F.size(F.filter("moves", lambda m: ~m.allowed)).cast("long") + F.when(ended, 0).otherwise(1)
    return run.select("id", F.size("moves").cast("long").alias("n_turns"), (wrong == 0).alias("valid"), wrong.alias("violations"), parts.alias("segments"))


def formatted(segments: str = "segments") -> Column:
    """The whole formatted text."""
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def read_turns(text: Column, template: Template = CHATML) -> Column:
    """The turns ``(role, text)`` of a formatted text."""
    end = template.close + template.after_turn

    def turn(piece: Column) -> Column:
        at = F.call_function("locate", F.lit(template.after_role), piece)
        after = at + len(template.after_role)
        body = F.substring(piece, after, F.length(piece) - after + 1 - len(end))
        return F.struct(unescape(F.substring(piece, F.lit(1), at - 1), template, True).alias("role"), unescape(body, template).alias("text"))

    quoted = "".join("\\" + c if not c.isalnum() else c for c in template.open)
    return F.transform(F.slice(F.split(text, quoted), 2, 1 << 30), turn)


def trained_text(segments: str = "segments", template: Template = CHATML) -> Column:
    """What is under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text, template)), "")


def digests(talks: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digests of what :func:`format_conversations` gave, read back from its segments."""
    told = talks.select("id", formatted().alias("formatted"), trained_text(template=template).alias("trained"), "valid", "violations")
    spoken = let(read_turns(F.col("formatted"), template), lambda t: F.struct(
        F.size(t).cast("long").alias("n"), F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""), 256).alias("sha")))
    return told.select("*", spoken.alias("s")).select(
        "id", F.col("s.n").alias("n_turns"), F.col("s.sha").alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "violations",
    )

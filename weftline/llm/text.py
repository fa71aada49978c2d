"""Column helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def whole(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text; an empty array where it has none."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Elements after which :func:`running` begins a new array.
_STRETCH = 64


def running(values: Column, start: Column, add) -> Column:
    """For each element of an array what ``add`` makes of ``start`` and all elements before it.

    Totals of stretches come first, then each stretch is filled from its own total, so no array
    that grows is longer than a stretch or the number of stretches.
    """
    stretch = lambda b: F.slice(values, b * _STRETCH + 1, F.lit(_STRETCH))
    begin = lambda at: F.struct(at.alias("at"), F.slice(F.array(start), 1, 0).alias("out"))
    step = lambda s, x: F.struct(add(s.at, x).alias("at"), F.concat(s.out, F.array(s.at)).alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _STRETCH).cast("int"))
    totals = F.transform(blocks, lambda b: F.aggregate(stretch(b), start, add))
    begins = F.aggregate(totals, begin(start), step, lambda s: s.out)
    filled = F.flatten(F.transform(begins, lambda at, b: F.aggregate(stretch(b), begin(at), step, lambda s: s.out)))
    return F.when(F.size(values) > 0, filled).otherwise(F.slice(F.array(start), 1, 0))

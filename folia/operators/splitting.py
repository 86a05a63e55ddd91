"""Splitting long texts into overlapping chunks at natural breaks, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.text import clean_text, let, strip

# Characters that a chunk aims at and has at most, those that two chunks share, and the share of the aim
# before which no break counts.
TARGET, HARD, OVERLAP, EARLIEST = 1100, 1400, 120, 0.45


def _break(head: Column) -> Column:
    """Characters of ``head`` up to its last line end or full stop before a blank, that one included; 0 without one.

    Both are looked for from the end, in the reversed text.
    """
    back = F.reverse(head)
    line, stop = F.instr(back, "\n"), F.instr(back, " .")
    return F.greatest(F.when(line > 0, F.length(head) - line + 1).otherwise(0), F.when(stop > 0, F.length(head) - stop).otherwise(0))


def spans(text: Column, target: int = TARGET, hard: int = HARD, overlap: int = OVERLAP) -> Column:
    """``ARRAY<STRUCT<start, size>>`` of the chunks of a text longer than ``hard``: a fold in which each chunk begins ``overlap`` before the last one's end.

    A chunk has ``hard`` characters, or ends at its last break within ``target`` if that lies beyond the earliest place.
    """
    least = int(EARLIEST * target) + 1  # a break counts from here on
    advance = max(1, min(least, hard) - overlap)
    steps = F.ceil(F.length(text) / advance).cast("int")

    def add(found: Column, _: Column) -> Column:
        last = F.element_at(found, -1)
        begin = F.greatest(last["start"] + last["size"] - overlap, last["start"] + 1)
        done = last["start"] + last["size"] >= F.length(text)
        return F.when(done, found).otherwise(F.concat(found, F.array(let(begin, one))))

    def one(begin: Column) -> Column:
        left = F.length(text) - begin
        cut = let(_break(F.substring(text, begin + 1, F.lit(target))), lambda b: F.when(b > least, b).otherwise(hard))
        return F.struct(begin.alias("start"), F.when(left <= hard, left).otherwise(cut).alias("size"))

    return F.aggregate(F.sequence(F.lit(2), F.greatest(steps, F.lit(2))), F.array(one(F.lit(0))), add)


def split_text(text: Column, target: int = TARGET, hard: int = HARD, overlap: int = OVERLAP) -> Column:
    """``ARRAY<STRING>`` of a text's chunks, cleaned and stripped; a short text is one chunk, an empty one none."""

    def pieces(ready: Column) -> Column:
        cut = F.transform(spans(ready, target, hard, overlap), lambda s: strip(F.substring(ready, s["start"] + 1, s["size"])))
        return F.when(F.length(ready) > hard, F.filter(cut, lambda p: p != "")).when(ready == "", F.array().cast("array<string>")).otherwise(F.array(ready))

    return let(clean_text(text), pieces)

"""Native pieces that the text scanners share: spans of regular expressions, windows of words, replaced spans. Each takes
time linear in the text, however many spans there are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import blocks, cut, let, running

#: Marks of regexp_replace; texts that hold them get another control character there, which no pattern mentions.
_OPEN, _CLOSE, _NEITHER = "\u0001", "\u0002", "\u0003"
TERM = r"\p{L}[\p{L}\p{M}\p{N}]{2,}"
_SPANS = "array<struct<start:int,end:int,value:string>>"


def unmarked(text: Column) -> Column:
    return F.translate(text, _OPEN + _CLOSE, _NEITHER * 2)


def marked(text: Column, pattern: str, maybe: Column, before: bool = False) -> Column:
    """unmarked() text with the leftmost non-overlapping matches between marks. maybe: a cheap condition without which
    there is no match (the result is then empty). before: group 1 is context ahead of the match, which is group 2."""
    new = f"$1{_OPEN}$2{_CLOSE}" if before else f"{_OPEN}$0{_CLOSE}"
    return F.when(F.coalesce(maybe, F.lit(False)), F.regexp_replace(text, F.lit(pattern), F.lit(new))).otherwise("")


def located(text: Column) -> Column:
    """array<struct<start,end,value>> of what is marked(), in code points, end exclusive. Where many patterns run, one
    transform over an array of marked texts is planned faster than many."""

    def every(pieces: Column) -> Column:
        nth = F.slice(F.sequence(F.lit(1), F.size(pieces) + 1, F.lit(2)), F.lit(1), F.floor(F.size(pieces) / 2).cast("int"))
        one = lambda at, i: F.struct(F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), F.get(pieces, i).alias("value"))
        return let(let(F.transform(pieces, lambda p: F.length(p)), lambda n: running(n)), lambda at: F.transform(nth, lambda i: one(at, i)))

    # bound as a lambda's variable, the pieces are computed once
    return F.coalesce(let(F.split(text, f"[{_OPEN}{_CLOSE}]", -1), every), F.array().cast(_SPANS))


def words(text: Column) -> Column:
    """array<struct<start,end,term>>: the terms of a text in lower case."""
    return F.transform(located(marked(unmarked(text), TERM, F.lit(True))), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("term")))


def replaced(text: Column, spans: Column, new) -> Column:
    """The text with each of spans (sorted structs of start, end, ...) replaced by new(span, characters): of spans that
    overlap, the first counts for all. characters: how many are replaced by it."""

    def made(held: Column, ss: Column) -> Column:
        def with_ends(before: Column) -> Column:
            # before: how far the spans ahead of each reach
            piece = lambda s, i: F.when(s["start"] >= F.get(before, i), F.concat(cut(held, F.get(before, i), s["start"] - F.get(before, i)), new(s, s["end"] - s["start"]))).otherwise(new(None, F.greatest(F.lit(0), s["end"] - F.get(before, i))))
            last = F.greatest(F.element_at(before, -1), F.element_at(ss, -1)["end"])
            return F.concat(F.array_join(F.transform(ss, piece), ""), cut(held, last, F.greatest(F.lit(0), F.length(text) - last)))

        return let(running(F.transform(ss, lambda s: s["end"]), F.greatest), with_ends)

    return F.when(F.size(spans) > 0, let(blocks(text), lambda held: let(spans, lambda ss: made(held, ss)))).otherwise(text)

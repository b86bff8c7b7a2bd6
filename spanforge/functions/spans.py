"""Columns of spans: arrays of struct<start, end, matchString>, with code-point offsets and an exclusive end.

Everything is row-local: no function here shuffles. Folds over spans run only where a text matches at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,matchString:string>"
SPANS = f"array<{SPAN}>"
_OPEN, _CLOSE = "\u0001", "\u0002"


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, match: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), match.alias("matchString"))


def running(items: Column, length=lambda x: x, block: int = 64) -> Column:
    """The sum of `length` over all items before each one. Sums run within blocks first and then over blocks, so that
    appending to an array copies a block and not the whole array."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    add = lambda s, x: F.struct((s["at"] + length(x)).alias("at"), F.array_append(s["found"], s["at"]).alias("found"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda k: F.aggregate(F.slice(items, k * block + 1, F.lit(block)), begin, add))
    outer = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("found"))
    moved = lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.array_append(s["found"], F.transform(b["found"], lambda x: x + s["at"])).alias("found"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, outer, moved)["found"])).otherwise(F.array().cast("array<int>"))


def scan(text: Column, pattern: str, max_len: int | None = None, limit: int | None = None, needs: str | None = None) -> Column:
    """All matches of a Java regex from left to right, each from the end of the one before.

    Matches longer than `max_len` are dropped, then the first `limit` stay. `needs` is a literal or a
    cheap regex without which no text can match: it spares most texts the costly pattern. Texts that don't match are not folded. Null text: no spans.
    Each match is taken from its own part of the text, so the time grows with the text's length.
    """
    plain = F.translate(text, _OPEN + _CLOSE, "\u0003\u0004")  # sentinels of the same length
    marked = F.struct(F.split(F.regexp_replace(plain, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN).alias("parts"), text.rlike(f"[{_OPEN}{_CLOSE}]").alias("odd"))

    def fold(x: Column) -> Column:
        rest = F.greatest(F.size(x["parts"]) - 1, F.lit(0))
        match = lambda part: F.substring_index(part, _CLOSE, 1)
        # All parts but the first hold a sentinel, and each counts as if it did: starts are one too small.
        own = lambda part, at: span(at + 1, at + 1 + F.length(match(part)), F.when(x["odd"], text.substr(at + 2, F.length(match(part)))).otherwise(match(part)))
        return F.zip_with(F.slice(x["parts"], F.lit(2), rest), F.slice(running(x["parts"], lambda part: F.length(part) - 1), F.lit(2), rest), own)

    found = let(marked, fold)
    if max_len is not None:
        found = F.filter(found, lambda x: x["end"] - x["start"] <= max_len)
    if limit is not None:
        found = F.slice(found, 1, limit)
    matches = text.rlike(pattern)
    if needs is not None:
        matches = (text.contains(needs) if re.escape(needs) == needs else text.rlike(needs)) & matches
    return F.when(matches, found).otherwise(no_spans())


def scan_line(marked: Column) -> Column:
    """The cells of a short text, given with a sentinel before and one behind each of them; what a cell holds is trimmed."""
    begin = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))
    size = lambda part: F.length(F.substring_index(part, _CLOSE, 1))
    own = lambda s, part: span(s["at"], s["at"] + size(part), F.trim(F.substring_index(part, _CLOSE, 1)))
    step = lambda s, part: F.when(part.contains(_CLOSE), F.struct((s["at"] + F.length(part) - 1).alias("at"), F.array_append(s["found"], own(s, part)).alias("found"))).otherwise(F.struct((s["at"] + F.length(part)).alias("at"), s["found"].alias("found")))
    return F.aggregate(F.split(marked, _OPEN), begin, step)["found"]


def mark(text: Column, pattern: str) -> Column:
    """`text` with a sentinel before and behind each match."""
    return F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "\u0003\u0004"), pattern, f"{_OPEN}$0{_CLOSE}")


def scan_longest(text: Column, patterns: list[str], union: str, max_len: int | None = None, limit: int | None = None, needs: str | None = None, cut: bool = False) -> Column:
    """Like `scan`, but of the patterns that match at the leftmost start the longest match counts. For patterns that don't
    look behind: each round reads the text from the end of the match before. `union`: all patterns as one.

    `cut`: matches longer than `max_len` are cut to it, and the scan goes on from there; else they are dropped."""
    begin = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))

    def step(state: Column, _: Column) -> Column:
        def best(rest: Column) -> Column:
            own = F.array(*[F.struct(F.regexp_instr(rest, F.lit(p)).alias("first"), F.regexp_extract(rest, p, 0).alias("m")) for p in patterns])
            order = lambda a, b: F.when(a["first"] != b["first"], a["first"] - b["first"]).otherwise(F.length(b["m"]) - F.length(a["m"]))
            return F.try_element_at(F.array_sort(F.filter(own, lambda x: x["m"] != ""), order), F.lit(1))

        def after(x: Column) -> Column:
            start = state["at"] + x["first"] - 1
            match = F.substring(x["m"], 1, max_len) if cut and max_len else x["m"]
            own = span(start, start + F.length(match), match)
            moved = F.struct((start + F.length(match)).alias("at"), F.array_append(state["found"], own).alias("found"))
            return F.when(x.isNull(), state).otherwise(moved)

        return let(let(text.substr(state["at"] + 1, F.length(text)), best), after)

    more = F.floor(F.length(text) / max_len).cast("int") if cut and max_len else F.lit(0)
    rounds = F.sequence(F.lit(1), F.regexp_count(text, F.lit(union)) + 4 + more)
    found = F.aggregate(rounds, begin, step)["found"]
    if max_len is not None and not cut:
        found = F.filter(found, lambda x: x["end"] - x["start"] <= max_len)
    if limit is not None:
        found = F.slice(found, 1, limit)
    matches = text.rlike(union) if needs is None else text.rlike(needs) & text.rlike(union)
    return F.when(matches, found).otherwise(no_spans())


def by_position(spans: Column) -> Column:
    """Sorted by start, then end."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])
    return F.array_sort(spans, order)


def _select(ordered: Column, kind: str) -> Column:
    begin = F.struct(F.lit(-1).alias("last"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        free = x["start"] >= state["last"]
        return F.struct(F.when(free, x["end"]).otherwise(state["last"]).alias("last"), F.when(free, F.array_append(state["kept"], x)).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(ordered, begin, step)["kept"]


def non_overlapping(spans: Column, kind: str = SPAN) -> Column:
    """From left to right, of equal starts the longest first, every span that begins at or after the last kept one's end."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    return _select(F.array_sort(spans, order), kind)


def shortest_first(spans: Column, kind: str = SPAN) -> Column:
    """Like `non_overlapping`, but of equal starts the shortest comes first: the choice for display across types."""
    return _select(by_position(spans), kind)


def finalized(spans: Column) -> Column:
    """Non-overlapping spans by position, each once."""
    return F.array_distinct(non_overlapping(spans))


def overlaps(a: Column, b: Column) -> Column:
    return (a["end"] > b["start"]) & (b["end"] > a["start"])


def without_overlap(spans: Column, others: list[Column]) -> Column:
    """Interval anti-join within the row: spans that overlap none of the others."""
    if not others:
        return spans
    against = F.concat(*others) if len(others) > 1 else others[0]
    return F.filter(spans, lambda x: ~F.exists(against, lambda y: overlaps(x, y)))


def no_digit_beside(spans: Column, text: Column) -> Column:
    """Spans with no digit right before or after them."""
    digit = lambda position: F.coalesce(text.substr(position, F.lit(1)).rlike(r"(?U)^\d$"), F.lit(False))
    return F.filter(spans, lambda x: ~digit(x["end"] + 1) & ~((x["start"] > 0) & digit(x["start"])))


def kept_positions(text: Column, dropped: str) -> Column:
    """Where in the source each character stands that `translate(text, dropped, '')` leaves."""
    characters = F.split(text, "")
    return F.filter(F.sequence(F.lit(0), F.length(text) - 1), lambda k: ~F.lit(dropped).contains(F.element_at(characters, k.cast("int") + 1)))


def remap(spans: Column, source: Column, kept: Column) -> Column:
    """Spans over a stripped text as spans over its source; dropped characters right behind a span belong to it."""
    def moved(places: Column) -> Column:
        start = lambda x: F.element_at(places, F.least(x["start"], F.size(places) - 1) + 1)
        end = lambda x: F.when(x["end"] >= F.size(places), F.length(source)).otherwise(F.element_at(places, F.least(x["end"], F.size(places) - 1) + 1))
        cut = lambda y: span(y["s"], y["e"], source.substr(y["s"] + 1, y["e"] - y["s"]))
        return F.transform(F.transform(spans, lambda x: F.struct(start(x).alias("s"), end(x).alias("e"))), cut)

    return let(kept, moved)


def split_lines(spans: Column) -> Column:
    """Each span as one span per line, trimmed, without empty ones."""
    def lines(x: Column) -> Column:
        parts = F.split(x["matchString"], r"\R")
        before = lambda k: F.coalesce(F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda s, p: s + F.length(p) + 1), F.lit(0))
        lead = lambda p: F.length(p) - F.length(F.ltrim(p))
        own = F.transform(parts, lambda p, k: span(x["start"] + before(k) + lead(p), x["start"] + before(k) + lead(p) + F.length(F.trim(p)), F.trim(p)))
        return F.filter(own, lambda y: y["end"] > y["start"])

    return F.flatten(F.transform(spans, lines))


def sentences(text: Column) -> Column:
    """Runs without . ! ? and line feeds, with the marks or line feeds that end them; the whole text if there is none."""
    whole = F.when(F.length(text) > 0, F.array(span(F.lit(0), F.length(text), text))).otherwise(no_spans())
    return let(scan(text, r"(?m)[^.!?\n]+(?:[.!?]+|\n+|$)"), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))


def context_bounds(sentence_spans: Column, start: Column, end: Column, around: Column | int) -> Column:
    """struct<start, end> of the `around` sentences before that of `start` to as many after that of `end`.

    Sentences ascend and don't overlap, so a place among them is a count of those before.
    """
    n = F.size(sentence_spans)
    at = lambda k: F.element_at(sentence_spans, k)
    i = F.size(F.filter(sentence_spans, lambda s: s["end"] <= start)) + 1
    j = F.size(F.filter(sentence_spans, lambda s: s["end"] < end)) + 1
    begun = F.size(F.filter(sentence_spans, lambda s: s["start"] <= end))
    i = F.when(i <= n, i).otherwise(1)
    j = F.when(j <= begun, j).when(begun > 0, begun).otherwise(n)
    low, high = F.greatest(F.lit(1), i - around), F.least(n, j + around)
    bounds = F.struct(at(low.cast("int"))["start"].alias("start"), at(high.cast("int"))["end"].alias("end"))
    return F.when(n > 0, bounds).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))


def clip_around(snippet: Column, snippet_start: Column, start: Column, end: Column, most: Column | int) -> Column:
    """At most `most` characters of a snippet, with the span in the middle as far as that goes; 0: all of it."""
    most = F.lit(most) if isinstance(most, int) else most
    size, half = F.length(snippet), F.floor(most / 2)
    low = F.greatest(F.lit(0), start - snippet_start)
    high = F.greatest(low, end - snippet_start)
    first = F.greatest(F.lit(0), F.floor((low + high) / 2) - half)
    first = F.least(first, F.greatest(F.lit(0), size - most))
    return F.when((size <= most) | (most <= 0), snippet).otherwise(snippet.substr((first + 1).cast("int"), most.cast("int")))

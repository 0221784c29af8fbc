"""Regular-expression matching with positions, as Column expressions.

All helpers stay inside the JVM.  A higher-order lambda re-evaluates whatever
outer expression it mentions once per element, so values used inside a lambda
are bound first with :func:`let`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_BLOCK = 256

# Every character that counts as white space in Unicode text.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an int array.

    Sums inside blocks of 256 keep long match lists near-linear; one running
    fold that appends to an array would copy it for every element.
    """

    def blocked(items: Column) -> Column:
        block_count = F.ceil(F.size(items) / PREFIX_BLOCK).cast("int")
        totals = F.transform(
            F.sequence(F.lit(0), block_count - 1),
            lambda b: total(F.slice(items, b * PREFIX_BLOCK + 1, F.lit(PREFIX_BLOCK))),
        )
        return let(totals, lambda t: let(
            F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b))),
            lambda before: F.transform(items, lambda _, i: F.get(before, F.floor(i / PREFIX_BLOCK).cast("int"))
                                       + total(F.slice(items, F.floor(i / PREFIX_BLOCK).cast("int") * PREFIX_BLOCK + 1,
                                                       i % PREFIX_BLOCK + 1))),
        ))

    return let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast("array<int>")))


def newlines(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


class Spec(NamedTuple):
    """One pattern of a multi-pattern scan; ``guard`` is a cheap test any matching text passes."""

    tag: str
    pattern: str
    group: int = 0
    guard: Column | None = None


LOCATED = "array<struct<tag:string,raw:string,value:string,start:int,newlines_before:int>>"


def located(text: Column, specs: list[Spec]) -> Column:
    """All matches of all patterns as ``LOCATED``; ``start`` is 0-based.

    The text between matches comes from ``split`` and the matches from
    ``regexp_extract_all``; their running lengths give every position.  The
    position arithmetic is written once and mapped over the patterns that matched.
    """

    def matched(spec: Spec) -> Column:
        found = let(matches(text, spec.pattern), lambda raws: F.when(F.size(raws) > 0, F.struct(
            F.lit(spec.tag).alias("tag"), raws.alias("raws"),
            (matches(text, spec.pattern, spec.group) if spec.group else raws).alias("values"),
            F.split(text, spec.pattern, -1).alias("gaps"))))
        return found if spec.guard is None else F.when(spec.guard, found)

    def place(hit: Column) -> Column:
        raws, gaps = hit["raws"], hit["gaps"]

        def step(measure: Callable[[Column], Column]) -> Column:
            return F.transform(raws, lambda m, i: measure(F.get(gaps, i))
                               + F.when(i == 0, 0).otherwise(measure(F.get(raws, i - 1))))

        bounds = F.struct(prefix_sums(step(F.length)).alias("start"), prefix_sums(step(newlines)).alias("nl"))
        return let(bounds, lambda at: F.transform(raws, lambda m, i: F.struct(
            hit["tag"].alias("tag"), m.alias("raw"), F.get(hit["values"], i).alias("value"),
            F.get(at["start"], i).alias("start"), F.get(at["nl"], i).alias("newlines_before"))))

    if not specs:
        return F.array().cast(LOCATED)
    found = F.filter(F.array(*[matched(s) for s in specs]), lambda hit: hit.isNotNull())
    return F.flatten(F.transform(found, place))


def line_starts(lines: Column) -> Column:
    """0-based offset at which each line begins."""
    return F.transform(prefix_sums(F.transform(lines, lambda s: F.length(s) + 1)),
                       lambda end, i: end - F.length(F.get(lines, i)) - 1)


def replace_matches(text: Column, pattern: str, mask: Callable[[Column], Column]) -> Column:
    """Replace each match by ``mask(match)``, as ``re.sub`` with a function does."""

    def rebuild(raws: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.concat(
            F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(raws)), raws,
                                    lambda g, m: F.concat(g, mask(m))), ""),
            F.element_at(gaps, -1),
        )

    return let(matches(text, pattern), lambda raws: F.when(F.size(raws) > 0, rebuild(raws)).otherwise(text))


def digits_of(value: Column) -> Column:
    """The decimal digits of any script, as they stand."""
    return F.regexp_replace(value, r"(?U)\D", "")


def ascii_digits(value: Column) -> Column:
    """Decimal digits of any script as 0 to 9."""
    others = [chr(c) for c in range(128, 0x10000) if chr(c).isdecimal()]
    return F.translate(value, "".join(others), "".join(str(unicodedata.decimal(c)) for c in others))


def passes_luhn(value: Column) -> Column:
    """13 to 19 digits whose Luhn checksum is a multiple of ten."""

    def checksum(digits: Column) -> Column:
        chars = F.split(digits, "")
        parity = F.length(digits) % 2

        def weigh(ch: Column, i: Column) -> Column:
            d = ch.cast("int")
            doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
            return F.when(i % 2 == parity, doubled).otherwise(d)

        return total(F.transform(chars, weigh)) % 10 == 0

    return let(ascii_digits(digits_of(value)), lambda d: F.coalesce(
        F.when(F.length(d).between(13, 19), checksum(d)).otherwise(F.lit(False)), F.lit(False)))


def line_window(lines: Column, line: Column) -> Column:
    """The lines before, at and after a 1-based line number, trimmed."""
    first = F.greatest(line - 1, F.lit(1))
    return strip(F.array_join(F.slice(lines, first, line + 2 - first), "\n"))


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def literal_count(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")

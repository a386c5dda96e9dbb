"""Scalar text functions as column expressions (no Python per row)."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, functions as F

from limpid import vocabulary as V


@functools.cache
def _base_letters() -> tuple[str, str]:
    """Characters with accents and the bare letter each one decomposes to.

    Generated from the Unicode database. Characters whose decomposition keeps
    several letters are not in the map; ``_letters`` spells Hangul syllables.
    """
    source, target = [], []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        base = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(base) == 1:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


# how Unicode composes Hangul syllables: first of them, first letters, vowels, last letters
_SYLLABLES, _LEADS, _VOWELS, _TAILS = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A8, 27)


def _letters(value: Column) -> Column:
    """Hangul syllables as their two or three letters; other characters stay."""
    spelled = {k: "".join(map(chr, range(first, first + n))) for k, (first, n) in (("l", _LEADS), ("v", _VOWELS), ("t", _TAILS))}

    def one(char: Column) -> Column:
        at = F.ascii(char) - _SYLLABLES
        pick = lambda k, i: F.substr(F.lit(spelled[k]), i.cast("int"), F.lit(1))
        per_lead, per_vowel = _VOWELS[1] * (_TAILS[1] + 1), _TAILS[1] + 1
        tail = at % per_vowel
        letters = F.concat(
            pick("l", F.floor(at / per_lead) + 1), pick("v", F.floor((at % per_lead) / per_vowel) + 1),
            F.when(tail > 0, pick("t", tail)).otherwise(""),
        )
        return F.when((at >= 0) & (at < _LEADS[1] * per_lead), letters).otherwise(char)

    return F.when(value.rlike("[\uac00-\ud7a3]"), F.array_join(F.transform(F.split(value, ""), one), "")).otherwise(value)


def fold(value: Column) -> Column:
    """Case, accents and repeated blanks folded; single blanks are kept."""
    source, target = _base_letters()
    bare = F.regexp_replace(F.translate(_letters(value), source, target), r"\p{Mn}", "")
    blanks = F.regexp_replace(bare, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.lower(F.trim(blanks))


def without_blanks(value: Column) -> Column:
    """Key under which spellings that differ by blanks coincide."""
    return F.replace(value, F.lit(" "), F.lit(""))


def ascii_only(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\x00-\x7F]", "")


def has_non_ascii(value: Column) -> Column:
    return value.rlike(r"[^\x00-\x7F]")


NUMBER_LETTERS = "0123456789+-.eE"
"""All that a written decimal number may consist of; the cast decides about the rest."""


def reads_as_number(value: Column) -> Column:
    """A written number; stricter than a cast, which accepts ``nan`` or ``1d``."""
    return number_or_null(value).isNotNull()


def number_or_null(value: Column) -> Column:
    plain = F.trim(value)
    return F.when(F.translate(plain, NUMBER_LETTERS, "") == "", plain.try_cast("double"))


def day_or_null(value: Column) -> Column:
    """The calendar day that a text begins with, if all of it is a day or a moment.

    Spark's own reading decides what a moment is; it also takes years, months and
    one-digit parts for days, which the length of the day and its dashes exclude.
    """
    text = F.trim(value)
    head, rest = F.substring(text, 1, 10), F.substr(text, F.lit(11))
    day = F.when((F.substring(head, 5, 1) == "-") & (F.substring(head, 8, 1) == "-"), head.try_cast("date"))
    # Spark wants seconds before a zone; a clock of hours alone is no moment
    full = F.concat(F.substring(text, 1, 16), F.lit(":00"), F.substr(text, F.lit(17)))
    read = F.coalesce(text.try_cast("timestamp"), full.try_cast("timestamp"))
    clock = F.substring(rest, 1, 1).isin(" ", "T") & F.contains(rest, F.lit(":")) & read.isNotNull()
    return F.when((rest == "") | clock, day)


def reads_as_date(value: Column) -> Column:
    """A day of the calendar, alone or with a clock time and a zone."""
    return F.coalesce(day_or_null(value).isNotNull(), F.lit(False))


def has_fraction(value: Column) -> Column:
    """Is the number written in ``value`` finite and not whole?"""
    v = number_or_null(value)
    return F.coalesce(
        (F.abs(v) < F.lit(float("inf"))) & (v != F.floor(v).cast("double")), F.lit(False)
    )


def last_segment(table: Column) -> Column:
    return F.lower(F.element_at(F.split(table, r"\."), -1))


def shorten(text: Column, limit: int = 400) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))
    ).otherwise(text)


def exponent(size: Column) -> Column:
    """Largest whole e with 2**e <= size, for a positive size.

    The quotient of logarithms may land just beside a whole number, hence the
    comparison with the powers themselves.
    """
    near = F.floor(F.log2(size))
    return (
        F.when(F.pow(F.lit(2.0), near + 1) <= size, near + 1)
        .when(F.pow(F.lit(2.0), near) > size, near - 1)
        .otherwise(near)
    )


def octave(magnitude: Column) -> Column:
    """Order of magnitude in powers of two, as a label."""
    size = F.abs(magnitude.cast("double"))
    return (
        F.when(size.isNull(), F.lit(V.NO_MAGNITUDE))
        .when(size < V.ZERO_MAGNITUDE, F.lit("0"))
        .otherwise(exponent(size).cast("string"))
    )


def signature(table: Column, column: Column, kind: Column, magnitude: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(
        "|",
        F.coalesce(table, blank),
        F.coalesce(column, blank),
        F.coalesce(kind, blank),
        octave(magnitude),
    )


def split_signature(text: Column) -> Column:
    """Back to its four terms; missing or empty terms are NULL."""
    parts = F.split(text, r"\|", -1)

    def term(i: int) -> Column:
        return F.nullif(F.get(parts, F.lit(i)), F.lit(""))

    return F.struct(
        term(0).alias("table_name"),
        term(1).alias("column_name"),
        term(2).alias("type"),
        term(3).alias("octave"),
    )


def run_id(dataset: Column, table: Column, day: Column) -> Column:
    return F.concat_ws("|", dataset, table, day)


def integer_or_null(value: Column) -> Column:
    """Typed integer; a written fraction rounds half up instead of vanishing."""
    return value.try_cast("decimal(38,0)").try_cast("int")


def money_or_null(value: Column) -> Column:
    return value.try_cast("decimal(12,2)")


def rate(part: Column, whole: Column) -> Column:
    """Rounded share; an empty whole gives 0.0, not NULL."""
    return F.when(whole > 0, F.round(part / whole, V.RATE_DIGITS)).otherwise(F.lit(0.0))

"""Text functions as column expressions, evaluated in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that never count as terms of a decision.
TERM_STOP_WORDS = (
    "the a an will be is are to of and or for on in it they them this that with as not no thus far have has been "
    "used using use should can cannot but"
).split()


@cache
def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their plain forms; combining marks come last and map to nothing."""
    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


def without_accents(text: Column) -> Column:
    return F.translate(text, *_accent_table())


def ascii_words(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 after lower-casing and dropping accents, sorted; an empty array for null."""
    plain = without_accents(F.lower(F.coalesce(text, F.lit(""))))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))))


def decision_terms(text: Column) -> Column:
    """Distinct a-z runs of three or more letters without the stop words, sorted; an empty array for null."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in TERM_STOP_WORDS])
    return F.array_sort(F.array_except(F.filter(F.array_distinct(runs), lambda w: F.length(w) >= 3), stop))


def decision_id(cell: Column) -> Column:
    """The plain form of a decision id: blanks around dropped, capital series, small rest."""
    bare = F.regexp_replace(cell, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")
    series = F.regexp_extract(F.upper(bare), r"^[A-Z]+[0-9]+", 0)
    return F.when(bare == "", None).otherwise(F.concat(series, F.lower(F.substr(bare, F.length(series) + 1))))


def plain_label(cell: Column, labels: list[str]) -> Column:
    """The label that a cell spells, or null: case, accents, blanks around, a last full stop and separators don't count."""
    bare = F.regexp_replace(without_accents(F.lower(cell)), r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s*\.$", ""), r"[\s_-]+", "_")
    return F.when(bare.isin(labels), bare)

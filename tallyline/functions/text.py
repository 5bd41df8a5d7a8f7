"""Name, alias and timestamp text normalisation."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

from tallyline.functions.numeric import as_col


@cache
def accented() -> tuple[str, str]:
    """Every precomposed lower-case letter of the basic plane and its base letter, position by position."""
    found = {}
    for code in range(0x80, 0x10000):
        letter = chr(code)
        base, *marks = unicodedata.normalize("NFD", letter)
        if marks and letter.islower() and all(unicodedata.category(m) == "Mn" for m in marks):
            found[letter] = base
    return "".join(found), "".join(found.values())


SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def normalize_name(name: Column | str) -> Column:
    """'Guerrero Jr., Vladimir' -> 'vladimir guerrero jr'; NULL -> ''."""
    text = F.lower(F.coalesce(as_col(name), F.lit("")))
    text = F.translate(text, *accented())
    text = F.regexp_replace(text, r"\p{Mn}", "")
    halves = F.split(text, ",")
    text = F.when(
        F.size(halves) == 2,
        F.concat_ws(" ", F.trim(halves.getItem(1)), F.trim(halves.getItem(0))),
    ).otherwise(text)
    text = F.regexp_replace(text, r"(?U)[^\w\s]", "")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    words = F.split(text, " ")
    return F.when(F.size(words) > 2, _suffix_last(words)).otherwise(text)


def _suffix_last(words: Column) -> Column:
    """The first listed suffix that stands before the end moves to the end."""
    last = F.element_at(words, -1)
    stray = F.filter(
        F.array(*[F.lit(s) for s in SUFFIXES]),
        lambda s: F.array_contains(words, s) & (last != s),
    )
    suffix = F.get(stray, F.lit(0))
    at = F.array_position(words, suffix).cast("int")
    moved = F.concat(
        F.slice(words, F.lit(1), at - 1),
        F.slice(words, at + 1, F.size(words)),
        F.array(suffix),
    )
    return F.concat_ws(" ", F.when(suffix.isNotNull(), moved).otherwise(words))


def reverse_comma_name(name: Column | str) -> Column:
    """'Last, First' -> 'First Last'."""
    return F.concat_ws(" ", F.reverse(F.split(as_col(name), ", ")))


def clean_timestamp_text(text: Column | str) -> Column:
    """Drop the zone and the fraction, use 'T' between date and time; NULL -> ''."""
    t = F.trim(F.coalesce(as_col(text), F.lit("")))
    t = F.regexp_replace(t, r"(\+\d{2}:\d{2}|Z)$", "")
    t = F.when(F.contains(t, F.lit("T")), t).otherwise(F.replace(t, F.lit(" "), F.lit("T")))
    return F.split(t, r"\.").getItem(0)


def parse_timestamp(text: Column | str) -> Column:
    return clean_timestamp_text(text).try_cast("timestamp_ntz")


def canonical(value: Column | str, aliases: dict[str, str], default_to_input: bool = True) -> Column:
    """Alias lookup in a literal map (a constant table, so no join)."""
    value = as_col(value)
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), value)
    return F.coalesce(found, value) if default_to_input else found

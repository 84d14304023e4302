"""Expressions over INFO text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an entry of the keyed lists may consist of.
KEYED_ENTRIES = {"AF": "[0-9.eE+-]+", "AC": "[0-9]+"}

# 0-based places of the two lists in the positional form.
POSITIONAL_AF_TERM = 7
POSITIONAL_AC_TERM = 8


def keyed_values(info: Column, key: str, anchored: bool = False) -> Column:
    """The comma list after `key=`, up to the next `;` or the end; null when the key is
    absent.

    The first match counts, which may lie inside a longer key (`XAF=`); `anchored`
    asks for a whole key.
    """
    pattern = key + "=([^;]*)"
    if anchored:
        pattern = "(?:^|;)" + pattern
    block = F.regexp_extract(info, pattern, 1)
    return F.when(block != "", F.split(F.rtrim(block, F.lit(",")), ",\\s*"))


def positional_values(info: Column, term: int) -> Column:
    """Entries of the given `;` term without the first (reference) entry; null when
    the INFO text has too few terms."""
    entries = F.split(F.get(F.split(info, ";"), term), ",")
    return F.slice(entries, 2, F.greatest(F.size(entries) - 1, F.lit(0)))


def after_last_dash(entry: Column) -> Column:
    """`allele-value` -> value. The allele may hold dashes itself, but may not be
    empty; anything else is null."""
    value = F.regexp_extract(entry, "^.+-([^-]*)$", 1)
    return F.when(value != "", value)


def keyed_entry(entry: Column, key: str, to: str) -> Column:
    """The value of one entry; null unless it is a number through and through."""
    whole = "^(" + KEYED_ENTRIES[key] + ")$"
    return F.when(entry.rlike(whole), entry.try_cast(to))


def plain_decimal(value: Column) -> Column:
    """A double as text without an exponent, digit for digit the value's own text with the
    point moved. Not-a-number and the infinities keep their names."""
    text = value.cast("double").cast("string")
    part = lambda k: F.regexp_extract(text, "^(-?)([0-9]+)[.]([0-9]+)(?:E(-?[0-9]+))?$", k)
    digits = F.concat(part(2), part(3))
    exponent = F.when(part(4) == "", F.lit(0)).otherwise(part(4).try_cast("int"))
    point = F.length(part(2)) + exponent
    moved = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits))))
        .otherwise(
            F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
        )
    )
    ended = F.when(moved.contains("."), F.regexp_replace(moved, "[.]?0+$", "")).otherwise(moved)
    return F.when(digits == "", text).otherwise(F.concat(part(1), ended))

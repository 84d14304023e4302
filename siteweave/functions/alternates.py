"""Expressions over the comma list in `alternate_bases`."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def alternates(column: str = "alternate_bases") -> str:
    """SQL for the alternates as an array, without trimming.

    Trailing commas add nothing, while an empty entry between two commas keeps its
    place, because genotype indices count entries.
    """
    listed = f"trim(TRAILING ',' FROM {column})"
    return (
        f"CASE WHEN {listed} = '' AND {column} <> '' THEN CAST(array() AS array<string>) "
        f"ELSE split({listed}, ',') END"
    )


def is_copy_number(alternate_bases: Column) -> Column:
    """True for copy-number alternates such as `<CN2>`."""
    # Fixed value: the copy-number pattern.
    return F.trim(alternate_bases).rlike("^<CN[0-9]+>$")

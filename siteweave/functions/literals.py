"""Expressions over long lists of names.

A cohort has thousands of sample columns. One SQL text for all of them reaches Spark in
one call, where a Column object for each would take seconds.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(value: str | int) -> str:
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: list, item_type: str) -> Column:
    """An array of constant strings or integers."""
    return F.expr(f"CAST(array({', '.join(map(_literal, values))}) AS array<{item_type}>)")


def is_one_of(column: str, values: list[str]) -> Column:
    """Whether the column equals one of many constants."""
    if not values:
        return F.lit(False)
    return F.expr(f"{quoted_name(column)} IN ({', '.join(map(_literal, values))})")


def string_array(columns: list[str]) -> Column:
    """The columns as one array of strings."""
    return F.expr(f"CAST(array({', '.join(map(quoted_name, columns))}) AS array<string>)")

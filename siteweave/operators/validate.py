"""Rules of a legal variant record, applied to whole tables."""

import operator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.schema import POSITIONS, REFERENCE_NAMES, require


# What becomes of a row.
CLEAN, REJECTED = "clean", "rejected"


class Checked(NamedTuple):
    clean: DataFrame
    rejected: DataFrame


def _broken(df: DataFrame) -> dict[str, Column]:
    """For each checked column, whether its value breaks the rule; never null."""
    require(df, ["reference_name", *POSITIONS, "reference_bases", "alternate_bases"])

    def not_null(rule: Column) -> Column:
        return F.coalesce(rule, F.lit(False))

    broken = {"reference_name": not_null(~F.col("reference_name").isin(REFERENCE_NAMES + [""]))}
    for p in POSITIONS:
        if isinstance(df.schema[p].dataType, T.IntegralType):
            broken[p] = F.col(p).isNull()
            continue
        # The cast trims blanks, which are no part of a legal position.
        text = F.col(p).cast("string")
        whole = text.try_cast("bigint").isNotNull() & text.rlike("^[+-]?[0-9]+$")
        broken[p] = ~not_null(whole)
    for b in ("reference_bases", "alternate_bases"):
        broken[b] = not_null(~F.col(b).rlike("^[ACTG]*$"))
    return broken


def with_errors(df: DataFrame) -> DataFrame:
    """Add `errors`: the names of the columns that break a rule, in column order.

    Works on raw text positions as well as on typed ones. Empty or missing names and
    bases are legal, as absent request parameters are; a missing position is not.
    """
    named = [F.when(rule, F.lit(name)) for name, rule in _broken(df).items()]
    return df.withColumn("errors", F.array_compact(F.array(*named)))


def validate_variants(df: DataFrame) -> Checked:
    """Split a table into clean rows, with bigint positions, and rejected rows, as
    they came plus `errors`. Every input row is in exactly one of the two."""
    wrong = reduce(operator.or_, _broken(df).values())
    clean = df.where(~wrong)
    clean = clean.withColumns({p: F.col(p).try_cast("bigint") for p in POSITIONS})
    return Checked(clean, with_errors(df.where(wrong)))


def validate_outcomes(df: DataFrame) -> DataFrame:
    """Every row as it came with `errors` and its `outcome`, CLEAN or REJECTED, in one plan."""
    clean = F.when(F.size("errors") == 0, F.lit(CLEAN)).otherwise(F.lit(REJECTED))
    return with_errors(df).withColumn("outcome", clean)

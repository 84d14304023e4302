"""Variant exports of three shapes -> standardised records.

Each function returns the records and the input rows it could not read, with a
`reason`; only rows the rules say to skip are in neither. `outcomes` has both in one plan,
for a writer that parses the export once.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.info import (
    POSITIONAL_AC_TERM,
    POSITIONAL_AF_TERM,
    after_last_dash,
    keyed_entry,
    keyed_values,
    positional_values,
)
from siteweave.functions.jsontext import record_from_json, record_to_json
from siteweave.operators.filters import drop_copy_number
from siteweave.schema import KEY5, POSITIONS, STANDARD, require


class Standardised(NamedTuple):
    records: DataFrame
    rejected: DataFrame
    #: `outcome` (RECORD or REJECTED), `record` or `row` as a struct, and `reason`
    outcomes: DataFrame


# What becomes of a row.
RECORD, REJECTED = "record", "rejected"


def _first_reason(rules: dict[str, Column]) -> Column:
    return F.coalesce(
        *[F.when(F.coalesce(broken, F.lit(True)), F.lit(r)) for r, broken in rules.items()],
        F.lit(None).cast("string"),
    )


def _lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _position_rules(df: DataFrame) -> dict[str, Column]:
    return {
        f"{p} is no integer": F.col(p).cast("string").try_cast("bigint").isNull()
        for p in POSITIONS
    }


def _split_records(
    parsed: DataFrame, rules: dict[str, Column], raw: list[str], skipped: Column | None = None
) -> Standardised:
    """`parsed` holds `_alts`, `_afs` (double) and `_acs` (bigint) arrays.

    Rows are chosen by exploding an array that is null for the others. A filter would be
    pushed below the parsing and repeat it for every mention of a parsed column.
    """
    kept = F.lit(True) if skipped is None else ~F.coalesce(skipped, F.lit(False))
    judged = parsed.withColumns({"reason": _first_reason(rules), "_kept": kept})
    entries = F.arrays_zip(
        F.col("_alts").alias("alt"), F.col("_afs").alias("af"), F.col("_acs").alias("ac")
    )
    good = F.col("_kept") & F.col("reason").isNull()
    bad = F.col("_kept") & F.col("reason").isNotNull()
    records = judged.select(
        "reference_name",
        *[F.col(p).try_cast("bigint").alias(p) for p in POSITIONS],
        "reference_bases",
        F.inline(F.when(good, entries)).alias("alternate_bases", "minor_af", "allele_count"),
    ).select(*STANDARD.names)
    rejected = judged.select(*raw, F.explode(F.when(bad, F.array("reason"))).alias("reason"))

    def record(entry: Column) -> Column:
        values = {"alternate_bases": entry["alt"], "minor_af": entry["af"], "allele_count": entry["ac"]}
        for p in POSITIONS:
            values[p] = F.col(p).try_cast("bigint")
        return F.struct(*[values.get(n, F.col(n)).alias(n) for n in STANDARD.names]).cast(STANDARD)

    row = F.struct(*[F.col(f"`{c}`") for c in raw])
    no_row = F.when(F.lit(False), row)

    def outcome(name: str, own_record: Column, own_row: Column, reason: Column) -> Column:
        return F.struct(
            F.lit(name).alias("outcome"), own_record.alias("record"), own_row.alias("row"), reason.alias("reason")
        )

    no_reason = F.lit(None).cast("string")
    both = F.when(
        good, F.transform(entries, lambda e: outcome(RECORD, record(e), no_row, no_reason))
    ).when(bad, F.array(outcome(REJECTED, F.lit(None).cast(STANDARD), row, F.col("reason"))))
    return Standardised(records, rejected, judged.select(F.inline(both)))


def _lengths_differ(first: str, second: str) -> Column:
    return F.size(first) != F.size(second)


def _any_null(column: str) -> Column:
    return F.exists(column, lambda x: x.isNull())


def standardise_positional_info(df: DataFrame) -> Standardised:
    """Positional INFO: the 8th term lists allele frequencies, the 9th counts, each
    entry `allele-value`, the reference allele first."""
    df = _lower_names(df)
    require(df, [*KEY5, "info"])
    terms = df.withColumns(
        {
            "_alts": F.split("alternate_bases", ",\\s*"),
            "_af_entries": positional_values(F.col("info"), POSITIONAL_AF_TERM),
            "_ac_entries": positional_values(F.col("info"), POSITIONAL_AC_TERM),
        }
    )
    parsed = terms.withColumns(
        {
            "_afs": F.transform(
                "_af_entries", lambda e: after_last_dash(e).try_cast("double")
            ),
            "_acs": F.transform(
                "_ac_entries", lambda e: after_last_dash(e).try_cast("bigint")
            ),
        }
    )
    rules = {
        **_position_rules(df),
        "too few INFO terms": F.col("_afs").isNull() | F.col("_acs").isNull(),
        "frequency and count lists differ in length": _lengths_differ("_afs", "_acs"),
        "alternates and values differ in number": _lengths_differ("_alts", "_afs"),
        "malformed allele frequency": _any_null("_afs"),
        "malformed allele count": _any_null("_acs"),
    }
    return _split_records(parsed, rules, df.columns)


def standardise_columns(df: DataFrame) -> Standardised:
    """Plain `af` and `ac` columns, taken as they are; copy-number rows are skipped."""
    df = _lower_names(df)
    require(df, [*KEY5, "af", "ac"])
    parsed = drop_copy_number(df).withColumns(
        {
            "_alts": F.array("alternate_bases"),
            "_afs": F.array(F.col("af").try_cast("double")),
            "_acs": F.array(F.col("ac").try_cast("bigint")),
        }
    )
    rules = {
        **_position_rules(df),
        "malformed allele frequency": _any_null("_afs") & F.col("af").isNotNull(),
        "malformed allele count": _any_null("_acs") & F.col("ac").isNotNull(),
    }
    return _split_records(parsed, rules, df.columns)


def standardise_keyed_info(df: DataFrame, anchored: bool = False) -> Standardised:
    """Keyed INFO: the first `AF=` and the first `AC=` list. A row with any frequency
    `.` is skipped whole."""
    df = _lower_names(df)
    require(df, [*KEY5, "info"])
    listed = df.withColumns(
        {
            "_alts": F.split("alternate_bases", ",\\s*"),
            "_af_text": keyed_values(F.col("info"), "AF", anchored),
            "_ac_text": keyed_values(F.col("info"), "AC", anchored),
        }
    )
    same = F.size("_af_text") == F.size("_ac_text")
    skipped = same & F.exists("_af_text", lambda x: x == ".")
    parsed = listed.withColumns(
        {
            "_afs": F.transform("_af_text", lambda x: keyed_entry(x, "AF", "double")),
            "_acs": F.transform("_ac_text", lambda x: keyed_entry(x, "AC", "bigint")),
        }
    )
    rules = {
        **_position_rules(df),
        "no AF values in INFO": F.col("_af_text").isNull(),
        "no AC values in INFO": F.col("_ac_text").isNull(),
        "frequency and count lists differ in length": _lengths_differ("_afs", "_acs"),
        "malformed allele frequency": _any_null("_afs"),
        "malformed allele count": _any_null("_acs"),
        "alternates and values differ in number": _lengths_differ("_alts", "_afs"),
    }
    return _split_records(parsed, rules, df.columns, skipped)


def standard_to_json(records: DataFrame) -> DataFrame:
    """Add `json`, the record's JSON text."""
    return records.withColumn("json", record_to_json())


def standard_from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """The standardised columns read from JSON text; other columns are kept."""
    fields = record_from_json(F.col(column))
    names = set(STANDARD.names) - {"reference_name"}
    others = [c for c in df.columns if c != column and c not in names]
    return df.select(*others, *fields)

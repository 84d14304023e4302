"""Genotype arithmetic with built-in array functions.

A genotype is `a|b` (phased), `a` (haploid) or `.`; each part is an allele index, 0
being the reference. Parts that are not integers are ignored.

The expressions of the hot path are SQL text: each reaches Spark in one call.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave.functions.literals import literal_array

HOM_REF = "0|0"


def not_hom_ref(genotypes: str) -> str:
    """SQL that drops the `0|0` calls, by far the most common ones. Unlike a lambda,
    this is compiled, so that the lambdas below see only the few calls that are left."""
    return f"array_remove({genotypes}, '{HOM_REF}')"


def allele_indices(genotypes: str) -> str:
    """SQL for every integer allele index in the calls, as one array of bigint."""
    return f"""
        array_compact(transform(
          split(array_join({genotypes}, '|'), '[|]'),
          part -> CASE
            WHEN part = '0' THEN 0L
            WHEN part = '1' THEN 1L
            WHEN part = '.' THEN NULL
            WHEN part RLIKE '^[+-]?[0-9]+$' THEN try_cast(part AS bigint)
          END))"""


def count_equal(indices: str, wanted: str) -> str:
    """SQL for how many entries equal `wanted`; the array holds no nulls."""
    return f"CAST(size({indices}) - size(array_remove({indices}, CAST({wanted} AS bigint))) AS bigint)"


# Non-reference alleles carried by each known genotype text. Any text
# not listed (missing, unphased, indices above 3) carries none.
CARRIED = {
    "0": 0, "1": 1, "2": 1, "3": 1,
    "0|0": 0, "0|1": 1, "0|2": 1, "0|3": 1,
    "1|0": 1, "1|1": 2, "1|2": 2, "1|3": 2,
    "2|0": 1, "2|1": 2, "2|2": 2, "2|3": 2,
    "3|0": 1, "3|1": 2, "3|2": 2, "3|3": 2,
}


def carried_alleles(genotype: Column, haploid: bool = True) -> Column:
    """Non-reference alleles of one call by the fixed table, or by its phased part alone."""
    once = [g for g, n in CARRIED.items() if n == 1 and (haploid or "|" in g)]
    twice = [g for g, n in CARRIED.items() if n == 2]
    return (
        F.when(genotype == HOM_REF, 0)
        .when(genotype.isin(once), 1)
        .when(genotype.isin(twice), 2)
        .otherwise(0)
    )


def carried_indices(genotype: Column) -> Column:
    """Non-reference alleles of one call: its integer parts above 0, of any size."""
    parts = F.filter(F.split(genotype, "[|]"), lambda part: part.rlike("^[0-9]*[1-9][0-9]*$"))
    return F.coalesce(F.size(parts), F.lit(0))


def made_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value made once a row. Spark copies the expression that makes an
    array to each place that takes an element of it, and a lambda would make it anew for
    each element that it takes."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def carried_by(
    genotypes: Column, positions: list[int], every_index: bool = False, haploid: bool = True
) -> Column:
    """Alleles carried by the calls at the given array positions: `carried_alleles`, or
    `carried_indices` with `every_index`. Where the array is not a stored one, give it
    `made_once`."""
    if every_index:
        # the calls that are not 0|0 are few, so only these are taken apart
        chosen = F.transform(literal_array(positions, "int"), lambda at: F.get(genotypes, at))
        return F.aggregate(
            F.array_remove(F.array_compact(chosen), HOM_REF),
            F.lit(0).cast("bigint"),
            lambda total, call: total + carried_indices(call).cast("bigint"),
        )
    # the same for the texts of the table: without 0|0 and nulls few are left to look up
    chosen = F.transform(literal_array(positions, "int"), lambda at: F.get(genotypes, at))
    return F.aggregate(
        F.array_remove(F.array_compact(chosen), HOM_REF),
        F.lit(0).cast("bigint"),
        lambda total, call: total + carried_alleles(call, haploid).cast("bigint"),
    )


# The compact code of each common call. `-` is a null, `?` any other text.
CODES = {"0|0": "0", "0|1": "1", "1|0": "2", "1|1": "3", "0": "a", "1": "b", ".": "."}
NULL_CODE, OTHER_CODE = "-", "?"


def encoded(genotypes: str) -> str:
    """SQL for the codes of an array of calls, as one text."""
    cases = " ".join(f"WHEN g = '{text}' THEN '{code}'" for text, code in CODES.items())
    each = f"CASE {cases} WHEN g IS NULL THEN '{NULL_CODE}' ELSE '{OTHER_CODE}' END"
    return f"array_join(transform({genotypes}, g -> {each}), '')"


def others(genotypes: str) -> str:
    """SQL for the calls without a code, in order."""
    known = ", ".join(f"'{text}'" for text in CODES)
    return f"filter({genotypes}, g -> g IS NOT NULL AND g NOT IN ({known}))"


def decoded(codes: str, rest: str) -> str:
    """SQL for the array of calls, the inverse of `encoded` and `others`."""
    cases = " ".join(f"WHEN c = '{code}' THEN '{text}'" for text, code in CODES.items())
    # how many `?` there are up to here
    seen = f"i + 1 - length(replace(substring({codes}, 1, i + 1), '{OTHER_CODE}', ''))"
    each = f"CASE {cases} WHEN c = '{OTHER_CODE}' THEN element_at({rest}, {seen}) END"
    return f"CASE WHEN {codes} = '' THEN CAST(array() AS array<string>) ELSE transform(split({codes}, ''), (c, i) -> {each}) END"


def code_count(codes: str, texts: list[str]) -> str:
    """SQL for how many calls of these texts there are, without a lambda."""
    lengths = [f"length(replace({codes}, '{CODES[t]}', ''))" for t in texts]
    return f"CAST({len(texts)} * length({codes}) - ({' + '.join(lengths)}) AS bigint)"

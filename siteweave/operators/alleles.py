"""Allele counts and frequencies per alternate; none of these shuffles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.functions.alternates import alternates
from siteweave.functions.genotypes import allele_indices, code_count, count_equal, not_hom_ref
from siteweave.functions.literals import quoted_name
from siteweave.operators.columns import packed, packed_samples
from siteweave.schema import COMPACT, GENOTYPES


def _names(columns: list[str]) -> list[str]:
    return [quoted_name(c) for c in columns]


def split_alternates(df: DataFrame) -> DataFrame:
    """One row per alternate; `allele_index` is its place in the list, from 1."""
    order = [c for c in df.columns if c != "allele_index"]
    others = [c for c in order if c != "alternate_bases"]
    exploded = df.selectExpr(
        *_names(others), f"posexplode({alternates()}) AS (_at, alternate_bases)"
    )
    return exploded.selectExpr(*_names(order), "_at + 1 AS allele_index")


def tally_alleles(df: DataFrame) -> DataFrame:
    """Replace the genotypes by counts per site.

    `allele_counts` is an array with one count per alternate, `reference_count` the
    reference alleles, `allele_number` the sum of both, `bad_calls` the indices that
    name no allele of the site, and `n_samples` the sample columns of the table.
    """
    is_compact = COMPACT in df.columns
    df = df if is_compact else packed(df)
    n_samples = len(packed_samples(df))
    site = _names([c for c in df.columns if c not in (GENOTYPES, COMPACT)])
    # In steps, so that each array is computed once and then used several times. `_zeros` and
    # `_ones` are the alleles 0 and 1 of calls that need not be taken apart.
    if is_compact:
        codes = f"{COMPACT}.codes"
        one_each = code_count(codes, ["0|1", "1|0"])
        calls = df.selectExpr(
            *site,
            f"{COMPACT}.rare AS _rest",
            f"2 * {code_count(codes, ['0|0'])} + {one_each} + {code_count(codes, ['0'])} AS _zeros",
            f"{one_each} + 2 * {code_count(codes, ['1|1'])} + {code_count(codes, ['1'])} AS _ones",
            f"size({alternates()}) AS _n",
        )
    else:
        calls = df.selectExpr(
            *site,
            f"size({GENOTYPES}) AS _calls",
            f"{not_hom_ref(GENOTYPES)} AS _rest",
            f"size({alternates()}) AS _n",
        ).selectExpr(*site, "_rest", "CAST(2 * (_calls - size(_rest)) AS bigint) AS _zeros", "0L AS _ones", "_n")
    parsed = calls.selectExpr(*site, "_zeros", "_ones", f"{allele_indices('_rest')} AS _indices", "_n")
    counted = parsed.selectExpr(
        *site,
        "CASE WHEN _n = 0 THEN CAST(array() AS array<bigint>) ELSE "
        f"transform(sequence(1, _n), i -> {count_equal('_indices', 'i')} + IF(i = 1, _ones, 0L)) END AS allele_counts",
        f"_zeros + {count_equal('_indices', '0')} AS reference_count",
        "_zeros + _ones + size(_indices) AS _parsed",
        "CAST(size(filter(_indices, i -> i < 0 OR i > _n)) AS bigint) + IF(_n < 1, _ones, 0L) AS bad_calls",
    )
    return counted.selectExpr(
        *site,
        "allele_counts",
        "reference_count",
        "_parsed - bad_calls AS allele_number",
        "bad_calls",
        f"{n_samples}L AS n_samples",
    )


def allele_counts(df: DataFrame) -> DataFrame:
    """One row per alternate with its `allele_count`, beside the site's totals."""
    tallied = split_alternates(tally_alleles(df))
    kept = [c for c in tallied.columns if c not in ("allele_counts", "allele_index")]
    return tallied.selectExpr(
        *_names(kept), "get(allele_counts, allele_index - 1) AS allele_count"
    )


def with_frequencies(counts: DataFrame) -> DataFrame:
    """Add `af`, the count over the number of sample columns (missing calls stay in
    the denominator), and `af_called`, the count over the alleles called."""
    count = F.col("allele_count").cast("double")
    return counts.withColumns(
        {
            "af": F.try_divide(count, F.col("n_samples").cast("double")),
            "af_called": F.try_divide(count, F.col("allele_number").cast("double")),
        }
    )


def allele_frequencies(df: DataFrame) -> DataFrame:
    """`allele_counts` with both frequencies."""
    return with_frequencies(allele_counts(df))


# The columns of an answer.
REPORT_COLUMNS = [
    "reference_name",
    "start_position",
    "end_position",
    "id",
    "reference_bases",
    "alternate_bases",
    "allele_count",
    "af",
]


def allele_report(df: DataFrame) -> DataFrame:
    """The columns of a variant answer: the site, one alternate, count, frequency."""
    return allele_frequencies(df).select(*REPORT_COLUMNS)

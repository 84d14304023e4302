"""Counts and frequencies over variant tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.genotypes import carried_by, made_once
from siteweave.functions.literals import is_one_of, literal_array
from siteweave.operators.alleles import allele_counts
from siteweave.operators.columns import packed, packed_samples, samples_by_population
from siteweave.operators.filters import VariantFilter, filter_contained, filter_snp, filter_variants
from siteweave.operators.joins import SUPERPOPULATIONS
from siteweave.schema import COMPACT, GENOTYPES, KEY5


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def count_variants(sources: dict[str, DataFrame], where: VariantFilter) -> DataFrame:
    """Matching rows per source; a source without any counts 0."""
    return _union(
        [
            filter_variants(df, where)
            .agg(F.count("*").alias("ct"))
            .select(F.lit(name).alias("source"), "ct")
            for name, df in sources.items()
        ]
    )


def stat_variants(sources: dict[str, DataFrame], where: VariantFilter) -> DataFrame:
    """Whether each source has a matching row."""
    return _union(
        [
            # One row answers the question, so a task stops at its first match.
            filter_variants(df, where)
            .limit(1)
            .agg((F.count("*") > 0).alias("found"))
            .select(F.lit(name).alias("source"), "found")
            for name, df in sources.items()
        ]
    )


def count_where(df: DataFrame, field: str, value) -> DataFrame:
    """Rows whose `field` equals `value`."""
    return df.where(F.col(f"`{field}`") == value).agg(F.count("*").alias("ct"))


def count_contained(df: DataFrame, **bounds) -> DataFrame:
    """Rows that `filter_contained` keeps."""
    return filter_contained(df, **bounds).agg(F.count("*").alias("ct"))


def population_positions(
    df: DataFrame, metadata: DataFrame, populations: list[str] | None = None
) -> dict[str, list[int]]:
    """For each superpopulation, where its samples stand in the genotype array.

    The rows collected are the table's own samples, never more than its schema names.
    """
    at = {s: i for i, s in enumerate(packed_samples(df))}
    rows = (
        samples_by_population(metadata, populations)
        .where(is_one_of("sample", list(at)))
        .select("superpopulation", "sample")
        .distinct()
        .collect()
    )
    found: dict[str, list[int]] = {p: [] for p in sorted({r[0] for r in rows})}
    for population, sample in rows:
        found[population].append(at[sample])
    return {p: sorted(positions) for p, positions in found.items()}


def superpopulation_counts(
    df: DataFrame,
    metadata: DataFrame,
    populations: list[str] | None = None,
    snp_only: bool = True,
    suffix: str = "",
    haploid: bool = True,
) -> DataFrame:
    """Non-reference alleles per site and superpopulation, as columns
    `<population>_alleleCount<suffix>`.

    The sample lists become array positions, so every site is counted where it lies:
    no call is exploded and nothing is shuffled. A SNP's calls are looked up in a table of
    known texts, which has haploid calls unless `haploid=False`; with `snp_only=False` a call
    carries as many alleles as it has indices above 0.
    """
    df = packed(df)
    positions = population_positions(df, metadata, populations)
    sites = filter_snp(df) if snp_only else df
    names = {p: f"{p}_alleleCount{suffix}" for p in positions}
    kept = [F.col(f"`{c}`") for c in df.columns if c != GENOTYPES]
    if not positions:
        return sites.select(*kept)

    def counts(calls: Column) -> Column:
        return F.struct(*[carried_by(calls, at, not snp_only, haploid).alias(names[p]) for p, at in positions.items()])

    counted = sites.select(*kept, made_once(F.col(GENOTYPES), counts).alias("_counts"))
    return counted.select(*kept, *[F.col("_counts").getField(n).alias(n) for n in names.values()])


def carriers_by_population(
    calls: DataFrame,
    reference_name: str | None = None,
    populations: list[str] = SUPERPOPULATIONS,
) -> DataFrame:
    """Samples with genotype `1` per site and superpopulation, from long calls.

    Each population column is an array with the one count, or null when there is no
    carrier. Samples are counted, not gathered, so a site of any size aggregates
    before the shuffle.
    """
    if reference_name is not None:
        calls = calls.where(F.col("reference_name") == reference_name)
    carrier = F.col("genotype") == "1"
    counted = calls.groupBy(*KEY5, "quality", "filters").agg(
        *[
            F.count_if((F.col("SuperPopulation") == p) & carrier).alias(p)
            for p in populations
        ]
    )
    return counted.withColumns(
        {p: F.when(F.col(p) > 0, F.array(p)) for p in populations}
    )


def carriers_of_packed(
    df: DataFrame,
    metadata: DataFrame,
    reference_name: str | None = None,
    populations: list[str] = SUPERPOPULATIONS,
) -> DataFrame:
    """`carriers_by_population` for a variant table: each site is counted where it lies, at
    the array positions of a population's samples, so no call is exploded and nothing is
    shuffled. One row per site; a population without samples has no carrier."""
    df = packed(df)
    if reference_name is not None:
        df = df.where(F.col("reference_name") == reference_name)
    at = population_positions(df, metadata, populations)

    def carriers(calls: Column, population: str) -> Column:
        own = F.transform(literal_array(at.get(population, []), "int"), lambda i: F.get(calls, i))
        # all but the calls `1`, without a lambda
        known = F.array_compact(own)
        return (F.size(known) - F.size(F.array_remove(known, "1"))).cast("bigint")

    def counts(calls: Column) -> Column:
        return F.struct(*[carriers(calls, p).alias(p) for p in populations])

    site = [*KEY5, F.col("qual").alias("quality"), F.col("filter").alias("filters")]
    counted = df.select(*site, made_once(F.col(GENOTYPES), counts).alias("_counts"))
    number = {p: F.col("_counts").getField(p) for p in populations}
    return counted.select(
        *KEY5, "quality", "filters", *[F.when(n > 0, F.array(n)).alias(p) for p, n in number.items()]
    )


def reconcile_counts(
    arrays: DataFrame, populations: list[str] = SUPERPOPULATIONS
) -> DataFrame:
    """Sites whose population counts do not add up to the published count.

    Every array is unnested; the rows come in order of start.
    """
    names = [p + half for half in ("1", "2") for p in populations]
    site = ["start", "end", "reference_bases", "alternate_bases"]
    rows = arrays.select(*site, *names, "AC")
    for name in [*names, "AC"]:
        others = [c for c in rows.columns if c != name]
        rows = rows.select(*others, F.explode(name).alias(name))
    total = reduce(lambda x, y: x + y, [F.col(n) for n in names])
    wrong = rows.withColumn("AC_Fake", total).where(F.col("AC") != F.col("AC_Fake"))
    return ordered(wrong.select(*site, *names, "AC_Fake", "AC"), F.col("start"))


def ordered(df: DataFrame, *by) -> DataFrame:
    """Global sort that also spreads ties: the row's hash as last key lets the range
    partitioning split rows that are equal in `by`, in every attempt alike."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn("_tie", tie).orderBy(*by, "_tie").drop("_tie")


def rank_by_population_count(counts: DataFrame, column: str) -> DataFrame:
    """Sites with carriers, most first; equal counts in order of the variant key."""
    return ordered(
        counts.where(F.col(column) > 0), F.col(column).desc(), *[F.col(k) for k in KEY5]
    )


def pooled_frequencies(sources: dict[str, DataFrame]) -> DataFrame:
    """Allele counts and frequencies across several tables, one row per alternate.

    Alternates are split before pooling, so `A,T` in one table meets `T,A` in another,
    and only counts are shuffled, never genotypes. `af` divides by the samples of all
    tables, `af_present` by those of the tables that hold the variant, each table once
    however many of its rows give the alternate. `allele_number` sums the alleles called in
    all rows that give it. Tables that share a sample can't be pooled.
    """
    tables = {name: df if COMPACT in df.columns else packed(df) for name, df in sources.items()}
    names = [s for df in tables.values() for s in packed_samples(df)]
    everyone = len(names)
    if len(set(names)) < everyone:
        raise ValueError("a sample stands in several tables")
    pooled = (
        _union(
            [
                allele_counts(df.select(*KEY5, COMPACT if COMPACT in df.columns else GENOTYPES)).select(
                    *KEY5, "allele_count", "allele_number", "n_samples", F.lit(i).alias("_table")
                )
                for i, df in enumerate(tables.values())
            ]
        )
        .groupBy(*KEY5)
        .agg(
            F.sum("allele_count").alias("allele_count"),
            F.sum("allele_number").alias("allele_number"),
            reduce(
                lambda x, y: x + y,
                [
                    F.coalesce(F.max(F.when(F.col("_table") == i, F.col("n_samples"))), F.lit(0))
                    for i in range(len(tables))
                ],
            ).cast("long").alias("samples_present"),
        )
    )
    count = F.col("allele_count").cast("double")
    return pooled.withColumns(
        {
            "af": F.try_divide(count, F.lit(float(everyone))),
            "af_present": F.try_divide(count, F.col("samples_present").cast("double")),
            "af_called": F.try_divide(count, F.col("allele_number").cast("double")),
        }
    )


def chromosome_profile(df: DataFrame) -> DataFrame:
    """Rows and highest start position per chromosome, in one pass."""
    return df.groupBy("reference_name").agg(
        F.count("*").alias("variants"),
        F.max("start_position").alias("max_position"),
    )

"""Lookups by rsid, by gene and by population."""

import operator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.operators.columns import (
    bin_of,
    bin_width,
    level_of,
    level_widths,
    lookup_columns,
    samples_by_population,
    unpivot_calls,
)
from siteweave.operators.ranges import Coordinate, covering_ranges, starts_in_ranges
from siteweave.schema import BIN, BIN_WIDTH, LEVELS, require


# Fixed value: the id of a variant that has none.
MISSING_ID = "."

# A gene of more bins than this, longer than any chromosome at the usual width, is not dealt
# to bins.
MOST_BINS = 16_384

# Up to so many rsids are a list in the filter of the dbSNP scan, which its files can prune by.
LISTED_RSIDS = 100


def _id_table(spark: SparkSession, rsids: list[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({"id": pa.array(list(rsids), pa.string())}))


def rsid_locations(dbsnp: DataFrame, rsids: list[str] | DataFrame | None = None) -> DataFrame:
    """One row per rsid with its coordinates, `locations`, how many different places it has,
    and `rows`, how many rows name it. Several alternates at one place are one location.

    `rsids` restricts them to a list or to the `id` column of a table, of any length: what
    does not fit a filter is joined.
    """
    known = lookup_columns(dbsnp).where(F.col("id") != MISSING_ID)
    if isinstance(rsids, DataFrame):
        known = known.join(rsids.select("id"), "id", "left_semi")
    elif rsids is not None and len(rsids) <= LISTED_RSIDS:
        known = known.where(F.col("id").isin(list(rsids)))
    elif rsids is not None:
        known = known.join(_id_table(dbsnp.sparkSession, rsids), "id", "left_semi")
    place = ["reference_name", "start_position", "end_position"]
    places = known.groupBy("id", *place).agg(F.count("*").alias("rows"))
    return places.groupBy("id").agg(
        F.count("*").alias("locations"),
        F.sum("rows").alias("rows"),
        F.min("reference_name").alias("reference_name"),
        F.min("start_position").alias("lookup_start"),
        F.max("end_position").alias("lookup_end"),
    )


def ambiguous_rsids(dbsnp: DataFrame, rsids: list[str] | DataFrame | None = None) -> DataFrame:
    """rsids with more than one location, which no lookup answers."""
    return rsid_locations(dbsnp, rsids).where("locations > 1").select("id", "locations")


def rsid_location(dbsnp: DataFrame, rsid: str, strict: bool = False) -> Coordinate:
    """The one location of an rsid; unknown and ambiguous rsids are errors. With `strict` it
    must also be named by one row only."""
    found = rsid_locations(dbsnp, [rsid]).collect()  # one row at most: one rsid
    if not found:
        raise ValueError(f"unknown rsid {rsid}")
    row = found[0]
    if row["locations"] > 1 or strict and row["rows"] > 1:
        raise ValueError(f"more than one location for rsid {rsid}")
    return Coordinate(row["reference_name"], row["lookup_start"], row["lookup_end"])


def variants_by_rsid(
    df: DataFrame, dbsnp: DataFrame, rsids: list[str] | DataFrame | None = None
) -> DataFrame:
    """Variants of a set of rsids, or of every rsid with exactly one location.

    A variant must carry the rsid and start inside the looked-up location. Variants without
    an id stay out of the join. The set is a list or the `id` column of a table, of any size:
    its places are a table that is joined, and the scan of the variants is pruned by a
    bounded number of ranges that cover the places, so the plan does not grow with the set.
    """
    places = rsid_locations(dbsnp, rsids).where("locations = 1").drop("locations", "rows")
    known = df.where(F.col("id") != MISSING_ID)
    if rsids is not None:
        ranges = covering_ranges(places, "lookup_start", "lookup_end")
        if ranges is not None:
            known = known.where(starts_in_ranges(df, ranges))
    places = places.select(
        F.col("reference_name").alias("_lookup_name"),
        F.col("id").alias("_lookup_id"),
        F.col("lookup_start").alias("_lookup_start"),
        F.col("lookup_end").alias("_lookup_end"),
    )
    same = (F.col("reference_name") == F.col("_lookup_name")) & (F.col("id") == F.col("_lookup_id"))
    inside = F.col("start_position").between(F.col("_lookup_start"), F.col("_lookup_end"))
    return known.join(places, same, "inner").where(inside).select(*[F.col(f"`{c}`") for c in df.columns])


def gene_intervals(genes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One interval per gene name and chromosome, spanning all its transcripts."""
    require(genes, ["name2", "reference_name", "start_position", "end_position"])
    if names is not None:
        genes = genes.where(F.col("name2").isin(list(names)))
    return genes.groupBy(F.col("name2").alias("gene"), "reference_name").agg(
        F.min("start_position").alias("gene_start"),
        F.max("end_position").alias("gene_end"),
    )


def gene_coordinates(genes: DataFrame, name: str) -> list[Coordinate]:
    """Where one gene lies: a row per chromosome it is known on."""
    rows = gene_intervals(genes, [name]).collect()  # one gene: a row per contig
    if not rows:
        raise ValueError(f"unknown gene {name}")
    return sorted(Coordinate(*row[1:]) for row in rows)


def _gene_bins(low: Column, high: Column, width: int) -> Column:
    return bin_of(high, width) - bin_of(low, width)


def variants_by_gene(
    df: DataFrame,
    genes: DataFrame,
    names: list[str] | None = None,
    overlap: bool = False,
    gene_column: str | None = None,
) -> DataFrame:
    """Variants inside a set of genes, each with its gene.

    A variant belongs to a gene when it starts inside it, or, with `overlap`, when the
    two intervals share a position. Both sides meet on (chromosome, bin), so the interval
    condition never compares a whole chromosome. For overlaps the bins come in levels,
    LEVEL_FACTOR times wider each: a variant lies in the first level whose bin is as wide as
    itself, in one row, and only a gene is repeated, for the bins that it may reach. A gene
    of more than MOST_BINS bins holds whole chromosomes and meets them by name alone; one
    small job over the genes tells whether there is any.

    The gene's name is in `gene_column`: `gene`, or `lookup_gene` where the table has a
    column `gene` itself.
    """
    taken = {c.lower() for c in df.columns}
    if gene_column is None:
        gene_column = "lookup_gene" if "gene" in taken else "gene"
    if gene_column.lower() in taken:
        raise ValueError(f"the table has a column {gene_column} already")
    width = bin_width(df) or BIN_WIDTH
    low, high = F.least("gene_start", "gene_end"), F.greatest("gene_start", "gene_end")
    known = (
        gene_intervals(genes, names)
        .where("gene_start IS NOT NULL AND gene_end IS NOT NULL")
        .select(
            F.col("gene").alias("_gene"),
            F.col("reference_name").alias("_gene_name"),
            F.col("gene_start").alias("_gene_start"),
            F.col("gene_end").alias("_gene_end"),
            low.alias("_gene_low"),
            high.alias("_gene_high"),
            (_gene_bins(low, high, width) > MOST_BINS).alias("_gene_huge"),
        )
    )
    huge = known.where("_gene_huge")
    find = _overlapping if overlap else _starting_inside
    found = find(df, known.where("NOT _gene_huge"), width)
    start, end = F.col("start_position"), F.col("end_position")
    if not huge.isEmpty():
        meets = (start <= F.col("_gene_end")) & (end >= F.col("_gene_start"))
        if not overlap:
            meets = start.between(F.col("_gene_start"), F.col("_gene_end"))
        met = df.join(huge, F.col("reference_name") == F.col("_gene_name"), "inner").where(meets)
        found = found.unionByName(met.select(*[F.col(f"`{c}`") for c in df.columns], "_gene"))
    return found.withColumnRenamed("_gene", gene_column)


def _starting_inside(df: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    start = F.col("start_position")
    bins = F.sequence(bin_of(F.col("_gene_low"), width), bin_of(F.col("_gene_high"), width))
    spans = genes.select("*", F.explode(bins).alias("_gene_bin"))
    known = F.col(BIN) if bin_width(df) else bin_of(start, width)
    inside = start.between(F.col("_gene_start"), F.col("_gene_end"))
    same = (F.col("reference_name") == F.col("_gene_name")) & (F.col("_variant_bin") == F.col("_gene_bin"))
    met = df.withColumn("_variant_bin", known.cast("bigint")).join(spans, same, "inner").where(inside)
    return met.select(*[F.col(f"`{c}`") for c in df.columns], "_gene")


def _overlapping(df: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    start, end = F.col("start_position"), F.col("end_position")
    widths = level_widths(width)
    level, low = level_of(start, end, width), F.least(start, end)
    first = F.lit(0).cast("bigint")
    for k, w in enumerate(widths):
        first = F.when(level == k, bin_of(low, w)).otherwise(first)
    sites = df.where(start.isNotNull() & end.isNotNull()).withColumns({"_variant_level": level, "_variant_bin": first})

    def placed(k: int, w: int):
        # a variant of this level begins in the gene's bins or in the one before them
        bins = F.sequence(bin_of(F.col("_gene_low"), w) - 1, bin_of(F.col("_gene_high"), w))
        return F.transform(bins, lambda b: F.struct(F.lit(k).alias("_gene_level"), b.alias("_gene_bin")))

    at = [placed(k, w) for k, w in enumerate(widths)]
    # the last level is one bin: what is longer than any chromosome meets each of its genes
    last = F.struct(F.lit(LEVELS).alias("_gene_level"), F.lit(0).cast("bigint").alias("_gene_bin"))
    spans = genes.select("*", F.inline(F.concat(*at, F.array(last))))
    same = [
        F.col("reference_name") == F.col("_gene_name"),
        F.col("_variant_level") == F.col("_gene_level"),
        F.col("_variant_bin") == F.col("_gene_bin"),
    ]
    meets = (start <= F.col("_gene_end")) & (end >= F.col("_gene_start"))
    met = sites.join(spans, reduce(operator.and_, same), "inner").where(meets)
    return met.select(*[F.col(f"`{c}`") for c in df.columns], "_gene")


def calls_with_population(
    df: DataFrame,
    metadata: DataFrame,
    populations: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Long calls, each with the superpopulation of its sample."""
    people = samples_by_population(metadata, populations).select(
        F.col("sample").alias("call_set_name"), "superpopulation"
    )
    return unpivot_calls(df, keep).join(people, "call_set_name", "inner")

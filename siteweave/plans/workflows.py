"""The questions a user asks, as whole plans."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.operators.aggregates import (
    count_variants,
    stat_variants,
    superpopulation_counts,
)
from siteweave.operators.alleles import allele_report
from siteweave.operators.filters import VariantFilter, filter_any
from siteweave.operators.joins import annotate_variants
from siteweave.operators.lookups import gene_coordinates, rsid_location
from siteweave.sources.sinks import variant_envelope, write_counted_json



def _resolve(
    where: VariantFilter,
    gene: str | None,
    genes: DataFrame | None,
    rsid: str | None,
    dbsnp: DataFrame | None,
) -> list[VariantFilter]:
    """The filters to apply, with gene or rsid turned into coordinates.

    A gene known on several chromosomes gives one filter for each.
    """
    if gene is not None:
        if genes is None:
            raise ValueError("a gene needs the gene table")
        if rsid is not None or any(
            x is not None for x in (where.reference_name, where.start_position, where.end_position)
        ):
            raise ValueError("a gene cannot be mixed with coordinates or an rsid")
        return [
            replace(
                where,
                reference_name=at.reference_name,
                start_position=at.start_position,
                end_position=at.end_position,
                position_range=True,
            )
            for at in gene_coordinates(genes, gene)
        ]
    if rsid is not None:
        where = replace(where, rsid=rsid)
        known = (where.reference_name, where.start_position, where.end_position)
        if any(x is None for x in known):
            if dbsnp is None:
                raise ValueError("an rsid without full coordinates needs the rsid table")
            at = rsid_location(dbsnp, rsid)
            where = replace(
                where,
                reference_name=at.reference_name if known[0] is None else known[0],
                start_position=at.start_position if known[1] is None else known[1],
                end_position=at.end_position if known[2] is None else known[2],
            )
    return [where]


def _variant_filters(
    where: VariantFilter,
    gene: str | None,
    rsid: str | None,
    genes: DataFrame | None,
    dbsnp: DataFrame | None,
) -> list[VariantFilter]:
    """The filters of a variant question, which must name a place, a gene or an rsid."""
    rsid = rsid or where.rsid
    if gene is None and rsid is None:
        if where.reference_name is None:
            raise ValueError("give an rsid, a gene or a reference name")
        if where.start_position is None and where.end_position is None:
            raise ValueError("give a start or an end position")
    return _resolve(where, gene, genes, rsid, dbsnp)


def _filtered(df: DataFrame, wheres: list[VariantFilter]) -> DataFrame:
    """Rows of any of the filters, in one scan."""
    return filter_any(df, wheres)


def _tagged(parts: dict[str, DataFrame]) -> DataFrame:
    tagged = [df.select(F.lit(name).alias("source"), "*") for name, df in parts.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)


def stat(
    sources: dict[str, DataFrame],
    where: VariantFilter = VariantFilter(),
    gene: str | None = None,
    genes: DataFrame | None = None,
) -> DataFrame:
    """Is there a matching variant, per source?"""
    wheres = _resolve(where, gene, genes, None, None)
    if len(wheres) == 1:
        return stat_variants(sources, wheres[0])
    matched = {name: _filtered(df, wheres) for name, df in sources.items()}
    return stat_variants(matched, VariantFilter())


def count(
    sources: dict[str, DataFrame],
    where: VariantFilter = VariantFilter(),
) -> DataFrame:
    """How many variants match, per source?"""
    return count_variants(sources, where)


def variants(
    sources: dict[str, DataFrame],
    where: VariantFilter = VariantFilter(),
    gene: str | None = None,
    rsid: str | None = None,
    genes: DataFrame | None = None,
    dbsnp: DataFrame | None = None,
) -> DataFrame:
    """Matching variants of every source, one row per alternate, with allele count and
    frequency, labelled by source."""
    wheres = _variant_filters(where, gene, rsid, genes, dbsnp)
    return _tagged(
        {name: allele_report(_filtered(df, wheres)) for name, df in sources.items()}
    )


def variants_envelope(
    sources: dict[str, DataFrame],
    where: VariantFilter = VariantFilter(),
    gene: str | None = None,
    rsid: str | None = None,
    genes: DataFrame | None = None,
    dbsnp: DataFrame | None = None,
) -> DataFrame:
    """What `variants` would answer, without the rows: one row per source with the
    number of matching sites and the headers."""
    wheres = _variant_filters(where, gene, rsid, genes, dbsnp)
    return reduce(
        DataFrame.unionByName,
        [
            variant_envelope(_filtered(df, wheres), name, "variants")
            for name, df in sources.items()
        ],
    )


def write_variants(
    sources: dict[str, DataFrame],
    path: str,
    where: VariantFilter = VariantFilter(),
    gene: str | None = None,
    rsid: str | None = None,
    genes: DataFrame | None = None,
    dbsnp: DataFrame | None = None,
) -> DataFrame:
    """Write what `variants` answers as JSON lines, a folder per source under `path`, and
    return what `variants_envelope` does: each source is read once for both."""
    wheres = _variant_filters(where, gene, rsid, genes, dbsnp)
    return reduce(
        DataFrame.unionByName,
        [
            write_counted_json(_filtered(df, wheres), f"{path}/{name}", name, "variants")
            for name, df in sources.items()
        ],
    )


def annotate(
    variants: DataFrame,
    annotation: DataFrame,
    where: VariantFilter = VariantFilter(),
    gene: str | None = None,
    rsid: str | None = None,
    genes: DataFrame | None = None,
    dbsnp: DataFrame | None = None,
    prune: bool = False,
) -> DataFrame:
    """Variants that match, each with its annotation rows or nulls.

    Both tables are filtered before they meet; with `prune` the annotation is also read only
    where there are variants (see `annotate_variants`). An annotation table without rsids is
    filtered by the rsid's coordinates alone.
    """
    rsid = rsid or where.rsid
    by_place = any(
        x is not None
        for x in (
            where.reference_name,
            where.start_position,
            where.end_position,
            where.reference_bases,
            where.alternate_bases,
        )
    )
    if sum([gene is not None, rsid is not None, by_place]) > 1:
        raise ValueError("gene, rsid and coordinates exclude one another")
    wheres = _resolve(where, gene, genes, rsid, dbsnp)
    has_id = "id" in {c.lower() for c in annotation.columns}
    sides = wheres if has_id else [replace(w, rsid=None) for w in wheres]
    return annotate_variants(_filtered(variants, wheres), _filtered(annotation, sides), prune=prune)


def superpopulation_counts_by_gene(
    sources: dict[str, DataFrame],
    metadata: DataFrame,
    gene: str,
    genes: DataFrame,
    populations: list[str] | None = None,
) -> DataFrame:
    """Non-reference alleles per SNP of a gene and superpopulation, per source."""
    wheres = _resolve(VariantFilter(), gene, genes, None, None)
    return _tagged(
        {
            name: superpopulation_counts(_filtered(df, wheres), metadata, populations)
            for name, df in sources.items()
        }
    )

from siteweave.operators.aggregates import (
    carriers_by_population,
    carriers_of_packed,
    chromosome_profile,
    count_contained,
    count_variants,
    count_where,
    pooled_frequencies,
    rank_by_population_count,
    reconcile_counts,
    stat_variants,
    superpopulation_counts,
)
from siteweave.operators.alleles import (
    allele_counts,
    allele_frequencies,
    allele_report,
    split_alternates,
    tally_alleles,
)
from siteweave.operators.columns import (
    compact_genotypes,
    drop_by_suffix,
    drop_layout,
    expand_genotypes,
    lookup_columns,
    merge_columns,
    normalise_raw,
    pack_samples,
    packed_samples,
    sample_columns,
    samples_by_population,
    star_except,
    unpivot_calls,
    variant_columns,
    wide,
    with_bin,
    with_level,
)
from siteweave.operators.filters import (
    VariantFilter,
    drop_copy_number,
    filter_any,
    filter_carried,
    filter_contained,
    filter_overlap,
    filter_population,
    filter_snp,
    filter_variants,
)
from siteweave.operators.joins import (
    annotate_allele_match,
    annotate_variants,
    join_published_counts,
    join_variants,
    merge_halves,
    merge_halves_without_end,
)
from siteweave.operators.lookups import (
    ambiguous_rsids,
    calls_with_population,
    gene_coordinates,
    gene_intervals,
    rsid_location,
    rsid_locations,
    variants_by_gene,
    variants_by_rsid,
)
from siteweave.operators.standardise import (
    standard_from_json,
    standard_to_json,
    standardise_columns,
    standardise_keyed_info,
    standardise_positional_info,
)
from siteweave.operators.validate import validate_outcomes, validate_variants, with_errors

__all__ = [name for name in dir() if not name.startswith("_")]

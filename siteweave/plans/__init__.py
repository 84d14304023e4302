from siteweave.plans.workflows import (
    annotate,
    count,
    stat,
    superpopulation_counts_by_gene,
    variants,
    variants_envelope,
    write_variants,
)

__all__ = ["annotate", "count", "stat", "superpopulation_counts_by_gene", "variants", "variants_envelope", "write_variants"]

from siteweave.functions.alternates import alternates, is_copy_number
from siteweave.functions.genotypes import (
    allele_indices,
    carried_alleles,
    carried_by,
    not_hom_ref,
)
from siteweave.functions.info import (
    after_last_dash,
    keyed_values,
    plain_decimal,
    positional_values,
)
from siteweave.functions.jsontext import record_from_json, record_to_json

__all__ = [
    "after_last_dash",
    "allele_indices",
    "alternates",
    "carried_alleles",
    "carried_by",
    "is_copy_number",
    "keyed_values",
    "not_hom_ref",
    "plain_decimal",
    "positional_values",
    "record_from_json",
    "record_to_json",
]

from siteweave.sources.layout import (
    append_chromosome,
    bucket_count,
    rebin,
    replace_chromosome,
    write_binned,
    write_bucketed,
    write_clustered,
)
from siteweave.sources.readers import (
    read_annotation,
    read_bucketed,
    read_clean,
    read_import_csv,
    read_import_parquet,
    read_lookup,
    read_raw_vcf_csv,
    read_records,
    read_rejected,
    read_sharded_dir,
    read_string_csv,
    read_variants,
    read_variants_csv,
    stored_profile,
)
from siteweave.sources.sinks import (
    result_envelope,
    variant_envelope,
    write_counted_json,
    write_outcomes,
    write_result,
    write_standard_csv,
    write_table_json,
    write_vcf_json,
)

__all__ = [
    "append_chromosome",
    "bucket_count",
    "read_annotation",
    "read_bucketed",
    "read_clean",
    "read_import_csv",
    "read_import_parquet",
    "read_lookup",
    "read_raw_vcf_csv",
    "read_records",
    "read_rejected",
    "read_sharded_dir",
    "read_string_csv",
    "read_variants",
    "read_variants_csv",
    "rebin",
    "replace_chromosome",
    "result_envelope",
    "stored_profile",
    "variant_envelope",
    "write_binned",
    "write_bucketed",
    "write_clustered",
    "write_counted_json",
    "write_outcomes",
    "write_result",
    "write_standard_csv",
    "write_table_json",
    "write_vcf_json",
]

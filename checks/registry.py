"""Every operator as a query over the driver's tables, with its DuckDB counterpart.

The SQL is written apart from the Spark expressions: genotypes are unnested and counted
there, where Spark uses array functions.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import (
    ARRAY_NAMES,
    POPULATION_OF,
    POPULATIONS,
    SAMPLES1,
    SAMPLES2,
    ctes,
    fixture,
)
from checks.scratch import new_path, new_table
from siteweave import operators as op
from siteweave import plans, sources
from siteweave.functions.info import plain_decimal
from siteweave.operators.filters import VariantFilter
from siteweave.schema import KEY5, STANDARD, VCF_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return register


KEY = ", ".join(KEY5)
V8 = ", ".join(VCF_COLUMNS[:8])
CELLS1 = ", ".join(SAMPLES1)
CELLS2 = ", ".join(SAMPLES2)


def half1(spark, sf):
    return fixture(spark, sf, "half1")


def both(spark, sf):
    return {n: fixture(spark, sf, n) for n in ("half1", "half2")}


def as_json(df: DataFrame, *names: str) -> DataFrame:
    """Array columns as text, which both engines compare alike."""
    return df.withColumns({n: F.to_json(n) for n in names})


# --- DuckDB building blocks ------------------------------------------------------


def sql_calls(table: str, samples: list[str]) -> str:
    """Long calls: one row per site and sample."""
    names = ", ".join(f"'{s}'" for s in samples)
    return (
        f"SELECT {V8}, unnest([{names}]) AS sample, unnest([{', '.join(samples)}]) AS gt "
        f"FROM {table}"
    )


def sql_alts(table: str, columns: str = V8) -> str:
    """One row per alternate with its index."""
    return (
        f"SELECT {columns}, unnest(string_split(alternate_bases, ',')) AS one_alt, "
        f"unnest(range(1, len(string_split(alternate_bases, ',')) + 1)) AS i FROM {table}"
    )


def sql_alleles(table: str, samples: list[str], extra: str = "") -> str:
    """Per alternate: count, called alleles and both frequencies."""
    return f"""
    SELECT a.reference_name, a.start_position, a.end_position, a.id, a.reference_bases,
           a.one_alt AS alternate_bases, a.qual, a.filter,
           count(*) FILTER (p.idx = a.i) AS allele_count,
           count(*) FILTER (p.idx = 0) AS reference_count,
           count(*) FILTER (p.idx BETWEEN 0 AND len(string_split(a.alternate_bases, ','))) AS allele_number,
           count(*) FILTER (p.idx > len(string_split(a.alternate_bases, ',')) OR p.idx < 0) AS bad_calls,
           CAST({len(samples)} AS BIGINT) AS n_samples
    FROM ({sql_alts(table)}) a
    JOIN (SELECT reference_name, start_position, TRY_CAST(unnest(string_split(gt, '|')) AS BIGINT) AS idx
          FROM ({sql_calls(table, samples)}) c) p
      ON p.reference_name = a.reference_name AND p.start_position = a.start_position
    {extra}
    GROUP BY a.reference_name, a.start_position, a.end_position, a.id, a.reference_bases,
             a.one_alt, a.i, a.alternate_bases, a.qual, a.filter"""


REPORT = (
    "reference_name, start_position, end_position, id, reference_bases, alternate_bases, "
    "allele_count, CAST(allele_count AS DOUBLE) / n_samples AS af"
)


def sql_report(table: str, samples: list[str], extra: str = "") -> str:
    return f"SELECT {REPORT} FROM ({sql_alleles(table, samples, extra)}) r"


# --- sources and sinks -------------------------------------------------------------

WIDE1 = f"{ctes('half1')} SELECT {V8}, {CELLS1}, bin_id FROM half1"
WIDE1_TEXT_BIN = (
    f"{ctes('half1')} SELECT {V8}, {CELLS1}, CAST(bin_id AS VARCHAR) AS bin_id FROM half1"
)


@query("read_variants", WIDE1)
def _(spark, sf):
    path = new_path(spark)
    half1(spark, sf).write.parquet(path)
    return op.wide(sources.read_variants(spark, path, bin_width=62500))


@query("read_variants_by_chromosome", WIDE1)
def _(spark, sf):
    path = new_path(spark)
    half1(spark, sf).repartition("reference_name").write.partitionBy("reference_name").parquet(path)
    return op.wide(sources.read_variants(spark, path))


@query("read_annotation", f"{ctes('ann')} SELECT * FROM ann")
def _(spark, sf):
    path = new_path(spark)
    text = {p: F.col(p).cast("string") for p in ("start_position", "end_position")}
    fixture(spark, sf, "ann").withColumns(text).write.parquet(path)
    return sources.read_annotation(spark, path)


@query("read_variants_csv", WIDE1_TEXT_BIN)
def _(spark, sf):
    path = new_path(spark)
    df = half1(spark, sf)
    df.write.option("compression", "gzip").csv(path)
    return sources.read_variants_csv(spark, path, df.columns, partitions=8, pack=False)


@query("read_import_csv", WIDE1_TEXT_BIN)
def _(spark, sf):
    path = new_path(spark)
    df = half1(spark, sf)
    sources.write_result(df, path, "csv")
    return sources.read_import_csv(spark, path, df.columns)


@query("read_import_parquet", WIDE1)
def _(spark, sf):
    path = new_path(spark)
    sources.write_result(half1(spark, sf), path)
    return sources.read_import_parquet(spark, path)


@query(
    "read_string_csv",
    f"{ctes('ann')} SELECT reference_name, CAST(start_position AS VARCHAR) AS start_position, "
    "CAST(end_position AS VARCHAR) AS end_position, reference_bases, alternate_bases, "
    "note FROM ann",
)
def _(spark, sf):
    path = new_path(spark)
    df = fixture(spark, sf, "ann").drop("score")
    df.write.csv(path)
    return sources.read_string_csv(spark, path, df.columns)


@query(
    "read_raw_vcf_csv",
    f"{ctes('gnomad_raw')} SELECT reference_name, CAST(start_position AS VARCHAR) AS start_position, "
    "CAST(end_position AS VARCHAR) AS end_position, reference_bases, alternate_bases, qual, info "
    "FROM gnomad_raw",
)
def _(spark, sf):
    path = new_path(spark)
    df = fixture(spark, sf, "gnomad_raw")
    df.toDF(*[c.upper() for c in df.columns]).write.option("header", True).csv(path)
    return sources.read_raw_vcf_csv(spark, path)


@query("read_lookup", f"{ctes('dbsnp')} SELECT * FROM dbsnp")
def _(spark, sf):
    path = new_path(spark)
    fixture(spark, sf, "dbsnp").write.parquet(path)
    return sources.read_lookup(spark, path)


@query("read_sharded_dir", f"{ctes('ann')} SELECT * FROM ann UNION ALL SELECT * FROM ann")
def _(spark, sf):
    path = new_path(spark)
    df = fixture(spark, sf, "ann")
    for _ in range(2):
        sources.write_result(df.repartition(3), path, mode="append")
    return sources.read_sharded_dir(spark, path)


@query("write_result_parquet", f"{ctes('ann')} SELECT * FROM ann")
def _(spark, sf):
    path = new_path(spark)
    sources.write_result(fixture(spark, sf, "ann"), path)
    return spark.read.parquet(path)


@query(
    "write_result_csv",
    f"{ctes('ann')} SELECT {KEY}, CAST(score AS DOUBLE) AS score, note FROM ann",
)
def _(spark, sf):
    path = new_path(spark)
    df = fixture(spark, sf, "ann")
    sources.write_result(df, path, "csv")
    return spark.read.option("header", True).schema(df.schema).csv(path)


@query("write_result_table", f"{ctes('ann')} SELECT * FROM ann")
def _(spark, sf):
    path, name = new_path(spark), new_table()
    sources.write_result(fixture(spark, sf, "ann"), name, "table", location=path)
    rows = spark.table(name)
    # the files at the location stay
    spark.sql(f"DROP TABLE {name}")
    return rows


BINNED = (
    f"{ctes('half1')} SELECT {V8}, {CELLS1}, "
    "CAST(start_position // 100000 AS BIGINT) AS bin_id FROM half1"
)


@query("write_binned", BINNED)
def _(spark, sf):
    path = new_path(spark)
    sources.write_binned(half1(spark, sf), path, width=100000)
    return op.wide(sources.read_variants(spark, path))


@query("append_chromosome", WIDE1)
def _(spark, sf):
    path = new_path(spark)
    df = half1(spark, sf)
    for _ in range(2):  # the second run must not double the rows
        sources.append_chromosome(df, path)
    return op.wide(sources.read_variants(spark, path))


RAW_CLEAN = (
    "SELECT reference_name, TRY_CAST(pos AS BIGINT) AS start_position, "
    "TRY_CAST(pos AS BIGINT) + length(ref) AS end_position, id, ref AS reference_bases, "
    "alt AS alternate_bases, qual, filter FROM raw"
)


@query("write_clustered", f"{ctes('raw')} {RAW_CLEAN}")
def _(spark, sf):
    path = new_path(spark)
    sources.write_clustered(fixture(spark, sf, "raw"), path)
    return spark.read.parquet(path)


@query("rebin", f"{ctes('raw')} SELECT *, CAST(start_position // 62500 AS BIGINT) AS bin_id FROM ({RAW_CLEAN})")
def _(spark, sf):
    given, path = new_path(spark), new_path(spark)
    fixture(spark, sf, "raw").write.parquet(given)
    sources.rebin(spark, given, path)
    return sources.read_variants(spark, path, pack=False)


@query("write_vcf_json", f"{ctes('half1')} {sql_report('half1', SAMPLES1)}")
def _(spark, sf):
    path = new_path(spark)
    df = half1(spark, sf)
    sources.write_vcf_json(df, path)
    return spark.read.schema(op.allele_report(df).schema).json(path)


@query("write_table_json", f"{ctes('ann')} SELECT * FROM ann")
def _(spark, sf):
    path = new_path(spark)
    df = fixture(spark, sf, "ann")
    sources.write_table_json(df, path)
    return spark.read.schema(df.schema).json(path)


@query(
    "result_envelope",
    f"{ctes('half1')} SELECT 'half1' AS source, 'variants' AS \"table\", count(*) AS data_count, "
    "'[\"reference_name\",\"start_position\",\"end_position\",\"id\",\"reference_bases\","
    "\"alternate_bases\",\"allele_count\",\"af\"]' AS headers FROM half1",
)
def _(spark, sf):
    return as_json(sources.variant_envelope(half1(spark, sf), "half1", "variants"), "headers")


@query(
    "write_standard_csv",
    f"{ctes('standard')} SELECT reference_name AS \"REFERENCE_NAME\", "
    "CAST(start_position AS VARCHAR) AS \"START_POSITION\", CAST(end_position AS VARCHAR) AS \"END_POSITION\", "
    "reference_bases AS \"REFERENCE_BASES\", alternate_bases AS \"ALTERNATE_BASES\", "
    "CASE WHEN minor_af = 0 THEN '0' ELSE CAST(minor_af AS VARCHAR) END AS \"MINOR_AF\", "
    "CAST(allele_count AS VARCHAR) AS \"ALLELE_COUNT\" FROM standard",
)
def _(spark, sf):
    path = new_path(spark)
    sources.write_standard_csv(fixture(spark, sf, "standard"), path)
    return spark.read.option("header", True).csv(path)


# --- projections -------------------------------------------------------------------


@query("pack_samples", WIDE1)
def _(spark, sf):
    return op.wide(op.pack_samples(half1(spark, sf)))


@query(
    "sample_columns",
    f"{ctes('half1')} SELECT {KEY}, 10 AS samples, s01 AS first_call, s10 AS last_call FROM half1",
)
def _(spark, sf):
    df = op.pack_samples(half1(spark, sf))
    calls = F.col("genotypes")
    return df.select(
        *KEY5,
        F.size(calls).alias("samples"),
        F.get(calls, 0).alias("first_call"),
        F.element_at(calls, -1).alias("last_call"),
    )


@query("variant_columns", f"{ctes('half1')} SELECT {V8} FROM half1")
def _(spark, sf):
    return op.variant_columns(half1(spark, sf))


@query("drop_layout", f"{ctes('half1')} SELECT {V8}, {CELLS1} FROM half1")
def _(spark, sf):
    return op.drop_layout(half1(spark, sf))


@query("drop_by_suffix", f"{ctes('ann')} SELECT * FROM ann")
def _(spark, sf):
    df = fixture(spark, sf, "ann")
    return op.drop_by_suffix(
        df.withColumns({"day_please_ignore": F.current_date(), "x_ignore": F.lit(1)})
    )


@query("star_except", f"{ctes('ann')} SELECT * EXCLUDE ({KEY}) FROM ann")
def _(spark, sf):
    return op.star_except(fixture(spark, sf, "ann"))


@query("normalise_raw", f"{ctes('raw')} {RAW_CLEAN}")
def _(spark, sf):
    return op.normalise_raw(fixture(spark, sf, "raw"))


@query("with_bin", f"{ctes('half1')} SELECT {V8}, {CELLS1}, CAST(start_position // 50000 AS BIGINT) AS bin_id FROM half1")
def _(spark, sf):
    return op.with_bin(half1(spark, sf), 50000)


@query(
    "merge_columns",
    f"{ctes('half1', 'half2')} SELECT a.*, {CELLS2} FROM half1 a "
    f"JOIN half2 b USING ({KEY})",
)
def _(spark, sf):
    a, b = half1(spark, sf), fixture(spark, sf, "half2")
    return op.join_variants(a, b, "inner")


@query(
    "samples_by_population",
    f"{ctes('samples')} SELECT \"SuperPopulation\" AS superpopulation, 'half1' AS half, "
    "unnest(string_split(\"Half1\", ',')) AS sample FROM samples UNION ALL "
    "SELECT \"SuperPopulation\", 'half2', unnest(string_split(\"Half2\", ',')) FROM samples",
)
def _(spark, sf):
    return op.samples_by_population(fixture(spark, sf, "samples"))


@query(
    "unpivot_calls",
    f"{ctes('half1')} SELECT {KEY}, sample AS call_set_name, gt AS genotype "
    f"FROM ({sql_calls('half1', SAMPLES1)})",
)
def _(spark, sf):
    return op.unpivot_calls(half1(spark, sf), KEY5)


@query(
    "lookup_columns",
    f"{ctes('dbsnp')} SELECT chrm AS reference_name, \"start\" AS start_position, "
    "\"end\" AS end_position, base AS reference_bases, alt AS alternate_bases, \"ID\" AS id FROM dbsnp",
)
def _(spark, sf):
    return op.lookup_columns(fixture(spark, sf, "dbsnp"))


# --- filters -----------------------------------------------------------------------

GENE0 = VariantFilter(reference_name="1", start_position=0, end_position=3999999)


def filtered(name: str, where: VariantFilter, condition: str, width: int | None = None):
    @query(name, f"{ctes('half1')} SELECT {V8}, {CELLS1}, bin_id FROM half1 WHERE {condition}")
    def _(spark, sf):
        return op.filter_variants(half1(spark, sf), where, width)


filtered(
    "filter_variants",
    VariantFilter("2", 0, 100_000_000, reference_bases="C", alternate_bases="G"),
    "reference_name = '2' AND start_position BETWEEN 0 AND 100000000 "
    "AND reference_bases = 'C' AND alternate_bases = 'G'",
)
filtered("filter_none", VariantFilter(), "true")
filtered("filter_reference", VariantFilter("X"), "reference_name = 'X'")
filtered(
    "filter_range",
    VariantFilter(start_position=3_000_000, end_position=9_000_000),
    "start_position BETWEEN 3000000 AND 9000000",
)
filtered(
    "filter_range_open",
    VariantFilter("7", end_position=50_000_000),
    "reference_name = '7' AND start_position <= 50000000",
)
filtered(
    "filter_exact",
    VariantFilter("5", 4 * 7919, 4 * 7919 + 1, position_range=False),
    "reference_name = '5' AND start_position = 31676 AND end_position = 31677",
)
filtered(
    "filter_operators",
    VariantFilter(
        start_position=1_000_000,
        end_position=90_000_000,
        position_range=False,
        start_operator=">",
        end_operator="<>",
    ),
    "start_position > 1000000 AND end_position <> 90000000",
)
filtered(
    "filter_bin_pruned",
    VariantFilter("1", 1_000_000, 90_000_000),
    "reference_name = '1' AND start_position BETWEEN 1000000 AND 90000000 "
    "AND bin_id BETWEEN 16 AND 1440",
    width=62500,
)
filtered(
    "filter_bases",
    VariantFilter(reference_bases="AC", alternate_bases="G"),
    "reference_bases = 'AC' AND alternate_bases = 'G'",
)
filtered("filter_rsid", VariantFilter(rsid="rs77"), "id = 'rs77'")
filtered("filter_alternate_list", VariantFilter(alternate_bases="GA,T"), "alternate_bases = 'GA,T'")
filtered("filter_symbolic_alternate", VariantFilter(alternate_bases="<CN2>"), "alternate_bases = '<CN2>'")


@query(
    "filter_minor_af",
    f"{ctes('standard')} SELECT * FROM standard WHERE minor_af BETWEEN "
    "CAST(0.25 AS DOUBLE) AND CAST(0.75 AS DOUBLE)",
)
def _(spark, sf):
    where = VariantFilter(minor_af=0.5, minor_af_margin=0.5)
    return op.filter_variants(fixture(spark, sf, "standard"), where)


@query(
    "filter_overlap",
    f"{ctes('half1')} SELECT {V8}, {CELLS1}, bin_id FROM half1 WHERE reference_name = '1' AND "
    "((start_position BETWEEN 190056 AND 40000000) OR (end_position BETWEEN 190056 AND 40000000) "
    "OR (start_position < 190056 AND end_position > 40000000))",
)
def _(spark, sf):
    return op.filter_overlap(half1(spark, sf), "1", 190_056, 40_000_000)


@query(
    "filter_contained",
    f"{ctes('half1')} SELECT {V8}, {CELLS1}, bin_id FROM half1 "
    "WHERE start_position >= 190057 AND end_position <= 40000001",
)
def _(spark, sf):
    return op.filter_contained(half1(spark, sf), start=190_057, end=40_000_001)


@query(
    "filter_snp",
    f"{ctes('half1')} SELECT {V8}, {CELLS1}, bin_id FROM half1 "
    "WHERE length(reference_bases) = 1 AND length(alternate_bases) = 1",
)
def _(spark, sf):
    return op.filter_snp(half1(spark, sf))


@query(
    "drop_copy_number",
    f"{ctes('thousand_raw')} SELECT * FROM thousand_raw "
    "WHERE NOT regexp_full_match(alternate_bases, '<CN[0-9]+>')",
)
def _(spark, sf):
    return op.drop_copy_number(fixture(spark, sf, "thousand_raw"))


LONG_POPULATION = (
    f"SELECT {KEY}, sample AS call_set_name, gt AS genotype, superpopulation "
    f"FROM ({sql_calls('half1', SAMPLES1)}) c JOIN ("
    "SELECT \"SuperPopulation\" AS superpopulation, unnest(string_split(\"Half1\", ',')) AS sample "
    "FROM metadata) m USING (sample)"
)


@query(
    "filter_population",
    f"{ctes('half1', 'metadata')} SELECT * FROM ({LONG_POPULATION}) WHERE superpopulation IN ('AFR', 'EAS')",
)
def _(spark, sf):
    calls = op.calls_with_population(half1(spark, sf), fixture(spark, sf, "metadata"), keep=KEY5)
    return op.filter_population(calls, "AFR,EAS")


SQL_VALID = (
    "regexp_full_match(reference_name, '([1-9]|1[0-9]|2[0-2]|X|Y)') "
    "AND regexp_full_match(pos, '[+-]?[0-9]+') AND regexp_full_match(ref, '[ACGT]*') "
    "AND regexp_full_match(alt, '[ACGT]*')"
)
RAW_TEXT = (
    "SELECT reference_name, pos AS start_position, pos AS end_position, id, ref AS reference_bases, "
    "alt AS alternate_bases, qual, filter"
)


def raw_text(spark, sf):
    """Raw rows under variant names, positions still text."""
    raw = fixture(spark, sf, "raw")
    return raw.select(
        "reference_name",
        F.col("pos").alias("start_position"),
        F.col("pos").alias("end_position"),
        "id",
        F.col("ref").alias("reference_bases"),
        F.col("alt").alias("alternate_bases"),
        "qual",
        "filter",
    )


@query(
    "validate_variants",
    f"{ctes('raw')} SELECT * REPLACE (CAST(start_position AS BIGINT) AS start_position, "
    f"CAST(end_position AS BIGINT) AS end_position) FROM ({RAW_TEXT} FROM raw WHERE {SQL_VALID})",
)
def _(spark, sf):
    return op.validate_variants(raw_text(spark, sf)).clean


@query(
    "validate_quarantine",
    f"{ctes('raw')} {RAW_TEXT}, to_json(list_filter(["
    "CASE WHEN NOT regexp_full_match(reference_name, '([1-9]|1[0-9]|2[0-2]|X|Y)') THEN 'reference_name' END, "
    "CASE WHEN NOT regexp_full_match(pos, '[+-]?[0-9]+') THEN 'start_position' END, "
    "CASE WHEN NOT regexp_full_match(pos, '[+-]?[0-9]+') THEN 'end_position' END, "
    "CASE WHEN NOT regexp_full_match(ref, '[ACGT]*') THEN 'reference_bases' END, "
    "CASE WHEN NOT regexp_full_match(alt, '[ACGT]*') THEN 'alternate_bases' END], "
    f"lambda x: x IS NOT NULL))::VARCHAR AS errors FROM raw WHERE NOT ({SQL_VALID})",
)
def _(spark, sf):
    return as_json(op.validate_variants(raw_text(spark, sf)).rejected, "errors")


# --- alleles -----------------------------------------------------------------------


@query("split_alternates", f"{ctes('ann')} SELECT * REPLACE (unnest(string_split(alternate_bases, ',')) AS alternate_bases), CAST(unnest(range(1, len(string_split(alternate_bases, ',')) + 1)) AS INTEGER) AS allele_index FROM ann")
def _(spark, sf):
    return op.split_alternates(fixture(spark, sf, "ann"))


@query("allele_counts", f"{ctes('half1')} {sql_alleles('half1', SAMPLES1)}")
def _(spark, sf):
    return op.allele_counts(op.drop_layout(half1(spark, sf)))


@query(
    "allele_frequencies",
    f"{ctes('half1')} SELECT *, CAST(allele_count AS DOUBLE) / n_samples AS af, "
    "CASE WHEN allele_number > 0 THEN CAST(allele_count AS DOUBLE) / allele_number END AS af_called "
    f"FROM ({sql_alleles('half1', SAMPLES1)})",
)
def _(spark, sf):
    return op.allele_frequencies(op.drop_layout(half1(spark, sf)))


@query(
    "variants_by_range",
    f"{ctes('half1')} {sql_report('half1', SAMPLES1)} WHERE reference_name = '1' "
    "AND start_position BETWEEN 0 AND 3999999",
)
def variants_by_range(spark, sf):
    return op.allele_report(op.filter_variants(half1(spark, sf), GENE0))


# --- joins -------------------------------------------------------------------------

MERGED = f"""
SELECT coalesce(a.reference_name, b.reference_name) AS reference_name,
       coalesce(a.start_position, b.start_position) AS start_position,
       coalesce(a.end_position, b.end_position) AS end_position,
       coalesce(a.id, b.id) AS id,
       coalesce(a.reference_bases, b.reference_bases) AS reference_bases,
       coalesce(a.alternate_bases, b.alternate_bases) AS alternate_bases,
       coalesce(a.qual, b.qual) AS qual, coalesce(a.filter, b.filter) AS filter,
       coalesce(a.bin_id, b.bin_id) AS bin_id, {CELLS1}, {CELLS2}
FROM half1 a FULL JOIN half2 b ON a.reference_name = b.reference_name
 AND a.start_position = b.start_position AND a.reference_bases = b.reference_bases
 AND a.alternate_bases = b.alternate_bases"""


@query("merge_halves", f"{ctes('half1', 'half2')} {MERGED} AND a.end_position = b.end_position")
def merge_halves(spark, sf):
    return op.wide(op.merge_halves(half1(spark, sf), fixture(spark, sf, "half2")))


@query(
    "merge_halves_parity_keys",
    f"{ctes('half1', 'half2')} SELECT {', '.join('a.' + c for c in VCF_COLUMNS[:8])}, a.bin_id, "
    f"{CELLS1}, {CELLS2} FROM half1 a FULL JOIN half2 b "
    f"ON {' AND '.join(f'a.{k} = b.{k}' for k in KEY5)}",
)
def _(spark, sf):
    merged = op.merge_halves(half1(spark, sf), fixture(spark, sf, "half2"), parity_keys=True)
    return op.wide(merged)


@query("merge_halves_without_end", f"{ctes('half1', 'half2')} {MERGED}")
def _(spark, sf):
    return op.wide(op.merge_halves_without_end(half1(spark, sf), fixture(spark, sf, "half2")))


@query(
    "annotate_variants",
    f"{ctes('half1', 'ann')} SELECT a.*, score, note FROM half1 a LEFT JOIN ann b USING ({KEY})",
)
def annotate_variants(spark, sf):
    return op.annotate_variants(half1(spark, sf), fixture(spark, sf, "ann"))


for how in ("inner", "left", "right", "full"):

    @query(
        f"join_variants_{how}",
        f"{ctes('half1', 'ann')} SELECT {KEY}, id, s01, score, note "
        f"FROM half1 {how.upper()} JOIN ann USING ({KEY})",
    )
    def _(spark, sf, how=how):
        left = half1(spark, sf).select(*KEY5, "id", "s01")
        return op.join_variants(left, fixture(spark, sf, "ann"), how)


@query(
    "annotate_allele_match",
    f"{ctes('half1', 'ann')} SELECT {', '.join('v.' + k for k in KEY5)}, score, note FROM half1 v JOIN ann x "
    "ON x.reference_name = v.reference_name AND x.start_position = v.start_position "
    "AND x.end_position = v.end_position WHERE ((x.reference_bases = '' "
    "AND concat(v.reference_bases, x.alternate_bases) = v.alternate_bases "
    "OR x.alternate_bases = v.alternate_bases) AND v.reference_bases = x.reference_bases)",
)
def _(spark, sf):
    return op.annotate_allele_match(half1(spark, sf), fixture(spark, sf, "ann"))


@query(
    "annotate_allele_match_insertion",
    f"{ctes('insertions', 'ann_ins')} SELECT {', '.join('v.' + k for k in KEY5)}, score FROM insertions v "
    "JOIN ann_ins x ON x.reference_name = v.reference_name AND x.start_position = v.start_position "
    "AND x.end_position = v.end_position WHERE (x.reference_bases = '' "
    "AND concat(v.reference_bases, x.alternate_bases) = v.alternate_bases) "
    "OR (x.alternate_bases = v.alternate_bases AND v.reference_bases = x.reference_bases)",
)
def _(spark, sf):
    return op.annotate_allele_match(
        fixture(spark, sf, "insertions"), fixture(spark, sf, "ann_ins"), insertion=True
    )


def flat_calls(spark, sf, half: str) -> DataFrame:
    """Long calls of a half with the population of each sample, under their flat names."""
    calls = op.calls_with_population(
        fixture(spark, sf, half), fixture(spark, sf, "metadata"), keep=[*KEY5, "qual", "filter"]
    )
    return calls.withColumnsRenamed(
        {"qual": "quality", "filter": "filters", "superpopulation": "SuperPopulation"}
    )


def sql_flat(half: str, samples: list[str]) -> str:
    column = "Half1" if samples == SAMPLES1 else "Half2"
    return (
        f"SELECT {KEY}, qual AS quality, filter AS filters, sample AS call_set_name, "
        f"gt AS genotype, pop FROM ({sql_calls(half, samples)}) c JOIN (SELECT "
        f"\"SuperPopulation\" AS pop, unnest(string_split(\"{column}\", ',')) AS sample "
        "FROM metadata) m USING (sample)"
    )


def sql_carriers(half: str, samples: list[str]) -> str:
    counts = ", ".join(
        f"count(*) FILTER (pop = '{p}' AND genotype = '1') AS n{p}" for p in POPULATIONS
    )
    return (
        f"SELECT {KEY}, quality, filters, {counts} FROM ({sql_flat(half, samples)}) f "
        f"GROUP BY {KEY}, quality, filters"
    )


CARRIERS = (
    f"{ctes('half2', 'metadata')} SELECT {KEY}, quality, filters, "
    + ", ".join(f"CASE WHEN n{p} > 0 THEN to_json([n{p}])::VARCHAR END AS {p}" for p in POPULATIONS)
    + f" FROM ({sql_carriers('half2', SAMPLES2)})"
)


@query("carriers_by_population", CARRIERS + " WHERE reference_name = 'Y'")
def _(spark, sf):
    carriers = op.carriers_by_population(flat_calls(spark, sf, "half2"), reference_name="Y")
    return as_json(carriers, *POPULATIONS)


@query("carriers_on_every_chromosome", CARRIERS)
def _(spark, sf):
    carriers = op.carriers_by_population(flat_calls(spark, sf, "half2"))
    return as_json(carriers, *POPULATIONS)


@query("carriers_of_packed", CARRIERS)
def _(spark, sf):
    carriers = op.carriers_of_packed(fixture(spark, sf, "half2"), fixture(spark, sf, "metadata"))
    return as_json(carriers, *POPULATIONS)


@query(
    "join_published_counts",
    f"{ctes('half1', 'half2', 'metadata', 'published')}, "
    f"c1 AS ({sql_carriers('half1', SAMPLES1)}), c2 AS ({sql_carriers('half2', SAMPLES2)}) "
    "SELECT p.\"start\", p.\"end\", p.reference_bases, p.alt AS alternate_bases, p.\"AC\", "
    + ", ".join(f"CASE WHEN c1.n{p} > 0 THEN c1.n{p} END AS {p}1" for p in POPULATIONS)
    + ", "
    + ", ".join(f"CASE WHEN c2.n{p} > 0 THEN c2.n{p} END AS {p}2" for p in POPULATIONS)
    + " FROM (SELECT *, unnest(alternate_bases) AS alt FROM published) p "
    + " ".join(
        f"JOIN {c} ON {c}.reference_name = p.reference_name AND {c}.start_position = p.\"start\" "
        f"AND {c}.end_position = p.\"end\" AND {c}.reference_bases = p.reference_bases "
        f"AND {c}.alternate_bases = p.alt"
        for c in ("c1", "c2")
    ),
)
def _(spark, sf):
    counts = [
        op.carriers_by_population(flat_calls(spark, sf, half), reference_name=None).withColumns(
            {p: F.get(F.col(p), 0) for p in POPULATIONS}
        )
        for half in ("half1", "half2")
    ]
    return op.join_published_counts(fixture(spark, sf, "published"), *counts)


# --- lookups -----------------------------------------------------------------------

PLACES = 'SELECT DISTINCT "ID", chrm, "start", "end" FROM dbsnp WHERE "ID" <> \'.\''


@query(
    "variants_by_rsid",
    f"{ctes('half1', 'dbsnp')} SELECT v.* FROM half1 v JOIN ({PLACES}) d ON d.\"ID\" = v.id "
    "AND d.chrm = v.reference_name AND v.start_position BETWEEN d.\"start\" AND d.\"end\" "
    f"WHERE d.\"ID\" IN (SELECT \"ID\" FROM ({PLACES}) GROUP BY \"ID\" HAVING count(*) = 1)",
)
def _(spark, sf):
    return op.variants_by_rsid(half1(spark, sf), fixture(spark, sf, "dbsnp"))


def sql_rsid_set(ids: str) -> str:
    return (
        f"{ctes('half1', 'dbsnp', 'site')} SELECT v.* FROM half1 v JOIN ({PLACES}) d ON d.\"ID\" = v.id "
        "AND d.chrm = v.reference_name AND v.start_position BETWEEN d.\"start\" AND d.\"end\" "
        f"WHERE d.\"ID\" IN (SELECT \"ID\" FROM ({PLACES}) GROUP BY \"ID\" HAVING count(*) = 1) AND d.\"ID\" IN ({ids})"
    )


@query("variants_by_rsid_list", sql_rsid_set("SELECT 'rs' || x FROM range(100000) AS r(x)"))
def _(spark, sf):
    """A list of 100,000 rsids; the variants are stored in bins."""
    path = new_path(spark)
    sources.write_binned(half1(spark, sf), path)
    stored = sources.read_variants(spark, path, pack=False)
    found = op.variants_by_rsid(stored, fixture(spark, sf, "dbsnp"), [f"rs{k}" for k in range(100_000)])
    return found.select(*half1(spark, sf).columns).withColumn("bin_id", F.col("bin_id").cast("int"))


@query("variants_by_rsid_table", sql_rsid_set("SELECT id FROM site WHERE status = 'P'"))
def _(spark, sf):
    """The rsids are a column of another table."""
    ids = fixture(spark, sf, "site").where("status = 'P'")
    return op.variants_by_rsid(half1(spark, sf), fixture(spark, sf, "dbsnp"), ids)


@query(
    "ambiguous_rsids",
    f"{ctes('dbsnp')} SELECT \"ID\" AS id, count(*) AS locations FROM ({PLACES}) GROUP BY \"ID\" HAVING count(*) > 1",
)
def _(spark, sf):
    return op.ambiguous_rsids(fixture(spark, sf, "dbsnp"))


SPANS = (
    "SELECT name2 AS gene, reference_name AS chrom, min(start_position) AS lo, max(end_position) AS hi "
    "FROM genes GROUP BY name2, reference_name"
)


@query(
    "variants_by_gene",
    f"{ctes('half1', 'genes')} SELECT v.*, gene FROM half1 v JOIN ({SPANS}) g "
    "ON g.chrom = v.reference_name AND v.start_position BETWEEN lo AND hi",
)
def variants_by_gene(spark, sf):
    return op.variants_by_gene(half1(spark, sf), fixture(spark, sf, "genes"))


@query(
    "variants_by_gene_overlap",
    f"{ctes('half1', 'genes')} SELECT v.*, gene FROM half1 v JOIN ({SPANS}) g "
    "ON g.chrom = v.reference_name AND v.start_position <= hi AND v.end_position >= lo",
)
def _(spark, sf):
    return op.variants_by_gene(half1(spark, sf), fixture(spark, sf, "genes"), overlap=True)


@query("calls_with_population", f"{ctes('half1', 'metadata')} {LONG_POPULATION}")
def _(spark, sf):
    return op.calls_with_population(half1(spark, sf), fixture(spark, sf, "metadata"), keep=KEY5)


# --- aggregates --------------------------------------------------------------------

CHROM1 = VariantFilter("1", 0, 200_000_000)
IN_CHROM1 = "reference_name = '1' AND start_position BETWEEN 0 AND 200000000"


@query(
    "count_variants",
    f"{ctes('half1', 'half2')} "
    + " UNION ALL ".join(
        f"SELECT '{h}' AS source, count(*) AS ct FROM {h} WHERE {IN_CHROM1}" for h in ("half1", "half2")
    ),
)
def _(spark, sf):
    return op.count_variants(both(spark, sf), CHROM1)


@query(
    "stat_variants",
    f"{ctes('half1', 'half2')} "
    + " UNION ALL ".join(
        f"SELECT '{h}' AS source, count(*) > 0 AS found FROM {h} WHERE start_position = 7919 "
        "AND end_position = 7920"
        for h in ("half1", "half2")
    ),
)
def _(spark, sf):
    return op.stat_variants(both(spark, sf), VariantFilter(None, 7919, 7920, position_range=False))


@query("count_where", f"{ctes('half1')} SELECT count(*) AS ct FROM half1 WHERE reference_name = 'Y'")
def _(spark, sf):
    return op.count_where(half1(spark, sf), "reference_name", "Y")


@query(
    "count_contained",
    f"{ctes('half1')} SELECT count(*) AS ct FROM half1 WHERE reference_name = '3' "
    "AND start_position >= 15838 AND end_position <= 90000000",
)
def _(spark, sf):
    return op.count_contained(half1(spark, sf), reference_name="3", start=15_838, end=90_000_000)


def sql_superpopulation(table: str, samples: list[str], extra: str = "") -> str:
    code = (
        "CASE WHEN gt IN ('1','2','3','0|1','0|2','0|3','1|0','2|0','3|0') THEN 1 "
        "WHEN gt IN ('1|1','1|2','1|3','2|1','2|2','2|3','3|1','3|2','3|3') THEN 2 ELSE 0 END"
    )
    half = "Half1" if samples == SAMPLES1 else "Half2"
    sums = ", ".join(
        f"CAST(sum({code}) FILTER (pop = '{p}') AS BIGINT) AS \"{p}_alleleCount\"" for p in POPULATION_OF
    )
    return (
        f"SELECT {V8}, {sums} FROM ({sql_calls(table, samples)}) c JOIN (SELECT \"SuperPopulation\" AS pop, "
        f"unnest(string_split(\"{half}\", ',')) AS sample FROM metadata) m USING (sample) "
        f"WHERE length(reference_bases) = 1 AND length(alternate_bases) = 1 {extra} GROUP BY {V8}"
    )


@query("superpopulation_counts", f"{ctes('half1', 'metadata')} {sql_superpopulation('half1', SAMPLES1)}")
def superpopulation_counts(spark, sf):
    df = op.drop_layout(half1(spark, sf))
    return op.superpopulation_counts(df, fixture(spark, sf, "metadata"))


RANKED = f"SELECT * FROM ({sql_superpopulation('half1', SAMPLES1)}) WHERE \"AFR_alleleCount\" > 0"


@query("filter_carried", f"{ctes('half1', 'metadata')} {RANKED}")
def _(spark, sf):
    return op.filter_carried(superpopulation_counts(spark, sf), "AFR_alleleCount")


@query("rank_by_population_count", f"{ctes('half1', 'metadata')} {RANKED}")
def _(spark, sf):
    return op.rank_by_population_count(superpopulation_counts(spark, sf), "AFR_alleleCount")


@query(
    "reconcile_counts",
    f"{ctes('pop_arrays')} SELECT * FROM (SELECT \"start\", \"end\", reference_bases, alternate_bases, "
    + ", ".join(f"{n}[1] AS {n}" for n in ARRAY_NAMES)
    + ", "
    + " + ".join(f"{n}[1]" for n in ARRAY_NAMES)
    + " AS \"AC_Fake\", \"AC\"[1] AS \"AC\" FROM pop_arrays) WHERE \"AC\" <> \"AC_Fake\"",
)
def _(spark, sf):
    return op.reconcile_counts(fixture(spark, sf, "pop_arrays"))


@query(
    "pooled_frequencies",
    f"{ctes('half1', 'half2')} SELECT *, CAST(allele_count AS DOUBLE) / 20 AS af, "
    "CAST(allele_count AS DOUBLE) / samples_present AS af_present, "
    "CASE WHEN allele_number > 0 THEN CAST(allele_count AS DOUBLE) / allele_number END AS af_called "
    f"FROM (SELECT {KEY}, CAST(sum(allele_count) AS BIGINT) AS allele_count, "
    "CAST(sum(allele_number) AS BIGINT) AS allele_number, CAST(sum(n_samples) AS BIGINT) AS samples_present "
    f"FROM ({sql_alleles('half1', SAMPLES1)} UNION ALL {sql_alleles('half2', SAMPLES2)}) GROUP BY {KEY})",
)
def pooled_frequencies(spark, sf):
    return op.pooled_frequencies(both(spark, sf))


@query(
    "chromosome_profile",
    f"{ctes('half1')} SELECT reference_name, count(*) AS variants, max(start_position) AS max_position "
    "FROM half1 GROUP BY reference_name",
)
def _(spark, sf):
    return op.chromosome_profile(half1(spark, sf))


# --- standardisation ---------------------------------------------------------------


@query(
    "standardise_positional_info",
    f"{ctes('wellderly_raw')} SELECT reference_name, start_position, end_position, reference_bases, "
    "alt AS alternate_bases, CAST(string_split(af, '-')[-1] AS DOUBLE) AS minor_af, "
    "CAST(string_split(ac, '-')[-1] AS BIGINT) AS allele_count FROM (SELECT *, "
    "unnest(string_split(alternate_bases, ',')) AS alt, "
    "unnest(string_split(string_split(info, ';')[8], ',')[2:]) AS af, "
    "unnest(string_split(string_split(info, ';')[9], ',')[2:]) AS ac FROM wellderly_raw)",
)
def _(spark, sf):
    return op.standardise_positional_info(fixture(spark, sf, "wellderly_raw")).records


@query(
    "standardise_positional_info_rejected",
    f"{ctes('gnomad_raw')} SELECT *, 'too few INFO terms' AS reason FROM gnomad_raw",
)
def _(spark, sf):
    # The keyed export has no positional terms, so every row must be turned away.
    return op.standardise_positional_info(fixture(spark, sf, "gnomad_raw")).rejected


@query(
    "standardise_columns",
    f"{ctes('thousand_raw')} SELECT {KEY}, af AS minor_af, ac AS allele_count FROM thousand_raw "
    "WHERE alternate_bases NOT LIKE '<CN%>'",
)
def _(spark, sf):
    return op.standardise_columns(fixture(spark, sf, "thousand_raw")).records


KEYED = (
    "SELECT reference_name, start_position, end_position, reference_bases, alt AS alternate_bases, "
    "CAST(af AS DOUBLE) AS minor_af, CAST(ac AS BIGINT) AS allele_count FROM (SELECT *, "
    "unnest(string_split(alternate_bases, ',')) AS alt, "
    "unnest(string_split(substr(string_split(info, ';')[2], 4), ',')) AS af, "
    "unnest(string_split(substr(string_split(info, ';')[1], 4), ',')) AS ac FROM gnomad_raw "
    "WHERE NOT list_contains(string_split(substr(string_split(info, ';')[2], 4), ','), '.'))"
)


@query("standardise_keyed_info", f"{ctes('gnomad_raw')} {KEYED}")
def _(spark, sf):
    return op.standardise_keyed_info(fixture(spark, sf, "gnomad_raw")).records


@query("standardise_keyed_info_anchored", f"{ctes('gnomad_raw')} {KEYED}")
def _(spark, sf):
    return op.standardise_keyed_info(fixture(spark, sf, "gnomad_raw"), anchored=True).records


@query(
    "standardise_keyed_info_rejected",
    f"{ctes('wellderly_raw')} SELECT *, 'no AF values in INFO' AS reason FROM wellderly_raw",
)
def _(spark, sf):
    return op.standardise_keyed_info(fixture(spark, sf, "wellderly_raw")).rejected


@query(
    "standard_to_json",
    f"{ctes('standard')} SELECT *, to_json({{'startValue': start_position, 'endValue': end_position, "
    "'referenceBases': reference_bases, 'alternateBases': alternate_bases, 'minorAF': minor_af, "
    "'alleleCount': allele_count})::VARCHAR AS json FROM standard",
)
def _(spark, sf):
    return op.standard_to_json(fixture(spark, sf, "standard"))


@query("standard_from_json", f"{ctes('standard')} SELECT * FROM standard")
def _(spark, sf):
    return op.standard_from_json(op.standard_to_json(fixture(spark, sf, "standard")))


@query(
    "plain_decimal",
    f"{ctes('standard')} SELECT {KEY}, CASE WHEN allele_count = 0 THEN '0' ELSE "
    "rtrim(concat('0.00000', lpad(CAST(allele_count AS VARCHAR), 3, '0')), '0') END AS plain FROM standard",
)
def _(spark, sf):
    tiny = F.col("allele_count").cast("double") / F.lit(1e8)
    return fixture(spark, sf, "standard").select(*KEY5, plain_decimal(tiny).alias("plain"))


# Doubles as text, and the decimals they stand for.
DECIMALS = {
    "1.2345678901234568e-05": "0.000012345678901234568", "3e-19": "0.0000000000000000003", "1e21": "1" + "0" * 21,
    "-2.5e-7": "-0.00000025", "1e-10": "0.0000000001", "123456.789": "123456.789", "0.1": "0.1", "100": "100",
    "0": "0", "1.7976931348623157e308": "17976931348623157" + "0" * 292, "0.30000000000000004": "0.30000000000000004",
}


def decimal_case(texts) -> str:
    whens = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts))
    return f"CASE allele_count % {len(DECIMALS)} {whens} END"


@query("plain_decimal_odd", f"{ctes('standard')} SELECT {KEY}, {decimal_case(DECIMALS.values())} AS plain FROM standard")
def _(spark, sf):
    given = F.expr(decimal_case(DECIMALS)).cast("double")
    return fixture(spark, sf, "standard").select(*KEY5, plain_decimal(given).alias("plain"))


@query(
    "write_standard_csv_odd",
    f"{ctes('standard')} SELECT {KEY}, {decimal_case(DECIMALS.values())} AS minor_af, "
    "CAST(allele_count AS VARCHAR) AS allele_count FROM standard",
)
def _(spark, sf):
    path = new_path(spark)
    given = fixture(spark, sf, "standard").withColumn("minor_af", F.expr(decimal_case(DECIMALS)).cast("double"))
    sources.write_standard_csv(given, path)
    back = spark.read.option("header", True).csv(path)
    return back.toDF(*[c.lower() for c in back.columns]).withColumns({p: F.col(p).cast("bigint") for p in KEY5[1:3]})


def sql_odd(anchored: bool) -> str:
    first = "0.5" if anchored else "0.9"
    return (
        "SELECT reference_name, start_position, end_position, reference_bases, alternate_bases, "
        f"CASE k % 9 WHEN 0 THEN 1.2E-05 ELSE CAST({first} AS DOUBLE) END AS minor_af, "
        "CAST(CASE k % 9 WHEN 0 THEN 3000000000 ELSE 1 END AS BIGINT) AS allele_count "
        "FROM gnomad_odd WHERE k % 9 IN (0, 1)"
    )


# Reasons by the kind of row in the `gnomad_odd` fixture.
ODD_REASONS = {
    2: "no AF values in INFO", 3: "no AC values in INFO", 4: "frequency and count lists differ in length",
    5: "malformed allele frequency", 6: "malformed allele count", 7: "alternates and values differ in number",
}
ODD_CASE = " ".join(f"WHEN {i} THEN '{r}'" for i, r in ODD_REASONS.items())


@query("standardise_keyed_info_odd", f"{ctes('gnomad_odd')} {sql_odd(False)}")
def _(spark, sf):
    return op.standardise_keyed_info(fixture(spark, sf, "gnomad_odd")).records


@query("standardise_keyed_info_odd_anchored", f"{ctes('gnomad_odd')} {sql_odd(True)}")
def _(spark, sf):
    return op.standardise_keyed_info(fixture(spark, sf, "gnomad_odd"), anchored=True).records


@query(
    "standardise_keyed_info_odd_rejected",
    f"{ctes('gnomad_odd')} SELECT *, CASE k % 9 {ODD_CASE} END AS reason FROM gnomad_odd WHERE k % 9 BETWEEN 2 AND 7",
)
def _(spark, sf):
    return op.standardise_keyed_info(fixture(spark, sf, "gnomad_odd")).rejected


# --- hot keys, shared samples, far positions ---------------------------------------


@query("with_bin_far", f"{ctes('far')} SELECT *, CAST(start_position // 62500 AS BIGINT) AS bin_id FROM far")
def _(spark, sf):
    return op.with_bin(fixture(spark, sf, "far"))


for how in ("left", "right", "full"):

    @query(
        f"join_hot_{how}",
        f"{ctes('hot_left', 'hot_right')} SELECT "
        + ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in KEY5)
        + f", a.x, b.y FROM hot_left a {how.upper()} JOIN hot_right b ON "
        + " AND ".join(f"a.{c} = b.{c}" for c in KEY5),
    )
    def _(spark, sf, how=how):
        return op.join_variants(fixture(spark, sf, "hot_left"), fixture(spark, sf, "hot_right"), how)


for how in ("left", "right", "full"):

    @query(f"join_salted_{how}", ORACLES[f"join_hot_{how}"])
    def _(spark, sf, how=how):
        """As join_hot, with keys dealt out from a hundred rows on."""
        left, right = fixture(spark, sf, "hot_left"), fixture(spark, sf, "hot_right")
        return op.join_variants(left, right, how, hot_rows=100)


@query(
    "merge_halves_shared_sample",
    f"{ctes('half1', 'half2_shared')} "
    + MERGED.replace(", s10,", ", coalesce(a.s10, b.s10) AS s10,").replace("half2", "half2_shared")
    + " AND a.end_position = b.end_position",
)
def _(spark, sf):
    return op.wide(op.merge_halves(half1(spark, sf), fixture(spark, sf, "half2_shared")))


@query(
    "pooled_frequencies_repeated_alternate",
    f"{ctes('half1', 'half1_t', 'half2')} SELECT *, CAST(allele_count AS DOUBLE) / 20 AS af, "
    "CAST(allele_count AS DOUBLE) / samples_present AS af_present, "
    "CASE WHEN allele_number > 0 THEN CAST(allele_count AS DOUBLE) / allele_number END AS af_called "
    f"FROM (SELECT {KEY}, CAST(sum(allele_count) AS BIGINT) AS allele_count, "
    "CAST(sum(allele_number) AS BIGINT) AS allele_number, "
    "CAST(coalesce(max(n_samples) FILTER (t = 1), 0) + coalesce(max(n_samples) FILTER (t = 2), 0) AS BIGINT) "
    f"AS samples_present FROM (SELECT *, 1 AS t FROM ({sql_alleles('half1', SAMPLES1)}) UNION ALL "
    f"SELECT *, 1 AS t FROM ({sql_alleles('half1_t', SAMPLES1)}) UNION ALL "
    f"SELECT *, 2 AS t FROM ({sql_alleles('half2', SAMPLES2)})) GROUP BY {KEY})",
)
def _(spark, sf):
    twice = half1(spark, sf).unionByName(fixture(spark, sf, "half1_t"))
    return op.pooled_frequencies({"half1": twice, "half2": fixture(spark, sf, "half2")})


def sql_every_index(table: str, samples: list[str]) -> str:
    code = "len(list_filter(string_split(gt, '|'), lambda x: regexp_full_match(x, '[0-9]*[1-9][0-9]*')))"
    half = "Half1" if samples == SAMPLES1 else "Half2"
    sums = ", ".join(f"CAST(sum({code}) FILTER (pop = '{p}') AS BIGINT) AS \"{p}_alleleCount\"" for p in POPULATION_OF)
    return (
        f"SELECT {V8}, {sums} FROM ({sql_calls(table, samples)}) c JOIN (SELECT \"SuperPopulation\" AS pop, "
        f"unnest(string_split(\"{half}\", ',')) AS sample FROM metadata) m USING (sample) GROUP BY {V8}"
    )


@query("superpopulation_counts_every_index", f"{ctes('half1', 'metadata')} {sql_every_index('half1', SAMPLES1)}")
def _(spark, sf):
    df = op.drop_layout(half1(spark, sf))
    return op.superpopulation_counts(df, fixture(spark, sf, "metadata"), snp_only=False)


@query(
    "variants_by_gene_overlap_long",
    f"{ctes('long', 'genes')} SELECT v.*, gene FROM long v JOIN ({SPANS}) g "
    "ON g.chrom = v.reference_name AND v.start_position <= hi AND v.end_position >= lo",
)
def _(spark, sf):
    return op.variants_by_gene(fixture(spark, sf, "long"), fixture(spark, sf, "genes"), overlap=True)


GENE_COLUMN = "(SELECT *, concat('own', id) AS gene, bin_id AS _bin FROM half1)"
# Each gene of the list once more, with an end that no chromosome has.
FAR_GENES = (
    "(SELECT * FROM genes UNION ALL SELECT name2 || '-far', reference_name, start_position, 1152921504606846976 FROM genes)"
)


@query(
    "variants_by_gene_named",
    f"{ctes('half1', 'genes')} SELECT v.*, g.gene AS lookup_gene FROM {GENE_COLUMN} v JOIN "
    f"({SPANS.replace('FROM genes', 'FROM ' + FAR_GENES)}) g "
    "ON g.chrom = v.reference_name AND v.start_position BETWEEN lo AND hi",
)
def _(spark, sf):
    """The table has columns `gene` and `_bin` of its own, and some genes have absurd ends."""
    df = half1(spark, sf).withColumns({"gene": F.concat(F.lit("own"), "id"), "_bin": F.col("bin_id")})
    return op.variants_by_gene(df, far_genes(spark, sf))


@query(
    "variants_by_gene_overlap_far",
    f"{ctes('long', 'genes')} SELECT v.*, gene FROM long v JOIN ({SPANS.replace('FROM genes', 'FROM ' + FAR_GENES)}) g "
    "ON g.chrom = v.reference_name AND v.start_position <= hi AND v.end_position >= lo",
)
def _(spark, sf):
    return op.variants_by_gene(fixture(spark, sf, "long"), far_genes(spark, sf), overlap=True)


def far_genes(spark, sf):
    genes = fixture(spark, sf, "genes")
    far = {"name2": F.concat("name2", F.lit("-far")), "end_position": F.lit(1 << 60)}
    return genes.unionByName(genes.withColumns(far))


# --- workflows ---------------------------------------------------------------------

IN_GENE0 = "reference_name = '1' AND start_position BETWEEN 0 AND 3999999"


def tagged(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS source, * FROM ({sql})" for n, sql in parts.items())


@query(
    "stat",
    f"{ctes('half1', 'half2')} "
    + " UNION ALL ".join(
        f"SELECT '{h}' AS source, count(*) > 0 AS found FROM {h} WHERE {IN_GENE0}" for h in ("half1", "half2")
    ),
)
def _(spark, sf):
    return plans.stat(both(spark, sf), gene="GENE0", genes=fixture(spark, sf, "genes"))


@query(
    "count",
    f"{ctes('half1', 'half2')} "
    + " UNION ALL ".join(f"SELECT '{h}' AS source, count(*) AS ct FROM {h}" for h in ("half1", "half2")),
)
def _(spark, sf):
    return plans.count(both(spark, sf))


@query(
    "variants",
    f"{ctes('half1', 'half2')} "
    + tagged(
        {
            "half1": sql_report("half1", SAMPLES1) + f" WHERE {IN_GENE0}",
            "half2": sql_report("half2", SAMPLES2) + f" WHERE {IN_GENE0}",
        }
    ),
)
def variants(spark, sf):
    return plans.variants(both(spark, sf), gene="GENE0", genes=fixture(spark, sf, "genes"))


IN_HLA = "reference_name = '6' AND start_position BETWEEN 29000000 AND 99000000"
HALVES = (("half1", SAMPLES1), ("half2", SAMPLES2))


@query(
    "stat_of_haplotype_gene",
    f"{ctes('half1', 'half2')} "
    + " UNION ALL ".join(f"SELECT '{h}' AS source, count(*) > 0 AS found FROM {h} WHERE {IN_HLA}" for h, _ in HALVES),
)
def _(spark, sf):
    return plans.stat(both(spark, sf), gene="HLA-A", genes=fixture(spark, sf, "genes"))


@query(
    "variants_of_haplotype_gene",
    f"{ctes('half1', 'half2')} " + tagged({h: sql_report(h, s) + f" WHERE {IN_HLA}" for h, s in HALVES}),
)
def _(spark, sf):
    return plans.variants(both(spark, sf), gene="HLA-A", genes=fixture(spark, sf, "genes"))


@query(
    "annotate_haplotype_gene",
    f"{ctes('half1', 'ann')} SELECT a.*, score, note FROM half1 a LEFT JOIN ann b USING ({KEY}) WHERE {IN_HLA}",
)
def _(spark, sf):
    genes = fixture(spark, sf, "genes")
    return plans.annotate(half1(spark, sf), fixture(spark, sf, "ann"), gene="HLA-A", genes=genes)


@query(
    "superpopulation_counts_by_haplotype_gene",
    f"{ctes('half1', 'half2', 'metadata')} "
    + tagged({h: sql_superpopulation(h, s, f"AND {IN_HLA}") for h, s in HALVES}),
)
def _(spark, sf):
    tables = {n: op.drop_layout(df) for n, df in both(spark, sf).items()}
    return plans.superpopulation_counts_by_gene(
        tables, fixture(spark, sf, "metadata"), "HLA-A", fixture(spark, sf, "genes")
    )


@query(
    "variants_envelope",
    f"{ctes('half1', 'half2')} "
    + " UNION ALL ".join(
        f"SELECT '{h}' AS source, 'variants' AS \"table\", count(*) AS data_count, "
        "'[\"reference_name\",\"start_position\",\"end_position\",\"id\",\"reference_bases\","
        f"\"alternate_bases\",\"allele_count\",\"af\"]' AS headers FROM {h} WHERE {IN_GENE0}"
        for h in ("half1", "half2")
    ),
)
def _(spark, sf):
    genes = fixture(spark, sf, "genes")
    return as_json(plans.variants_envelope(both(spark, sf), gene="GENE0", genes=genes), "headers")


@query(
    "variants_of_chromosome",
    f"{ctes('half1', 'half2')} "
    + tagged(
        {
            "half1": sql_report("half1", SAMPLES1) + " WHERE reference_name = 'Y'",
            "half2": sql_report("half2", SAMPLES2) + " WHERE reference_name = 'Y'",
        }
    ),
)
def _(spark, sf):
    return plans.variants(both(spark, sf), VariantFilter("Y", start_position=0))


@query(
    "variants_of_rsid",
    f"{ctes('half1', 'half2')} "
    + tagged(
        {
            "half1": sql_report("half1", SAMPLES1) + " WHERE id = 'rs14'",
            "half2": sql_report("half2", SAMPLES2) + " WHERE id = 'rs14'",
        }
    ),
)
def _(spark, sf):
    site = fixture(spark, sf, "site").select(
        F.col("reference_name").alias("chrm"),
        F.col("start_position").alias("start"),
        F.col("end_position").alias("end"),
        F.col("id").alias("ID"),
    )
    return plans.variants(both(spark, sf), rsid="rs14", dbsnp=site)


@query(
    "annotate",
    f"{ctes('half1', 'ann')} SELECT a.*, score, note FROM half1 a LEFT JOIN ann b USING ({KEY}) WHERE {IN_GENE0}",
)
def annotate(spark, sf):
    return plans.annotate(
        half1(spark, sf), fixture(spark, sf, "ann"), gene="GENE0", genes=fixture(spark, sf, "genes")
    )


@query(
    "annotate_range",
    f"{ctes('half1', 'ann')} SELECT a.*, score, note FROM half1 a LEFT JOIN ann b USING ({KEY}) "
    "WHERE reference_name = '4' AND start_position >= 0",
)
def _(spark, sf):
    return plans.annotate(half1(spark, sf), fixture(spark, sf, "ann"), VariantFilter("4", 0))


@query(
    "superpopulation_counts_by_gene",
    f"{ctes('half1', 'half2', 'metadata')} "
    + tagged(
        {
            "half1": sql_superpopulation("half1", SAMPLES1, f"AND {IN_GENE0}"),
            "half2": sql_superpopulation("half2", SAMPLES2, f"AND {IN_GENE0}"),
        }
    ),
)
def _(spark, sf):
    tables = {n: op.drop_layout(df) for n, df in both(spark, sf).items()}
    return plans.superpopulation_counts_by_gene(
        tables, fixture(spark, sf, "metadata"), "GENE0", fixture(spark, sf, "genes")
    )


# --- compact genotypes, bucketed tables, levels, inserts -----------------------------


@query("allele_counts_compact", ORACLES["allele_counts"])
def _(spark, sf):
    """Compact genotypes, stored and read."""
    path = new_path(spark)
    sources.write_result(op.compact_genotypes(op.drop_layout(half1(spark, sf))), path)
    return op.allele_counts(sources.read_variants(spark, path))


@query("compact_genotypes", WIDE1)
def _(spark, sf):
    return op.wide(op.compact_genotypes(half1(spark, sf)))


@query("merge_halves_compact", ORACLES["merge_halves"])
def _(spark, sf):
    return op.wide(op.merge_halves(op.compact_genotypes(half1(spark, sf)), fixture(spark, sf, "half2")))


@query("pooled_frequencies_compact", ORACLES["pooled_frequencies"])
def _(spark, sf):
    return op.pooled_frequencies({n: op.compact_genotypes(df) for n, df in both(spark, sf).items()})


@query("merge_halves_bucketed", ORACLES["merge_halves"])
def _(spark, sf):
    """Both halves bucketed by key, so that the merge shuffles neither."""
    names = [new_table(), new_table()]
    halves = [op.pack_samples(df) for df in both(spark, sf).values()]
    buckets = sources.bucket_count(*halves)
    for name, df in zip(names, halves, strict=True):
        sources.write_bucketed(df, name, buckets)
    return op.wide(op.merge_halves(*[sources.read_bucketed(spark, n) for n in names], plain=True))


@query("annotate_variants_bucketed", ORACLES["annotate_variants"])
def _(spark, sf):
    names = [new_table(), new_table()]
    tables = half1(spark, sf), fixture(spark, sf, "ann")
    buckets = sources.bucket_count(*tables)
    for name, df in zip(names, tables, strict=True):
        sources.write_bucketed(df, name, buckets)
    return op.annotate_variants(*[sources.read_bucketed(spark, n) for n in names], plain=True)


@query(
    "filter_overlap_levels",
    f"{ctes('long')} SELECT * FROM long WHERE reference_name = '1' AND start_position <= 40000000 AND end_position >= 190056",
)
def _(spark, sf):
    """A layout with levels, whose rows are as long as a chromosome or longer."""
    path = new_path(spark)
    df = fixture(spark, sf, "long")
    sources.write_binned(df, path, levels=True)
    stored = sources.read_variants(spark, path, pack=False)
    return op.filter_overlap(stored, "1", 190_056, 40_000_000).select(*df.columns)


CORRECTED = "reference_bases = 'AC' OR alternate_bases = 'GA,T'"


@query(
    "append_chromosome_delta",
    f"{ctes('half1')} SELECT * REPLACE (CASE WHEN {CORRECTED} THEN '200' ELSE qual END AS qual) FROM half1",
)
def _(spark, sf):
    """New and corrected rows go into a stored table, twice."""
    path = new_path(spark)
    df = half1(spark, sf)
    sources.append_chromosome(df.where("reference_bases <> 'AC'"), path)
    delta = df.where(CORRECTED).withColumn("qual", F.lit("200"))
    for _ in range(2):
        sources.append_chromosome(delta, path)
    return op.wide(sources.read_variants(spark, path)).select(*df.columns)


# --- one pass for two answers, pruned scans, footers ----------------------------------


def outcomes_of(spark, outcomes: DataFrame) -> str:
    path = new_path(spark)
    sources.write_outcomes(outcomes, path)
    return path


@query("standardise_outcomes_records", ORACLES["standardise_keyed_info_odd"])
def _(spark, sf):
    """Records and rejected rows written in one pass over the export."""
    outcomes = op.standardise_keyed_info(fixture(spark, sf, "gnomad_odd")).outcomes
    return sources.read_records(spark, outcomes_of(spark, outcomes))


@query("standardise_outcomes_rejected", ORACLES["standardise_keyed_info_odd_rejected"])
def _(spark, sf):
    outcomes = op.standardise_keyed_info(fixture(spark, sf, "gnomad_odd")).outcomes
    return sources.read_rejected(spark, outcomes_of(spark, outcomes))


@query("validate_outcomes_clean", ORACLES["validate_variants"])
def _(spark, sf):
    return sources.read_clean(spark, outcomes_of(spark, op.validate_outcomes(raw_text(spark, sf))))


@query("validate_outcomes_rejected", ORACLES["validate_quarantine"])
def _(spark, sf):
    found = sources.read_rejected(spark, outcomes_of(spark, op.validate_outcomes(raw_text(spark, sf))))
    return as_json(found, "errors")


@query("write_variants_envelope", ORACLES["variants_envelope"])
def _(spark, sf):
    """The envelope of an answer, counted while its rows are written."""
    found = plans.write_variants(both(spark, sf), new_path(spark), gene="GENE0", genes=fixture(spark, sf, "genes"))
    return as_json(found, "headers")


@query("write_variants_rows", ORACLES["variants"])
def _(spark, sf):
    """The rows of that answer."""
    path, halves = new_path(spark), both(spark, sf)
    plans.write_variants(halves, path, gene="GENE0", genes=fixture(spark, sf, "genes"))
    schema = op.allele_report(halves["half1"]).schema
    rows = [
        spark.read.schema(schema).json(f"{path}/{name}").select(F.lit(name).alias("source"), "*") for name in halves
    ]
    return rows[0].unionByName(rows[1])


@query("annotate_variants_pruned", ORACLES["annotate_variants"])
def _(spark, sf):
    """The annotation is stored in bins and read where there are variants."""
    path = new_path(spark)
    sources.write_binned(fixture(spark, sf, "ann"), path)
    stored = sources.read_annotation(spark, path)
    half = half1(spark, sf)
    return op.annotate_variants(half, stored.drop("bin_id"), prune=True).select(
        *op.annotate_variants(half, fixture(spark, sf, "ann")).columns
    )


@query("chromosome_profile_stored", ORACLES["chromosome_profile"])
def _(spark, sf):
    """From the footers of a stored table."""
    path = new_path(spark)
    sources.write_binned(half1(spark, sf), path)
    return sources.stored_profile(spark, path)


@query("superpopulation_counts_phased", ORACLES["superpopulation_counts"].replace("'1','2','3',", ""))
def _(spark, sf):
    """Haploid calls count nothing."""
    df = op.drop_layout(half1(spark, sf))
    return op.superpopulation_counts(df, fixture(spark, sf, "metadata"), haploid=False)

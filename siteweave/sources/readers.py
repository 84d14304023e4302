"""Readers of variant, annotation, lookup and raw tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.operators.aggregates import chromosome_profile
from siteweave.operators.columns import pack_samples
from siteweave.operators.standardise import RECORD, REJECTED
from siteweave.operators.validate import CLEAN
from siteweave.schema import (
    BIN,
    BIN_WIDTH_KEY,
    COMPACT,
    GENOTYPES,
    POSITIONS,
    import_schema,
    string_schema,
)


# Fixed value: a quote inside quoted text is written twice.
CSV_QUOTING = {"escape": '"'}


def _typed(df: DataFrame, bad_positions: str = "null") -> DataFrame:
    """Positions as bigint, whatever the files hold. Text that is no number becomes null, or
    stops the read with `bad_positions="raise"`."""
    if bad_positions not in ("raise", "null"):
        raise ValueError(f"bad_positions must be raise or null, not {bad_positions!r}")

    def typed(name: str):
        given = F.col(name)
        number = given.try_cast("bigint")
        if bad_positions == "null" or not isinstance(df.schema[name].dataType, T.StringType):
            return number
        wrong = F.concat(F.lit(f"{name} is no number: "), given)
        return F.when(given.isNotNull() & number.isNull(), F.raise_error(wrong)).otherwise(number)

    casts = {c: typed(c) for c in df.columns if c.lower() in POSITIONS and df.schema[c].dataType != T.LongType()}
    return df.withColumns(casts) if casts else df


def _with_width(df: DataFrame, width: int | None) -> DataFrame:
    """Attach the bin width the caller names, or the one the layout recorded."""
    if BIN not in df.columns or BIN_WIDTH_KEY in df.schema[BIN].metadata:
        return df
    if width is None and "start_position" in df.columns:
        width = df.schema["start_position"].metadata.get(BIN_WIDTH_KEY)
    return df if width is None else df.withMetadata(BIN, {BIN_WIDTH_KEY: width})


def _partitioned(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """Parquet whose `reference_name` stays text: when every directory name is a
    number, Spark takes the partition column for one."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    if "reference_name" not in df.columns or df.schema["reference_name"].dataType == T.StringType():
        return df
    fields = [
        T.StructField(f.name, T.StringType(), f.nullable, f.metadata)
        if f.name == "reference_name"
        else f
        for f in df.schema.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_variants(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    bin_width: int | None = None,
    pack: bool = True,
    bad_positions: str = "null",
) -> DataFrame:
    """A variant table in Parquet, wide, packed or compact, plain or partitioned by bin or by
    chromosome. `bin_width` names the width of bins written by someone else. A position that
    is text and no number is null, or stops the read with `bad_positions="raise"`; such rows
    can be told apart with `validate_variants` on the text."""
    df = _with_width(_typed(_partitioned(spark, path, schema), bad_positions), bin_width)
    return pack_samples(df) if pack and not {GENOTYPES, COMPACT} & set(df.columns) else df


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """A table of `write_bucketed`, as it was written."""
    return _with_width(spark.table(table), None)


def read_annotation(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    bin_width: int | None = None,
    bad_positions: str = "null",
) -> DataFrame:
    """An annotation table in Parquet; text positions become bigint, as `read_variants` does it."""
    return _with_width(_typed(_partitioned(spark, path, schema), bad_positions), bin_width)


def read_variants_csv(
    spark: SparkSession,
    path: str,
    columns: list[str],
    partitions: int | None = None,
    pack: bool = True,
) -> DataFrame:
    """Comma text without a header row, plain or gzip.

    A gzip file is one task whatever its size; `partitions` spreads its rows.
    """
    df = spark.read.options(**CSV_QUOTING).schema(import_schema(columns)).csv(path)
    if partitions:
        df = df.repartition(partitions)
    return pack_samples(df) if pack else df


def read_import_csv(spark: SparkSession, directory: str, columns: list[str]) -> DataFrame:
    """A directory of CSV files with a header row: bigint positions, the rest text."""
    reader = spark.read.options(header=True, **CSV_QUOTING)
    return reader.schema(import_schema(columns)).csv(directory)


def read_import_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files with their own schema."""
    return spark.read.parquet(*paths)


def read_string_csv(
    spark: SparkSession, directory: str, columns: list[str], header: bool = False
) -> DataFrame:
    """CSV with every column text, named by the caller."""
    reader = spark.read.options(header=header, **CSV_QUOTING)
    return reader.schema(string_schema(columns)).csv(directory)


def read_raw_vcf_csv(spark: SparkSession, directory: str) -> DataFrame:
    """Every `*.csv` of a directory, header row, names in lower case, all text.

    Other files and sub-directories are left out. The files must share one header; a
    file with another one is an error, never a silent shift of columns.
    """
    df = (
        spark.read.options(header=True, enforceSchema=False, **CSV_QUOTING)
        .option("pathGlobFilter", "*.csv")
        .csv(directory)
    )
    return df.toDF(*[c.lower() for c in df.columns])


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A dbSNP, gene or sample-metadata table.

    No broadcast is forced: Spark broadcasts it when it is below its size threshold.
    """
    return spark.read.parquet(path)


def _outcome(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("outcome") == outcome).drop("outcome")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The standardised records of `write_outcomes`."""
    return _outcome(spark, path, RECORD).select("record.*")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `write_outcomes` stored as rejected, as they came, with `reason` or
    `errors`."""
    rows = _outcome(spark, path, REJECTED)
    return rows.select("row.*", "reason") if "row" in rows.columns else rows


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `write_outcomes` stored as clean, positions as bigint."""
    return _typed(_outcome(spark, path, CLEAN).drop("errors"))


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    """`chromosome_profile` of a per-chromosome layout from the footers of its files: counts
    and maxima per partition, which the Parquet reader answers without reading a column.

    It reads in a session of its own, as this needs the reader's second version.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    return chromosome_profile(own.read.parquet(path))


def read_sharded_dir(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """All shards of a result directory as one table; gzip text is unpacked."""
    if fmt == "csv":
        options = {"header": True, **CSV_QUOTING, **options}
    return spark.read.options(**options).format(fmt).load(path)

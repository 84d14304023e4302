"""Writers of results."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siteweave.functions.info import plain_decimal
from siteweave.operators.alleles import REPORT_COLUMNS, allele_report
from siteweave.operators.columns import drop_by_suffix
from siteweave.schema import STANDARD
from siteweave.sources.readers import CSV_QUOTING


def write_result(
    df: DataFrame,
    target: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    location: str | None = None,
):
    """Write a query's rows: `parquet`, `csv` (gzip shards with a header) or `table`
    (a table name in the catalog, its files at `location` if given). Every task writes
    its own shard."""
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(target)
    elif fmt == "csv":
        writer.options(header=True, compression="gzip", **CSV_QUOTING).csv(target)
    elif fmt == "table":
        (writer.option("path", location) if location else writer).saveAsTable(target)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_vcf_json(df: DataFrame, path: str, mode: str = "errorifexists"):
    """Per-allele rows of a variant table as JSON lines."""
    allele_report(drop_by_suffix(df)).write.mode(mode).option(
        "ignoreNullFields", False
    ).json(path)


def write_counted_json(df: DataFrame, path: str, source: str, table: str, mode: str = "errorifexists") -> DataFrame:
    """`write_vcf_json`, and the answer's `variant_envelope`, from one run over the source: its
    rows are counted while they are written."""
    seen = Observation()
    write_vcf_json(df.observe(seen, F.count(F.lit(1)).alias("data_count")), path, mode)
    count = seen.get["data_count"]
    one = df.sparkSession.range(1).select(
        F.lit(source).alias("source"),
        F.lit(table).alias("table"),
        F.lit(count).cast("long").alias("data_count"),
        F.lit(REPORT_COLUMNS).alias("headers"),
    )
    return one


def write_outcomes(outcomes: DataFrame, path: str, mode: str = "errorifexists"):
    """The rows of `outcomes` (of a standardiser or `validate_outcomes`) with a directory for
    what was accepted and one for what was rejected, in one pass over the export."""
    outcomes.write.mode(mode).partitionBy("outcome").parquet(path)


def write_table_json(df: DataFrame, path: str, mode: str = "errorifexists"):
    """Any table as JSON lines, values typed by the schema."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def result_envelope(
    df: DataFrame, source: str, table: str, headers: list[str] | None = None
) -> DataFrame:
    """One row about a result: source, table, `data_count` and `headers`.

    `data_count` counts the rows of `df`, the source rows of a variant answer.
    """
    names = list(df.columns) if headers is None else headers
    return df.agg(F.count("*").alias("data_count")).select(
        F.lit(source).alias("source"),
        F.lit(table).alias("table"),
        "data_count",
        F.lit(names).alias("headers"),
    )


def variant_envelope(df: DataFrame, source: str, table: str) -> DataFrame:
    """The envelope of a variant answer."""
    return result_envelope(df, source, table, REPORT_COLUMNS)


def write_standard_csv(records: DataFrame, path: str, mode: str = "errorifexists"):
    """Standardised records as CSV with upper-case headers and plain decimals."""
    columns = [
        (plain_decimal(F.col(c)) if c == "minor_af" else F.col(c)).alias(c.upper())
        for c in STANDARD.names
    ]
    records.select(*columns).write.mode(mode).options(header=True, **CSV_QUOTING).csv(path)

"""Stored layouts that later queries can prune.

All of them range-partition by position, so that a file covers a short stretch of one
chromosome and its statistics skip it. A hash of the row as last range key lets Spark split
a position that holds far more rows than others; it is the same in every attempt of a task.
"""

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.operators.columns import bin_width, level_width, normalise_raw, with_bin, with_level
from siteweave.schema import BIN, BIN_WIDTH, BIN_WIDTH_KEY, COMPACT, KEY5, LEVEL, SAMPLES_KEY, require

ORDER = ["reference_name", "start_position"]

#: HotSpot compiles no method of more bytes of code than this, and Spark's own limit is eight times
#: as high: a row of many cells is often made by one method between the two, which is interpreted.
COMPILED = ("spark.sql.codegen.hugeMethodLimit", "8000")


@contextmanager
def _compiled(spark: SparkSession):
    """Spark makes methods that are compiled, in several steps if need be, while this is open,
    unless the session sets a limit of its own."""
    name, limit = COMPILED
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.unset(name)


def _by_position(df: DataFrame, partitions: int | None, order: list[str] = ORDER) -> DataFrame:
    salted = df.withColumn("_spread", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    keys = [*order, "_spread"]
    ranged = (
        salted.repartitionByRange(partitions, *keys)
        if partitions
        else salted.repartitionByRange(*keys)
    )
    return ranged.sortWithinPartitions(*order).drop("_spread")


def write_binned(
    df: DataFrame,
    path: str,
    width: int = BIN_WIDTH,
    partitions: int | None = None,
    partition_by_bin: bool = False,
    mode: str = "errorifexists",
    levels: bool = False,
):
    """Position-binned Parquet with one directory per chromosome.

    The bin is an ordinary column unless `partition_by_bin`, which makes one directory
    per bin and suits only tables that are dense at that width. With `levels` each row has the
    level of its span as well and rows are sorted by it first, so that overlaps with a
    stretch prune files and row groups by start although some variants are very long.
    """
    if bin_width(df) != width:
        df = with_bin(df, width)
    if levels and level_width(df) != width:
        df = with_level(df, width)
    order = ["reference_name", LEVEL, "start_position"] if levels else ORDER
    df = df.withMetadata(
        "start_position", {**df.schema["start_position"].metadata, BIN_WIDTH_KEY: width}
    )
    by = ["reference_name", BIN] if partition_by_bin else ["reference_name"]
    with _compiled(df.sparkSession):
        _by_position(df, partitions, order).write.mode(mode).partitionBy(*by).parquet(path)


def replace_chromosome(df: DataFrame, path: str, partitions: int | None = None):
    """Copy every chromosome of `df` into a per-chromosome table, in one job, in the place of
    what the table has of it; the other chromosomes stay."""
    with _compiled(df.sparkSession):
        _by_position(df, partitions).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("reference_name").parquet(path)


def _kept(have: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `have` that stay when `df` is inserted: those of its chromosomes under other keys.

    The names of the chromosomes come to the driver, as each is a directory: only those are
    read, and the rows move once, to meet the keys.
    """
    names = [r[0] for r in df.select("reference_name").distinct().collect()]
    concerned = F.col("reference_name").isin([n for n in names if n is not None])
    if None in names:
        concerned |= F.col("reference_name").isNull()
    delta = df.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    return have.where(concerned).join(delta, same, "left_anti")


def append_chromosome(df: DataFrame, path: str, partitions: int | None = None, keys: list[str] = KEY5):
    """Insert the rows of `df` into a per-chromosome table, by key and safe to repeat.

    The rows that the table has under keys of `df` make way for those of `df`; all its
    others stay, and so do chromosomes that `df` has nothing of. The new content of the
    chromosomes concerned is written beside the table first and takes the place of the old
    one in one job then: a run that fails or is repeated leaves nothing out and nothing twice.
    """
    require(df, keys)
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return replace_chromosome(df, path, partitions)
    schema = spark.read.parquet(path).schema
    name = T.StructField("reference_name", df.schema["reference_name"].dataType)
    fields = [name if f.name == name.name else f for f in schema.fields]
    have = spark.read.schema(T.StructType(fields)).parquet(path)
    # a folder that readers of the table pass over
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    with _compiled(spark):
        _kept(have, df, keys).unionByName(df, allowMissingColumns=True).write.parquet(staged)
    replace_chromosome(spark.read.parquet(staged), path, partitions)
    files.delete(jvm.org.apache.hadoop.fs.Path(staged), True)


#: What a bucket holds at most, about, in bytes of Spark's rows: a join sorts a whole bucket of
#: each table in one task.
BUCKET_BYTES = 64 << 20
LEAST_BUCKETS, MOST_BUCKETS = 4, 100_000


def _row_bytes(df: DataFrame) -> int:
    """About how many bytes a row takes in memory: 16 for each call, one if it is compact."""
    size = 0
    for field in df.schema.fields:
        if SAMPLES_KEY in field.metadata:
            each = 1 if field.name == COMPACT else 16
            size += 16 + each * len(field.metadata[SAMPLES_KEY])
        else:
            size += 8 if isinstance(field.dataType, (T.NumericType, T.BooleanType)) else 32
    return size


def bucket_count(*tables: DataFrame) -> int:
    """How many buckets `write_bucketed` should give each of these tables, which are to be joined:
    their number follows the rows of the largest table, so that a bucket does not. The rows
    are counted, which reads next to nothing of a stored table."""
    sizes = [df.count() * _row_bytes(df) for df in tables]
    return min(max(LEAST_BUCKETS, -(-max(sizes) // BUCKET_BYTES)), MOST_BUCKETS)


def write_bucketed(
    df: DataFrame, table: str, buckets: int, keys: list[str] = KEY5, mode: str = "errorifexists"
):
    """A catalog table bucketed and sorted by the variant key, one file a bucket.

    Two tables of equally many buckets by the same keys are merged or annotated without
    a shuffle: `merge_halves(a, b, plain=True)`, `annotate_variants(a, b, plain=True)`. A key
    stays in one bucket however many rows it has. `bucket_count` finds how many suit both.
    """
    require(df, keys)
    dealt = df.repartition(buckets, *[F.col(k) for k in keys])
    with _compiled(df.sparkSession):
        dealt.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def write_clustered(
    raw: DataFrame, target: str, partitions: int | None = None, mode: str = "errorifexists"
):
    """Raw VCF names -> a table clustered by chromosome and position, end derived."""
    with _compiled(raw.sparkSession):
        _by_position(normalise_raw(raw), partitions).write.mode(mode).parquet(target)


def rebin(
    spark: SparkSession,
    path_in: str,
    path_out: str,
    width: int = BIN_WIDTH,
    partitions: int | None = None,
    mode: str = "errorifexists",
):
    """Raw Parquet -> the binned layout of `write_binned`, in one pass."""
    write_binned(normalise_raw(spark.read.parquet(path_in)), path_out, width, partitions, mode=mode)

"""Helpers the operators share: saved tables, words, shingles, connected components."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: The words of a text are the runs of these, as SQL patterns see them.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting for the size of an Arrow batch, and what it is set to where the user left it
#: unset. Texts in 10,000 rows take tens of MB, in the JVM (outside its heap) and in Python alike.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark: SparkSession):
    """Bound Arrow batches by bytes in this session, unless the user has set a bound."""
    if spark.conf.get(ARROW_BYTES[0], None) is None:
        spark.conf.set(*ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (`spark.checkpoint.dir`).

    Only a local master may leave it unset; it then gets one in the warehouse folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that `saved` wrote and `remove_saved` has not removed yet.
SAVED: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and a lost
    executor costs no more than the reading. It stays until `remove_saved`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    SAVED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_saved(spark: SparkSession, since: int = 0):
    """Remove what `saved` wrote in this process, from the `since`-th folder on. Results that
    operators returned read these folders: store them first."""
    jvm = spark.sparkContext._jvm
    for path in SAVED[since:]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    del SAVED[since:]


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


#: Bytes of text that a piece of a batch holds besides its first text, and what a row counts for besides its text.
PIECE_BYTES, ROW_BYTES = 1 << 20, 64


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices that hold at most PIECE_BYTES in the string column `at`, besides the
    slice's first text. What Python makes of a slice is gone before the next, so a worker's memory does not
    follow the size of Spark's batches."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + ROW_BYTES)
    starts = [0, *(np.flatnonzero(np.diff(ends // PIECE_BYTES)) + 1).tolist(), batch.num_rows]
    for start, end in zip(starts, starts[1:], strict=False):
        yield batch.slice(start, end - start)


def words_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased. bytes.lower and bytes.split know ASCII alone, which is
    what WORD asks for."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles_of(words: list[bytes], width: int = 5) -> np.ndarray:
    """The distinct hashes of all runs of `width` words, ascending. A shorter sequence is
    one shingle; no words, none."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    span = min(width, len(words))
    runs = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - span + 1 + k]
    return np.unique(mixed(runs))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node that each node reaches: (node, component).

    Large-star and small-star steps in turn until the edges are stars. A step is a
    smallest neighbour per node, which combines before the shuffle, and a join that
    Spark can split, so a node with very many neighbours holds no task up.
    """
    now = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u > v")
        .distinct()
    )
    before = None
    while True:
        mark = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")
        ).first()
        if mark == before or mark["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v"), F.col("v")).distinct()
            )
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.union(low.select("u", F.col("m").alias("v"))).distinct())


#: Bits of a filter for each member, and the most bits of a filter (16 MB).
FILTER_BITS = 16
MOST_BITS = 1 << 27


def likely(rows: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with `likely`: true where the keys are among those of `members`, and for about one
    in FILTER_BITS of the others (more of them beyond MOST_BITS / FILTER_BITS members).

    A bitmap of the keys' hashes goes to every task. It is bounded, which the members are
    not, so however many these are the rows stay where they are.
    """
    size = min(MOST_BITS, 1 << max(15, (FILTER_BITS * members.count() - 1).bit_length()))
    at = F.pmod(F.xxhash64(*keys, F.lit("likely")), F.lit(size)) + 1
    bits = members.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits")
    )
    byte = "conv(hex(substring(_bits, CAST(bitmap_bit_position(_at) DIV 8 AS int) + 1, 1)), 16, 10)"
    is_set = F.expr(f"getbit(CAST({byte} AS int), CAST(bitmap_bit_position(_at) % 8 AS int)) = 1")
    found = rows.withColumn("_at", at).join(
        F.broadcast(bits), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left"
    )
    return found.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias("likely"))


def parted(rows: DataFrame, members: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys are among those of `members`, and the others. Only rows that are
    likely to be found are joined, and so shuffled."""
    marked = likely(rows, members, keys)
    maybe = marked.where("likely").drop("likely")
    others = marked.where("NOT likely").drop("likely")
    wanted = members.select(*keys)
    return maybe.join(wanted, keys, "left_semi"), others.unionByName(maybe.join(wanted, keys, "left_anti"))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at the most, by a hash of their key: all rows if there are fewer,
    the same ones on each run, and spread evenly over the table."""
    n = rows.count()
    if n <= most:
        return rows
    slices = 1_000_003
    # 5 % under the bound, so that chance does not exceed it
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(slices)) < int(slices * 0.95 * most / n))


def crc_part(id_column: str, parts: int) -> Column:
    """The remainder of crc32 of the id as text."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts))


def tiled(rows: DataFrame, groups: list[str], parts: Column, node: str) -> DataFrame:
    """Deals rows of (groups, cell, node, ...) to tiles, in which every pair of rows of one
    group meets whose cells are equal or next to each other, exactly once.

    A cell is cut by hash into `parts` parts, an aggregate over its rows. A tile is a pair of
    parts: (cell, i, step, j), of the cell itself (step 0) or of it and the next (step 1).
    Its rows have side 0 or 1; where i and j are the same part, all have side 0.
    """
    cells = rows.groupBy(*groups, "cell").agg(parts.cast("int").alias("parts"))
    beside = F.explode(F.array(F.col("cell"), F.col("cell") - 1, F.col("cell") + 1))
    at = lambda step: F.max(F.when(F.col("cell") == F.col("of") + step, F.col("parts")))
    near = (
        cells.select(*groups, beside.alias("of"), "cell", "parts")
        .groupBy(*groups, "of")
        .agg(at(0).alias("own"), at(-1).alias("below"), at(1).alias("above"))
        .where("own is not null")
        .withColumnRenamed("of", "cell")
    )
    cell, part = F.col("cell"), F.col("part")

    def upto(n):
        n = F.coalesce(n, F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def tile(first, i, step, j, side):
        return F.struct(
            first.alias("cell"), i.alias("i"), F.lit(step).alias("step"), j.alias("j"), F.lit(side).alias("side")
        )

    tiles = F.concat(
        F.transform(F.sequence(part, F.col("own") - 1), lambda j: tile(cell, part, 0, j, 0)),
        F.transform(upto(part), lambda i: tile(cell, i, 0, part, 1)),
        F.transform(upto(F.col("above")), lambda j: tile(cell, part, 1, j, 0)),
        F.transform(upto(F.col("below")), lambda i: tile(cell - 1, i, 1, part, 1)),
    )
    kept = [c for c in rows.columns if c != "cell"]
    return (
        rows.join(near, [*groups, "cell"])
        .withColumn("part", F.pmod(F.xxhash64(node), F.col("own")).cast("int"))
        .select(*kept, F.explode(tiles).alias("tile"))
        .select(*kept, "tile.*")
    )


TILE_KEYS = ["cell", "i", "step", "j"]


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new

"""Sharding by Karmarkar-Karp differencing, in levels."""

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.llm.common import saved, table

#: Most partial partitions that one task combines.
FAN_IN = 4096


def combine(parts: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over partial partitions, each a list of k sums.

    The two with the largest spread merge, the fullest bin of one with the emptiest of the
    other, until one is left. Returns its sums and, for each part, the bin of the result
    that each of its bins went to.
    """
    k = len(parts[0])
    # bins of a partial partition: (sum, the members' bins as (part, bin) chains)
    where = [list(range(k)) for _ in parts]
    groups = {i: [i] for i in range(len(parts))}
    sums = {i: list(p) for i, p in enumerate(parts)}
    heap = [(min(p) - max(p), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        if len(groups[a]) < len(groups[b]):
            a, b = b, a
        up = sorted(range(k), key=lambda x: (sums[a][x], x))
        down = sorted(range(k), key=lambda x: (-sums[b][x], x))
        to = dict(zip(down, up, strict=True))
        for x in range(k):
            sums[a][to[x]] += sums[b][x]
        for part in groups.pop(b):
            where[part] = [to[x] for x in where[part]]
            groups[a].append(part)
        del sums[b]
        heapq.heappush(heap, (min(sums[a]) - max(sums[a]), a))
    (root,) = groups
    return sums[root], where


def difference(items: DataFrame, shards: int) -> DataFrame:
    """The shard of each item of (item, size): (item, shard).

    Items are dealt by hash into bins of about FAN_IN, and each bin is differenced in its
    own task. Its result is again a partial partition, so the results are differenced in
    the same way, level by level, until one is left: no task gets more than a few times
    FAN_IN parts at any size of the input. Each level keeps where a part's bins went, and
    the items follow those moves down.
    """
    count = items.count()
    if count == 0:
        return items.select("item", F.lit(0).alias("shard"))
    schema = "part long, parent long, sums array<long>, moves array<int>"
    levels = []
    parts = items.select(
        F.col("item").alias("part"),
        F.concat(F.array(F.col("size")), F.array_repeat(F.lit(0).cast("long"), shards - 1)).alias("sums"),
    )
    while True:
        bins = max(1, -(-count // FAN_IN))

        def one_bin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part", ignore_index=True)
            sums, moves = combine([[int(x) for x in s] for s in pdf["sums"]])
            first = [sums if k == 0 else None for k in range(len(pdf))]
            return pd.DataFrame({"part": pdf["part"], "parent": key[0], "sums": first, "moves": moves})

        done = saved(
            parts.withColumn("bin", F.pmod(F.xxhash64("part", F.lit(len(levels))), F.lit(bins)))
            .groupBy("bin")
            .applyInPandas(one_bin, schema)
        )
        levels.append(done)
        if bins == 1:
            break
        parts = done.where("sums is not null").select(F.col("parent").alias("part"), "sums")
        count = bins
    # an item begins in bin 0 of its own partition
    shard = levels[0].select(F.col("part").alias("item"), "parent", F.col("moves")[0].alias("shard"))
    for level in levels[1:]:
        up = level.select(F.col("part").alias("parent"), F.col("parent").alias("above"), "moves")
        shard = shard.join(up, "parent").select(
            "item", F.col("above").alias("parent"), F.element_at("moves", F.col("shard") + 1).alias("shard")
        )
    return shard.select("item", "shard")


def slots(rows: DataFrame, bucket_rows: int = 50_000) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, in no single task.

    Equal rows count as one with a number of copies; the rest fall in hash buckets of about
    `bucket_rows`, numbered each on its own after the sizes of the buckets before it.
    """
    names = rows.columns
    buckets = max(1, -(-rows.count() // bucket_rows))
    once = saved(
        rows.groupBy(*names)
        .agg(F.count("*").alias("copies"))
        .withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    )
    sizes = once.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    offset = F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = sizes.select("shard", "bucket", offset.alias("start"))
    inside = W.partitionBy("shard", "bucket").orderBy(*[n for n in names if n != "shard"])
    upto = F.sum("copies").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return (
        once.withColumn("upto", upto)
        .join(starts, ["shard", "bucket"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(*names, (F.col("start") + F.col("upto") - F.col("copies") + F.col("copy")).alias("slot"))
    )


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents dealt to shards of nearly equal bytes, equal texts together.

    Equal texts form a group that no shard border cuts; a group is known by two hashes and
    the length of its text (texts that agree in all three would merely stay together). The
    groups are partitioned by differencing.

    Returns one row per row: doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32
    (null text: 0), law 'bytes', shard, slot, grown_shard null. All null texts are one
    group; empty tables give no rows; a group may hold any part of all rows.
    """
    text = F.col(text_column)
    raw = F.encode(text, "UTF-8")
    rows = saved(
        docs.select(
            F.col(id_column).alias("doc_id"),
            text_bytes(text).alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text, F.octet_length(text)).alias("item"),
        )
    )
    key = ["item", "size", "text_crc32"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"))
    items = groups.groupBy("item").agg(F.sum(F.col("n") * F.col("size")).alias("size"))
    dealt = saved(difference(saved(items), shards))
    placed = rows.join(dealt, "item").select("doc_id", "size", "text_crc32", "shard")
    return slots(placed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards."""
    return shard(table(spark, sf_dir, "documents"))

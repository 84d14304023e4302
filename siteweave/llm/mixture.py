"""Mixing sources to target weights by hash-threshold histograms."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.llm.common import WORD, saved, table

#: Bits of the hash that one histogram resolves, and how many histograms follow one another.
BITS = 12
LEVELS = 3

Weights = Callable[[list[str | None]], list[float]]


def targets_of(sizes: list[tuple[str | None, int]], weights: list[float], total: float, most: float):
    """Shares of `total` by weight; what exceeds `most` times a source's size goes to the
    others by weight, until none is above."""
    targets = [0.0] * len(sizes)
    open_ = {k for k, (_, size) in enumerate(sizes) if size > 0}
    left = min(float(total), sum(most * size for _, size in sizes))
    while open_:
        whole = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / whole >= most * sizes[k][1]}
        if not full:
            for k in open_:
                targets[k] = left * weights[k] / whole
            break
        for k in full:
            targets[k] = float(most * sizes[k][1])
        left -= sum(targets[k] for k in full)
        open_ -= full
    return targets


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(id_column: str, text_column: str) -> Column:
    """A number of LEVELS * BITS bits from the hash of a row."""
    mark = F.xxhash64(F.col(id_column), F.crc32(F.encode(text_column, "UTF-8")))
    return F.shiftrightunsigned(mark, 64 - BITS * LEVELS)


def copies_of(place: Column) -> Column:
    """How often the mixture takes a row of this place, beside the columns of `sources_mixed`."""
    return F.col("mix_times") + (place < F.col("mix_cut")).cast("int")


def sources_mixed(rows: DataFrame, weights: Weights, share: float, most: float) -> DataFrame:
    """One row per source of (source, size, h): mix_source, mix_size, mix_target, mix_times,
    mix_cut. What the driver holds is a few numbers a source."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    # by code point, which is also the order of the UTF-8 bytes
    order = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [(r["source"], r["size"]) for r in order]
    total = sum(size for _, size in sizes)
    targets = targets_of(sizes, weights([name for name, _ in sizes]), share * total, most)
    plan = []
    for (name, size), target in zip(sizes, targets, strict=True):
        times = int(target // size) if size else 0
        plan.append((name, size, target, times, target - times * size))
    schema = "mix_source string, mix_size long, mix_target double, mix_times int, rest double"
    mixture = rows.sparkSession.createDataFrame(plan, schema)
    cuts = thresholds(rows, mixture.select(F.col("mix_source").alias("source"), "rest"))
    return saved(
        mixture.join(cuts, mixture["mix_source"].eqNullSafe(cuts["source"]), "left").select(
            "mix_source", "mix_size", "mix_target", "mix_times", F.col("cut").alias("mix_cut")
        )
    )


def measured(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return saved(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).cast("string").alias("source"),
            word_count(F.col(text_column)).alias("size"),
            place_of(id_column, text_column).alias("h"),
        )
    )


def mix(
    docs: DataFrame,
    weights: Weights,
    share: float,
    most: float = 2.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """How many words of each document a mixture of the sources takes.

    `weights` gets the sources by code point, null last, and gives their weights; `share`
    is the mixture's size as a part of all words, `most` the most that a source repeats.

    A source with target t and size s takes each document floor(t / s) times, and those
    once more whose hash lies under a threshold. Thresholds come from histograms: words by
    source and the hash's first bits; the bucket where the budget ends is split by the next
    bits, and so on, LEVELS times. The documents taken at a smaller budget are among those
    taken at a larger one. Nothing is sorted, and the driver holds a few numbers a source.

    Returns one row per row of `docs`: doc_id, size, source_size, target, taken, copies.
    Null and empty texts have size 0 and 0 words taken; a null source is a source; rows
    alike in id and text share their hash and go in or stay out together; no rows give none.
    """
    rows = measured(docs, id_column, text_column, source_column)
    plan = sources_mixed(rows, weights, share, most)
    return rows.join(plan, rows["source"].eqNullSafe(plan["mix_source"]), "left").select(
        "doc_id",
        "size",
        F.col("mix_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("size") * copies_of(F.col("h"))).alias("taken"),
        copies_of(F.col("h")).alias("copies"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: Weights,
    share: float,
    most: float = 2.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The rows of `docs` as often as the mixture takes them, all columns as they are. The
    texts meet a table of one row per source and are not sorted or grouped."""
    rows = measured(docs, id_column, text_column, source_column)
    plan = sources_mixed(rows, weights, share, most)
    whole = docs.select(
        F.struct("*").alias("mix_row"),
        F.col(source_column).cast("string").alias("mix_of"),
        place_of(id_column, text_column).alias("mix_place"),
    )
    times = F.array_repeat(F.lit(0), copies_of(F.col("mix_place")))
    return (
        whole.join(plan, F.col("mix_of").eqNullSafe(F.col("mix_source")))
        .select("mix_row", F.explode(times).alias("mix_copy"))
        .select("mix_row.*")
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """The threshold of each source: rows with h under it hold about `rest` words.

    One histogram a level. The first covers all rows, later ones the boundary bucket of
    each source alone, a 2**-BITS part of the rows of the level before.
    """
    state = saved(budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix")))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = rows.join(
            state,
            rows["source"].eqNullSafe(state["source"])
            & (F.shiftright(rows["h"], shift + BITS) == state["prefix"]),
        ).select(rows["source"], rows["size"], F.shiftright(rows["h"], shift).alias("bucket"))
        bars = inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        # at most 2**BITS bars a source
        upto = F.sum("words").over(
            W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        )
        under = bars.withColumn("upto", upto).join(
            state.select(F.col("source").alias("s"), F.col("rest"), F.col("prefix")),
            F.col("source").eqNullSafe(F.col("s")),
            "right",
        )
        fits = F.col("upto") <= F.col("rest")
        state = saved(
            under.groupBy("s", "rest", "prefix")
            .agg(
                F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("used"),
                # the bucket where the budget ends; past all bars if it never does
                F.min(F.when(~fits, F.col("bucket"))).alias("edge"),
                F.max("bucket").alias("top"),
                F.min_by("words", F.when(~fits, F.col("bucket"))).alias("edge_words"),
            )
            .select(
                F.col("s").alias("source"),
                (F.col("rest") - F.col("used")).alias("rest"),
                F.coalesce("edge", F.shiftleft(F.col("prefix") + 1, BITS)).alias("prefix"),
                F.col("edge_words"),
            )
        )
        edge = state
        state = state.drop("edge_words")
    # the last bucket goes in if that brings the words nearer to the budget
    return edge.select(
        "source",
        (F.col("prefix") + F.coalesce((2 * F.col("rest") > F.col("edge_words")).cast("long"), F.lit(0))).alias(
            "cut"
        ),
    )


def cycle_5_2_1(sources: list[str | None]) -> list[float]:
    return [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sources))]


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: weights 5, 2, 1 in turn, 150% of all words, at most twice each."""
    return mix(table(spark, sf_dir, "documents"), cycle_5_2_1, 1.5)

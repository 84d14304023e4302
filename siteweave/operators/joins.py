"""Joins of variant tables on their key.

Spark splits a hot key of an inner join on both sides (AQE skew join), but in an outer
join only the preserved side of a one-sided join: one key that fills much of the other
side would end in one task. An outer join therefore counts the keys of both tables first,
inside the same query, and takes the HOT_KEYS heaviest of those with HOT_ROWS rows or more.
The rows of such a key are dealt out by a salt on the side that has more of them and
repeated for every salt on the other side; a repeated row that meets nothing under its salt
met others under another one and is dropped. Each table is read twice, once for its keys
alone, and shuffled as a whole once. Rows with a null key match nothing and are dealt out by
hash. No job runs while the plan is built; a caller who knows that no key is hot may ask for
the plain join.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.genotypes import NULL_CODE
from siteweave.functions.literals import literal_array
from siteweave.operators.columns import (
    bin_width,
    compact_genotypes,
    merge_columns,
    packed,
    packed_samples,
    star_except,
    with_bin,
)
from siteweave.operators.ranges import covering_ranges, starts_in_ranges
from siteweave.schema import BIN, COMPACT, GENOTYPES, KEY3, KEY4, KEY5, SAMPLES_KEY, require

JOIN_TYPES = ("inner", "left", "right", "full")

# Rows of one key that make it hot, and the most keys that are treated so.
HOT_ROWS = 10_000
HOT_KEYS = 1_000
# The most parts that a hot key and the rows with null keys are dealt into.
MOST_SALTS = 10_000
NULL_SALTS = 4_096


def _prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(
        *keys,
        *[F.col(f"`{c}`").alias(prefix + c.lower()) for c in df.columns if c not in keys],
    )


def _plain_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """One join; `_side` tells which table a row comes from."""
    flagged = left.selectExpr("*", "true AS _on_left").join(right.selectExpr("*", "true AS _on_right"), keys, how)
    return flagged.selectExpr(
        "*", "CASE WHEN _on_right IS NULL THEN 'left' WHEN _on_left IS NULL THEN 'right' ELSE 'both' END AS _side"
    )


def _no_null(keys: list[str]) -> str:
    return " AND ".join(f"{k} IS NOT NULL" for k in keys)


def _key_hashes(keys: list[str]) -> tuple[str, str]:
    """SQL for the key in 128 bits, which are fewer to group by than its columns."""
    return f"xxhash64({', '.join(keys)})", f"xxhash64('second', {', '.join(keys)})"


def _hot_keys(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """The heaviest keys with their rows on both sides: HOT_KEYS at most, so that they can go
    to every task. Any key that is left out has fewer rows than `hot_rows`, or than each
    of these."""
    first, second = _key_hashes(keys)
    hashes = [f"{first} AS _hot_1", f"{second} AS _hot_2"]
    counts = [
        df.where(_no_null(keys)).selectExpr(*hashes, f"{a} AS _n_left", f"{b} AS _n_right")
        for df, a, b in ((left, 1, 0), (right, 0, 1))
    ]
    both = counts[0].union(counts[1]).groupBy("_hot_1", "_hot_2")
    found = both.agg(F.expr("sum(_n_left) AS _n_left"), F.expr("sum(_n_right) AS _n_right"))
    rows = "greatest(_n_left, _n_right)"
    order = F.expr(rows).desc()
    return found.where(f"{rows} >= {hot_rows}").orderBy(order, "_hot_1", "_hot_2").limit(HOT_KEYS)


def _salted(
    df: DataFrame, hot: DataFrame, keys: list[str], hot_rows: int, spread: str, repeated: str
) -> DataFrame:
    """`df` with `_salt`, and whether the row is there once for each salt. Where `spread`
    holds, this side deals its rows of a hot key out; equal rows of several partitions part
    as well, and every attempt of a task deals alike."""
    first, second = _key_hashes(keys)
    is_hot = f"{_no_null(keys)} AND {first} = _hot_1 AND {second} = _hot_2"
    names = [f"`{c}`" for c in df.columns]
    row = f"xxhash64({', '.join(names)}, spark_partition_id())"
    salts = f"least(ceil(greatest(_n_left, _n_right) / {hot_rows}), {MOST_SALTS})"
    salt = f"""CASE WHEN NOT ({_no_null(keys)}) THEN array(pmod({row}, {NULL_SALTS}L))
        WHEN _hot_1 IS NULL THEN array(0L)
        WHEN {spread} THEN array(pmod({row}, {salts}))
        ELSE sequence(0L, {salts} - 1) END"""
    found = df.join(F.broadcast(hot), F.expr(is_hot), "left")
    is_repeated = f"_hot_1 IS NOT NULL AND NOT ({spread}) AS {repeated}"
    return found.selectExpr(*names, is_repeated, f"explode({salt}) AS _salt")


def _key_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, plain: bool, hot_rows: int
) -> DataFrame:
    """Join prefixed tables; outer joins with hot keys dealt out, unless `plain`."""
    if plain or how == "inner":
        return _plain_join(left, right, keys, how)
    hot = _hot_keys(left, right, keys, hot_rows)
    a = _salted(left, hot, keys, hot_rows, "_n_left >= _n_right", "_left_repeated")
    b = _salted(right, hot, keys, hot_rows, "_n_left < _n_right", "_right_repeated")
    joined = _plain_join(a, b, [*keys, "_salt"], how)
    # under another salt a repeated row has met the rows that its key is hot for
    twin = "(_side = 'left' AND _left_repeated) OR (_side = 'right' AND _right_repeated)"
    return joined.where(f"NOT coalesce({twin}, false)")


def _same_bins(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bins of different widths must not meet in one column."""
    if not {BIN} <= set(left.columns) & set(right.columns):
        return left, right
    width = bin_width(left)
    if width == bin_width(right):
        return left, right
    if width is None:
        return left.drop(BIN), right.drop(BIN)
    return left, with_bin(right.drop(BIN), width)


def join_variants(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    keys: list[str] = KEY5,
    coalesce: bool = False,
    parity_keys: bool = False,
    plain: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join on the variant key with the merged column list.

    Column names are lower-cased, left columns first. A name on both sides shows the
    left value, or the right one on rows that have no left part; `coalesce` also lets
    the right value stand in for a null on the left. Keys are filled from either side
    unless `parity_keys` asks for the left side's alone. `plain` makes an outer join one
    join, which suits keys that never repeat much; else keys with `hot_rows` rows or more on
    a side are dealt out to several tasks.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"how must be one of {JOIN_TYPES}, not {how!r}")
    require(left, keys)
    require(right, keys)
    left, right = _same_bins(left, right)
    merged = merge_columns(left.columns, right.columns)
    on_left = {c.lower() for c in left.columns}
    on_right = {c.lower() for c in right.columns}
    joined = _key_join(
        _prefixed(left, keys, "l_"), _prefixed(right, keys, "r_"), keys, how, plain, hot_rows
    )

    def column(side: str, name: str) -> Column:
        if name in keys:
            if parity_keys:
                return F.when(F.col("_side") != "right", F.col(name))
            return F.col(name)
        if name in on_left and name in on_right:
            first, second = F.col("l_" + name), F.col("r_" + name)
            if coalesce:
                return F.coalesce(first, second)
            if parity_keys:
                return first
            return F.when(F.col("_side") == "right", second).otherwise(first)
        return F.col(("l_" if side == "left" else "r_") + name)

    out = joined.select(*[column(s, n).alias(n) for s, n in merged])
    for df in (right, left):
        for field in df.schema.fields:
            if field.metadata and field.name.lower() in out.columns:
                out = out.withMetadata(field.name.lower(), field.metadata)
    return out


def merge_halves(
    a: DataFrame,
    b: DataFrame,
    keys: list[str] = KEY5,
    parity_keys: bool = False,
    plain: bool = False,
) -> DataFrame:
    """Full outer merge of two variant tables with disjoint samples.

    Takes wide or packed tables and gives a packed one: the genotypes of `a`, then
    those of the samples that only `b` has, null where a half has no such site. A sample
    named in both halves has the call of `a`, or that of `b` where `a` has none. With
    `keys=KEY4` the end position is not compared. If one of the tables is compact, the merged
    one is, and the join moves a byte a call.
    """
    if COMPACT in a.columns or COMPACT in b.columns:
        a, b = compact_genotypes(a), compact_genotypes(b)
        if not set(packed_samples(a)) & set(packed_samples(b)):
            return _merge_compact(a, b, keys, parity_keys, plain)
        return compact_genotypes(merge_halves(packed(a), packed(b), keys, parity_keys, plain))
    a, b = packed(a), packed(b)
    first, second = packed_samples(a), packed_samples(b)
    at = {s: i for i, s in enumerate(second)}
    fresh = [i for i, s in enumerate(second) if s not in set(first)]
    a = a.withColumnsRenamed({GENOTYPES: "_first"})
    b = b.withColumnsRenamed({GENOTYPES: "_second"})
    merged = join_variants(a, b, "full", keys, not parity_keys, parity_keys, plain)

    def or_missing(column: str, n: int) -> Column:
        return F.coalesce(F.col(column), F.array_repeat(F.lit(None).cast("string"), n))

    calls_a, calls_b = or_missing("_first", len(first)), or_missing("_second", len(second))
    if len(fresh) < len(second):
        # for each sample of `a` its place in `b`, one past the end if it has none
        twins = literal_array([at.get(s, len(second)) for s in first], "int")
        both, other = calls_a, calls_b
        calls_a = F.transform(
            F.arrays_zip(both.alias("call"), twins.alias("twin")),
            lambda x: F.coalesce(x["call"], F.get(other, x["twin"])),
        )
        calls_b = F.transform(literal_array(fresh, "int"), lambda i: F.get(other, i))
    samples = first + [second[i] for i in fresh]
    return merged.withColumn(GENOTYPES, F.concat(calls_a, calls_b)).withMetadata(
        GENOTYPES, {SAMPLES_KEY: samples}
    ).drop("_first", "_second")


def _merge_compact(a: DataFrame, b: DataFrame, keys: list[str], parity_keys: bool, plain: bool) -> DataFrame:
    samples = packed_samples(a) + packed_samples(b)
    sides = []
    for df, name in ((a, "_first"), (b, "_second")):
        sides.append(df.withColumnsRenamed({COMPACT: name}))
    merged = join_variants(*sides, "full", keys, not parity_keys, parity_keys, plain)

    def part(column: str, df: DataFrame) -> tuple[str, str]:
        missing = NULL_CODE * len(packed_samples(df))
        return f"coalesce({column}.codes, '{missing}')", f"coalesce({column}.rare, CAST(array() AS array<string>))"

    (codes_a, rare_a), (codes_b, rare_b) = part("_first", a), part("_second", b)
    calls = f"named_struct('codes', concat({codes_a}, {codes_b}), 'rare', concat({rare_a}, {rare_b}))"
    return (
        merged.withColumn(COMPACT, F.expr(calls)).withMetadata(COMPACT, {SAMPLES_KEY: samples}).drop("_first", "_second")
    )


def merge_halves_without_end(a: DataFrame, b: DataFrame) -> DataFrame:
    """`merge_halves` that does not compare end positions; the first known one stays."""
    return merge_halves(a, b, keys=KEY4)


def annotate_variants(
    variants: DataFrame, annotation: DataFrame, plain: bool = False, prune: bool = False
) -> DataFrame:
    """Left join of variants with their annotation rows.

    Several annotation rows for one key give several output rows. With `prune` a small job
    over the variants' positions finds a bounded number of ranges that cover them, and the
    scan of the annotation leaves out the chromosomes, bins and row groups outside of these:
    for few variants against an annotation table of the whole genome.
    """
    if prune:
        ranges = covering_ranges(variants, "start_position", "start_position")
        if ranges is not None:
            annotation = annotation.where(starts_in_ranges(annotation, ranges))
    return join_variants(variants, annotation, "left", plain=plain)


def annotate_allele_match(
    variants: DataFrame, annotation: DataFrame, insertion: bool = False
) -> DataFrame:
    """Inner join of the five variant keys with annotation columns, alleles equal.

    With `insertion`, an annotation row with an empty reference also matches a variant
    whose alternate is its reference followed by the annotated alternate. Each variant
    then offers up to two allele pairs, and the join stays a plain equi-join.
    """
    right = annotation.select(
        *KEY5, *[F.col(f"`{c}`") for c in star_except(annotation).columns]
    )
    left = variants.select(*KEY5)
    if not insertion:
        return left.join(right, KEY5, "inner")
    ref, alt = F.col("reference_bases"), F.col("alternate_bases")
    same = F.struct(ref.alias("match_ref"), alt.alias("match_alt"))
    inserted = F.struct(
        F.lit("").alias("match_ref"),
        F.substring(alt, F.length(ref) + 1, F.length(alt)).alias("match_alt"),
    )
    offers = left.select(
        *KEY5,
        F.inline(
            F.array_compact(F.array(same, F.when((ref != "") & alt.startswith(ref), inserted)))
        ),
    )
    match = [*KEY3, "match_ref", "match_alt"]
    right = right.withColumnsRenamed(
        {"reference_bases": "match_ref", "alternate_bases": "match_alt"}
    )
    return offers.join(right, match, "inner").drop("match_ref", "match_alt").select(
        *KEY5, *star_except(annotation).columns
    )


# The superpopulations, in report order.
SUPERPOPULATIONS = ["AMR", "EUR", "AFR", "SAS", "EAS"]


def join_published_counts(
    published: DataFrame,
    half1: DataFrame,
    half2: DataFrame,
    populations: list[str] = SUPERPOPULATIONS,
) -> DataFrame:
    """Published counts, one row per alternate, beside the population counts of both
    halves (`AMR1` .. `EAS2`). A site must be present in both halves."""
    main = published.select(
        "reference_name",
        F.col("start").alias("start_position"),
        F.col("end").alias("end_position"),
        "reference_bases",
        F.explode("alternate_bases").alias("alternate_bases"),
        "AC",
    )
    counts = [
        half.select(*KEY5, *[F.col(p).alias(p + suffix) for p in populations])
        for suffix, half in (("1", half1), ("2", half2))
    ]
    # The counts have one row a key, so only the last join may be skewed. Its further key asks
    # for shuffles of its own on both sides, which Spark can split.
    hashed = {"_key": F.xxhash64(*KEY5)}
    both = counts[0].join(counts[1], KEY5, "inner").withColumns(hashed)
    main = main.withColumns(hashed).join(both, [*KEY5, "_key"], "inner")
    return main.select(
        F.col("start_position").alias("start"),
        F.col("end_position").alias("end"),
        "reference_bases",
        "alternate_bases",
        "AC",
        *[p + s for s in ("1", "2") for p in populations],
    )

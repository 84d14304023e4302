"""Projections: sample columns, layout columns, column-list merging."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.functions.genotypes import decoded, encoded, others
from siteweave.functions.literals import literal_array, quoted_name, string_array
from siteweave.schema import (
    BIN,
    BIN_WIDTH,
    BIN_WIDTH_KEY,
    COMPACT,
    GENOTYPES,
    IGNORED_SUFFIXES,
    KEY5,
    LEVEL,
    LEVEL_FACTOR,
    LEVEL_WIDTH_KEY,
    LEVELS,
    POSITIONS,
    SAMPLES_KEY,
    VCF_COLUMNS,
    require,
)


def sample_columns(df: DataFrame) -> list[str]:
    """Every column that is neither a VCF column nor a layout column."""
    known = {c.lower() for c in VCF_COLUMNS} | {BIN, LEVEL, GENOTYPES, COMPACT}
    return [
        c
        for c in df.columns
        if c.lower() not in known and not c.lower().endswith(IGNORED_SUFFIXES)
    ]


def pack_samples(df: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Wide table -> packed table: one `genotypes` array instead of sample columns.

    The sample names go into the metadata of the array column, so that joins and
    sorts move only the genotypes, and a row never widens with the cohort.
    """
    samples = sample_columns(df) if samples is None else samples
    packed_away = set(samples)
    site = [F.col(quoted_name(c)) for c in df.columns if c not in packed_away]
    calls = string_array(samples)
    return df.select(*site, calls.alias(GENOTYPES, metadata={SAMPLES_KEY: samples}))


def packed_samples(df: DataFrame) -> list[str]:
    """Sample names of a packed or compact table, in the order of the calls."""
    column = COMPACT if COMPACT in df.columns else GENOTYPES
    require(df, [column])
    metadata = df.schema[column].metadata
    if SAMPLES_KEY not in metadata:
        raise ValueError(f"column {column} carries no sample names; pack it again")
    return list(metadata[SAMPLES_KEY])


def packed(df: DataFrame) -> DataFrame:
    """The packed form of a table, which may be wide, compact or packed already."""
    if COMPACT in df.columns:
        return expand_genotypes(df)
    return df if GENOTYPES in df.columns else pack_samples(df)


def compact_genotypes(df: DataFrame) -> DataFrame:
    """The compact form of a table: a character per call and the texts of the rare ones, in
    `compact_genotypes` instead of `genotypes`. An array costs 16 bytes a call in memory and
    in a shuffle, this form one. Counting, merging and pooling work on it as it is; other
    operators expand it first."""
    if COMPACT in df.columns:
        return df
    df = packed(df)
    samples = packed_samples(df)
    site = [quoted_name(c) for c in df.columns if c != GENOTYPES]
    calls = f"named_struct('codes', {encoded(GENOTYPES)}, 'rare', {others(GENOTYPES)})"
    # a row without an array stays without one
    column = f"CASE WHEN {GENOTYPES} IS NOT NULL THEN {calls} END AS {COMPACT}"
    return df.selectExpr(*site, column).withMetadata(COMPACT, {SAMPLES_KEY: samples})


def expand_genotypes(df: DataFrame) -> DataFrame:
    """The packed form of a compact table."""
    samples = packed_samples(df)
    site = [quoted_name(c) for c in df.columns if c != COMPACT]
    calls = decoded(f"{COMPACT}.codes", f"{COMPACT}.rare")
    column = f"CASE WHEN {COMPACT} IS NOT NULL THEN {calls} END AS {GENOTYPES}"
    return df.selectExpr(*site, column).withMetadata(GENOTYPES, {SAMPLES_KEY: samples})


def wide(df: DataFrame) -> DataFrame:
    """Packed or compact table -> wide table, the inverse of `pack_samples`."""
    df = packed(df)
    samples = packed_samples(df)
    site = [quoted_name(c) for c in df.columns if c != GENOTYPES]
    cells = [f"get({GENOTYPES}, {i}) AS {quoted_name(s)}" for i, s in enumerate(samples)]
    return df.selectExpr(*site, *cells)


def variant_columns(df: DataFrame) -> DataFrame:
    """Only the VCF columns, those that exist."""
    vcf = {c.lower() for c in VCF_COLUMNS}
    return df.select(*[c for c in df.columns if c.lower() in vcf])


def drop_layout(df: DataFrame) -> DataFrame:
    """All columns but the position bin and the level."""
    return df.drop(BIN, LEVEL)


def drop_by_suffix(
    df: DataFrame, suffixes: tuple[str, ...] = IGNORED_SUFFIXES
) -> DataFrame:
    """Drop columns whose name ends in one of the suffixes."""
    return df.drop(*[c for c in df.columns if c.endswith(tuple(suffixes))])


def star_except(df: DataFrame, names: list[str] = KEY5) -> DataFrame:
    """All columns except the given ones."""
    return df.drop(*names)


def normalise_raw(df: DataFrame) -> DataFrame:
    """Raw VCF names (`pos`, `ref`, `alt`) -> variant names, in lower case.

    Positions become bigint; a missing end is the start plus the reference length.
    Text that is no integer becomes null, which `validate_variants` reports.
    """
    renames = {
        "chrom": "reference_name",
        "pos": "start_position",
        "ref": "reference_bases",
        "alt": "alternate_bases",
    }
    vcf = {c.lower() for c in VCF_COLUMNS}
    columns = {}
    for c in df.columns:
        name = renames.get(c.lower(), c.lower() if c.lower() in vcf else c)
        if name in columns:
            raise ValueError(f"two columns become {name}")
        columns[name] = F.col(f"`{c}`")
    for p in POSITIONS:
        if p in columns:
            columns[p] = columns[p].try_cast("bigint")
    if "end_position" not in columns:
        end = columns["start_position"] + F.length(columns["reference_bases"])
        columns = {
            k: v
            for name, col in columns.items()
            for k, v in (
                [(name, col), ("end_position", end)]
                if name == "start_position"
                else [(name, col)]
            )
        }
    return df.select(*[col.alias(name) for name, col in columns.items()])


def bin_of(position, width: int):
    """Bin number of a position column or of a Python number."""
    if isinstance(position, int):
        return position // width
    # whole numbers throughout: a double would lose the last digits of a large position
    return F.call_function("div", position - F.pmod(position, F.lit(width)), F.lit(width))


def with_bin(df: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Add the position bin; its width is kept in the column's metadata."""
    if width <= 0:
        raise ValueError("bin width must be positive")
    column = bin_of(F.col("start_position"), width)
    return df.withColumn(BIN, column).withMetadata(BIN, {BIN_WIDTH_KEY: width})


def bin_width(df: DataFrame) -> int | None:
    """Width of the table's bins, or None when it has none or it is not known."""
    if BIN not in df.columns:
        return None
    return df.schema[BIN].metadata.get(BIN_WIDTH_KEY)


def level_widths(width: int) -> list[int]:
    """Bin widths of the levels, the last level aside."""
    return [width * LEVEL_FACTOR**k for k in range(LEVELS)]


def level_of(start, end, width: int):
    """The level of an interval, whose ends may come in either order."""
    level = F.lit(LEVELS)
    span = F.abs(end - start)
    for k, w in reversed(list(enumerate(level_widths(width)))):
        level = F.when(span < w, F.lit(k)).otherwise(level)
    return F.when(span.isNotNull(), level)


def with_level(df: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Add the level of each variant's span; its width is kept in the column's metadata."""
    if width <= 0:
        raise ValueError("bin width must be positive")
    column = level_of(F.col("start_position"), F.col("end_position"), width)
    return df.withColumn(LEVEL, column).withMetadata(LEVEL, {LEVEL_WIDTH_KEY: width})


def level_width(df: DataFrame) -> int | None:
    """Width of the table's levels, or None when it has none or it is not known."""
    if LEVEL not in df.columns:
        return None
    return df.schema[LEVEL].metadata.get(LEVEL_WIDTH_KEY)


def merge_columns(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """Merged column list as (side, name), left first.

    Names are lower-cased, the first of two equal names wins, and a list that
    repeats a name by itself is an error.
    """
    merged: dict[str, str] = {}
    for side, names in (("left", left), ("right", right)):
        lowered = [n.lower() for n in names]
        if len(set(lowered)) != len(lowered):
            raise ValueError(f"duplicate column names on the {side} side")
        for n in lowered:
            merged.setdefault(n, side)
    return [(side, name) for name, side in merged.items()]


def samples_by_population(
    metadata: DataFrame, populations: list[str] | None = None
) -> DataFrame:
    """Comma lists per half -> one row per (superpopulation, half, sample)."""
    require(metadata, ["SuperPopulation", "Half1", "Half2"])
    if populations is not None:
        metadata = metadata.where(F.col("SuperPopulation").isin(list(populations)))
    halves = F.array(
        F.struct(F.lit("half1").alias("half"), F.col("Half1").alias("names")),
        F.struct(F.lit("half2").alias("half"), F.col("Half2").alias("names")),
    )
    return (
        metadata.select(F.col("SuperPopulation").alias("superpopulation"), F.inline(halves))
        .withColumn("sample", F.explode(F.split("names", ",")))
        .select("superpopulation", "half", "sample")
    )


def unpivot_calls(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per site and sample: the site columns, `call_set_name`, `genotype`."""
    df = packed(df)
    keep = [c for c in df.columns if c != GENOTYPES] if keep is None else keep
    calls = F.arrays_zip(
        literal_array(packed_samples(df), "string").alias("call_set_name"),
        F.col(GENOTYPES).alias("genotype"),
    )
    return df.select(*keep, F.inline(calls).alias("call_set_name", "genotype"))


def lookup_columns(dbsnp: DataFrame) -> DataFrame:
    """dbSNP names -> variant names; other columns are kept."""
    return dbsnp.withColumnsRenamed(
        {
            "chrm": "reference_name",
            "start": "start_position",
            "end": "end_position",
            "base": "reference_bases",
            "alt": "alternate_bases",
            "ID": "id",
        }
    )

"""Column names, record types and fixed values shared by every module."""

from pyspark.sql import types as T

# The variant key, and the VCF columns of a variant table.
KEY3 = ["reference_name", "start_position", "end_position"]
KEY4 = ["reference_name", "start_position", "reference_bases", "alternate_bases"]
KEY5 = [
    "reference_name",
    "start_position",
    "end_position",
    "reference_bases",
    "alternate_bases",
]
VCF_COLUMNS = [
    "reference_name",
    "start_position",
    "end_position",
    "id",
    "reference_bases",
    "alternate_bases",
    "qual",
    "filter",
    "info",
    "format",
]
POSITIONS = ["start_position", "end_position"]
REFERENCE_NAMES = [str(c) for c in range(1, 23)] + ["X", "Y"]

# Fixed value: width in bases of one position bin in the published layout.
BIN = "bin_id"
BIN_WIDTH = 62500

# Suffixes that mark layout-only columns.
IGNORED_SUFFIXES = ("_ignore", "_please_ignore")

# A packed variant table keeps one genotype per sample in this array column. The
# sample names, which are the same for every row, live in the column's metadata.
GENOTYPES = "genotypes"
SAMPLES_KEY = "samples"
BIN_WIDTH_KEY = "bin_width"

# The compact form of that column: a struct of one character per call and, for the `?` among
# them, their texts in order.
COMPACT = "compact_genotypes"

# Level of a variant by its span, for overlaps: the first whose bins are as wide as it is.
# Each level's are LEVEL_FACTOR times wider; the widest hold the longest chromosome, and what
# is longer is in a level of its own.
LEVEL = "span_level"
LEVEL_WIDTH_KEY = "level_width"
LEVEL_FACTOR = 16
LEVELS = 4

STANDARD = T.StructType(
    [
        T.StructField("reference_name", T.StringType()),
        T.StructField("start_position", T.LongType()),
        T.StructField("end_position", T.LongType()),
        T.StructField("reference_bases", T.StringType()),
        T.StructField("alternate_bases", T.StringType()),
        T.StructField("minor_af", T.DoubleType()),
        T.StructField("allele_count", T.LongType()),
    ]
)


def string_schema(names):
    """A schema of nullable strings, for text whose columns are typed later."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def import_schema(names):
    """Two bigint positions, everything else string."""
    return T.StructType(
        [
            T.StructField(
                n, T.LongType() if n.lower() in POSITIONS else T.StringType()
            )
            for n in names
        ]
    )


def require(df, names):
    """Raise when `df` lacks a column; names are compared without case."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; table has {df.columns}")

"""Standardised records to and from JSON text."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JSON field of each standardised column.
JSON_FIELDS = {
    "start_position": "startValue",
    "end_position": "endValue",
    "reference_bases": "referenceBases",
    "alternate_bases": "alternateBases",
    "minor_af": "minorAF",
    "allele_count": "alleleCount",
}
JSON_SCHEMA = T.StructType(
    [
        T.StructField("startValue", T.LongType()),
        T.StructField("endValue", T.LongType()),
        T.StructField("referenceBases", T.StringType()),
        T.StructField("alternateBases", T.StringType()),
        T.StructField("minorAF", T.DoubleType()),
        T.StructField("alleleCount", T.LongType()),
    ]
)


def record_to_json() -> Column:
    """JSON text of the standardised columns of the row."""
    return F.to_json(F.struct(*[F.col(c).alias(f) for c, f in JSON_FIELDS.items()]))


def record_from_json(text: Column) -> list[Column]:
    """The standardised columns read back from JSON text."""
    record = F.from_json(text, JSON_SCHEMA)
    return [record[f].alias(c) for c, f in JSON_FIELDS.items()]

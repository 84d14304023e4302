"""A training corpus from `documents`, in five stages.

Each stage works on all rows that the one before it kept. All but the last return the
columns of documents; the last returns where each row goes.
"""

from pyspark.sql import DataFrame, SparkSession

from siteweave.llm.common import saved, table
from siteweave.llm.decontaminate import decontaminated
from siteweave.llm.mixture import cycle_5_2_1, mixed_documents
from siteweave.llm.near_duplicates import without_near_duplicates
from siteweave.llm.sharding import shard
from siteweave.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain finds toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixed_documents(docs, cycle_5_2_1, 1.5)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return shard(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs


#: The trained classifier of the first stage is beyond SQL.
ORACLE_SQL = None

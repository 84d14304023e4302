"""Where the sink queries write before they read back."""

import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession) -> str:
    """A fresh folder name in the cluster's shared folder (`spark.checkpoint.dir`), or, on a
    local master that names none, beside the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/results"
    return f"{shared.rstrip('/')}/siteweave-{uuid.uuid4().hex}"


def new_table() -> str:
    """A fresh table name."""
    return f"result_{uuid.uuid4().hex}"

"""Tables that are written once and read back, in the folder of spark.checkpoint.dir, for what is used more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder. Only a local master may do without spark.checkpoint.dir."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/codeloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """``df``, written and read back: cuts lineage and survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import Refused


def new_folder(spark: SparkSession) -> str:
    """A path not used before, below the folder of spark.checkpoint.dir; a session on one machine gets a temporary one, a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise Refused("shared_folder_required", "spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df below the folder of spark.checkpoint.dir and reads it again, so that it is worked out once and survives lost executors."""
    spark = df.sparkSession
    path = f"{new_folder(spark)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Places and small tables that several operators need."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Where that setting is missing, a session on one machine (tests) gets a temporary folder; on a cluster, whose executors couldn't
    see it, this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: later steps don't compute it anew, nor if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(counts: DataFrame, key: str, n: str, total: int, least: int = 1000, most: int = 10_000) -> DataFrame | None:
    """(_hot, _copies): the keys with more than ``least`` rows and more than 1 / ``most`` of all; None if there are none.

    counts: key and its number of rows n; total: the sum of n. As the numbers add up to it, there are about ``most`` such keys at the
    most, however large the table: few enough to broadcast.
    """
    limit = max(least, total // most)
    hot = stash(counts.where(F.col(n) > limit).select(F.col(key).alias("_hot"), F.ceil(F.col(n) / limit).alias("_copies")))
    return None if hot.isEmpty() else hot


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """many joined with one on a column that both have. The rows of a hot key in many are dealt by hashes of ``by`` over _copies tasks,
    each of which gets the key's rows of one; so are those of null keys, which match nothing."""
    if hot is None:
        return many.join(one, key, how)
    copies = F.coalesce("_copies", F.lit(1).cast("long"))
    part = F.pmod(F.xxhash64(by), F.when(F.col(key).isNull(), F.lit(1000).cast("long")).otherwise(copies))
    left = many.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_part", part).drop("_hot", "_copies")
    right = one.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_hot", "_copies")
    return left.join(right, [key, "_part"], how).drop("_part")


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker, or until another owner asks for one: workers outlive jobs, and so would large tables."""
    module = sys.modules.setdefault("_tabprep_llm_worker", types.ModuleType("_tabprep_llm_worker"))
    held = vars(module).setdefault("cache", {})
    if vars(module).get("owner") != owner:
        held.clear()
        gc.collect()
        vars(module)["owner"] = owner
    return held


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as it takes to differ from the columns."""
    while name in df.columns:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> SparkSession:
    """Lets Spark send texts to Python in batches of some megabytes, where the session doesn't say otherwise: the default counts rows only."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(4 << 20))
    return spark

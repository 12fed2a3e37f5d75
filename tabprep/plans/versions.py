"""A log of table versions: who made what from what, read with DataFrames.

Tables in Parquet: versions (dataset, version, path, recipe, created_at), lineage (version, input, input_order, role base or append, recipe),
sources (version, source, source_order), previews (candidates that wait to be applied) and files (digests of their files). What belongs to a version or
preview lies in a folder of its own, so writing it again changes nothing.

A dataset's heads are one small file for each revision, made only if it isn't there yet: that is the one step that publishes, whoever tries it at the
same time. Stores whose "create" doesn't refuse existing files need another catalog.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.identity import content_fingerprint, user_columns
from ..sources.stored import source_digests, verify_files
from ..storage import materialize
from .recipe import recipe_preview

SCHEMAS = {
    "versions": "dataset string, version string, path string, recipe string, created_at timestamp",
    "heads": "dataset string, version string, revision long",
    "lineage": "version string, input string, input_order int, role string, recipe string",
    "sources": "version string, source string, source_order int",
    "previews": "preview string, dataset string, version string, revision long, path string, recipe string, recipe_hash string, inputs array<string>, rows_before long, rows_after long, columns_after int, fingerprint string, created_at timestamp, expires_at timestamp",
    "files": "preview string, path string, name string, size long, sha256 string",
}


def read_log(spark: SparkSession, log: str, table: str) -> DataFrame:
    read = spark.read.schema(SCHEMAS[table]).option("recursiveFileLookup", "true")
    return read.json(f"{log}/{table}") if table == "heads" else read.parquet(f"{log}/{table}")


def start_log(spark: SparkSession, log: str) -> None:
    for table, schema in SCHEMAS.items():
        empty = spark.createDataFrame([], schema).write
        empty.json(f"{log}/{table}") if table == "heads" else empty.parquet(f"{log}/{table}")


def _put(rows: DataFrame, log: str, table: str, of: str) -> None:
    """Writes what a log's table has of one version or preview; again, if it was there."""
    rows.select(*(f.split()[0] for f in SCHEMAS[table].split(", "))).write.mode("overwrite").parquet(f"{log}/{table}/{quote(of, safe='')}")


def _claim(spark: SparkSession, path: str, text: str) -> str:
    """Writes a small file unless it exists; what it holds then."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = store.create(place, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
    except (Py4JJavaError, PySparkException):
        if not store.exists(place):
            raise
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _commit(spark: SparkSession, log: str, dataset: str, version: str, revision: int) -> bool:
    """Makes the version the dataset's head at a revision; False if another one is."""
    head = json.dumps({"dataset": dataset, "version": version, "revision": revision})
    return _claim(spark, f"{log}/heads/{quote(dataset, safe='')}/{revision:012}.json", head) == head


def _told(spark: SparkSession, log: str, dataset: str, version: str, path: str, sources: list[str], inputs: list[str], recipe: str | None) -> None:
    """Everything that the log says of a version but its being the head."""
    if inputs:
        lineage = spark.createDataFrame([(version, v, i, "append" if i else "base", recipe) for i, v in enumerate(inputs)], SCHEMAS["lineage"])
        taken = inherit_sources(lineage, read_log(spark, log, "sources")).select("version", "source", F.col("source_order").cast("int").alias("source_order"))
        _put(materialize(taken), log, "sources", version)  # it reads the table that it is written to
        _put(lineage, log, "lineage", version)
    else:
        _put(spark.createDataFrame([(version, s, i) for i, s in enumerate(sources)], SCHEMAS["sources"]), log, "sources", version)
    _put(spark.range(1).select(*(F.lit(v).cast("string").alias(c) for c, v in (("dataset", dataset), ("version", version), ("path", path), ("recipe", recipe))), F.current_timestamp().alias("created_at")), log, "versions", version)


def head_of(spark: SparkSession, log: str, dataset: str) -> tuple[str | None, int]:
    """The dataset's version and revision; (None, 0) before the first."""
    row = current_heads(read_log(spark, log, "heads").where(F.col("dataset") == dataset)).first()
    return (row["version"], row["revision"]) if row else (None, 0)


def publish(df: DataFrame, log: str, dataset: str, version: str, sources: list[str] | None = None, inputs: list[str] | None = None, recipe: str | None = None) -> str:
    """Writes df as a version and what is known of it; the head last, so that a broken run leaves the head as it was.

    A version has either sources of its own or inputs (the base first), whose sources it takes over. If another version became the head meanwhile,
    this one is refused.
    """
    spark, path = df.sparkSession, f"{log}/tables/{version}"
    if bool(sources) == bool(inputs):
        raise Refused("sources_or_inputs_required")
    _, revision = head_of(spark, log, dataset)
    df.write.option("compression", "zstd").parquet(path)
    _told(spark, log, dataset, version, path, sources or [], inputs or [], recipe)
    if not _commit(spark, log, dataset, version, revision + 1):
        raise Refused("head_moved", dataset)
    return path


def _hash(recipe: str) -> str:
    return hashlib.sha256(recipe.encode()).hexdigest()


def preview(spark: SparkSession, log: str, dataset: str, steps: list[tuple[str, dict]], lifetime: timedelta = timedelta(hours=1)) -> tuple[str, DataFrame, DataFrame]:
    """Runs a recipe over the head and keeps the result as a candidate: the preview's id, what each step did, and samples.

    append_rows takes {"versions": [...]}, versions of the log.
    """
    if lifetime.total_seconds() <= 0:
        raise Refused("lifetime_must_be_positive")
    base, revision = head_of(spark, log, dataset)
    if base is None:
        raise Refused("unknown_dataset", dataset)
    known = [(o, {"others": [(v, read_version(spark, log, v)) for v in p["versions"]]} if o == "append_rows" else p) for o, p in steps]
    inputs = [base, *dict.fromkeys(v for o, p in steps if o == "append_rows" for v in p["versions"])]
    before = read_version(spark, log, base)
    done, report, samples = recipe_preview(before, known)
    name = uuid.uuid4().hex
    path, recipe = f"{log}/candidates/{name}", json.dumps(steps, sort_keys=True, default=str)
    done.write.option("compression", "zstd").parquet(path)
    candidate = spark.read.parquet(path)
    now = datetime.now(UTC)
    facts = content_fingerprint(candidate).first()[0]
    _put(source_digests(spark, path).withColumn("preview", F.lit(name)), log, "files", name)
    row = (name, dataset, base, revision, path, recipe, _hash(recipe), inputs, before.count(), candidate.count(), len(user_columns(candidate)), facts, now, now + lifetime)
    _put(spark.createDataFrame([row], SCHEMAS["previews"]), log, "previews", name)
    return name, report, samples


def apply_preview(spark: SparkSession, log: str, name: str, now: Column | None = None) -> str:
    """Makes a preview's candidate a version and the head, without working it out again; its version.

    Applying it again gives the same version, and so does going on after a run that broke off. Expired and stale previews are refused, and those whose files or recipe have changed.
    """
    known = read_log(spark, log, "previews").where(F.col("preview") == name)
    row = known.first()
    if row is None:
        raise Refused("preview_not_found", name)
    version, heads = f"applied-{name}", read_log(spark, log, "heads").where(F.col("dataset") == row["dataset"])
    if heads.where(F.col("version") == version).first() is not None:
        return version
    if _hash(row["recipe"]) != row["recipe_hash"]:
        raise Refused("preview_recipe_changed", name)
    files = read_log(spark, log, "files").where(F.col("preview") == name)
    verified = verify_files(spark, files, row["path"]).select(F.lit(name).alias("preview"), "status")
    held = source_digests(spark, row["path"]).select("path").exceptAll(files.select("path")).isEmpty()
    status = preview_status(known.withColumn("applied_version", F.lit(None).cast("string")), heads, verified, F.current_timestamp() if now is None else now).first()["status"]
    if status == "ready" and not held:
        status = "tampered"
    if status != "ready":
        raise Refused(f"preview_{status}", name)
    _told(spark, log, row["dataset"], version, row["path"], [], list(row["inputs"]), row["recipe"])
    if not _commit(spark, log, row["dataset"], version, row["revision"] + 1):
        raise Refused("preview_stale", name)
    return version


def current_heads(heads: DataFrame) -> DataFrame:
    """Per dataset its version of the highest revision."""
    top = F.max(F.struct("revision", "version")).alias("t")
    return heads.groupBy("dataset").agg(top).select("dataset", F.col("t.version").alias("version"), F.col("t.revision").alias("revision"))


def version_history(heads: DataFrame, dataset: str | Column) -> DataFrame:
    return heads.where(F.col("dataset") == dataset).orderBy("revision")


def version_lineage(lineage: DataFrame, version: str | Column) -> DataFrame:
    """What a version was made from, in order."""
    return lineage.where(F.col("version") == version).orderBy("input_order")


def read_version(spark: SparkSession, log: str, version: str) -> DataFrame:
    """The table as of any version."""
    at = read_log(spark, log, "versions").where(F.col("version") == version).select("path").first()
    if at is None:
        raise Refused("unknown_version", version)
    return spark.read.parquet(at[0])


#: Rows that a task of inherit_sources sorts at once, about; lineage of so few rows is broadcast.
ROWS_A_TASK, FEW = 500_000, 10_000


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys over as many tasks as so many rows want, so that no task's memory grows with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def inherit_sources(lineage: DataFrame, sources: DataFrame) -> DataFrame:
    """Per version the sources of all its inputs in input order, each once where first seen (ties by name), numbered from 0.

    How many rows the join gives is estimated from the sources of a version on the average; it decides on the number of tasks only.
    """
    own = sources.select(F.col("version").alias("input"), "source", F.col("source_order").alias("_at"))
    inputs, held, of = lineage.count(), *own.agg(F.count(F.lit(1)), F.approx_count_distinct("input")).first()
    seen = inputs * held // max(of, 1)
    if inputs <= FEW:
        joined = F.broadcast(lineage).join(own, "input")
    else:
        joined = _dealt(lineage, inputs + held, "input").join(_dealt(own, inputs + held, "input"), "input")
    taken = joined.select("version", "source", F.struct("input_order", "_at").alias("_first"))
    first = _dealt(taken, seen, "version", "source").groupBy("version", "source").agg(F.min("_first").alias("_first"))
    place = F.row_number().over(Window.partitionBy("version").orderBy("_first", "source")) - 1
    return _dealt(first, seen, "version").select("version", "source", place.cast("long").alias("source_order"))


def preview_status(previews: DataFrame, heads: DataFrame, verified: DataFrame, now: Column) -> DataFrame:
    """Per preview (preview, dataset, version, revision, expires_at, applied_version): applied, expired, stale, tampered or ready.

    verified (preview, status) holds verify_files' answer for its candidate; a preview that it lacks counts as tampered.
    """
    head = current_heads(heads).select("dataset", F.col("version").alias("_version"), F.col("revision").alias("_revision"))
    files = verified.groupBy("preview").agg(F.min((F.col("status") == "ok").cast("int")).alias("_ok"))
    same = F.col("version").eqNullSafe(F.col("_version")) & F.col("revision").eqNullSafe(F.col("_revision"))
    status = (
        F.when(F.col("applied_version").isNotNull(), "applied")
        .when(F.col("expires_at") <= now, "expired")
        .when(~same, "stale")
        .when(F.coalesce(F.col("_ok"), F.lit(0)) == 0, "tampered")
        .otherwise("ready")
    )
    return previews.join(head, "dataset", "left").join(files, "preview", "left").select("preview", status.alias("status"))

"""Stored files: digests, metadata, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..storage import materialize
from .csv import check_files, file_facts, read_cells

#: File types by suffix.
FILE_TYPES = {"csv": "CSV", "xlsx": "XLSX"}
#: Bytes that a task reads at once of a file that is digested as a stream.
READ_BYTES = 1 << 20
#: Files of up to so many bytes are digested by Spark itself, each as one value of a row.
SMALL_BYTES = 8 << 20


def _listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and length of each file, in nested folders too; contents aren't read unless asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)


def _empty(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The paths of files without bytes, which Spark leaves out: those of its listing, which the driver holds anyway, that have no row."""
    every = spark.createDataFrame([(u,) for u in files.inputFiles()], "uri string")
    path = F.regexp_replace(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    return every.select(path.alias("path")).join(files.select("path"), "path", "left_anti")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system, and the place in it, of a path as Spark gives it."""
    scheme, _, rest = path.partition(":")
    if not rest.startswith("/") or scheme == "file":
        return fs.LocalFileSystem(), ("/" + rest.lstrip("/")) if scheme == "file" else path
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def open_stream(path: str) -> pa.NativeFile:
    system, place = located(path)
    return system.open_input_stream(place, compression=None)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            digest = hashlib.sha256()
            with open_stream(path) as stream:
                while block := stream.read(READ_BYTES):
                    digest.update(block)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([digest.hexdigest()])], ["path", "length", "sha256"])


def source_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per file: path, name, size and sha256. Files of more than SMALL_BYTES are read as streams of READ_BYTES, so a task's memory doesn't grow with them."""
    files = _listed(spark, paths)
    small = files.where(F.col("length") <= SMALL_BYTES).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > SMALL_BYTES).select("path", "length").mapInArrow(_hashed, "path string, length long, sha256 string")
    none = _empty(spark, files).select("path", F.lit(0).cast("long").alias("length"), F.lit(hashlib.sha256().hexdigest()).alias("sha256"))
    return small.unionByName(large).unionByName(none).select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size"), "sha256")


def source_totals(spark: SparkSession, paths: str | list[str], warn_from: int = 1 << 30) -> DataFrame:
    files = _listed(spark, paths).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("large", F.col("bytes") >= warn_from)


def verify_files(spark: SparkSession, manifest: DataFrame, paths: str | list[str]) -> DataFrame:
    """Per manifest row (path, name, size, sha256): path, name and status ok, changed or missing. Files are told apart by their paths."""
    now = source_digests(spark, paths).select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha256"))
    same = (F.col("size") == F.col("_size")) & (F.col("sha256") == F.col("_sha256"))
    return manifest.join(now, "path", "left").select("path", "name", F.when(F.col("_size").isNull(), "missing").when(same, "ok").otherwise("changed").alias("status"))


def source_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per file, in nested folders too: name, file_type, size, and for CSV files rows and columns. Contents of other files aren't read; other types are refused."""
    files = _listed(spark, paths).select("path", "length", F.col("_metadata.file_path").alias("_file"))
    suffix = F.lower(F.regexp_extract("path", "\\.([^./]*)$", 1))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in FILE_TYPES.items() for x in pair)), suffix)
    files = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), kind.alias("file_type"), F.col("length").alias("size"), "path", "_file")
    if other := files.where(F.col("file_type").isNull()).select("name").first():
        raise Refused("unsupported_file_type", other[0])
    texts = files.where("file_type = 'CSV'").select("path").first()
    if texts is None:
        return files.select("name", "file_type", "size", F.lit(None).cast("long").alias("rows"), F.lit(None).cast("int").alias("columns"))
    cells = read_cells(spark, paths, recursive=True)
    facts = materialize(file_facts(cells))
    check_files(facts, cells.names)
    facts = facts.select(F.col("file").alias("_file"), "rows")
    made = files.join(facts, "_file", "left")
    is_csv = F.col("file_type") == "CSV"
    return made.select("name", "file_type", "size", F.when(is_csv, F.coalesce("rows", F.lit(0))).cast("long").alias("rows"), F.when(is_csv, len(cells.names)).alias("columns"))

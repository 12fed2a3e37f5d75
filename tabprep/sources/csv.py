"""CSV import with types inferred from the values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions.names import col, free
from .records import begin_inside, lines_of, range_ends, records_of

#: Texts that count as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_INT = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?([iI]nf|[iI]nfinity)\s*$"
#: Encodings in which quotes, delimiters and line ends are single bytes that stand for nothing else; files in others are read whole.
_BY_BYTES = {"utf-8": None, "utf8": None, "ascii": None, "us-ascii": None, "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1"}
#: What the type of a column is decided by: cells that aren't missing, missing ones, and those that can be read as each kind.
_STATE = ("n", "gaps", "ints", "floats", "flags")


def _type_state(c: Column) -> list[Column]:
    """The numbers of _STATE that one cell adds: sums of them decide, in whatever order cells come."""
    v = F.when(~c.isin(*MISSING), c)
    kinds = (v.rlike(_INT) & v.try_cast("bigint").isNotNull(), v.rlike(_FLOAT), v.isin("True", "TRUE", "true", "False", "FALSE", "false"))
    return [x.cast("long") for x in (v.isNotNull(), v.isNull(), *(F.coalesce(k, F.lit(False)) for k in kinds))]


def _decided(n: int, gaps: int, ints: int, floats: int, flags: int) -> str:
    if n == 0:
        return "double"
    if ints == n:
        return "double" if gaps else "bigint"
    if floats == n:
        return "double"
    return "boolean" if flags == n and not gaps else "string"


def _typed(texts: DataFrame, kinds: list[str]) -> DataFrame:
    out = []
    for c, kind in zip(texts.columns, kinds, strict=True):
        v = F.when(~col(c).isin(*MISSING), col(c) if kind == "string" else F.trim(col(c)))
        out.append((v if kind == "string" else v.try_cast(kind)).alias(c))
    return texts.select(out)


def infer_types(texts: DataFrame) -> DataFrame:
    """Columns of texts cast to long, double (also whole numbers with gaps), boolean, or left as they are; one aggregate decides."""
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(f"{s}{i}") for i, c in enumerate(texts.columns) for s, x in zip(_STATE, _type_state(col(c)), strict=True)]
    got = texts.agg(*sums).first()
    return _typed(texts, [_decided(*(got[f"{s}{i}"] for s in _STATE)) for i in range(len(texts.columns))])


@dataclass
class Cells:
    """CSV files before types: names, every line's cells (file, at: the order within a file as far as the header goes, c0, c1, ..., over), and the lines below the headers as texts."""

    names: list[str]
    every: DataFrame
    body: DataFrame


def _header(cells: list[str | None] | None) -> list[str]:
    names = [c if c is not None else "" for c in cells or []]
    names[:1] = [n.removeprefix("﻿") for n in names[:1]]
    if not names or any(not n.strip() for n in names):
        raise Refused("empty_column_names")
    if len(set(names)) != len(names):
        raise Refused("duplicate_column_names")
    return names


def _places(names: list[str]) -> list[str]:
    return [*(f"c{i}" for i in range(len(names))), "over"]


def _texts(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _plain(spark: SparkSession, path: str | list[str], options: dict, whole: bool) -> Cells:
    """Read by Spark: files whole, or by lines."""
    read = lambda: spark.read.options(multiLine=whole, pathGlobFilter="*.csv", **options)
    head = read().csv(path, header=False).first()
    names = _header(list(head) if head else None)
    every = read().schema(_texts(_places(names))).csv(path, header=False)
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    over = free(names, "_over")
    body = read().option("enforceSchema", True).schema(_texts([*names, over])).csv(path, header=True).drop(over)
    return Cells(names, every.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), *_places(names)), body)


def _cut(spark: SparkSession, records: DataFrame, options: dict) -> Cells:
    """Records cut beforehand; each is read by itself."""
    charset = _BY_BYTES[options["encoding"].lower()]
    text = F.decode("record", charset) if charset else F.col("record").cast("string")
    records = records.select(text.alias("record"), "file", "first")
    one = {k: options[k] for k in ("sep", "quote", "escape", "nullValue", "emptyValue")}
    head = records.where("first").orderBy("file").first()
    if head is None:
        raise Refused("empty_column_names")
    width = len(T.DataType.fromDDL(spark.range(1).select(F.schema_of_csv(head["record"], one)).first()[0]).fields)
    parts = spark.range(1).select(F.from_csv(F.lit(head["record"]), ", ".join(f"c{i} string" for i in range(width)), one).alias("x"))
    names = _header(list(parts.select("x.*").first()))
    parsed = F.from_csv("record", ", ".join(f"{p} string" for p in _places(names)), one).alias("x")
    every = records.select("file", F.struct((~F.col("first")).cast("long").alias("start"), F.lit(0).cast("long").alias("line")).alias("at"), parsed).select("file", "at", "x.*")
    body = records.where(~F.col("first")).select(parsed).select(*(F.col(f"x.c{i}").alias(n) for i, n in enumerate(names)))
    return Cells(names, every, body)


def _longest(spark: SparkSession, path: str | list[str], recursive: bool) -> int:
    """Bytes of the longest file; contents aren't read."""
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.csv", recursiveFileLookup=recursive).load(path)
    return files.agg(F.max("length")).first()[0] or 0


def read_cells(spark: SparkSession, path: str | list[str], delimiter: str = ",", encoding: str = "utf-8", multi_line: bool = True, recursive: bool = False) -> Cells:
    """With multi_line, fields may hold line ends: one pass over the lines finds out whether any does, and where the files' byte ranges begin inside such
    a field, and many tasks share a large file. Files are read whole if none is longer than what one task takes (spark.sql.files.maxPartitionBytes), in other encodings than _BY_BYTES, and
    where lines end with a carriage return alone. Without multi_line a line is a record."""
    if len(delimiter) != 1 or delimiter in '"\r\n':
        raise Refused("invalid_csv_delimiter")
    options = dict(sep=delimiter, encoding=encoding, quote='"', escape='"', nullValue="\0", emptyValue="", recursiveFileLookup=recursive)
    if not multi_line:
        return _plain(spark, path, options, False)
    if encoding.lower() not in _BY_BYTES or _longest(spark, path, recursive) <= spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return _plain(spark, path, options, True)
    lines = lines_of(spark, path, recursive)
    ends = range_ends(lines, delimiter).collect()  # a row for each byte range
    if any(r["other_ends"] for r in ends):
        return _plain(spark, path, options, True)
    if not any(r["spans"] for r in ends):
        return _plain(spark, path, options, False)
    return _cut(spark, records_of(lines, begin_inside(ends), delimiter), options)


def file_facts(cells: Cells, types: bool = False) -> DataFrame:
    """Per file: head (its first line), over (whether a line goes on behind the header), rows (without the header), and with types the sums of each column's _STATE, header included."""
    places = _places(cells.names)[:-1]
    sums = [F.sum(x).alias(f"{s}{i}") for i, p in enumerate(places) for s, x in zip(_STATE, _type_state(F.col(p)), strict=True)] if types else []
    return cells.every.groupBy("file").agg(F.min_by(F.array(*places), "at").alias("head"), F.max(F.col("over").isNotNull()).alias("over"), (F.count(F.lit(1)) - 1).alias("rows"), *sums)


def check_files(facts: DataFrame, names: list[str], more: Sequence[Column] = ()) -> dict:
    """Sums over all files, after refusing lines with too many fields and files with other headers."""
    bare = F.transform("head", lambda c, i: F.when(i == 0, F.regexp_replace(c, "^﻿", "")).otherwise(c))
    differs = ~bare.eqNullSafe(F.array(*(F.lit(n) for n in names)))
    odd = lambda what: F.min(F.when(what, F.col("file")))
    got = facts.agg(odd(F.col("over")).alias("over"), odd(differs).alias("differs"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), *more).first()
    if got["over"] is not None:
        raise Refused("csv_too_many_fields", got["over"])
    if got["differs"] is not None:
        raise Refused("csv_headers_differ", got["differs"])
    return got.asDict()


def read_texts(spark: SparkSession, path: str | list[str], delimiter: str = ",", encoding: str = "utf-8", multi_line: bool = True, recursive: bool = False) -> DataFrame:
    """The cells of CSV files with the same header row, as texts. Lines with too many fields, empty or repeated names, and files with other headers
    than the first one are refused."""
    cells = read_cells(spark, path, delimiter, encoding, multi_line, recursive)
    check_files(file_facts(cells), cells.names)
    return cells.body


def import_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", multi_line: bool = True) -> DataFrame:
    """A CSV file or folder as a table with inferred types; files without rows are refused. One aggregate checks the files and decides the types;
    what the headers add to its sums is taken off, as all headers are equal."""
    cells = read_cells(spark, path, delimiter, encoding, multi_line)
    names, facts = cells.names, file_facts(cells, types=True)
    every = [f"{s}{i}" for i in range(len(names)) for s in _STATE]
    got = check_files(facts, names, [F.sum(F.col(s)).alias(s) for s in every])
    if not got["rows"]:
        raise Refused("csv_has_no_rows")
    own = spark.range(1).select(*(x.alias(f"{s}{i}") for i, n in enumerate(names) for s, x in zip(_STATE, _type_state(F.lit(n)), strict=True))).first()
    return _typed(cells.body, [_decided(*(got[f"{s}{i}"] - got["files"] * own[f"{s}{i}"] for s in _STATE)) for i in range(len(names))])

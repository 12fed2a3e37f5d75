"""Records of CSV files whose quoted fields may hold line ends, read by many tasks for each file.

Spark deals out a file's lines by byte ranges, and no range can tell by itself whether it begins inside a quoted field. A first pass gives for
each range how it ends if it begins outside and if it begins inside; running over the ranges of each file these tell how each really begins. In
a second pass every range then cuts its lines into records. A record that crosses a border is put together from its parts.

A quote opens a field only at the field's beginning, two quotes inside stand for one, and what follows a closing quote up to the next delimiter belongs
to the field: as Spark's and other readers have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Parts of a record in one range: all of it, its end, its middle, its beginning.
WHOLE, END, MIDDLE, BEGIN = range(4)


class Quotes:
    """Whether a quoted field is open at the end of a line."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter.encode())
        self.opens = re.compile(rb'(?:(?:"(?:[^"]++|"")*+"[^%b]*+|[^"%b][^%b]*+|)%b)*+"(?:[^"]++|"")*+\Z' % (d, d, d, d))
        self.closes = re.compile(rb'(?:[^"]++|"")*+"[^%b]*+' % d)

    def after(self, line: bytes, inside: bool) -> bool:
        if not inside:
            return self.opens.match(line) is not None
        closed = self.closes.match(line)
        if closed is None:
            return True
        return closed.end() < len(line) and self.opens.match(line, closed.end() + 1) is not None


def lines_of(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """line (bytes), file, start (of its byte range)."""
    read = spark.read.options(lineSep="\n", pathGlobFilter="*.csv", recursiveFileLookup=recursive).text(path)
    return read.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The batch's lines, cut where another range begins."""
    start = batch.column(2).to_numpy(zero_copy_only=False)
    file = pc.dictionary_encode(batch.column(1)).indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
        if hi > lo:
            yield batch.column(1)[lo].as_py(), int(start[lo]), batch.column(0).slice(lo, hi - lo)


def range_ends(lines: DataFrame, delimiter: str) -> DataFrame:
    """Per byte range: file, start, whether a field is open at its end after a beginning outside (o) and inside (i); whether after a beginning outside
    any line leaves one open (spans); whether a line holds a carriage return that doesn't end it (other_ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(delimiter)
        states: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for file, start, lines in _stretches(batch):
                state = states.setdefault((file, start), [False, True, False, False])
                state[3] = state[3] or bool(pc.any(pc.match_substring_regex(lines, "\r[^\r]")).as_py())
                for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                    state[0], state[1] = quotes.after(line, state[0]), quotes.after(line, state[1])
                    state[2] = state[2] or state[0]
        rows = [(*k, *v) for k, v in states.items()]
        types = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["file", "start", "o", "i", "spans", "other_ends"])

    return lines.mapInArrow(run, "file string, start long, o boolean, i boolean, spans boolean, other_ends boolean")


def begin_inside(ends: list) -> set[tuple[str, int]]:
    """The ranges that begin inside a quoted field, given range_ends' rows."""
    out, inside, last = set(), False, None
    for r in sorted(ends, key=lambda r: (r["file"], r["start"])):
        inside = inside and r["file"] == last
        if inside:
            out.add((r["file"], r["start"]))
        inside, last = r["i"] if inside else r["o"], r["file"]
    return out


class _Cutter:
    """Cuts the lines of one range into records."""

    def __init__(self, quotes: Quotes, file: str, start: int, inside: bool):
        self.quotes, self.file, self.start = quotes, file, start
        self.inside, self.part, self.held = inside, MIDDLE if inside else WHOLE, []
        self.fresh = start == 0
        self.rows: list[tuple[int, bool, bytes]] = []

    def add(self, part: int, record: bytes) -> None:
        record = record.removesuffix(b"\r") if part in (WHOLE, END) else record
        if record or part != WHOLE:  # empty lines are no records
            self.rows.append((part, self.fresh, record))
            self.fresh = False

    def take(self, lines: pa.Array) -> None:
        quoted = pc.match_substring(lines, '"').to_pylist()
        for line, has in zip(lines.to_pylist(), quoted, strict=True):
            after = self.quotes.after(line, self.inside) if has else self.inside
            if self.inside or after:
                if not self.inside:
                    self.part = BEGIN
                self.held.append(line)
                if not after:
                    self.add(END if self.part == MIDDLE else WHOLE, b"\n".join(self.held))
                    self.held, self.part = [], WHOLE
            else:
                self.add(WHOLE, line)
            self.inside = after

    def end(self) -> None:
        if self.held:
            self.add(self.part, b"\n".join(self.held))
            self.held = []


def records_of(lines: DataFrame, inside: set[tuple[str, int]], delimiter: str) -> DataFrame:
    """record (bytes), file, first (of its file). Written, since parts of records are joined with the others."""
    sent = lines.sparkSession.sparkContext.broadcast(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, cutter = Quotes(delimiter), None

        def told() -> pa.RecordBatch:
            rows, cutter.rows = cutter.rows, []
            n = len(rows)
            columns = [pa.array([cutter.file] * n, pa.string()), pa.array([cutter.start] * n, pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.binary())))]
            return pa.RecordBatch.from_arrays(columns, ["file", "start", "part", "first", "record"])

        for batch in batches:
            for file, start, some in _stretches(batch):
                if cutter is None or (cutter.file, cutter.start) != (file, start):
                    if cutter is not None:
                        cutter.end()
                        yield told()
                    cutter = _Cutter(quotes, file, start, (file, start) in sent.value)
                cutter.take(some)
                yield told()
        if cutter is not None:
            cutter.end()
            yield told()

    pieces = materialize(lines.mapInArrow(run, "file string, start long, part int, first boolean, record binary"))
    # at most two parts a range: the end of an earlier record (or the middle), and the beginning of a later one
    order = Window.partitionBy("file").orderBy("start", "part")
    crossing = pieces.where(F.col("part") != WHOLE).withColumn("number", F.sum((F.col("part") == BEGIN).cast("int")).over(order))
    made = crossing.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "part", "record"))).alias("parts"), F.max("first").alias("first"))
    joined = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0))["record"], lambda a, x: F.concat(a, F.lit(b"\n"), x["record"]))
    return pieces.where(F.col("part") == WHOLE).select("record", "file", "first").unionByName(made.select(joined.alias("record"), "file", "first"))

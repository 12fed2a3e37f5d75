"""Benchmark decontamination: Wu-Manber search for many word windows at once.

Words are the runs of 0-9, a-z (A-Z is lower-cased) and all characters from U+0080 on. Each benchmark item gives its windows of
``window`` consecutive words; an item of fewer words is one window. A table for each window length holds how far the search may
jump after a block of two words (words that no window ends with are never looked at), and which windows end with the block;
a direct comparison confirms each hit.

The windows of the benchmark go to the tasks in blocks of at most about ``block_windows`` windows (long items are cut into pieces
that overlap by a window less a word), so that what is broadcast is bounded whatever the benchmark's size. A larger benchmark takes one
pass over the documents for each block; the documents stay where they are, and only what was hit is written and joined to them.

Defined results: a null or empty text has no words and is clean; a null or empty item has no windows; an item without an id counts
as item ''; items of equal id count as one; repeated documents are each reported; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .native import row_key
from .shared import free_name, small_batches, stash, worker_cache

_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: Words of a piece of an item.
PIECE = 20_000


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class WuManber:
    """Finds word windows of one length."""

    def __init__(self, length: int, windows: dict[tuple, set[str]]):
        self.length, self.windows = length, windows
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.ending: dict[bytes, list[tuple[list[bytes], set[str]]]] = defaultdict(list)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                block = b" ".join(window[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.ending[block].append((list(window), items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of each occurrence, from left to right."""
        length, far, jump, ending, n = self.length, self.far, self.shift.get, self.ending, len(text)
        at = length - 1
        two = self.block == 2
        while at < n:
            block = text[at - 1] + b" " + text[at] if two else text[at]
            step = jump(block, far)
            if step:
                at += step
                continue
            start = at - length + 1
            first = text[start]
            for window, items in ending[block]:
                if window[0] == first and text[start : at + 1] == window:
                    yield start, items
            at += 1


def searchers(items: list[tuple[str, str]], window: int) -> list[WuManber]:
    """One searcher for each window length that occurs."""
    by_length: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    for name, text in items:
        w = words((text or "").encode())
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            by_length[size][tuple(w[i : i + size])].add(name or "")
    return [WuManber(n, dict(x)) for n, x in sorted(by_length.items())]


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_windows: int) -> list[DataFrame]:
    """The benchmark as (name, text of words), each once, in parts of about block_windows windows, no row having more than PIECE words."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.regexp_extract_all(lower, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0)).alias("w"))
    step = max(1, PIECE - window + 1)
    pieces = F.greatest(F.ceil((F.size("w") - window + 1) / step), F.lit(1)).cast("int")
    cut = plain.where(F.size("w") > 0).withColumn("k", F.explode(F.sequence(F.lit(0), pieces - 1))).select("name", F.slice("w", F.col("k") * step + 1, F.lit(step + window - 1)).alias("w"))
    cut = stash(cut.select("name", F.array_join("w", " ").alias("text"), F.size("w").alias("n")).distinct())
    if (cut.agg(F.sum("n")).first()[0] or 0) <= block_windows:
        return [cut]
    # running totals over ranges of the pieces' hashes, so that no block gets much more than the others
    order = F.xxhash64("name", "text")
    ranged = stash(cut.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    at, firsts = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("n")).collect()):
        firsts.append((part, at))
        at += n
    first = F.broadcast(items.sparkSession.createDataFrame(firsts, "part int, first long"))
    upto = F.col("first") + F.sum("n").over(Window.partitionBy("part").orderBy(order, "name", "text")) - F.col("n")
    dealt = stash(ranged.join(first, "part").select("name", "text", F.floor(upto / block_windows).alias("block")))
    return [dealt.where(F.col("block") == r["block"]).select("name", "text") for r in dealt.select("block").distinct().collect()]


def _pass(docs: DataFrame, text_col: str, block: DataFrame, window: int, finish: Callable, schema: T.StructType | str) -> DataFrame:
    """finish(batch, words of each text, spans of hit words, names of items that occur) over all documents."""
    items = sorted((r["name"], r["text"]) for r in block.collect())
    sent = small_batches(docs.sparkSession).sparkContext.broadcast(items)
    # workers outlive jobs, and what they hold is known by its content
    key = ("windows", hashlib.sha256(json.dumps([window, items]).encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("windows")
        if cache.get("searchers", (None,))[0] != key:
            cache["searchers"] = (key, searchers(sent.value, window))
        found_by = cache["searchers"][1]
        for batch in batches:
            n_words, spans, hit_items = [], [], []
            for text in batch.column(text_col).cast(pa.large_binary() if pa.types.is_large_string(batch.column(text_col).type) else pa.binary()):
                w = words(text.as_py() or b"")
                mine, names = [], set()
                for s in found_by:
                    for start, its in s.search(w):
                        mine.append((start, start + s.length))
                        names |= its
                n_words.append(len(w))
                spans.append(mine)
                hit_items.append(names)
            yield finish(batch, n_words, spans, hit_items)

    return docs.mapInArrow(run, schema)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _listed(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in _merge(s)] for s in spans], _ARROW_SPAN)


def _hits(docs: DataFrame, block: DataFrame, window: int) -> DataFrame:
    """_key, _spans, _items of the rows (_key, _text) that the block's windows hit, written."""

    def finish(batch, n_words, spans, names):
        found = pa.array([bool(s) for s in spans], pa.bool_())
        all_rows = pa.RecordBatch.from_arrays([batch.column("_key"), _listed(spans), pa.array([sorted(x) for x in names], pa.list_(pa.string()))], ["_key", "_spans", "_items"])
        return all_rows.filter(found)

    schema = T.StructType([T.StructField("_key", T.BinaryType()), T.StructField("_spans", _SPAN), T.StructField("_items", T.ArrayType(T.StringType()))])
    return stash(_pass(docs.select("_key", "_text"), "_text", block, window, finish, schema).dropDuplicates(["_key"]))


def _joined_spans(spans):
    """Sorted spans, those that touch or overlap made one."""
    grown = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end"))))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(F.array_sort(spans), none, lambda a, x: F.when((F.size(a) > 0) & (x["start"] <= F.get(a, F.size(a) - 1)["end"]), grown(a, x)).otherwise(F.array_append(a, x)))


def contamination(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_windows: int = 200_000) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside any occurrence of a window), spans (word positions, end exclusive) and items."""
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), row_key(id_col, text_col).alias("_key"))
    first, *others = _blocks(items, item_id, item_text, window, block_windows)
    more = bool(others)

    def finish(batch, n_words, spans, names):
        head = ["_id", "_key"] if more else ["_id"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in head), pa.array(n_words, pa.int64()), _listed(spans), pa.array([sorted(x) for x in names], pa.list_(pa.string()))], [*head, "n_words", "spans", "items"])

    report = [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))]
    head = [T.StructField("_id", documents.schema[id_col].dataType), *([T.StructField("_key", T.BinaryType())] if more else [])]
    found = _pass(docs if more else docs.drop("_key"), "_text", first, window, finish, T.StructType([*head, *report]))
    if more:
        hits = reduce(DataFrame.unionByName, [_hits(docs, b, window) for b in others])
        hits = hits.groupBy("_key").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_items")).alias("_items"))
        both = found.join(hits, "_key", "left")
        none = F.array().cast("array<string>")
        found = both.select("_id", "n_words", F.when(F.col("_spans").isNull(), F.col("spans")).otherwise(_joined_spans(F.concat("spans", "_spans"))).alias("spans"), F.array_sort(F.array_union("items", F.coalesce("_items", none))).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items")


def decontaminate(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_windows: int = 200_000) -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs."""

    def finish(batch, n_words, spans, names):
        return batch.filter(pa.array([not s for s in spans], pa.bool_()))

    first, *others = _blocks(items, item_id, item_text, window, block_windows)
    docs = _pass(documents, text_col, first, window, finish, documents.schema)
    if not others:
        return docs
    keyed = documents.select(F.col(text_col).cast("string").alias("_text"), row_key(id_col, text_col).alias("_key"))
    hits = reduce(DataFrame.unionByName, [_hits(keyed, b, window) for b in others]).select("_key").distinct()
    key = free_name(documents, "_row_key")
    return docs.withColumn(key, row_key(id_col, text_col)).join(hits, F.col(key) == hits["_key"], "left_anti").drop(key)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_sort("items")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS seq
  FROM item_words, unnest(range(1, greatest(len(w) - least(len(w), 10) + 2, 1))) AS r(i)
  WHERE len(w) > 0),
doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
doc_windows AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS seq
  FROM doc_words, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) AS r(i)
  WHERE len(w) >= size),
hits AS (SELECT d.rid, d.i, d.size, x.item_id FROM doc_windows d JOIN windows x ON d.size = x.size AND d.seq = x.seq),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS r(p) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(x.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(x.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c USING (rid) LEFT JOIN items x USING (rid)
"""

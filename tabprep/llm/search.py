"""Ranked lexical search over a length-stratified index.

Documents with the same length normaliser m form a stratum. A row of the index is a stratum of some megabytes of text that one task has read: the
documents' ids and, term by term, runs of documents in which the term occurs equally often (largest tf first). Terms are 64-bit hashes: of
q terms asked for and V terms of the corpus two different ones are taken for each other with a probability of about q * V / 2 ** 64.

A search works out each run's impact once for its tf, w * ((10 ** 9 * tf) div (1000 * tf + 8 * m)). A term's first run bounds what it adds to any
document of the stratum, so the sum of these bounds over an item's terms bounds the stratum. Strata are visited by falling bounds, in waves of growing size,
until the bound is below the score that the task's last ranked document has so far; ties are visited. Each task returns the best documents
of each item, and these are ranked together.

Building takes two passes over the texts (sizes of the collection, then the index) and no shuffle. Items are searched in blocks of about ``block_terms``
terms, which are broadcast; each block takes one pass over the index, as terms' frequencies need another over two of its columns.

Defined results: null and empty texts have no terms, are never found, and don't count for N; an item without terms finds nothing. Rows of documents are ranked each on its
own, even if ids repeat; items of equal id and text are one, of equal id and other text two. Null ids of documents come last among ties. Empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import vec
from .shared import shared_dir, small_batches, stash

#: Words are runs of 0-9, a-z (A-Z is lower-cased) and all characters from U+0080 on.
_KIND = vec.table(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)))

#: Text that the strata of one part of the index come from.
PART_BYTES = 4 << 20
#: Parquet's row groups of the index: no task holds more of it at once, writing or reading.
GROUP_BYTES = 8 << 20


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each term of the texts its row and its hash."""
    data, bounds = vec.text_bytes(text)
    lower = vec.lowered()
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, start, end in vec.stretches(data, bounds, _KIND):
        if len(start):
            hashes.append(vec.span_hashes(vec.prefix_sums(lower[data[at : at + end[-1]]]), start, end))
            rows.append(vec.rows_of(start + at, bounds))
    return np.concatenate(rows), np.concatenate(hashes).view(np.int64)


def _counted(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of each term of each row."""
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return row[at], term[at], np.diff(np.append(at, len(row)))


@dataclass
class Index:
    """strata: one row for each stratum of each part; n_docs (N) and n_terms (L) of the collection."""

    strata: DataFrame
    n_docs: int
    n_terms: int


def _lists(values, sizes: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), values).cast(pa.list_(values.type))


def _strata(ids: pa.Array, row: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The strata of some texts, given each term's row and hash."""
    length = np.bincount(row, minlength=len(ids))
    docs = np.flatnonzero(length)
    m = 100 - 75 + (75 * length[docs] * n_docs) // n_terms
    order = np.argsort(m, kind="stable")
    docs, m = docs[order], m[order]
    strata, first, width = np.unique(m, return_index=True, return_counts=True)
    stratum, ordinal = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32)
    stratum[docs] = np.repeat(np.arange(len(strata)), width)
    ordinal[docs] = np.arange(len(docs)) - np.repeat(first, width)
    row, term, tf = _counted(row, term)
    order = np.lexsort((ordinal[row], -tf, term, stratum[row]))
    row, term, tf = row[order], term[order], tf[order]
    new = np.ones(len(row), bool)
    new[1:] = (stratum[row[1:]] != stratum[row[:-1]]) | (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
    at = np.flatnonzero(new)
    runs = np.bincount(stratum[row[at]], minlength=len(strata))
    size = np.diff(np.append(at, len(row))).astype(np.int32)
    columns = [pa.array(strata), _lists(ids.take(pa.array(docs)), width), _lists(pa.array(term[at]), runs), _lists(pa.array(tf[at].astype(np.int32)), runs), _lists(pa.array(size), runs), _lists(pa.array(ordinal[row]), np.bincount(stratum[row], minlength=len(strata)))]
    return pa.RecordBatch.from_arrays(columns, ["m", "ids", "terms", "tfs", "sizes", "docs"])


def build_index(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index over all terms of all documents, written to the shared folder."""
    small_batches(documents.sparkSession)
    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            data, bounds = vec.text_bytes(batch.column(0))
            has = np.zeros(len(batch), bool)
            for at, start, _ in vec.stretches(data, bounds, _KIND):
                has[vec.rows_of(start + at, bounds)] = True
                n_terms += len(start)
            n_docs += int(has.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], ["n_docs", "n_terms"])

    sizes = narrow.select("text").mapInArrow(count, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = sizes[0] or 0, sizes[1] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def part() -> pa.RecordBatch:
            rows, hashes, base = [], [], 0
            for ids, row, term in held:
                rows.append(row + base)
                hashes.append(term)
                base += len(ids)
            return _strata(pa.concat_arrays([h[0] for h in held]), np.concatenate(rows), np.concatenate(hashes), n_docs, n_terms)

        for batch in batches:
            held.append((batch.column(0), *terms(batch.column(1))))
            size += batch.nbytes
            if size >= PART_BYTES:
                yield part()
                held, size = [], 0
        if held:
            yield part()

    schema = T.StructType([T.StructField("m", T.LongType()), T.StructField("ids", T.ArrayType(documents.schema[id_col].dataType)), T.StructField("terms", T.ArrayType(T.LongType())), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("tfs", "sizes", "docs"))])
    spark, path = documents.sparkSession, f"{shared_dir(documents.sparkSession)}/index"
    narrow.mapInArrow(build, schema).write.option("parquet.block.size", str(GROUP_BYTES)).parquet(path)
    return Index(spark.read.schema(schema).parquet(path), n_docs, n_terms)


def _asked(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> tuple[DataFrame, int]:
    """The items as (item, terms, times, block), and the number of blocks of about block_terms different terms of items."""
    narrow = items.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, times = _counted(*terms(batch.column(1)))
            n = np.bincount(row, minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(pa.array(term), n), _lists(pa.array(times.astype(np.int64)), n)], ["item", "terms", "times"])

    schema = T.StructType([T.StructField("item", items.schema[id_col].dataType), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])
    cut = stash(narrow.mapInArrow(run, schema).where(F.size("terms") > 0).withColumn("key", F.monotonically_increasing_id()))
    n = -(-(cut.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    return cut.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, n)))), n


def _frequencies(strata: DataFrame, asked: np.ndarray) -> np.ndarray:
    """In how many documents each of the terms (sorted) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(asked), np.int64)
        for batch in batches:
            term, size = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.minimum(np.searchsorted(asked, term), len(asked) - 1)
            known = asked[at] == term
            df += np.bincount(at[known], weights=size[known], minlength=len(asked)).astype(np.int64)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(df[has])], ["at", "df"])

    out = np.zeros(len(asked), np.int64)
    for r in strata.select("terms", "sizes").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
        out[r["at"]] = r["df"]
    return out


class _Best:
    """The best documents of one item so far."""

    def __init__(self, top: int):
        self.top, self.least, self.rows = top, 0, []

    def add(self, score: np.ndarray, rank: np.ndarray, ids: pa.Array, at: np.ndarray) -> None:
        """score and rank (of the ids) of the documents at places of ids."""
        if len(score) > self.top:
            least = np.partition(score, len(score) - self.top)[len(score) - self.top]
            keep = score >= least
            score, rank, at = score[keep], rank[keep], at[keep]
            keep = np.lexsort((rank, -score))[: self.top]
            score, at = score[keep], at[keep]
        new = zip(score.tolist(), ids.take(pa.array(at)).to_pylist(), strict=True)
        self.rows = sorted([*self.rows, *new], key=lambda r: (-r[0], r[1] is None, r[1]))[: self.top]
        if len(self.rows) == self.top:
            self.least = self.rows[-1][0]


class _Part:
    """Strata of a batch, as far as their terms are asked for."""

    def __init__(self, batch: pa.RecordBatch, asked: np.ndarray, weight: np.ndarray):
        m = batch.column(0).to_numpy(zero_copy_only=False)
        self.ids = batch.column(1).flatten()
        width, runs, posts = (pc.list_value_length(batch.column(i)).to_numpy(zero_copy_only=False) for i in (1, 2, 5))
        term, tf, size, docs = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4, 5))
        self.n = len(m)
        self.first = np.cumsum(width) - width
        stratum = np.repeat(np.arange(self.n), runs)
        at = np.minimum(np.searchsorted(asked, term), len(asked) - 1)
        known = np.flatnonzero(asked[at] == term)
        known = known[np.argsort(at[known], kind="stable")]  # by term, then stratum, then falling tf
        start = np.cumsum(size) - size
        self.doc = docs + np.repeat(self.first, posts)
        self.stratum, self.size, self.start = stratum[known], size[known], start[known]
        tf, term = tf[known], at[known]
        self.impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.stratum]))
        self.bound = np.searchsorted(term, np.arange(len(asked) + 1))
        self.head = np.ones(len(term), bool)
        self.head[1:] = (term[1:] != term[:-1]) | (self.stratum[1:] != self.stratum[:-1])
        order = pc.sort_indices(self.ids, null_placement="at_end").to_numpy()
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.score = np.zeros(len(self.ids), np.int64)
        self.stratum_of = np.repeat(np.arange(self.n), width)

    def search(self, item_terms: np.ndarray, times: np.ndarray, best: _Best) -> None:
        here = [(slice(self.bound[t], self.bound[t + 1]), x) for t, x in zip(item_terms, times, strict=True) if self.bound[t] < self.bound[t + 1]]
        most = np.zeros(self.n, np.int64)
        for runs, x in here:
            head = self.head[runs]
            most[self.stratum[runs][head]] += x * self.impact[runs][head]
        order = np.argsort(-most, kind="stable")
        order = order[: np.count_nonzero(most)]
        at, wave = 0, 8
        while at < len(order) and most[order[at]] >= best.least:
            chosen = np.zeros(self.n, bool)
            visit = order[at : at + wave]
            chosen[visit[most[visit] >= best.least]] = True
            at, wave = at + wave, wave * 4
            for runs, x in here:
                use = np.flatnonzero(chosen[self.stratum[runs]]) + runs.start
                size = self.size[use]
                places = np.repeat(self.start[use] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                self.score[self.doc[places]] += x * np.repeat(self.impact[use], size)  # a document has one run for each term
            found = np.flatnonzero(self.score >= max(1, best.least))
            best.add(self.score[found], self.rank[found], self.ids, found)
            self.score[:] = 0


def search(index: Index, items: DataFrame, *, top: int = 10, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id", block_terms: int = 200_000) -> DataFrame:
    """The ``top`` best documents with a score above 0 of each item: item id, rank, document's id, score."""
    spark = small_batches(items.sparkSession)
    cut, n_blocks = _asked(items, id_col, text_col, block_terms)
    id_type = index.strata.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", id_type), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)
    found = spark.createDataFrame([], schema)
    for block in range(n_blocks):
        rows = cut.where(F.col("block") == block).select("key", "terms", "times").collect()
        if not rows:
            continue
        asked = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]))
        df = _frequencies(index.strata, asked)
        weight = np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * df + 1))).astype(np.int64)
        sent = spark.sparkContext.broadcast((asked, weight, [(r["key"], np.searchsorted(asked, r["terms"]), np.array(r["times"], np.int64)) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, weight, wanted = sent.value
            best = [_Best(top) for _ in wanted]
            for batch in batches:
                part = _Part(batch, asked, weight)
                for (_, item_terms, times), mine in zip(wanted, best, strict=True):
                    part.search(item_terms, times, mine)
            out = [(w[0], r[1], r[0]) for w, b in zip(wanted, best, strict=True) for r in b.rows]
            yield pa.RecordBatch.from_pydict({"key": [r[0] for r in out], "doc": [r[1] for r in out], "score": [r[2] for r in out]}, schema=arrow)

        found = found.unionByName(index.strata.mapInArrow(run, schema))
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(cut.select("key", "item"), "key").select(F.col("item").alias(id_col), "rank", F.col("doc").alias(doc_col), "score")


def op12_search(spark, sf_dir: str) -> DataFrame:
    return search(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS MATERIALIZED (SELECT rid, doc_id, term, count(*) AS tf FROM d GROUP BY rid, doc_id, term),
docs AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY rid),
size AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT qid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS qid, * FROM (SELECT DISTINCT item_id, text FROM benchmark))),
asked AS (SELECT qid, item_id, term, count(*) AS times FROM i GROUP BY qid, item_id, term),
scored AS (
  SELECT a.qid, a.item_id, t.doc_id, t.rid,
         sum(a.times * CAST(floor(1000 * ln((2 * s.nd + 2) / CAST(2 * f.df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + (75 * n.n * s.nd) // s.l)))) AS score
  FROM asked a JOIN df f USING (term) JOIN tf t ON t.term = a.term JOIN docs n ON n.rid = t.rid CROSS JOIN size s
  GROUP BY a.qid, a.item_id, t.doc_id, t.rid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE place <= 10
"""

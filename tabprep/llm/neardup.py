"""Near-duplicate documents: MinHash with tensored banding, and verification on full shingle sets.

Each document becomes a set of shingles (five words, A-Z lower-cased; a shorter text is one shingle). ``collections`` small
collections of two minhashes each are computed; the key of each of the collections * (collections - 1) / 2 tables combines a pair of
them, so that 32 minhashes serve 120 tables of four minhashes. A pair of documents meets in a table when any two collections
agree: at a similarity of 0.75 all tables miss it with a probability below 4 in 100,000, at higher ones far less.

1. Documents with equal shingle sets form a class; all further work is on classes.
2. Collections whose value no other class has are dropped before tables are formed: most documents end here.
3. In each table bucket every class is compared, on full sets, with the bucket's centre: the class whose collections' values are
   the most widely shared. Connected components are found by joins.
4. Classes that share a bucket with its centre's component without being in it are the stragglers. Shingles of a class that no class
   near it has limit what it can share with any partner (exactly, from counts). The pairs of a straggler and another class of its
   bucket that these limits allow, and 1,024 more minhashes, one bit of each, don't rule out (3.8 standard deviations), are verified
   on full sets, too. Pairs inside a component are never formed.

Defined results: a null or empty text has no shingles and stands alone; repeated rows of a document are copies of each other;
a null id reports the smallest id of its component; ties don't matter, since the component's id is a minimum.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .shared import free_name, hot_keys, small_batches, spread_join, stash, worker_cache

#: Minhashes in one collection.
_PER = 2
#: 64 bits each, of the sketch that tells more closely.
_LONGS = 16


def shingle_sets(text: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    data, bounds = vec.text_bytes(text)
    kind, lower = vec.table(vec.SPACES), vec.lowered()
    for lo, hi in vec.pieces(bounds):
        part = lower[data[bounds[lo] : bounds[hi]]]
        own = bounds[lo : hi + 1] - bounds[lo]
        start, end = vec.runs(part, own, kind)
        word = vec.span_hashes(vec.prefix_sums(part), start, end)
        row = vec.rows_of(start, own)
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        if len(word) >= width:
            rolled = word[: len(word) - width + 1].copy()
            for k in range(1, width):
                rolled = vec.mix(rolled * vec.U(0xD6E8FEB86659FD93) + word[k : len(word) - width + 1 + k])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield np.array([int.from_bytes(blake2b(word[a:b].tobytes(), digest_size=8).digest(), "little")], vec.U)
            else:
                yield np.zeros(0, vec.U)


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def sketch(documents: DataFrame, id_col: str, text_col: str, width: int, collections: int, seed: int) -> DataFrame:
    """doc, text_key, n_shingles, set_key (of the full set; null without shingles), u: the collections' values, two 32-bit minhashes in each."""
    draws = np.random.default_rng(seed).integers(0, 1 << 63, (2, collections * _PER), np.uint64)
    factor, offset = draws[0] * vec.U(2) + vec.U(1), draws[1]
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("sets")
        for batch in batches:
            n, keys, us = [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    us.append([])
                    continue
                keys.append(blake2b(s.tobytes(), digest_size=16).digest())
                low = np.full(collections * _PER, 2**64 - 1, np.uint64)
                for i in range(0, len(s), 4096):
                    np.minimum(low, (s[i : i + 4096, None] * factor + offset).min(axis=0), out=low)
                low >>= vec.U(32)
                us.append(((low[0::2] << vec.U(32)) | low[1::2]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(us, pa.list_(pa.int64())), batch.column(2)], ["doc", "n_shingles", "set_key", "u", "text_key"])

    plain = documents.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), _text_key(text_col).alias("text_key"))
    return plain.mapInArrow(run, f"doc {id_type}, n_shingles long, set_key binary, u array<bigint>, text_key binary")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b); equal labels are connected. By joins: neighbours' smallest label, then the label's label."""
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("to"))
        new = stash(lower.join(jump, lower.label == jump["at"]).select("node", "old", F.least("label", "to").alias("label")))
        if new.where("label < old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with 100 * intersection >= percent * union, on full sets that are made anew from the texts."""
    nodes = pairs.select("a").union(pairs.select("b")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("sets")
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), width))
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
            keys = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["k", "shingles"])

    sets = _texts_of(nodes, classes, documents, id_col, text_col).mapInArrow(run, "k binary, shingles array<bigint>").dropDuplicates(["k"])
    one, two = sets.select(F.col("k").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("k").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    # the centre of a large group is in a pair with each of its classes
    total = pairs.count()
    hot_a, hot_b = (hot_keys(pairs.groupBy(c).count(), c, "count", total) for c in ("a", "b"))
    full = spread_join(spread_join(pairs, one, "a", hot_a, "b"), two, "b", hot_b, "a")
    return full.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _texts_of(nodes: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One text of each class in nodes (a); more where rows of an id differ."""
    wanted = classes.join(nodes, classes.set_key == nodes.a, "left_semi").select(F.col("rep").alias("_rep")).distinct()
    texts = documents.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    return texts.join(wanted, F.col("_doc").eqNullSafe(F.col("_rep")), "left_semi").select("_text")


def _own_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(k, own): how many shingles of a set no other set of the texts has; sets without any are missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("sets")
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                key = blake2b(s.tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key, pa.binary()), len(s)), pa.array(s.astype(np.int64))], ["k", "shingle"])

    single = texts.mapInArrow(run, "k binary, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("k")).where("rows = 1")
    return single.groupBy("k").agg(F.count(F.lit(1)).alias("own"))


def _bits(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """k, b0 .. b15: one bit each of 1,024 more minhashes of the texts' sets."""
    draws = np.random.default_rng(seed + 1).integers(0, 1 << 63, (2, 64 * _LONGS), np.uint64)
    factor, offset = draws[0] * vec.U(2) + vec.U(1), draws[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("sets")
        for batch in batches:
            keys, words = [], []
            for s in shingle_sets(batch.column(0), width):
                low = np.full(64 * _LONGS, 2**64 - 1, np.uint64)
                for i in range(0, len(s), 256):
                    np.minimum(low, (s[i : i + 256, None] * factor + offset).min(axis=0), out=low)
                keys.append(blake2b(s.tobytes(), digest_size=16).digest())
                words.append(np.packbits(((low >> vec.U(40)) & vec.U(1)).astype(np.uint8)).view(np.int64))
            flat = np.array(words, np.int64).reshape(-1, _LONGS)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(flat[:, k]) for k in range(_LONGS))], ["k", *(f"b{k}" for k in range(_LONGS))])

    return texts.mapInArrow(run, "k binary, " + ", ".join(f"b{k} long" for k in range(_LONGS))).dropDuplicates(["k"])


def _components(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, collections: int = 16, seed: int = 1) -> DataFrame:
    """One row per document: doc, text_key, n_shingles, component (its smallest id), label (equal in a component; null without shingles)."""
    small_batches(documents.sparkSession)
    docs = stash(sketch(documents, id_col, text_col, width, collections, seed))
    classes = stash(docs.where("set_key is not null").groupBy("set_key").agg(F.min("doc").alias("rep"), F.min("n_shingles").alias("n"), F.first("u").alias("u"), F.count(F.lit(1)).alias("copies")))
    check = (classes, documents, id_col, text_col, width)

    each = classes.select("set_key", "n", F.posexplode("u").alias("i", "v"))
    shared = each.groupBy("i", "v").agg(F.count(F.lit(1)).alias("spread")).where("spread > 1")
    live = each.join(shared, ["i", "v"]).groupBy("set_key", "n").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"), F.sum("spread").alias("spread")).where(F.size("c") > 1)
    first = live.select("set_key", "n", "spread", "c", F.posexplode("c").alias("p", "x"))
    second = first.select("set_key", "n", "spread", "x", F.explode(F.slice("c", F.col("p") + 2, F.greatest(F.size("c") - F.col("p") - 1, F.lit(0)))).alias("y"))
    keyed = second.select(F.xxhash64("x.i", "y.i", "x.v", "y.v").alias("key"), F.col("x.i").alias("i"), F.col("y.i").alias("j"), "set_key", "n", "spread")
    full = stash(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("spread", "set_key")).alias("top")).where("size > 1"))
    hot = hot_keys(full, "key", "size", full.agg(F.sum("size")).first()[0] or 0)
    buckets = stash(spread_join(keyed, full.select("key", F.col("top.set_key").alias("head")), "key", hot, "set_key").select("key", "i", "j", "set_key", "n", "head"))

    star = stash(buckets.where("set_key <> head").select(F.least("head", "set_key").alias("a"), F.greatest("head", "set_key").alias("b")).distinct())
    links = stash(verified(star, *check, percent))
    labels = connected(links)

    named = stash(buckets.join(labels, buckets.set_key == labels.node, "left").select("key", "i", "j", "set_key", "n", "head", F.coalesce("label", "set_key").alias("label")))
    apart = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.min(F.when(F.col("set_key") == F.col("head"), F.col("label"))).alias("of")).where("lo <> hi")
    minor = stash(spread_join(named, apart.select("key", "least", "of"), "key", hot, "set_key").where("label <> of").select("key", "i", "j", "set_key", "label", "least", "of"))
    if not minor.isEmpty():
        of = minor.select("of").distinct()
        near = stash(minor.select(F.col("set_key").alias("a")).union(of).union(labels.join(of, labels.label == of["of"], "left_semi").select("node")).distinct())
        texts = _texts_of(near, *check[:-1])
        own, bits = _own_shingles(texts, width).withColumnRenamed("k", "own_k"), _bits(texts, width, seed)
        # of n shingles at most n - own are shared, so a partner has at most this many
        room = F.floor(((100 + percent) * (F.col("n") - F.coalesce("own", F.lit(0))) - percent * F.col("n")) / percent)
        facts = classes.join(near, classes.set_key == near.a, "left_semi").join(bits, F.col("set_key") == F.col("k")).join(own, F.col("set_key") == F.col("own_k"), "left")
        facts = stash(facts.where(100 * room >= percent * F.col("n")).select("set_key", F.col("n").alias("size"), room.alias("most"), "u", *(f"b{k}" for k in range(_LONGS))))
        x = minor.join(facts, "set_key").where("least <= most").select("key", "i", "j", "label", *facts.columns)
        x = stash(x.select("key", "i", "j", *(F.col(c).alias(f"{c}_x") for c in x.columns[3:])))
        y = named.select("key", "set_key", "label").join(facts, "set_key", "left")
        differ = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"b{k}_x"))) for k in range(_LONGS)), F.lit(0))
        # at a similarity of percent, half of the other minhashes' bits differ: 3.8 standard deviations more are allowed
        odd, all_bits = (1 - percent / 100) / 2, 64 * _LONGS
        most_differ = all_bits * odd + 3.8 * (all_bits * odd * (1 - odd)) ** 0.5
        fits = (F.col("size") <= F.col("most_x")) & (F.col("size_x") <= F.col("most")) & (100 * F.least("size", "size_x") >= percent * F.greatest("size", "size_x")) & (differ <= F.lit(most_differ))
        alike = F.filter(F.sequence(F.lit(0), F.lit(collections - 1)), lambda k: F.get("u", k) == F.get("u_x", k))
        # of the tables where a pair meets, the first one gives it
        once = (F.get(alike, F.lit(0)) == F.col("i")) & (F.get(alike, F.lit(1)) == F.col("j"))
        cross = spread_join(y, x, "key", hot, "set_key").where((F.col("label") != F.col("label_x")) & fits & once)
        cross = cross.select(F.least("set_key_x", "set_key").alias("a"), F.greatest("set_key_x", "set_key").alias("b")).distinct()
        more = stash(verified(stash(cross.join(star, ["a", "b"], "left_anti")), *check, percent))
        if not more.isEmpty():
            labels = connected(links.union(more))

    lead = labels.join(classes, labels.node == classes.set_key).select("node", "label", "rep")
    lowest = lead.groupBy("label").agg(F.min("rep").alias("component"))
    of_node = lead.join(lowest, "label").select(F.col("node").alias("set_key"), "component", "label")
    of_class = classes.select("set_key", "rep").join(of_node, "set_key", "left").select("set_key", F.coalesce("component", "rep").alias("component"), F.coalesce("label", "set_key").alias("label"))
    hot_sets = hot_keys(classes, "set_key", "copies", classes.agg(F.sum("copies")).first()[0] or 0)
    out = spread_join(docs.select("doc", "text_key", "n_shingles", "set_key"), of_class, "set_key", hot_sets, "doc", "left")
    return out.select("doc", "text_key", "n_shingles", F.coalesce("component", "doc").alias("component"), "label")


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept."""
    found = _components(documents, id_col=id_col, **options)
    return found.select(F.col("doc").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, one of each component: that with the smallest id (null ones last), of its texts that with
    the smallest hash, of its repeated rows any one. Without shingles each id and text stands alone."""
    found = _components(documents, id_col=id_col, text_col=text_col, **options)
    alone = F.when(F.col("label").isNull(), F.struct("doc", "text_key"))
    counted = found.groupBy("label", alone.alias("alone"), "doc", "text_key").agg(F.count(F.lit(1)).alias("n"))
    least = counted.groupBy("label", "alone").agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "text_key", "n")).alias("k"))
    one = stash(least.select(F.col("k.doc").alias("doc"), F.col("k.text_key").alias("text_key"), F.col("k.n").alias("n")))
    key = free_name(documents, "_text_key")
    keyed = documents.withColumn(key, _text_key(text_col))
    out = keyed.join(one, keyed[id_col].eqNullSafe(one["doc"]) & (keyed[key] == one["text_key"]), "left_semi")
    return (out if one.where("n > 1").isEmpty() else out.dropDuplicates([id_col, key])).drop(key)


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT rid, doc_id, md5(array_to_string(w[i : i + least(len(w), 5) - 1], ' ')) AS sh
  FROM d, unnest(range(1, greatest(len(w) - least(len(w), 5) + 2, 1))) AS r(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY rid),
links AS MATERIALIZED (
  SELECT a.rid AS x, b.rid AS y FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid JOIN n p ON p.rid = a.rid JOIN n q ON q.rid = b.rid
  GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))),
reach AS (
  SELECT rid AS x, rid AS y FROM d
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_id AS (SELECT reach.x AS rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.y GROUP BY reach.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM d JOIN least_id l USING (rid) LEFT JOIN n USING (rid)
"""

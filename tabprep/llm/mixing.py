"""Mixing sources to target weights by Poisson replication.

A source's rate is its share of the target size divided by its documents. Each document draws its number of copies from the Poisson
distribution of that rate, by inverting the distribution at a hash of seed and id: the same input gives the same copies, on any
number of machines. Copies are then dealt out and sorted by another hash, which shuffles the whole mixture.

A rate above 400 is drawn as the sum of several smaller ones, so that no term underflows. Source counts are summed before the
shuffle; their rates are broadcast when there are at most ``broadcast_sources`` of them, and joined otherwise.

Defined results: weights are relative and default to equal ones; sources without a weight, or with 0, are left out; a null source
is a source of its own (None among the weights); a null id draws as one id of its own; repeated rows draw the same number; null or
empty texts are documents like others; an empty table gives an empty mixture.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let
from .shared import stash


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / 2.0**52


def _cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... until nothing above it can be drawn."""

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(s["sums"], F.get(s["sums"], k - 1) + p).alias("sums"))

    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")), start, step, lambda s: s["sums"])


def source_rates(documents: DataFrame, weights: Mapping[str | None, float] | None, source_col: str, size: int | None) -> DataFrame:
    """_source, _rate, _parts, _cdf of each source with a rate above 0."""
    spark = documents.sparkSession
    counts = stash(documents.groupBy(F.col(source_col).cast("string").alias("_source")).count())
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "s string, w double")
        weighted = counts.join(given, F.col("_source").eqNullSafe(F.col("s"))).drop("s")
    all_w, all_n = weighted.agg(F.sum("w")).first()[0], size if size is not None else counts.agg(F.sum("count")).first()[0]
    rate = F.lit(float(all_n or 0)) * F.col("w") / F.lit(all_w or 1.0) / F.col("count")
    rated = weighted.select("_source", rate.alias("_rate")).withColumn("_parts", F.greatest(F.ceil(F.col("_rate") / 400), F.lit(1)).cast("int"))
    return stash(rated.withColumn("_cdf", _cdf(F.col("_rate") / F.col("_parts"))))


def mix_sources(documents: DataFrame, weights: Mapping[str | None, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", size: int | None = None, seed: int = 1, replica_col: str | None = None, broadcast_sources: int = 20_000) -> DataFrame:
    """The mixture: all columns of documents, and the copy's number from 1 on if replica_col names a column for it."""
    rates = source_rates(documents, weights, source_col, size)
    if rates.count() <= broadcast_sources:
        rates = F.broadcast(rates)
    # a document's columns stay together under one name, so none of theirs can clash with those made here
    docs = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("_doc"), documents[id_col].alias("_id"), documents[source_col].cast("string").alias("_of"))
    joined = docs.join(rates, F.col("_of").eqNullSafe(F.col("_source")))

    def drawn(j: Column) -> Column:
        return let(uniform(F.lit(seed), F.col("_id"), j), lambda u: F.size(F.filter("_cdf", lambda c: c < u)))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda s, j: s + drawn(j))
    drawn_rows = joined.select("_doc", "_id", copies.alias("_copies")).where("_copies > 0").select("_doc", "_id", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_replica"))
    dealt = drawn_rows.withColumn("_place", F.xxhash64(F.lit(seed), F.col("_id"), F.col("_replica")))
    dealt = dealt.repartition(F.col("_place")).sortWithinPartitions("_place")
    return dealt.select("_doc.*", *([F.col("_replica").alias(replica_col)] if replica_col else []))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), replica_col="replica")


OP9_SQL = r"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT count(*) FROM documents) * 1.0::DOUBLE / (SELECT count(*) FROM c) / n AS rate FROM c),
cdf AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS f
  FROM r, unnest(range(0, 200)) AS t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 25)),
u AS (SELECT row_number() OVER () AS rid, *, (CAST('0x' || substring(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS x FROM documents),
d AS (SELECT rid, count(*) AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.f < u.x GROUP BY rid)
SELECT doc_id, text, lang, source, n_chars, CAST(replica AS INTEGER) AS replica FROM u JOIN d USING (rid), unnest(range(1, copies + 1)) AS t(replica)
"""

"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (single tokens and pairs, hashed to ``buckets`` places) are counted: one from the target,
that is a bounded sample of documents labelled good, one from all raw text. A document's log weight is the mean log ratio of
target to raw over its n-grams (long texts don't crowd out short ones), times a sharpness. Adding Gumbel noise that is
drawn from a hash of seed and id and taking the k largest sums samples k documents without replacement by their weights.

The sharpness is fitted, so that the draw counts and yet goes by quality: the largest at which about a share ``chance`` of the k sampled documents are ones that
a plain cut by the mean would leave out (worked out from a histogram of the means). Where no document with n-grams is below the limit, nothing can be drawn instead, and
the largest sharpness is used.

k is the number of documents whose mean log ratio reaches a limit, and the limit is where labelled documents are told apart best
(largest difference of the shares of good and bad documents above it, good ones counting more). The k-th largest sum is found exactly, by counting in
ever finer bins; no list of all documents is gathered.

``target_sample`` bounds the labelled documents that the target model uses (those with the smallest hashes of their ids);
raw counts, scores and the choice cover all documents.

Defined results: a null or empty text has no n-grams and gets the mean -100, so it is rejected; documents of equal id and text (repeated rows) share their fate; ties at the k-th place all stay; without labels of both
kinds every document with a token stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .shared import small_batches, stash, worker_cache

#: Bounds of the sharpness, by which mean log ratios are multiplied.
LEAST_SHARP, MOST_SHARP = 1.0, 100_000.0
#: Mean log ratios are told apart in steps of this size when the limit is chosen.
STEP = 0.005
#: Rejecting a good document counts as much as keeping so many bad ones, as shares of their kinds.
GOOD_COUNTS = 8

_KIND = vec.table(vec.SPACES)
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2


def ngrams(text: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with the places of their n-grams and the n-grams' rows within the range."""
    data, bounds = vec.text_bytes(text)
    lower = vec.lowered()
    for lo, hi in vec.pieces(bounds):
        part = lower[data[bounds[lo] : bounds[hi]]]
        own = bounds[lo : hi + 1] - bounds[lo]
        start, end = vec.runs(part, own, _KIND)
        token = vec.span_hashes(vec.prefix_sums(part), start, end)
        row = vec.rows_of(start, own)
        pair = row[1:] == row[:-1]
        two = vec.mix(token[:-1][pair] * vec.U(0xD6E8FEB86659FD93) + token[1:][pair])
        places = np.concatenate([token, two]) % vec.U(buckets)
        yield lo, hi, places.astype(np.int64), np.concatenate([row, row[1:][pair]])


def fit(documents: DataFrame, target_ids: list, id_col: str, text_col: str, buckets: int) -> np.ndarray:
    """The log ratio of target to raw at each place."""
    sent = small_batches(documents.sparkSession).sparkContext.broadcast(target_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        wanted = None
        worker_cache("scores")
        for batch in batches:
            wanted = pa.array(sent.value, batch.column(0).type) if wanted is None else wanted
            good = pc.is_in(batch.column(0), wanted).to_numpy(zero_copy_only=False)
            for lo, hi, places, rows in ngrams(batch.column(1), buckets):
                raw += np.bincount(places, minlength=buckets)
                target += np.bincount(places[good[lo:hi][rows]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["place", "raw", "target"])

    counts = documents.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, "place long, raw long, target long")
    rows = counts.groupBy("place").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in rows:
        raw[r["place"]] += r["raw"]
        target[r["place"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if target_ids else np.zeros(buckets)


def means(text: pa.Array, model: np.ndarray) -> np.ndarray:
    """The mean log ratio of each text; -100 without n-grams."""
    out = np.full(len(text), -100.0)
    for lo, hi, places, rows in ngrams(text, len(model)):
        n = np.bincount(rows, minlength=hi - lo)
        total = np.bincount(rows, weights=model[places], minlength=hi - lo)
        np.divide(total, n, out=out[lo:hi], where=n > 0)
    return out


def gumbel(ids: pa.Array, seed: int) -> np.ndarray:
    """Gumbel noise from a hash of seed and id."""
    data, bounds = vec.text_bytes(pc.fill_null(pc.cast(ids, pa.string()), "null"))
    h = vec.mix(vec.span_hashes(vec.prefix_sums(data), bounds[:-1], bounds[1:]) ^ vec.U(seed))
    u = ((h >> vec.U(12)).astype(np.float64) + 0.5) / 2.0**52
    return -np.log(-np.log(u))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 2048, few: int = 4096) -> float:
    """The k-th largest value of a column, by counts in ever finer bins."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    part, above = keys, 0
    while True:
        width = (hi - lo) / bins
        if not width:
            return lo
        counts = dict(part.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).alias("bin")).count().collect())
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                break
            above += counts[b]
        part = part.where(F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)) == b)
        if counts[b] <= few:
            return sorted((r[0] for r in part.select(column).collect()), reverse=True)[k - above - 1]
        new = part.agg(F.min(column), F.max(column)).first()
        if (new[0], new[1]) == (lo, hi):
            return lo
        lo, hi = new


def _limit(scores: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> float:
    """Where good and bad labelled documents are told apart best: the middle of the best stretch."""
    labelled = scores.join(labels.select(F.col(id_col).alias("_l"), (F.col(label_col) == 1).alias("good")), F.col("id") == F.col("_l"))
    rows = labelled.where("mean > -100 and good is not null").groupBy(F.floor(F.col("mean") / STEP).alias("bin"), "good").count().collect()
    good, bad = ({r["bin"]: r["count"] for r in rows if r["good"] == g} for g in (True, False))
    if not good or not bad:
        return -100 + STEP
    n_good, n_bad, up_good, up_bad, best = sum(good.values()), sum(bad.values()), 0, 0, (-2.0, 0, 0)
    bins = sorted({*good, *bad}, reverse=True)
    for i, b in enumerate(bins):
        up_good, up_bad = up_good + good.get(b, 0), up_bad + bad.get(b, 0)
        after = bins[i + 1] if i + 1 < len(bins) else b - 1
        best = max(best, (GOOD_COUNTS * up_good / n_good - up_bad / n_bad, -b, -after))
    return (-best[1] - best[2] + 1) / 2 * STEP


def _swapped(sharp: float, mean: np.ndarray, n: np.ndarray, k: int, limit: float) -> float:
    """The share of k sampled documents that are expected to be below the limit, given n documents at each mean."""
    low, high = sharp * mean.min() - 50, sharp * mean.max() + 50
    for _ in range(200):  # the least key that stays
        least = (low + high) / 2
        stay = n * -np.expm1(-np.exp(np.minimum(sharp * mean - least, 700)))
        low, high = (least, high) if stay.sum() > k else (low, least)
    return float(stay[mean < limit].sum() / k)


def _sharpness(scores: DataFrame, k: int, limit: float, chance: float) -> float:
    """The largest sharpness at which the draw swaps at least the share ``chance``."""
    rows = scores.where("mean > -100").groupBy(F.floor(F.col("mean") / STEP).alias("bin"), (F.col("mean") >= limit).alias("above")).agg(F.avg("mean").alias("mean"), F.count("*").alias("n")).collect()
    mean, n = np.array([r["mean"] for r in rows]), np.array([r["n"] for r in rows], np.float64)
    if all(r["above"] for r in rows):
        return MOST_SHARP
    low, high = np.log(LEAST_SHARP), np.log(MOST_SHARP)
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if _swapped(float(np.exp(middle)), mean, n, k, limit) >= chance else (low, middle)
    return float(np.exp(low))


def _fitted(documents, labels, id_col, text_col, label_col, buckets, target_sample, chance, seed):
    """model, scores (id, mean, key), the sharpness, and the least key that stays."""
    ids = labels.where(F.col(label_col) == 1).where(F.col(id_col).isNotNull()).select(id_col).distinct()
    target = [r[0] for r in ids.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(target_sample).collect()]
    model = fit(documents, target, id_col, text_col, buckets)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("scores")
        for batch in batches:
            mean = means(batch.column(1), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean), pa.array(gumbel(batch.column(0), seed))], ["id", "mean", "noise"])

    id_type = documents.schema[id_col].dataType.simpleString()
    scores = stash(documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {id_type}, mean double, noise double"))
    limit = _limit(scores, labels, id_col, label_col)
    k = scores.where(F.col("mean") >= limit).count()
    sharp = _sharpness(scores, k, limit, chance) if k else MOST_SHARP
    keyed = scores.select("id", "mean", (F.col("mean") * F.lit(sharp) + F.col("noise")).alias("key"))
    return sent, keyed, sharp, kth_largest(keyed, "key", k) if k else float("inf")


def importance_scores(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = 10_000, target_sample: int = 20_000, chance: float = 0.005, seed: int = 1) -> DataFrame:
    """Per document: id, mean_log_ratio, sampling_key, kept."""
    _, scores, _, least = _fitted(documents, labels, id_col, text_col, label_col, buckets, target_sample, chance, seed)
    return scores.select(F.col("id").alias(id_col), F.col("mean").alias("mean_log_ratio"), F.col("key").alias("sampling_key"), (F.col("key") >= least).alias("kept"))


def resample(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = 10_000, target_sample: int = 20_000, chance: float = 0.005, seed: int = 1) -> DataFrame:
    """The documents that are kept, with all their columns. Scores are worked out again, which is cheaper than shuffling texts."""
    model, _, sharp, least = _fitted(documents, labels, id_col, text_col, label_col, buckets, target_sample, chance, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("scores")
        for batch in batches:
            key = means(batch.column(text_col), model.value) * sharp + gumbel(batch.column(id_col), seed)
            yield batch.filter(pa.array(key >= least))

    return documents.mapInArrow(run, documents.schema)


def op2_importance(spark, sf_dir: str) -> DataFrame:
    return importance_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

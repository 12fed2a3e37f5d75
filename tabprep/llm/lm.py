"""Scores of a log-bilinear neural language model.

Tokens are words, lower-cased, and one end for each text. The ``words`` most frequent words are a class each; all others fall into ``rest`` classes by their
last two bytes. The model gives a class's probability after the two tokens before it, and within a class a word has its smoothed share
(count + 0.1) / (class's count + 0.1 * (class's words + 1)), where words never seen share one place; so the probabilities of all tokens add up to 1 after any two
tokens.

After classes a and b the class w scores (u * R[a] + v * R[b]) . Q[w] + bias[w], with vectors R and Q of ``size`` numbers and weights u and v of the
two places. Parameters are learned in numpy by noise-contrastive estimation: the class that follows is to be told from ``noise`` classes drawn from their
shares in the corpus (one draw for each minibatch), without any sum over classes. Learning starts at the classes' shares, that is, at the unigram model.
Tasks learn from their own texts, each from the same parameters; these are then averaged, each vector by how often it was used. ``rounds`` rounds take disjoint
parts of the texts, small ones first, so every text learned from is used once.

For scoring, the sum over all classes is worked out by matrix products for every pair of preceding classes, once, in blocks that tasks share out; a
token's log-probability is then exact and normalised.

Nothing is limited by the corpus's size: counts of words are shuffled; the driver and the broadcasts hold ``words`` + ``rest`` classes, the table of sums
over pairs of them, and at most ``known`` counts of frequent words. The rarer words of each text are joined with the table of counts. Words are told apart by
64-bit hashes; of V words two get the same hash with a probability of about V * V / 2 ** 65.

Defined results: a null or empty text has its end only; a null id counts as the id '' for the choice of texts to learn from; rows of equal ids and texts are
scored each, and learned from each; an empty table gives an empty result; without any text to learn from all classes
are alike and base_score is 0. Columns other than id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .importance import kth_largest
from .shared import small_batches, stash

_KIND = vec.table(vec.SPACES)
#: Stands for the end of a text among hashes of words.
END = np.uint64(0)


@dataclass(frozen=True)
class Settings:
    words: int = 768
    rest: int = 255
    known: int = 262_144
    size: int = 32
    noise: int = 64
    rounds: int = 3
    batch: int = 512
    rate: float = 0.1
    seed: int = 3
    held_out: int = 10

    @property
    def classes(self) -> int:
        """Words, the end, and the rest."""
        return self.words + 1 + self.rest


def tokens(text: pa.Array, rest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of (row, hash, class among the rest) of the texts' tokens in order; ends have the hash END."""
    data, bounds = vec.text_bytes(text)
    lower = vec.lowered()
    n = len(bounds) - 1
    done = 0
    for at, start, end in vec.stretches(data, bounds, _KIND):
        part = lower[data[at : at + (end[-1] if len(end) else 0)]]
        hashes = vec.span_hashes(vec.prefix_sums(part), start, end)
        hashes[hashes == END] = vec.U(1)
        last = part[end - 1].astype(np.uint64)
        before = np.where(end - start > 1, part[np.maximum(end - 2, 0)], 0).astype(np.uint64)
        kind = (vec.mix(last * vec.U(256) + before) % vec.U(rest)).astype(np.int64)
        row = vec.rows_of(start + at, bounds)
        upto = int(row[0]) if len(row) else done  # texts before the first word here have ended
        nexts = np.append(row[1:], row[-1:])
        ends = nexts - row  # how many texts end after each word
        places = np.repeat(np.arange(len(row)), ends) + 1
        rows_ended = np.repeat(row, ends) + np.arange(len(places)) - np.repeat(np.cumsum(ends) - ends, ends)
        lead = np.arange(done, upto)
        where = np.concatenate([np.zeros(len(lead), np.int64), places])
        yield np.insert(row, where, np.concatenate([lead, rows_ended])), np.insert(hashes, where, END), np.insert(kind, where, 0)
        done = int(row[-1]) if len(row) else done
    left = np.arange(done, n)
    if len(left):
        yield left, np.zeros(len(left), np.uint64), np.zeros(len(left), np.int64)


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray], kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return h, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64), np.concatenate(kinds)[first]


def word_counts(texts: DataFrame, rest: int) -> DataFrame:
    """(h, c, kind): each token's hash, count and class among the rest, over all rows of texts (text), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        names = ["h", "c", "kind"]
        more = 0
        for batch in batches:
            for _, h, kind in tokens(batch.column(0), rest):
                for to, x in zip(held, _merged([h], [np.ones(len(h), np.int64)], [kind]), strict=True):
                    to.append(x)
                more += len(held[0][-1])
            if more > 1 << 20:
                held = tuple([x] for x in _merged(*held))
                more = 0
                if len(held[0][0]) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[1][0]), pa.array(held[2][0])], names)
                    held = tuple([x[0][:0]] for x in held)
        h, c, kind = _merged(*held)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(kind)], names)

    parts = texts.mapInArrow(run, "h long, c long, kind long")
    return stash(parts.groupBy("h").agg(F.sum("c").alias("c"), F.first("kind").alias("kind")))


class Vocabulary:
    """Classes of words, and counts of frequent ones; known words are sorted by their hashes."""

    def __init__(self, counts: DataFrame, s: Settings):
        totals = counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("n"))
        distinct = counts.count()
        frequent = counts if distinct <= s.known else counts.where(F.col("c") > kth_largest(counts, "c", s.known))  # fewer than known
        rows = [r for r in frequent.where(F.col("h") != 0).select("h", "c", "kind").collect()]
        end = counts.where("h = 0").select("c").first()
        h, c, kind = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        order = np.lexsort((h, -c))[: s.words]
        own = np.full(len(h), -1)
        own[order] = np.arange(len(order))
        by_hash = np.argsort(h.view(np.uint64), kind="stable")
        self.hash, self.count, self.own = h.view(np.uint64)[by_hash], c[by_hash], own[by_hash]
        self.words, self.rest, self.end = s.words, s.rest, int(end[0]) if end else 0
        self.class_count, self.class_words = np.zeros(s.classes), np.zeros(s.classes)
        self.class_count[: len(order)] = c[order]
        self.class_words[: len(order)] = 1
        self.class_count[s.words] = self.end
        for r in totals.collect():
            mine = order[kind[order] == r["kind"]]
            is_end = r["kind"] == 0 and bool(self.end)
            self.class_count[s.words + 1 + r["kind"]] = r["c"] - c[mine].sum() - (self.end if is_end else 0)
            self.class_words[s.words + 1 + r["kind"]] = r["n"] - len(mine) - is_end
        self.total, self.distinct = int(self.class_count.sum()), distinct

    def look_up(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each token; the count is -1 where it isn't held here."""
        end = h == END
        if not len(self.hash):
            return np.where(end, self.words, self.words + 1 + kind), np.where(end, self.end, -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        known = self.hash[at] == h
        own = np.where(known, self.own[at], -1)
        return np.where(end, self.words, np.where(own >= 0, own, self.words + 1 + kind)), np.where(end, self.end, np.where(known, self.count[at], -1))

    def share(self) -> np.ndarray:
        """Smoothed share of each class among tokens."""
        return (self.class_count + 0.1) / (self.total + 0.1 * len(self.class_count))


@dataclass
class Model:
    """Vectors of preceding classes (the last row stands for the text's begin) and of following ones, the places' weights, and biases."""

    before: np.ndarray
    after: np.ndarray
    places: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        """One row for each vector: before, after (with its bias), places."""
        wide = lambda x, b: np.concatenate([x, b[:, None]], axis=1)
        none = lambda x: np.zeros(len(x), np.float32)
        return np.concatenate([wide(self.before, none(self.before)), wide(self.after, self.bias), wide(self.places, none(self.places))])

    @classmethod
    def of(cls, flat: np.ndarray, classes: int) -> Model:
        flat = flat.astype(np.float32)
        return cls(flat[: classes + 1, :-1].copy(), flat[classes + 1 : 2 * classes + 1, :-1].copy(), flat[2 * classes + 1 :, :-1].copy(), flat[classes + 1 : 2 * classes + 1, -1].copy())


def start_model(share: np.ndarray, s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    n = s.classes
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return Model(small(n + 1, s.size), small(n, s.size), np.full((2, s.size), 0.7, np.float32), np.log(share).astype(np.float32))


class Trainer:
    """Learns from minibatches of (class before last, last class, class) by noise-contrastive estimation, with step sizes that shrink by use."""

    def __init__(self, model: Model, share: np.ndarray, s: Settings):
        self.m, self.s = model, s
        self.log_noise = np.log(s.noise * share).astype(np.float32)
        self.cumulated = np.cumsum(share)
        self.used_before, self.used_after = np.zeros(s.classes + 1, np.int64), np.zeros(s.classes, np.int64)
        self.seen = [np.full(x.shape, 1e-2, np.float32) for x in (model.before, model.after, model.places, model.bias)]

    def _step(self, which: int, x: np.ndarray, rows: np.ndarray, grads: np.ndarray) -> None:
        """Moves the rows of x by the sums of their gradients."""
        order = np.argsort(rows, kind="stable")
        rows, starts = np.unique(rows[order], return_index=True)
        g = np.add.reduceat(grads[order], starts)
        seen = self.seen[which][rows] + g * g
        self.seen[which][rows] = seen
        x[rows] += self.s.rate * g / np.sqrt(seen)

    def learn(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        m, s = self.m, self.s
        # the draw depends on the texts only, so a task that runs again learns the same
        rng = np.random.default_rng([s.seed, len(w), int(w.sum()), int(a[0]), int(b[0])])
        drawn = np.minimum(np.searchsorted(self.cumulated, rng.random(s.noise) * self.cumulated[-1]), len(self.cumulated) - 1)
        ra, rb, q = m.before[a], m.before[b], m.after[w]
        h = ra * m.places[0] + rb * m.places[1]
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, q) + m.bias[w] - self.log_noise[w]))  # the true class's error
        qn = m.after[drawn]
        down = -1 / (1 + np.exp(-(h @ qn.T + m.bias[drawn] - self.log_noise[drawn])))
        gh = up[:, None] * q + down @ qn
        g_places = np.stack([np.einsum("ij,ij->j", gh, ra), np.einsum("ij,ij->j", gh, rb)])
        self._step(0, m.before, np.concatenate([a, b]), np.concatenate([gh * m.places[0], gh * m.places[1]]))
        both = np.concatenate([w, drawn])
        self._step(1, m.after, both, np.concatenate([up[:, None] * h, down.T @ h]))
        self._step(3, m.bias, both, np.concatenate([up, down.sum(axis=0)]))
        self._step(2, m.places, np.arange(2), g_places)
        self.used_before += np.bincount(a, minlength=s.classes + 1) + np.bincount(b, minlength=s.classes + 1)
        self.used_after += np.bincount(w, minlength=s.classes)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each vector was used, and the vectors."""
        used = np.concatenate([self.used_before, self.used_after, np.full(2, self.used_after.sum())])
        return used, self.m.flat()


class Reader:
    """Turns stretches of tokens into classes with the two classes before them; keeps what a text's later stretches need."""

    def __init__(self, begin: int):
        self.begin, self.row, self.last = begin, -1, (begin, begin)

    def before(self, row: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.concatenate([[self.row, self.row], row])
        classes = np.concatenate([self.last, classes])
        b = np.where(row[2:] == row[1:-1], classes[1:-1], self.begin)
        a = np.where(row[2:] == row[:-2], classes[:-2], self.begin)
        self.row, self.last = row[-1], (classes[-2] if row[-2] == row[-1] else self.begin, classes[-1])
        return a, b


def _learned(texts: DataFrame, words: Vocabulary, model: Model, s: Settings) -> Model:
    """One round over texts (text): tasks learn apart, and their vectors are averaged by use."""
    sent = texts.sparkSession.sparkContext.broadcast((words, model.flat()))
    width = s.size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = sent.value
        share = words.share()
        trainer = Trainer(Model.of(flat, s.classes), share, s)
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            reader = Reader(s.classes)
            for row, h, kind in tokens(batch.column(0), s.rest):
                w, _ = words.look_up(h, kind)
                held = [np.concatenate([x, y]) for x, y in zip(held, (*reader.before(row, w), w), strict=True)]
                # a minibatch takes tokens from all over what is held, not one text's
                n = len(held[0]) // s.batch
                for i in range(n if n >= 8 else 0):
                    trainer.learn(*(x[i : n * s.batch : n] for x in held))
                if n >= 8:
                    held = [x[n * s.batch :] for x in held]
        if len(held[0]):
            for part in zip(*(np.array_split(x, -(-len(x) // s.batch)) for x in held), strict=True):
                trainer.learn(*part)
        used, rows = trainer.rows()
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(used[at]), pa.FixedSizeListArray.from_arrays(pa.array(rows[at].astype(np.float64).ravel()), width).cast(pa.list_(pa.float64()))], ["at", "used", "x"])

    parts = texts.mapInArrow(run, "at long, used long, x array<double>")
    total = parts.groupBy("at").agg(F.sum("used").alias("used"), F.array(*(F.sum(F.col("used") * F.get("x", F.lit(i))) for i in range(width))).alias("x"))
    flat = model.flat().astype(np.float64)
    for r in total.collect():  # one row for each vector of the model
        flat[r["at"]] = np.array(r["x"]) / r["used"]
    return Model.of(flat, s.classes)


def log_sums(spark, model: Model, s: Settings) -> np.ndarray:
    """The log of the sum over all classes after each pair of classes, by matrix products, shared out over tasks."""
    n = s.classes + 1
    sent = spark.sparkContext.broadcast(model.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(sent.value, s.classes)
        second = m.before * m.places[1]
        for batch in batches:
            for a in batch.column(0).to_pylist():
                score = (m.before[a] * m.places[0] + second) @ m.after.T + m.bias
                top = score.max(axis=1)
                sums = top + np.log(np.exp(score - top[:, None]).sum(axis=1, dtype=np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([sums.tolist()], pa.list_(pa.float64()))], ["a", "sums"])

    rows = spark.range(0, n, numPartitions=min(n, 16)).mapInArrow(run, "a long, sums array<double>").collect()
    return np.array([r["sums"] for r in sorted(rows)])


@dataclass
class Scorer:
    """A trained model: what tasks need to score texts, and the table of all counts for rare words."""

    words: Vocabulary
    model: Model
    sums: np.ndarray
    counts: DataFrame
    settings: Settings

    def log_class(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 of the classes' probabilities after a and b."""
        m = self.model
        out = np.empty(len(w))
        for i in range(0, len(w), 1 << 16):
            x, y, z = a[i : i + (1 << 16)], b[i : i + (1 << 16)], w[i : i + (1 << 16)]
            h = m.before[x] * m.places[0] + m.before[y] * m.places[1]
            out[i : i + (1 << 16)] = np.einsum("ij,ij->i", h, m.after[z], dtype=np.float64) + m.bias[z] - self.sums[x, y]
        return out / np.log(10)


def train(documents: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", settings: Settings = Settings()) -> Scorer:
    """Learns from all rows of documents."""
    s = settings
    spark = small_batches(documents.sparkSession)
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(s.seed)), F.lit(4 ** (s.rounds - 1)))
    texts = documents.select(F.col(text_col).cast("string").alias("text"), part.alias("part"))
    counts = word_counts(texts.select("text"), s.rest)
    words = Vocabulary(counts, s)
    model = start_model(words.share(), s)
    for i in range(s.rounds if words.total else 0):
        model = _learned(texts.where(F.col("part").between(4 ** (i - 1) if i else 0, 4**i - 1)).select("text"), words, model, s)
    return Scorer(words, model, log_sums(spark, model, s), counts, s)


def score(scorer: Scorer, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, n_known, train_tokens, base_score (log10 of the smoothed unigram shares), score (the model's log10 probability)."""
    spark, s, words = small_batches(documents.sparkSession), scorer.settings, scorer.words
    sent = spark.sparkContext.broadcast((words, scorer.model, scorer.sums, s))
    id_type = documents.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, n_known long, logs double, score double, rare array<struct<h:long,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Scorer(*sent.value[:3], None, sent.value[3])
        words, s = mine.words, mine.settings
        in_class = np.log10(words.class_count + 0.1 * (words.class_words + 1))
        for batch in batches:
            rows = len(batch)
            n_tokens, n_known, logs, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
            rare_row, rare_hash = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            reader = Reader(s.classes)
            for row, h, kind in tokens(batch.column(1), s.rest):
                w, c = words.look_up(h, kind)
                of_class = mine.log_class(*reader.before(row, w), w)
                known = np.log10(np.maximum(c, 0) + 0.1) * (c >= 0)
                many = w > s.words  # classes of many words; the words' own counts are added below and by the join
                n_tokens += np.bincount(row, minlength=rows)
                n_known += np.bincount(row[c > 0], minlength=rows)
                logs += np.bincount(row, weights=known, minlength=rows)
                total += np.bincount(row, weights=of_class + many * (known - in_class[w]), minlength=rows)
                rare_row.append(row[c < 0])
                rare_hash.append(h[c < 0])
            row, h = np.concatenate(rare_row), np.concatenate(rare_hash)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(new)
            pairs = pa.StructArray.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(row))))], ["h", "n"])
            bounds = np.append(0, np.cumsum(np.bincount(row[at], minlength=rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens), pa.array(n_known), pa.array(logs), pa.array(total), pa.ListArray.from_arrays(pa.array(bounds), pairs)], ["id", "n_tokens", "n_known", "logs", "score", "rare"])

    # written, so that the rows' numbers stay the same
    found = stash(documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = found.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.n").join(scorer.counts.select("h", "c"), "h", "left")
    c = F.coalesce("c", F.lit(0))
    summed = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.1)).alias("rare_logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    all_rows = found.drop("rare").join(summed, "row", "left")
    more = F.coalesce("rare_logs", F.lit(0.0))
    whole = float(np.log10(words.total + 0.1 * (words.distinct + 1)))
    return all_rows.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op11_lm_scores(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % Settings().held_out == 0
    scorer = train(documents.where(~held_out))
    return score(scorer, documents).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

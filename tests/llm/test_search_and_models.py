import hashlib
import random
import zlib
from collections import Counter
from math import floor, log, log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabprep.llm import centroids, lm, search, vec

DOCS = "doc_id long, text string, id string, m long, row long, h long, block long, key string"


def documents(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, "y") for i, t in rows], DOCS)


def prose(seed, n, longest=60):
    rng = random.Random(seed)
    words = [f"{'abcdefghij'[k % 10]}{k}" for k in range(80)]
    weights = [1 / (k + 1) for k in range(80)]
    return [" ".join(rng.choices(words, weights, k=rng.randrange(1, longest))) for _ in range(n)]


ODD = [(None, None), (7, ""), (8, " \t\n"), (1, "one two two"), (1, "one two two"), (2, "one two two"), (None, "Two, ONE"), (3, "ünï two"), (4, "two " * 40_000 + "x" * 70_000)]


# --- search


def own_terms(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        ch = ch.lower() if "A" <= ch <= "Z" else ch
        if ch.isascii() and not ch.isalnum():
            out += [word] * bool(word)
            word = ""
        else:
            word += ch
    return out


def brute_search(docs, items, top):
    held = [(i, Counter(own_terms(t))) for i, t in docs if own_terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        scored = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            scored.append((sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own_terms(text) if t in c), i))
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1]))[:top]
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(best)]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("z")).withColumn("score", F.lit(1))
    got = search.search(search.build_index(documents(spark, docs).repartition(3)), frame, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("block_terms", [200_000, 15])
def test_search_equals_brute_force(spark, block_terms):
    docs = [*enumerate(prose(1, 300)), *((1000 + i, t) for i, t in enumerate(prose(1, 30)))]  # copies, so that scores tie
    items = [*enumerate(prose(2, 12, 20)), (3, prose(2, 4, 20)[3]), (3, "a0 other"), (50, None), (51, "unheard"), (None, "b1 B1 c2")]
    assert found(spark, docs, items, block_terms=block_terms) == brute_search(docs, items, 10)


def test_search_visits_in_waves_and_skips(spark, monkeypatch):
    """Many strata of a part, and parts of a few texts, give the same."""
    docs = [(i, t) for i, t in enumerate(prose(3, 400, 300))]
    items = list(enumerate(prose(4, 6, 12)))
    want = brute_search(docs, items, 3)
    assert found(spark, docs, items, top=3) == want
    monkeypatch.setattr(search, "PART_BYTES", 1)
    assert found(spark, docs, items, top=3) == want


def test_search_bounds_leave_strata_unvisited():
    ids, n = pa.array(range(200)), 200
    row, term = search.terms(pa.array(["rare " + "often " * 3] + ["often " * (k + 1) for k in range(199)]))
    batch = search._strata(ids, row, term, n, len(row))
    asked = np.unique(term)
    part, best, visited = search._Part(batch, asked, np.where(np.bincount(np.searchsorted(asked, term)) == 1, 5000, 1)), search._Best(1), []
    add = best.add
    best.add = lambda score, *more: (visited.append(len(score)), add(score, *more))[1]
    part.search(np.arange(2), np.array([1, 1]), best)
    assert best.rows[0][1] == 0 and len(visited) == 1  # one wave of eight strata of about two hundred


def test_search_odd_rows(spark):
    items = [(0, "two"), (1, ""), (2, "ünï ÜNÏ"), (3, "x" * 70_000)]
    assert found(spark, ODD, items) == brute_search(ODD, items, 10)
    assert found(spark, [], items) == found(spark, ODD, []) == []


def test_search_takes_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "doc_id string, text string")
    got = search.search(search.build_index(docs), spark.createDataFrame([("q", "two")], "item_id string, text string"), top=3)
    assert [(r["rank"], r["doc_id"]) for r in got.orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]


# --- centroids


def brute_clusters(rows, k, rounds, dim, seed):
    kept = [(i, [floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(cs)):
            mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign())), key=str), cs


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, x int")


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(900 + i, [0.25] * 8) for i in range(20)] + [(3, rows[3][1]), (3, rows[5][1]), (None, rows[7][1]), (800, None), (801, [1.0] * 7), (802, [None] + [1.0] * 7), (803, [float("nan")] + [1.0] * 7), (804, [float("inf")] + [1.0] * 7)]
    got, cs = centroids.cluster(vectors(spark, rows).repartition(3), k=9, rounds=3, dim=8, seed=seed)
    want, want_cs = brute_clusters(rows, 9, 3, 8, seed)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and cs.tolist() == want_cs


def test_fewer_vectors_than_clusters_and_none(spark):
    got, cs = centroids.cluster(vectors(spark, [(5, [0.5, 1.0]), (5, [0.5, 1.0]), (6, [-1.0, 0.0])]), k=4, rounds=2, dim=2)
    assert len(cs) == 3 and {r.distance for r in got.collect()} == {0} and got.count() == 3
    got, cs = centroids.cluster(vectors(spark, []), dim=2)
    assert got.count() == 0 and len(cs) == 0


def test_nearest_is_exact_with_ties_and_far_values():
    rng = np.random.default_rng(4)
    for spread in (2, 300, centroids.FARTHEST):
        v, c = rng.integers(-spread, spread, (400, 16)), rng.integers(-spread, spread, (30, 16))
        c[7] = c[3]
        number, distance = centroids.nearest(v, c)
        want = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (number == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_scan_leaves_centroids_unmeasured(monkeypatch):
    measured = []
    real = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, *more, **kw: (measured.append(len(a)), real(how, a, *more, **kw))[1])
    rng = np.random.default_rng(5)
    centre = rng.integers(-500, 500, (40, 1)) + np.zeros((40, 64), np.int64)
    centroids.nearest(centre[rng.integers(0, 40, 1000)] + rng.integers(-3, 4, (1000, 64)), centre)
    assert sum(measured) - 1040 < 0.2 * 40 * 1000  # two calls are the deviations


def test_values_out_of_range_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(vectors(spark, [(1, [1e30, 0.0])]), dim=2)[0].count()


# --- language model

SMALL = lm.Settings(words=12, rest=5, known=20, size=8, noise=16, batch=64)


def own_tokens(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\v\f\r":
            out += [word] * bool(word)
            word = ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    return [*out, None]


@pytest.fixture(scope="module")
def learned(spark):
    rows = list(enumerate([*prose(6, 250), *prose(7, 50, 400)]))
    rows += ODD
    held = [r for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0]
    training = [r for r in rows if r not in held]
    scorer = lm.train(documents(spark, training).repartition(3), settings=SMALL)
    return rows, training, scorer, lm.score(scorer, documents(spark, rows))


def test_counts_and_base_scores_equal_plain_python(learned):
    rows, training, _, scores = learned
    c = Counter(t for _, text in training for t in own_tokens(text))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(own_tokens(t)), sum(c[x] > 0 for x in own_tokens(t)), n, round(sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own_tokens(t)), 4)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scores.collect()), key=str) == want


def plain_score(scorer, counts, text):
    """The model's log10 probability, summing over all classes after each pair of tokens."""
    s, m, words = scorer.settings, scorer.model, scorer.words
    before, total = [s.classes, s.classes], 0.0
    _, h, kind = (np.concatenate(x) for x in zip(*lm.tokens(pa.array([text]), s.rest)))
    for x, cls in zip(h, words.look_up(h, kind)[0]):
        state = m.before[before[0]].astype(float) * m.places[0] + m.before[before[1]].astype(float) * m.places[1]
        e = m.after.astype(float) @ state + m.bias
        total += (e[cls] - np.log(np.exp(e).sum())) / np.log(10)
        if cls > s.words:
            total += log10((counts.get(int(x.view(np.int64)), 0) + 0.1) / (words.class_count[cls] + 0.1 * (words.class_words[cls] + 1)))
        before = [before[1], cls]
    return total


def test_scores_equal_plain_sums_over_all_classes(learned):
    rows, _, scorer, scores = learned
    counts = {r.h: r.c for r in scorer.counts.collect()}
    got = {}
    for r in scores.collect():
        got.setdefault(r.doc_id, []).append(r.score)
    for i, text in [*rows[:60], (7, ""), (1, "one two two"), (3, "ünï two")]:
        assert any(abs(x - plain_score(scorer, counts, text)) < 1e-3 for x in got[i])


def test_probabilities_of_all_tokens_add_up_to_one(learned):
    _, training, scorer, _ = learned
    s, words = scorer.settings, scorer.words
    counts = {r.h: (r.c, r.kind) for r in scorer.counts.collect()}
    h = np.array(list(counts), np.int64).view(np.uint64)
    cls = words.look_up(h, np.array([k for _, k in counts.values()]))[0]
    inside = np.zeros(s.classes)
    for c, (n, _) in zip(cls, counts.values()):
        inside[c] += (n + 0.1) / (words.class_count[c] + 0.1 * (words.class_words[c] + 1)) if c > s.words else 1
    for c in range(s.words + 1, s.classes):
        inside[c] += 0.1 / (words.class_count[c] + 0.1 * (words.class_words[c] + 1))
    assert np.allclose(inside, 1)
    for a, b in [(s.classes, s.classes), (0, 3), (s.words, s.words + 2)]:
        w = np.arange(s.classes)
        assert abs((10 ** scorer.log_class(np.full(len(w), a), np.full(len(w), b), w)).sum() - 1) < 1e-4


def test_model_learns_what_follows_what(spark):
    """Held-out texts of a language whose words depend on the one before score better than by shares alone."""
    rng, rows = random.Random(8), []
    for i in range(400):
        w, out = rng.randrange(20), []
        for _ in range(60):
            w = (3 * w + rng.choice([1, 1, 1, 2])) % 20
            out.append(f"w{w}")
        rows.append((i, " ".join(out)))
    scorer = lm.train(documents(spark, rows[:360]), settings=lm.Settings(words=20, rest=3, size=16, noise=16, batch=128))
    got = lm.score(scorer, documents(spark, rows[360:])).agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.3


def test_training_again_gives_the_same(spark):
    docs = documents(spark, list(enumerate(prose(9, 60))))
    one, two = (lm.train(docs, settings=SMALL) for _ in range(2))
    assert (one.model.flat() == two.model.flat()).all()


def test_no_text_to_learn_from(spark):
    scorer = lm.train(documents(spark, []), settings=SMALL)
    got = lm.score(scorer, documents(spark, [(1, "one two"), (2, None)])).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)} and all(np.isfinite(r.score) and r.base_score == 0 for r in got)
    assert lm.score(scorer, documents(spark, [])).count() == 0


def test_stretches_cut_texts_between_words_only():
    text = ["ab cd " * 50, "", "x" * 300, " y", "z"]
    data, bounds = vec.text_bytes(pa.array(text))
    whole = [(s, e) for s, e in zip(*vec.runs(data, bounds, lm._KIND))]
    for size in (1, 7, 64, 10_000):
        parts = [(at + s, at + e) for at, start, end in vec.stretches(data, bounds, lm._KIND, size) for s, e in zip(start, end)]
        assert parts == whole

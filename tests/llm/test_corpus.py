import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabprep.llm import chat, decontaminate, importance, mixing, neardup, pii, repeats, rules, tokenfiles, warc
from tabprep.llm.native import row_key
from tabprep.llm.shared import hot_keys, shared_dir, spread_join

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, source string, count long, label string, key string"


def texts(seed, n, size):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=size)) for _ in range(n)]


def frame(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, s, 1, "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty and a very long text, ties and repeated rows."""
    long = " ".join(texts(1, 1, 30_000))
    return frame(spark, [(None, None, None), (1, "", "a"), (2, "one two", "a"), (2, "one two", "a"), (3, "one two", "b"), (4, long, "b"), (5, None, "c"), (None, "one two", None)]).cache()


#: Names that operators use inside.
CLASHING = ["_doc", "_text_key", "_copies", "_replica", "_place", "_id", "_key", "_row_key", "k", "n", "doc", "label", "_source", "_part", "_n"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents, some twice, with columns of such names."""
    rows = [(i % 9, t, "ab"[i % 2]) for i, t in enumerate([*texts(17, 8, 60), None, "", *texts(17, 4, 60)])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(f"own {c}") for c in CLASHING}).cache()


def unharmed(clashing, got):
    assert got.columns == clashing.columns
    assert {tuple(r[c] for c in CLASHING) for r in got.collect()} == {tuple(f"own {c}" for c in CLASHING)}


def test_columns_of_clashing_names_stay(spark, clashing, labels):
    items = spark.createDataFrame([(i, " ".join(t.split()[:12])) for i, t in enumerate(texts(17, 2, 60))], "item_id long, text string")
    unharmed(clashing, neardup.drop_near_duplicates(clashing))
    unharmed(clashing, mixing.mix_sources(clashing))
    for block in (10**9, 10):
        unharmed(clashing, decontaminate.decontaminate(clashing, items, block_windows=block))
    unharmed(clashing, importance.resample(clashing, labels))
    n = clashing.count()
    assert pii.find_pii(clashing).count() == rules.quality_rules(clashing).count() == repeats.remove_repeats(clashing).count() == neardup.near_duplicates(clashing).count() == n


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 6)] + [(None, 1)], "doc_id long, quality int")


def test_pii_kinds(spark):
    rows = [(0, "mail a@b.co x@y, a@b.c_d@e.fr 1.2.3.4 1.2.3.256 pay 4539578763621486 or 4539578763621487 or +1 (017) 555-7713"), (1, "account DE89370400440532013000 or call 415 555 1234, not 415 555 9999999"), (2, "é" * 3 + " q@é.fr z@w.fr.")]
    got = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["spans"]] for r in pii.find_pii(frame(spark, [(*r, "s") for r in rows])).collect()}
    assert got[0] == [("email", "a@b.co"), ("email", "a@b.c"), ("email", "_d@e.fr"), ("ip", "1.2.3.4"), ("card", "4539578763621486"), ("phone", "+1 (017) 555-7713")]
    assert got[1] == [("iban", "DE89370400440532013000"), ("phone_local", "415 555 1234")]
    assert got[2] == [("email", "z@w.fr")]


def test_pii_survives_hostile_texts(spark):
    rows = [(0, "a" * 200_000, "s"), (1, "a@b" + ".c" * 100_000, "s"), (2, "1 " * 50_000, "s"), (3, "+" + "1" * 100_000, "s")]
    got = {r["doc_id"]: len(r["spans"]) for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) for i in range(len(rows))}


def test_near_duplicates_equal_brute_force(spark):
    rng, rows = random.Random(5), []
    for base in texts(2, 12, 90):
        for _ in range(8):
            w = base.split()
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, [(*r, "s") for r in rows])).collect()}
    assert got == brute_components(rows)


def test_hot_groups_are_dealt_over_tasks_and_lose_nothing(spark, monkeypatch):
    """Exact copies, near copies of one text and empty texts, each many times the number of rows from which keys are hot here."""
    used = []

    def early(*a):
        found = hot_keys(*a, least=3)
        used.append((a[1], found is not None))
        return found

    monkeypatch.setattr(neardup, "hot_keys", early)
    rng, rows = random.Random(8), []
    one, two, three = texts(4, 3, 80)
    for i in range(25):
        w = two.split()
        w[rng.randrange(80)] = f"n{i}"
        rows += [one, " ".join(w), "", None]
    rows = list(enumerate([*rows, three, three + " end", one + " end"]))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, [(*r, "s") for r in rows])).collect()}
    assert got == brute_components(rows) and {("key", True), ("set_key", True)} <= set(used) and {("a", True), ("b", True)} & set(used)


def test_spread_join_equals_join(spark):
    many = spark.range(500).select(F.when(F.col("id") % 10 > 0, F.least(F.col("id") % 50, F.lit(20))).alias("k"), "id")
    one = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    counts = many.groupBy("k").count()
    hot = hot_keys(counts, "k", "count", 500, least=8)
    assert hot.count() > 0 and hot_keys(counts, "k", "count", 500) is None
    assert hot_keys(counts, "k", "count", 500, least=1, most=3).where("_copies > 1").count() == 1
    for how in ("inner", "left"):
        for h in (hot, None):
            assert sorted(map(str, spread_join(many, one, "k", h, "id", how).collect())) == sorted(map(str, many.join(one, "k", how).collect()))


def test_near_duplicates_odd(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_shingles"]) for r in got if r["doc_id"] != 4) == [(0, 0, 0), (0, 2, 1), (1, 1, 0), (2, 2, 1), (2, 2, 1), (3, 2, 1), (5, 5, 0)]
    assert neardup.drop_near_duplicates(odd).where("text = 'one two'").count() == 1
    assert neardup.near_duplicates(none).count() == 0


def test_one_of_each_component_with_repeated_and_null_ids(spark):
    one, two, three = texts(11, 3, 90)
    near = [f"{t} {w}" for t in (one, two, three) for w in ("x", "y z", "")]
    rows = list(zip([7, 7, 9, None, None, None, None, 5, 5], near, ["s"] * 9, strict=True)) + [(7, one[:200], "s"), (None, "", "s"), (None, None, "s"), (8, "", "s")]
    got = neardup.drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 5, 7, 7, 8]
    assert [sum((r["text"] or "").startswith(t) for r in got) for t in (one, two, three)] == [1, 1, 1]


@pytest.mark.parametrize("block", [200_000, 30])
def test_decontamination(spark, odd, none, block):
    item = " ".join(f"b{i}" for i in range(25))
    items = spark.createDataFrame([("q1", item), ("q2", "solo"), ("q3", None), (None, "b1 b2 b3")], "item_id string, text string")
    docs = frame(spark, [(1, "x, B0 b1 b2 b3 b4 b5 b6 b7 b8; b9 y", "s"), (2, "b0 b1 b2 b3 b4", "s"), (3, "clean text", "s"), (4, "solo", "s"), (5, None, "s")])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontaminate.contamination(docs, items, block_windows=block).collect()}
    assert got == {1: (12, 10, ["", "q1"]), 2: (5, 3, [""]), 3: (2, 0, []), 4: (1, 1, ["q2"]), 5: (0, 0, [])}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items, block_windows=block).collect()) == [3, 5]
    assert decontaminate.decontaminate(odd, items).count() == 8 and decontaminate.decontaminate(none, items).count() == 0


def test_decontamination_in_blocks_and_with_two_benchmarks_in_one_session(spark):
    """What Python workers hold of one block or benchmark must not answer for another."""
    rng = random.Random(12)
    parts = texts(13, 40, 30)
    rows = [(i, " ".join(rng.choices(WORDS, k=20)) + " " + " ".join(parts[rng.randrange(40)].split()[rng.randrange(12) :]), "s") for i in range(60)] + [(None, parts[0], "s"), (None, parts[0], "s")]
    docs = frame(spark, rows).repartition(4)
    long = spark.createDataFrame([(i, t) for i, t in enumerate([*parts[:20], " ".join(rng.choices(WORDS, k=50_000)), "one", None])], "item_id long, text string")
    other = spark.createDataFrame(list(enumerate(parts[20:])), "item_id long, text string")

    def told(items, block):
        return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], [tuple(x) for x in r["spans"]], r["items"]) for r in decontaminate.contamination(docs, items, block_windows=block).collect())

    def brute(items):
        windows = {}
        for name, text in items:
            w = (text or "").split()
            n = min(10, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
        out = []
        for i, t, _ in rows:
            w = t.split()
            found = [(k, k + n, windows[tuple(w[k : k + n])]) for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows]
            hit = {p for a, b, _ in found for p in range(a, b)}
            out.append((-1 if i is None else i, len(w), len(hit), sorted(set().union(*(x for _, _, x in found)))))
        return sorted(out)

    for items, small in ((long, 8_000), (other, 60)):
        want = brute([tuple(r) for r in items.collect()])
        for block in (10**9, small):
            got = told(items, block)
            assert [(a, b, c, e) for a, b, c, _, e in got] == want
            clean = decontaminate.decontaminate(docs, items, block_windows=block)
            assert clean.columns == docs.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in want if not r[2])
    assert told(other, 60) == told(other, 10**9) != told(long, 10**9)


def test_repeats_equal_brute_force(spark, odd, none):
    rng = random.Random(3)
    parts = texts(4, 8, 120)
    docs = [(i, " ".join(rng.choices(parts, k=2))[rng.randrange(200) :]) for i in range(30)] + [(30, "ab" * 3000), (31, None), (32, "é" * 700), (33, parts[0]), (34, parts[0])]
    want = repeats.brute_force([(t or "").encode() for _, t in docs], 400)
    for group in (4000, 3):
        got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in repeats.remove_repeats(frame(spark, [(*d, "s") for d in docs]), group=group).collect()}
        assert [got[i] for i, _ in docs] == want
    assert repeats.remove_repeats(odd).count() == 8 and repeats.remove_repeats(none).count() == 0


def test_shared_passages_equal_brute_force(spark, odd, none):
    rng = random.Random(23)
    parts = texts(24, 6, 30)
    docs = [(i, rng.choice(["", "\n"]).join(f"{t}  " for t in rng.choices(parts, k=3))[rng.randrange(60) : -rng.randrange(1, 60)]) for i in range(30)]
    docs += [(40, "a " * 90), (41, "b\t" * 40), (42, None), (43, " ".join(WORDS[:9])), (44, parts[0]), (45, parts[0]), (46, f"{parts[1]} {parts[1]}"), (47, "a " * 20 + "c"), (48, "é ü " * 9), (49, "é ü " * 30)]
    for words in (9, 20):
        where = {}
        for d, t in docs:
            w = (t or "").split()
            for k in range(len(w) - words + 1):
                where.setdefault(tuple(w[k : k + words]), set()).add(d)
        want = {}
        for d, t in docs:
            w = (t or "").split()
            hit = {p for k in range(len(w) - words + 1) if len(where[tuple(w[k : k + words])]) > 1 for p in range(k, k + words)}
            want[d] = sorted(hit)
        got = {r["doc_id"]: [p for s, e in r["passages"] for p in range(s, e)] for r in repeats.remove_repeats(frame(spark, [(*d, "s") for d in docs]).repartition(5), words=words).collect()}
        assert got == want and not all(want.values())
    assert repeats.remove_repeats(odd, words=51).count() == 8 and repeats.remove_repeats(none, words=51).count() == 0


def test_word_segments_do_not_depend_on_the_batch():
    import pyarrow as pa

    docs = [*texts(28, 60, 5_000), *texts(29, 1, 300_000)]
    told = lambda some: [x for *c, _, _ in repeats.word_segments(pa.array(some), 51) for x in zip(*(a.tolist() for a in c[1:]), strict=True)]
    assert told(docs) == [x for t in docs for x in told([t])]


def test_op8_tells_passages_that_the_rule_of_bytes_leaves(spark, tmp_path):
    own = texts(25, 8, 90)
    short = " ".join(texts(26, 1, 55))
    assert len(short) < 400
    docs = [(i, f"{t} {short} {own[i - 1]}" if i < 4 else t, "s") for i, t in enumerate(own)]
    docs[1] = (1, f"x {short} y", "s")
    docs[3:] = [(i + 3, t, "s") for i, t in enumerate(texts(27, 4, 90))]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in repeats.op8_repeats(spark, str(tmp_path)).collect()}
    assert [got[i]["shares_passage"] for i, *_ in docs] == [True] * 3 + [False] * 4
    assert [got[i]["n_passage_words"] for i in range(3)] == [55] * 3
    for i, t, _ in docs:  # what the contract removes is as before
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest())


def brute_groups(docs, least):
    """Occurrences of each maximal repeat, by growing every repeated string to the right until its occurrences part."""
    texts_of = [(t or "").encode() for _, t in docs]
    found, level = {}, {}
    for d, t in enumerate(texts_of):
        for i in range(len(t) - least + 1):
            level.setdefault(t[i : i + least], []).append((d, i))
    level = [(least, v) for v in level.values() if len(v) > 1]
    while level:
        longer = []
        for n, at in level:
            after = {}
            for d, i in at:
                after.setdefault(texts_of[d][i + n : i + n + 1] or (d, i), []).append((d, i))
            before = {texts_of[d][i - 1] if i else (d, i) for d, i in at}
            if len(after) > 1 and len(before) > 1:
                d, i = at[0]
                found[texts_of[d][i : i + n]] = sorted((docs[d][0], i, i + n) for d, i in at)
            longer += [(n + 1, v) for v in after.values() if len(v) > 1]
        level = longer
    return found


@pytest.mark.parametrize("group", [4000, 3])
def test_repeat_groups_equal_brute_force(spark, none, group):
    rng = random.Random(7)
    parts = texts(5, 5, 40)
    docs = [(i, " ".join(rng.choices(parts, k=3))[rng.randrange(30) :]) for i in range(14)] + [(20, "ab" * 60), (21, None), (22, "é" * 60), (23, parts[0]), (24, parts[0])]
    docs += [(30 + i, f"{i}<{parts[1]}|{i * 7}") for i in range(30)]
    # copies that only share their whole text, copies that also begin like others, and one that ends where others go on
    alone, begun = texts(6, 2, 150)
    docs += [(70, alone), (71, alone), (72, f"x{begun}"), (73, f"y{begun}"), (74, begun[:500]), (75, begun[:700] + "!")]
    want = brute_groups(docs, 80)
    got = {}
    for r in repeats.repeat_groups(frame(spark, [(*d, "s") for d in docs]).repartition(5), least=80, group=group).collect():
        got.setdefault((bytes(r["repeat"]), r["n_bytes"], r["occurrences"]), []).append((r["doc_id"], r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {(xxhash.xxh3_128_digest(t), len(t), len(v)): v for t, v in want.items()}
    assert max(len(v) for v in want.values()) > 30
    assert repeats.repeat_groups(none).count() == 0


def test_token_files(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = [(i, t, "s") for i, t in enumerate(["it's, a. b", "a\n\nb  c", " lead", "tab\there é, ü.", "x y", "ends ", "A.B,c...", "don't,won't", "\n", "word\nnext, line. 'S", "a<|endoftext|>b c", "<|endoftext|>", "a <|endoftext|> <|endoftext"])]
    folder = tokenfiles.write_tokens(frame(spark, rows), path, shards=3)
    got, files, at = {r["doc_id"]: r for r in tokenfiles.read_tokens(spark, folder).collect()}, tokenfiles.TokenFiles(folder), 0
    for i, t, _ in rows:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert [x.tolist() for x in files.get(i)] == [ids.tolist()]
        at += len(ids)
    assert [files.get(k) for k in (99, -1)] == [[], []]
    whole.encode_special_tokens = True
    plain = tokenfiles.TokenFiles(tokenfiles.write_tokens(frame(spark, rows), path, shards=2, special_as_text=True))
    assert [plain.get(i)[0].tolist() for i, _, _ in rows] == [[*whole.encode(t, add_special_tokens=False).ids, 0] for _, t, _ in rows]
    folder = tokenfiles.write_tokens(odd, path)
    assert tokenfiles.read_tokens(spark, folder).count() == 8 and len(tokenfiles.TokenFiles(folder).get(2)) == 2
    assert tokenfiles.read_tokens(spark, tokenfiles.write_tokens(none, path)).count() == 0


def test_runs_of_equal_hashes_are_told_apart(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, docs = Tokenizer.from_file(path), texts(14, 30, 50) + ["w1 w22 w333", "", "x"]
    real = tokenfiles.vec.span_hashes
    monkeypatch.setattr(tokenfiles.vec, "span_hashes", lambda *a: real(*a) % tokenfiles.vec.U(90))
    encoder = tokenfiles.Encoder(path)
    for some in (docs[:10], docs[10:], docs):
        assert [x.tolist() for x in encoder.encode(pa.array(some))] == [whole.encode(t, add_special_tokens=False).ids for t in some]


def test_shards_are_read_in_parts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(15)
    rows = [(rng.randrange(-(2**62), 2**62), t, "s") for t in texts(16, 3_000, 8)] + [(7, "seven", "s")] * 3
    folder = tokenfiles.write_tokens(frame(spark, rows), path, shards=3)
    files = tokenfiles.TokenFiles(folder)
    for i, t, _ in rows[:3_000:100]:
        assert len(files.get(i)) == 1 and files.get(i + 1) == []
    assert len(files.get(7)) == 3
    for s in files.open.values():
        table = s.rows(0, s.footer["docs"])
        parts = list(s.stream(table, 1_000))
        assert [x.tolist() for x in parts] == [s.ids(r).tolist() for r in table]


def test_index_is_perfect():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000, np.uint64))
    levels, slots = tokenfiles.build_index(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (tokenfiles.find_slots(levels, [np.cumsum(x) for x in levels], keys) == slots).all()


def test_rules(spark, odd, none):
    good = texts(6, 40, 80)
    rows = [(i, t, "good") for i, t in enumerate(good)] + [(100 + i, f"word{i}", "bad") for i in range(40)] + [(200, good[0], "bad")]
    got = {r["doc_id"]: r for r in rules.quality_rules(frame(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(40)) and not got[200]["base_failed"] and not got[200]["kept"]
    one = rules.document_rules(frame(spark, [(1, "a b c d a b c\nx #\nx #\n", "s"), (2, None, None)])).orderBy("doc_id").collect()
    assert (one[0]["n_words"], one[0]["word_chars"], one[0]["n_symbols"], one[0]["n_dup_lines"], one[0]["n_repeat_words"]) == (11, 11, 2, 1, 6)
    assert rules.quality_rules(odd).count() == 8 and rules.quality_rules(none).count() == 0


def test_pii_odd(odd, none):
    got = pii.find_pii(odd).collect()
    assert len(got) == 8 and all(r["spans"] == [] for r in got) and pii.find_pii(none).count() == 0


def test_chat_odd(spark):
    """A very long text, repeated rows, equal turns and columns of clashing names."""
    long = "</turn>\n### assistant: \\" * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "x"), (2, 0, "user", "x"), (2, 0, "user", "w"), (2, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("_id", "_row", "_turns", "_plain", "formatted", "turns", "loss_spans")})
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [long, long] and len(got[1]["loss_spans"]) == 1
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("assistant", "first"), ("user", "w"), ("user", "x"), ("user", "x")]


def test_chat(spark):
    rows = [(1, 0, "user", "\\### a: </turn>\n### assistant: x</turn>"), (1, 1, "assistant", "\\"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 0, "a:b\n", "</turn"), (None, None, "assistant", "z")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for k in (1, 2, 3, None):
        assert [(t["role"], t["text"]) for t in got[k]["turns"]] == [(r or "", t or "") for c, _, r, t in rows if c == k]
    assert got[1]["formatted"].startswith(chat.ESCAPED) and got[2]["formatted"].startswith(chat.PLAIN)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_warc(spark, packed):
    body = "<p>" + "x" * 1200
    rows = [(1, "http://a/é b", body), (2, None, body), (3, "http://c", "short"), (4, "http://d", "short"), (5, "u", None), (None, "n", "WARC/1.1\r\n\r\n")]
    folder = f"{shared_dir(spark)}/w"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, compress=packed)
    back = warc.read_warc(spark, folder, payload=True)
    got = {r["page_id"]: r for r in back.collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[1]["payload_bytes"], got[1]["url"]) == ("revisit", 2, 1203, "http://a/é%20b")
    assert got[2]["payload"] == body.encode() and got[3]["record_type"] == got[4]["record_type"] == "response" and got[5]["payload_bytes"] == 0
    assert got[None]["payload_digest"] == hashlib.sha1(b"WARC/1.1\r\n\r\n").hexdigest()
    assert [r["page_id"] for r in back.where("record_type = 'revisit' and page_id > 0").collect()] == [1]
    empty = f"{shared_dir(spark)}/w"
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_odd(spark):
    """A very long page, repeated rows and columns of clashing names; readers skip the payloads that nobody asks for."""
    long = "<p>" + "é" * 1_500_000
    rows = [(1, "u1", long), (2, "u2", long), (2, "u2", long), (3, "u3", "x" * 5_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "_digest", "_latest", "_n")})
    folder = f"{shared_dir(spark)}/w"
    warc.write_warc(df, folder)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc.read_warc(spark, folder).collect())
    assert got == [(1, "revisit", 2, 3_000_003), (2, "response", 0, 3_000_003), (2, "response", 0, 3_000_003), (3, "response", 0, 5_000)]
    read = warc.WarcReader(warc.WarcSource({"path": folder}).schema() and warc.read_warc(spark, folder).schema, {"path": folder})
    assert list(read.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == [] and [f[0] for f in read.filters] == ["record_type"]
    rows_read = [r for p in read.partitions() for b in read.read(p) for r in b.to_pylist()]
    assert [(r["page_id"], "payload" in r) for r in rows_read] == [(1, False)]


def test_mixing(spark, odd, none):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 15_000, "big").otherwise("small").alias("source"))
    counts = {r[0]: r[1] for r in mixing.mix_sources(docs, {"big": 1, "small": 3}).groupBy("source").count().collect()}
    assert abs(counts["big"] - 5_000) < 300 and abs(counts["small"] - 15_000) < 500
    assert mixing.mix_sources(docs, {"big": 1, "other": 5}).where("source = 'small'").count() == 0
    assert mixing.mix_sources(docs.limit(5), {"big": 1}, size=5 * 900).count() > 4_000
    assert mixing.mix_sources(odd).columns == odd.columns and mixing.mix_sources(none).count() == 0


def test_importance(spark, odd, none, labels):
    rows = [(i, t if i % 4 else t.upper().replace(" ", "!! "), "s") for i, t in enumerate(texts(9, 400, 60))]
    some = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    got = importance.importance_scores(frame(spark, rows), some).where("doc_id >= 200").collect()
    assert sum(r["kept"] == (r["doc_id"] % 4 > 0) for r in got) >= 198
    assert importance.resample(frame(spark, rows), some).columns == odd.columns
    assert importance.importance_scores(odd, labels).count() == 8 and importance.resample(none, labels).count() == 0
    values = spark.range(20_000).select((F.hash("id") % 1000).cast("double").alias("v"))
    assert importance.kth_largest(values, "v", 777) == sorted((r[0] for r in values.collect()), reverse=True)[776]


def test_importance_equals_plain_python(spark):
    """Counts, scores, noise and choice by loops over words."""
    import math
    import re

    vec, buckets, seed, U = importance.vec, 500, 3, 2**64
    docs = [(i, " ".join(random.Random(i).choices(WORDS[: 40 + 9 * (i % 3)], k=30 + i)) + ("! Z." if i % 4 == 0 else ""), "s") for i in range(90)] + [(200, None, "s"), (201, " \n", "s")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")

    def mixed(x):
        for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * k % U
        return x ^ (x >> 33)

    def hashed(token):
        return mixed(sum((b + 1) * pow(vec._B, i, U) for i, b in enumerate(token)) % U)

    def places(text):
        t = [hashed(x) for x in re.findall(rb"[a-z0-9\x80-\xff\x00-\x08\x0e-\x1f\x7f]+|[!-/:-@\[-`{-~]+", (text or "").lower().encode())]
        return [x % buckets for x in t] + [mixed((a * 0xD6E8FEB86659FD93 + b) % U) % buckets for a, b in zip(t, t[1:])]

    raw, target = [1] * buckets, [1] * buckets
    for i, t, _ in docs:
        for p in places(t):
            raw[p] += 1
            target[p] += i < 60 and i % 3 > 0
    model = [math.log(a / sum(target)) - math.log(b / sum(raw)) for a, b in zip(target, raw)]
    mean = {i: sum(model[p] for p in places(t)) / len(places(t)) if places(t) else -100.0 for i, t, _ in docs}
    noise = {i: -math.log(-math.log(((mixed(hashed(str(i).encode()) ^ seed) >> 12) + 0.5) / 2**52)) for i in mean}
    got = {r["doc_id"]: r for r in importance.importance_scores(frame(spark, docs).repartition(3), labels, buckets=buckets, seed=seed).collect()}
    assert all(got[i]["mean_log_ratio"] == pytest.approx(mean[i], abs=1e-9) for i in mean)
    sharp = (got[1]["sampling_key"] - noise[1]) / mean[1]  # fitted: equal for all, and the draw swaps about the share asked for
    assert all(got[i]["sampling_key"] == pytest.approx(mean[i] * sharp + noise[i], rel=1e-6, abs=1e-6) for i in mean)
    bins = {i: math.floor(mean[i] / importance.STEP) for i in range(60)}
    n_good, n_bad = sum(i % 3 > 0 for i in bins), sum(i % 3 == 0 for i in bins)

    def told(b):
        return importance.GOOD_COUNTS * sum(x >= b for i, x in bins.items() if i % 3) / n_good - sum(x >= b for i, x in bins.items() if i % 3 == 0) / n_bad

    best = max(sorted(set(bins.values())), key=lambda b: (told(b), -b))
    below = max((x for x in bins.values() if x < best), default=best - 1)
    k = sum(m >= (best + below + 1) / 2 * importance.STEP for m in mean.values())
    keys = sorted((r["sampling_key"] for r in got.values()), reverse=True)
    assert 0 < k < len(docs) and {i for i, r in got.items() if r["kept"]} == {i for i, r in got.items() if r["sampling_key"] >= keys[k - 1]}


def test_importance_draws_by_weight():
    """Over many seeds, a document is the first of the draw as often as its weight says."""
    import pyarrow as pa

    log_weight = np.log(np.array([1.0, 2.0, 5.0, 12.0]))
    first = [int(np.argmax(log_weight + importance.gumbel(pa.array([7, 8, 9, 10]), seed))) for seed in range(4_000)]
    assert np.abs(np.bincount(first, minlength=4) / 4_000 - np.array([1, 2, 5, 12]) / 20).max() < 0.03


def test_importance_swaps_the_share_asked_for(spark):
    """Seeds give different samples; over 40 of them, documents below the cut get about the share of places that was asked for."""
    rng = np.random.default_rng(3)
    mean = np.concatenate([rng.normal(0.03, 0.02, 900), rng.normal(-0.06, 0.03, 300), [-100.0]])
    scores = spark.createDataFrame([(i, float(m)) for i, m in enumerate(mean)], "id long, mean double")
    k = int((mean >= 0).sum())
    import pyarrow as pa

    for chance in (0.02, 0.1):
        sharp = importance._sharpness(scores, k, 0.0, chance)
        kept = [set(np.argsort(-(mean * sharp + importance.gumbel(pa.array(np.arange(len(mean))), seed)))[:k].tolist()) for seed in range(40)]
        swapped = np.mean([np.mean([mean[i] < 0 for i in s]) for s in kept])
        assert chance * 0.8 < swapped < chance * 1.3 and len({frozenset(s) for s in kept}) == 40
        often = np.bincount([i for s in kept for i in s], minlength=len(mean)) / 40
        assert often[mean > 0.03].mean() > 0.95 > often[(mean < 0) & (mean > -100)].mean() and often[-1] == 0
    assert importance._sharpness(scores.where("mean >= 0"), k, 0.0, 0.1) == importance.MOST_SHARP


def test_row_keys_tell_ids_and_texts_apart(spark):
    """Ids that hold colons: the parts of an id and a text can't be taken for another id and text."""
    long = " ".join(texts(31, 1, 200))
    rows = [("a", "b:" + long), ("a:b", long), (None, long), ("null", long), ("-1", "" + long), ("", "-1:" + long)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert docs.select(row_key("doc_id", "text").alias("k")).distinct().count() == len(rows)
    removed = [(r["doc_id"], sum(s["end"] - s["start"] for s in r["spans"]), r["n_bytes"]) for r in repeats.remove_repeats(docs).collect()]
    want = {i: sum(b - a for a, b in x) for (i, _), x in zip(rows, repeats.brute_force([t.encode() for _, t in rows], 400), strict=True)}
    assert sorted(removed, key=str) == sorted(((i, want[i], len(t.encode())) for i, t in rows), key=str)
    words = long.split()
    items = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 12])) for i in range(12)], "item_id long, text string")
    whole = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in decontaminate.contamination(docs, items).collect()}
    parts = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in decontaminate.contamination(docs, items, block_windows=30).collect()}
    assert whole == parts and len(whole) == len(rows)


def test_equal_items_make_one_block(spark):
    item = " ".join(texts(32, 1, 14))
    items = spark.createDataFrame([(1, item)] * 3_000 + [(2, "solo")], "item_id long, text string")
    assert len(decontaminate._blocks(items, "item_id", "text", 10, 1_000)) == 1
    many = spark.createDataFrame([(i, t) for i, t in enumerate(texts(33, 300, 20))], "item_id long, text string")
    blocks = decontaminate._blocks(many, "item_id", "text", 10, 500)
    assert 12 <= len(blocks) <= 13 and sum(b.count() for b in blocks) == 300 and max(b.count() for b in blocks) <= 26
    docs = frame(spark, [(1, "x " + item + " y solo", "s"), (2, "clean", "s")])
    assert [(r["doc_id"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, items, block_windows=10).orderBy("doc_id").collect()] == [(1, 15, ["1", "2"]), (2, 0, [])]

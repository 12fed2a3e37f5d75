"""The whole pipeline on the smallest tables, against plain Python for every stage after the fitted one."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def without_near_duplicates(docs):
    rows = sorted(docs.items())
    sets, up = [shingles(t) for _, (t, _) in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {k: v for i, (k, v) in enumerate(rows) if root(i) == i}


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def without_benchmark(docs, items):
    windows = defaultdict(set)
    for text in items:
        w = benchmark_words(text)
        n = min(len(w), 10)
        if n:
            windows[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def clean(text):
        w = benchmark_words(text)
        return not any(tuple(w[i : i + n]) in known for n, known in windows.items() for i in range(len(w) - n + 1))

    return {k: v for k, v in docs.items() if clean(v[0])}


def copies(docs):
    of = Counter(s for _, s in docs.values())
    out = {}
    for k, (_, source) in docs.items():
        rate = len(docs) / len(of) / of[source]
        u = (int(hashlib.md5(f"1:{k}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p = 0, math.exp(-rate)
        total = p
        while total < u:
            n += 1
            p *= rate / n
            total += p
        out[k] = n
    return out


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the small tables")
def test_pipeline_equals_brute_force(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_passages", "mixture", "token_files"]
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.quality(spark, documents, FOLDER)
    assert kept.columns == documents.columns
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in kept.collect()}
    assert 0 < len(docs) < documents.count()
    docs = without_near_duplicates(docs)
    docs = without_benchmark(docs, [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    tokenizer, want, start = Tokenizer.from_file(str(public.path("byte_bpe_50k.json"))), [], 0
    drawn = copies(docs)
    for k in sorted(docs):
        ids = [*tokenizer.encode(docs[k][0] or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        for _ in range(drawn[k]):
            want.append((k, start, len(ids), crc))
            start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == want
    assert len(want) > 10

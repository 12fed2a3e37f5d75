"""Token ids of documents in binary shards, with a minimal perfect hash index for access by key.

Documents are dealt into shards by ranges of their id and encoded in ascending order. A shard file is

* payload: the raw ids of all documents, little-endian, 16 bits each if the vocabulary allows, else 32;
* a row for each document: key (int64), start within the shard and number of ids (both uint64), and whether the key is null;
* per distinct key: a minimal perfect hash (levels of bits: a key is placed on the first level where it is alone, its slot is the
  number of bits before it; bits are kept in blocks of 512, each with the number of bits before it), and in the slot a 32-bit
  fingerprint, the first document of the key and how many follow;
* a JSON footer that says where each part starts, and how large the levels are; its length, and a magic number.

A shard is opened by reading its footer. Looking a key up then reads one block of a few levels, one slot, one row and one range of the
payload: constant time, whatever the number of documents. A fingerprint that differs, or the stored key, rejects keys that aren't there.
The manifest lists the shards in the order of their keys, with first positions; a key's shards are found by bisection. Tasks name their
files anew for each attempt, and the manifest has those of successful ones only.

Encoding looks up runs of characters between blanks in a table of what the tokenizer has given for them. Runs are found by 64-bit
hashes and compared byte by byte. A text whose white space could make tokens reach across such runs, that holds the string of an added
token, or of whose runs one shares its hash with another, goes to the tokenizer as a whole.

Defined results: a null or empty text is the end id alone; null keys come first and can't be looked up; repeated keys are documents of
their own, within a shard in order of their texts, over shards of those texts' hashes; strings of special tokens give those tokens, as the tokenizers library has it, or are ordinary text with
``special_as_text``; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .files import reader, writer
from .shared import shared_dir, small_batches, worker_cache

MAGIC = b"TPTOKEN2"
_SEED = 0x5851F42D4C957F2D
_ROW = np.dtype([("key", "<i8"), ("start", "<u8"), ("n", "<u8"), ("null", "u1")])
_SLOT = np.dtype([("print", "<u4"), ("row", "<u4"), ("more", "<u4")])
#: 512 bits of a level, and how many bits are set in those before.
_BLOCK = np.dtype([("before", "<u8"), ("bits", "u1", (64,))])

# ---------------------------------------------------------------- index


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (vec.mix(keys ^ vec.U(_SEED * (level + 1) % 2**64)) % vec.U(size)).astype(np.int64)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (vec.mix(keys * vec.U(0xD6E8FEB86659FD93) + vec.U(1)) >> vec.U(32)).astype(np.uint32)


def build_index(keys: np.ndarray, spread: float = 2.0) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits for distinct uint64 keys, and each key's slot."""
    levels, slots, rest, first = [], np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while len(rest):
        size = max(64, int(spread * len(rest)))
        at = _place(keys[rest], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rank = np.cumsum(alone) - 1
        here = alone[at]
        slots[rest[here]] = first + rank[at[here]]
        first += int(alone.sum())
        rest = rest[~here]
    return levels, slots


def find_slots(levels: list[np.ndarray], ranks: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Each key's slot; -1 if no level has it."""
    out, rest, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for i, (bits, rank) in enumerate(zip(levels, ranks, strict=True)):
        at = _place(keys[rest], i, len(bits))
        here = bits[at]
        out[rest[here]] = first + rank[at[here]] - 1
        first += int(rank[-1]) if len(rank) else 0
        rest = rest[~here]
    return out


def _blocks_of(bits: np.ndarray) -> np.ndarray:
    """A level as it is stored."""
    packed = np.packbits(bits)
    out = np.zeros(-(-len(packed) // 64), _BLOCK)
    out["bits"] = np.pad(packed, (0, len(out) * 64 - len(packed))).reshape(-1, 64)
    ones = np.bitwise_count(out["bits"]).sum(axis=1, dtype=np.uint64)
    out["before"] = np.cumsum(ones) - ones
    return out


# ---------------------------------------------------------------- encoding


class Encoder:
    """Encodes texts with a tokenizer file, remembering what it gave for the runs that it has seen."""

    #: Forgets all beyond so many runs, or so many bytes of them.
    MOST, MOST_BYTES = 1_500_000, 24 << 20
    #: Texts or runs that the tokenizer gets at once: its answers take much more memory than ids.
    AT_ONCE = 2_000

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        # without special_as_text strings of special tokens are looked for, and those of other added tokens in any case
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if not (t.special and special_as_text)]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        """Of each run its hash, and where its ids and bytes are kept."""
        self.keys, self.ids, self.bytes = np.zeros(0, vec.U), np.zeros(0, self.type), np.zeros(0, np.uint8)
        self.at, self.n, self.from_, self.size = (np.zeros(0, np.int32) for _ in range(4))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def _learn(self, keys: np.ndarray, runs: list[bytes]) -> None:
        n, flat = np.zeros(len(runs), np.int64), []
        for i in range(0, len(runs), self.AT_ONCE):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([r.decode() for r in runs[i : i + self.AT_ONCE]], add_special_tokens=False)]
            n[i : i + len(got)] = [len(x) for x in got]
            flat.append(np.fromiter(chain.from_iterable(got), self.type, int(n[i : i + len(got)].sum())))
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        at, from_ = len(self.ids) + np.cumsum(n) - n, len(self.bytes) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *flat])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(runs), np.uint8)])
        to = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, to, keys), np.insert(self.at, to, at), np.insert(self.n, to, n)
        self.from_, self.size = np.insert(self.from_, to, from_), np.insert(self.size, to, size)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        data, bounds = vec.text_bytes(column)
        for lo, hi in vec.pieces(bounds, 1 << 20):
            part, own = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
            odd = _odd_rows(part, own)
            raw = part.tobytes()
            for token in self.added:
                found = raw.find(token)
                while found >= 0:
                    odd[np.searchsorted(own, found, "right") - 1] = True
                    found = raw.find(token, found + 1)
            start = _run_starts(part, own)
            end = np.append(start[1:], len(part))
            row = vec.rows_of(start, own)
            keep = ~odd[row]
            start, end, row = start[keep], end[keep], row[keep]
            hashes, first, back = np.unique(vec.span_hashes(vec.prefix_sums(part), start, end), return_index=True, return_inverse=True)
            if len(self.keys) + len(hashes) > self.MOST or len(self.bytes) > self.MOST_BYTES:
                self.forget()
            to = np.searchsorted(self.keys, hashes)
            known = self.keys[np.minimum(to, len(self.keys) - 1)] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
            if not known.all():
                new = first[~known]
                self._learn(hashes[~known], [raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
                to = np.searchsorted(self.keys, hashes)
            false = self._false(part, start, end, to[back])
            if len(false):
                odd[row[false]] = True
                keep = ~odd[row]
                row, back = row[keep], back[keep]
            n = self.n[to][back]
            total = np.cumsum(n)
            ids = self.ids[np.repeat(self.at[to][back] - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, weights=n, minlength=hi - lo).astype(np.int64))]).tolist()
            for r in range(hi - lo):
                yield self.whole(raw[own[r] : own[r + 1]].decode()) if odd[r] else ids[cut[r] : cut[r + 1]]

    def _false(self, part: np.ndarray, start: np.ndarray, end: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The runs that aren't those known by the same hash."""
        n = end - start
        other = self.size[to] != n
        out = [np.flatnonzero(other)] if other.any() else []
        same = np.flatnonzero(~other)
        a, b, n = start[same], self.from_[to[same]], n[same]
        before = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        differ = np.flatnonzero(part[np.repeat(a - before, n) + step] != self.bytes[np.repeat(b - before, n) + step])
        if len(differ):
            out.append(same[np.unique(np.searchsorted(before, differ, "right") - 1)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _odd_rows(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows with white space other than single blanks and line ends between other characters."""
    out = np.zeros(len(bounds) - 1, bool)
    if not len(data):
        return out
    blank = (data == 32) | (data == 10)
    bad = ((data >= 9) & (data <= 13) & (data != 10)) | ((data >= 28) & (data <= 31))
    bad[1:] |= blank[1:] & blank[:-1]
    two, three = (data[:-1].astype(np.uint16) << 8) | data[1:], data[2:]
    bad[:-1] |= (two == 0xC285) | (two == 0xC2A0)
    bad[:-2] |= ((two[:-1] == 0xE280) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))) | ((two[:-1] == 0xE281) & (three == 0x9F)) | ((two[:-1] == 0xE19A) & (three == 0x80)) | ((two[:-1] == 0xE380) & (three == 0x80))
    full = bounds[1:] > bounds[:-1]
    out[full] = blank[bounds[:-1][full]] | blank[bounds[1:][full] - 1]
    where = np.flatnonzero(bad)
    out[vec.rows_of(where, bounds)] = True
    return out


def _run_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the tokenizer's own splitting surely begins a new piece: rows, blanks, line ends and what follows them, and a dot or comma after a letter."""
    if not len(data):
        return np.zeros(0, np.int64)
    new = (data == 32) | (data == 10)
    new[1:] |= data[:-1] == 10
    low = data | 0x20
    letter = (low >= 97) & (low <= 122)
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    stop = (data == 46) | (data == 44)
    new[1:] |= stop[1:] & (letter | latin)[:-1]
    begin = bounds[:-1]
    new[begin[begin < len(data)]] = True
    return np.flatnonzero(new)


# ---------------------------------------------------------------- files


def _write_shard(uri: str, batches: Iterator[pa.RecordBatch], encoder: Encoder, end_id: int) -> tuple[int, int]:
    keys, null, length, done = [], [], [], 0
    closing = np.array([end_id], encoder.type).tobytes()
    with writer(uri) as out:
        out.write(MAGIC)
        for batch in batches:
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            null.append(nulls)
            keys.append(batch.column(0).cast(pa.int64()).fill_null(0).to_numpy())
            for ids in encoder.encode(batch.column(1)):
                out.write(ids.tobytes())
                out.write(closing)
                length.append(len(ids) + 1)
        if not length:
            return 0, 0
        key, gone, n = np.concatenate(keys), np.concatenate(null), np.array(length, np.uint64)
        live = np.flatnonzero(~gone)
        distinct, first, count = np.unique(key[live], return_index=True, return_counts=True)
        levels, slots = build_index(distinct.view(np.uint64))
        rows, held = np.zeros(len(n), _ROW), np.zeros(len(distinct), _SLOT)
        rows["key"], rows["start"], rows["n"], rows["null"] = key, np.cumsum(n) - n, n, gone
        held["print"][slots], held["row"][slots], held["more"][slots] = _prints(distinct.view(np.uint64)), live[first], count
        done = len(MAGIC) + int(n.sum()) * encoder.type.itemsize
        footer: dict = {"type": encoder.type.str, "tokens": int(n.sum()), "docs": len(n), "keys": len(distinct), "levels": []}
        for name, x in (("rows", rows), ("slots", held)):
            footer[name] = done
            out.write(x.tobytes())
            done += x.nbytes
        slots_before = 0
        for bits in levels:
            footer["levels"].append([len(bits), done, slots_before])
            x = _blocks_of(bits)
            out.write(x.tobytes())
            done += x.nbytes
            slots_before += int(bits.sum())
        tail = json.dumps(footer).encode()
        out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
    return len(length), int(n.sum())


class Shard:
    """One shard file, open for reading: of its parts only the footer is held."""

    def __init__(self, uri: str):
        self.file = reader(uri)
        size = self.file.size()
        n, magic = int.from_bytes(self.file.read_at(8, size - 16), "little"), self.file.read_at(8, size - 8)
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a token shard")
        self.footer = json.loads(self.file.read_at(n, size - 16 - n))
        self.type = np.dtype(self.footer["type"])

    def _read(self, kind: np.dtype, at: int, first: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * kind.itemsize, at + first * kind.itemsize), kind)

    def slot(self, key: int) -> int:
        """The key's slot by the hash, -1 if no level has it: a block is read for each level looked at."""
        one = np.array([key], np.int64).view(np.uint64)
        for i, (size, at, before) in enumerate(self.footer["levels"]):
            block, bit = divmod(int(_place(one, i, size)[0]), 512)
            held = self._read(_BLOCK, at, block, 1)[0]
            bits = np.unpackbits(held["bits"])
            if bits[bit]:
                return before + int(held["before"]) + int(bits[:bit].sum())
        return -1

    def find(self, key: int) -> tuple[int, int]:
        """First row and number of rows of a key, (-1, 0) for one that isn't here."""
        slot = self.slot(key)
        if slot < 0:
            return -1, 0
        held = self._read(_SLOT, self.footer["slots"], slot, 1)[0]
        if held["print"] != _prints(np.array([key], np.int64).view(np.uint64))[0] or self.rows(int(held["row"]), 1)["key"][0] != key:
            return -1, 0
        return int(held["row"]), int(held["more"])

    def rows(self, first: int, n: int) -> np.ndarray:
        return self._read(_ROW, self.footer["rows"], first, n)

    def ids(self, row: np.void) -> np.ndarray:
        return self._read(self.type, len(MAGIC), int(row["start"]), int(row["n"]))

    def find_all(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As find, for many keys: the whole index is read once."""
        levels = [np.unpackbits(self._read(_BLOCK, at, 0, -(-size // 512))["bits"].ravel(), count=size).astype(bool) for size, at, _ in self.footer["levels"]]
        slot = find_slots(levels, [np.cumsum(x) for x in levels], keys.view(np.uint64))
        held = self._read(_SLOT, self.footer["slots"], 0, self.footer["keys"])[slot]
        there = (slot >= 0) & (held["print"] == _prints(keys.view(np.uint64)))
        return np.where(there, held["row"].astype(np.int64), -1), np.where(there, held["more"].astype(np.int64), 0)

    def stream(self, rows: np.ndarray, at_once: int = 4 << 20) -> Iterator[np.ndarray]:
        """The ids of consecutive rows, read in ranges of some at_once bytes; a longer document is a range."""
        ends = (rows["start"] + rows["n"]).astype(np.int64)
        i = 0
        while i < len(rows):
            first = int(rows["start"][i])
            to = max(i + 1, int(np.searchsorted(ends, first + at_once // self.type.itemsize, "right")))
            ids = self._read(self.type, len(MAGIC), first, int(ends[to - 1]) - first)
            for k in range(i, to):
                yield ids[int(rows["start"][k]) - first : int(ends[k]) - first]
            i = to


class TokenFiles:
    """A written set of shards, from its folder."""

    def __init__(self, folder: str):
        with reader(f"{folder}/manifest.json") as f:
            self.shards = json.loads(f.read())
        self.keyed = [s for s in self.shards if s["low"] is not None]
        self.highs = [s["high"] for s in self.keyed]
        self.open: dict[str, Shard] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with the key."""
        out = []
        for s in self.keyed[bisect_left(self.highs, key) :]:
            if s["low"] > key:
                break
            if s["path"] not in self.open:
                self.open[s["path"]] = Shard(s["path"])
            shard = self.open[s["path"]]
            row, n = shard.find(key)
            out += [shard.ids(r) for r in (shard.rows(row, n) if n else ())]
        return out


def write_tokens(documents: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shards: int | None = None, special_as_text: bool = False) -> str:
    """Writes token files of all documents to a new folder below the shared one, and returns its path.

    shards: as many as spark.sql.shuffle.partitions unless given.
    """
    spark = small_batches(documents.sparkSession)
    folder = f"{shared_dir(spark)}/tokens"
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = documents.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    dealt = plain.repartitionByRange(n, "_id", F.xxhash64("_text")).sortWithinPartitions("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("tokens")
        name = ("encoder", tokenizer_path, special_as_text)
        if name not in cache:
            cache[name] = Encoder(tokenizer_path, special_as_text)
        encoder = cache[name]
        order = TaskContext.get().partitionId()
        uri = f"{folder}/{order:06d}-{uuid.uuid4().hex}.tok"
        seen: list = []

        def watched() -> Iterator[pa.RecordBatch]:
            for b in batches:
                live = b.column(0).drop_null()
                if len(live):
                    seen[:] = [seen[0] if seen else live[0].as_py(), live[-1].as_py()]
                yield b

        docs, tokens = _write_shard(uri, watched(), encoder, end_id)
        if docs:
            yield pa.RecordBatch.from_pydict({"shard": [order], "path": [uri], "docs": [docs], "tokens": [tokens], "low": pa.array(seen[:1] or [None], pa.int64()), "high": pa.array(seen[1:] or [None], pa.int64())})

    rows = sorted(dealt.mapInArrow(run, "shard long, path string, docs long, tokens long, low long, high long").collect())
    manifest, at = [], 0
    for r in rows:
        manifest.append(r.asDict() | {"first": at})
        at += r["tokens"]
    with writer(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return folder


def read_tokens(spark, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32. Keys are found through the index."""
    shards = TokenFiles(folder).shards
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(s["path"], s["first"]) for s in shards], "path string, first long").repartition(len(shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(path)
                rows = shard.rows(0, shard.footer["docs"])
                live = rows["null"] == 0
                row, n = shard.find_all(np.unique(rows["key"][live]))
                begins = np.flatnonzero(live & np.append(True, (rows["key"][1:] != rows["key"][:-1]) | ~live[:-1]))
                if row.tolist() != begins.tolist() or n.sum() != live.sum():
                    raise ValueError(f"{path}: the index doesn't lead to all documents")
                crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.stream(rows)), np.int64, len(rows))
                key = pa.array(rows["key"], mask=~live)
                yield pa.RecordBatch.from_arrays([key, pa.array(first + rows["start"].astype(np.int64)), pa.array(rows["n"].astype(np.int64)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, schema)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder)

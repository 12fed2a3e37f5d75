"""Repeated passages: maximal repeats of enhanced suffix arrays, found without bringing the corpus together.

Every string of ``least`` bytes has one anchor: of its 64-byte substrings the leftmost one with the smallest hash. Equal strings
have equal anchors at equal places, so all occurrences of a repeated string meet in one anchor's group. Of a text, each run of
strings with the same anchor is one segment, some 170 strings together.

1. Anchors are counted; those that occur twice or more are set in a bit map of fixed size (others that share a bit are sent in vain,
   which costs time only). A second pass sends just their segments.
2. In an anchor's group the suffixes that begin at the anchor are sorted, with their common-prefix lengths: an enhanced suffix
   array. A stack scan gives its common-prefix intervals. Within each, the reversed texts before the anchor are sorted and scanned
   likewise; an interval of these that reaches ``least`` bytes is a repeat. Of all repeats of an occurrence the range that they
   cover is reported; a group whose suffixes all go on alike belongs to a deeper interval.
3. Equal segments within a task are settled there and sent once. Anchors with more than ``group`` occurrences don't form groups:
   their strings are compared by 128-bit hashes, in an ordinary aggregation, so no task ever holds a large group.

These steps give the ranges to remove. ``repeat_groups`` gives the maximal repeats themselves, each with all its occurrences; every
one lies within a range.

1. Texts with ranges are written once, and numbered. A repeat begins with a string of ``least`` bytes that has different bytes before it, or begins a text. Such strings stand only in
   segments (cut to the ranges) whose anchor has unequal segments, or one that begins a text: of just these the
   distinct ones are compared, an anchor's in one task, in slices of bounded size.
2. For each place of such a string the rest of its range is its suffix. Equal suffixes of equal strings are counted before they meet,
   so that copies are one row. Of a distinct one only as many bytes are sent as tell it from the others: ``least`` times the first
   power of two at which no other one begins alike, by hashes of these lengths. These are sorted by Spark and scanned with a
   stack, as above. An interval is maximal on the right as such, and on the left if its occurrences have different bytes before
   them or one begins a text.
3. Intervals of ranks are cut into blocks of 2 ** level ranks and joined with the places of the suffixes by level and block.

``shared_passages`` tells of words, beside the bytes: a passage of some words may be shorter than ``least`` bytes, so that the rule of
bytes leaves it. Its windows have anchors and segments of words, likewise. Segments are known by the 64-bit hash of their words. One
that two documents have is shared whole; of the others only those are compared window by window whose anchor others have, each distinct
one once, in an ordinary aggregation. All windows of a segment hold its anchor, so what they cover is one range of words.

Defined results: texts are UTF-8 bytes, null ones empty; matches never cross rows; repeated rows are copies of each other, as are
equal texts; a text shorter than ``least`` bytes stays as it is; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .native import row_key
from .shared import hot_keys, small_batches, spread_join, stash

#: Bytes of an anchor.
ANCHOR = 64
#: Words of an anchor of words.
ANCHOR_WORDS = 8
#: Bits of the places of anchors within a piece.
_PLACE = 20


def segments(data: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece: its first byte, and of the runs of strings with the same anchor the row, anchor hash, first and last string, anchor's place."""
    size = 1 << 19
    anchor = min(ANCHOR, least)
    reach = least - anchor + 1
    cuts: list[tuple[int, int]] = []
    for lo, hi in vec.pieces(bounds, size):
        a, b = int(bounds[lo]), int(bounds[hi])
        cuts += [(a, b)] if b - a <= size else [(s, min(b, s + size + least - 1)) for s in range(a, max(b - least + 1, a + 1), size)]
    for a, b in cuts:
        if b - a < least:
            continue
        part = data[a:b]
        sums = vec.prefix_sums(part)
        n = len(part) - anchor + 1
        h = vec.mix((sums[anchor:] - sums[:-anchor]) * vec.powers(vec._INV, len(sums))[:n])
        packed = (h >> vec.U(_PLACE) << vec.U(_PLACE)) | np.arange(n, dtype=vec.U)
        blocks = -(-n // reach)
        padded = np.full(blocks * reach, 2**64 - 1, vec.U)
        padded[:n] = packed
        square = padded.reshape(blocks, reach)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(part) - least + 1
        low = np.minimum(behind[:count], ahead[reach - 1 : reach - 1 + count])
        at = (low & vec.U((1 << _PLACE) - 1)).astype(np.int64)
        # the strings that lie within one row
        p = np.arange(count) + a
        row = np.searchsorted(bounds, p, "right") - 1
        whole = bounds[row + 1] >= p + least
        new = np.ones(count, bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], count) - 1
        keep = whole[first]
        first, last = first[keep], last[keep]
        yield a, row[first], h[at[first]], first, last, at[first]


def common_prefixes(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbouring rows of a matrix of padded strings of lengths n."""
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(n[1:], n[:-1]))


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each common-prefix interval, by a stack scan; last is included."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def _matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    width = max(1, int(n.max()))
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width), n


def _ordered(strings: list[bytes]) -> tuple[list[int], np.ndarray]:
    """The order of the strings, and the common prefixes of neighbours in it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    rows, n = _matrix([strings[i] for i in order])
    return order, common_prefixes(rows, n)


def _nearest(order: list[int], lcp: np.ndarray) -> np.ndarray:
    """For each string the longest common prefix with any other."""
    best = np.zeros(len(order), np.int64)
    best[1:] = lcp
    np.maximum(best[:-1], lcp, out=best[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = best
    return out


def maximal_repeats(right: list[bytes], left: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, occurrences) of each maximal repeat of at least least bytes.

    right: the text from the anchor on; left: the text before it, reversed.
    """
    live = list(range(len(right)))
    while len(live) > 1:  # those without a partner leave, and may leave others without one
        far = _nearest(*_ordered([right[i] for i in live])) + _nearest(*_ordered([left[i] for i in live]))
        stay = [i for i, f in zip(live, far.tolist(), strict=True) if f >= least]
        if len(stay) == len(live):
            break
        live = stay
    if len(live) < 2:
        return
    order, lcp = _ordered([right[i] for i in live])
    suffix = [live[i] for i in order]
    back = {x: k for k, x in enumerate(suffix)}
    for depth, lo, hi in intervals(lcp.tolist()):
        inside = suffix[lo : hi + 1]
        turned, left_lcp = _ordered([left[i] for i in inside])
        for before, a, b in intervals(left_lcp.tolist()):
            if before + depth < least:
                continue
            members = [inside[i] for i in turned[a : b + 1]]
            places = [back[m] for m in members]
            low, high = min(places), max(places)
            if lcp[low:high].min() > depth:  # all go on alike: a deeper interval has them
                continue
            yield before, depth, members


class _Settled:
    """Equal segments within a task: the first one's place by a 128-bit hash. Forgetting only costs sending again."""

    MOST = 300_000

    def __init__(self):
        self.places: dict[bytes, tuple | None] = {}

    def meet(self, segment: bytes, place: tuple) -> tuple[bool, tuple | None]:
        """Whether the segment is new; if not, the first one's place when it has not been told yet."""
        key = xxhash.xxh3_128_digest(segment)
        if key not in self.places:
            if len(self.places) >= self.MOST:
                self.places.clear()
            self.places[key] = place
            return True, None
        first, self.places[key] = self.places[key], None
        return False, first


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, _key: equal for rows of equal id and text only."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).alias("_id"), text.alias("_text"), row_key(id_col, text_col).alias("_key"))


def _bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """A map of 2 ** bits bits (fixed size) with those of the hashes set."""
    place = F.col("anchor").bitwiseAND((1 << bits) - 1)
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("set"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("set").to_numpy()
    return out


def _set(bit_map: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & vec.U(len(bit_map) * 64 - 1)
    return ((bit_map.view(np.uint64)[(place >> vec.U(6)).astype(np.int64)] >> (place & vec.U(63))) & vec.U(1)).astype(bool)


def repeated_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 400, group: int = 4000, bits: int = 26) -> DataFrame:
    """_key of the row, first and end byte of what an occurrence of an anchor has in repeats; together these cover all repeats."""
    spark = small_batches(documents.sparkSession)
    docs = _keyed(documents, id_col, text_col)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, *_ in segments(*vec.text_bytes(batch.column(0)), least):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["anchor"])

    counts = stash(docs.select("_text").mapInArrow(anchors, "anchor long").groupBy("anchor").count().where("count > 1"))
    twice = spark.sparkContext.broadcast(_bit_map(counts, bits))
    often = spark.sparkContext.broadcast(_bit_map(counts.where(F.col("count") > group), bits - 4))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of three kinds: a segment (anchor, key, first, at, bytes); a string of a frequent anchor (anchor and first of its hash, no bytes); a settled span (no anchor)."""
        settled = _Settled()
        for batch in batches:
            data, bounds = vec.text_bytes(batch.column(0))
            keys = batch.column(1).to_pylist()
            out: list[tuple] = []
            for base, row, h, first, last, at in segments(data, bounds, least):
                hit = np.flatnonzero(_set(twice.value, h))
                raw = data[base : base + (int(last[-1]) + least if len(last) else 0)].tobytes()
                hot = _set(often.value, h[hit]).tolist()
                for i, frequent in zip(hit.tolist(), hot, strict=True):
                    f, end = int(first[i]), int(last[i]) + least
                    r = int(row[i])
                    start, segment = f + base - int(bounds[r]), raw[f:end]
                    new, told = settled.meet(segment, (keys[r], start, start + end - f))
                    if not new:
                        out.append((None, None, keys[r], start, start + end - f, None))
                        if told:
                            out.append((None, None, told[0], told[1], told[2], None))
                    elif frequent:
                        for k in range(end - f - least + 1):
                            low, high = divmod(xxhash.xxh3_128_intdigest(segment[k : k + least]), 1 << 64)
                            out.append((low - (1 << 63), high - (1 << 63), keys[r], start + k, start + k + least, None))
                    else:
                        out.append((int(h[i].view(np.int64)), None, keys[r], start, int(at[i]) - f, segment))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "more", "_key", "start", "end", "bytes"])

    sent = stash(docs.select("_text", "_key").mapInArrow(send, "anchor long, more long, _key binary, start long, end long, bytes binary"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Walks the sorted rows of a partition, one anchor's group after another."""
        held: list[tuple] = []
        out: list[tuple] = []

        def finish() -> None:
            # nested repeats of an occurrence all hold the anchor, so together they cover one range
            widest: dict[int, tuple[int, int]] = {}
            for before, after, members in maximal_repeats([r[3][r[2] :] for r in held], [r[3][: r[2]][::-1] for r in held], least):
                for m in members:
                    b, a = widest.get(m, (0, 0))
                    widest[m] = max(b, before), max(a, after)
            for m, (b, a) in widest.items():
                key, start, at, _ = held[m]
                out.append((key, start + at - b, start + at + a))

        current = None
        for batch in batches:
            for anchor, key, start, at, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != current:
                    if len(held) > 1:
                        finish()
                    current, held = anchor, []
                held.append((key, start, at, segment))
            if len(out) > 20_000:
                yield found_of(out)
                out = []
        if len(held) > 1:
            finish()
        if out:
            yield found_of(out)

    def found_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.binary(), pa.int64(), pa.int64()], strict=True)], ["_key", "start", "end"])

    grouped = sent.where("bytes is not null").select("anchor", "_key", "start", "end", "bytes").repartition(F.col("anchor")).sortWithinPartitions("anchor")
    by_group = grouped.mapInArrow(scan, "_key binary, start long, end long")
    local = sent.where("anchor is null").select("_key", "start", "end")
    strings = sent.where("anchor is not null and bytes is null").select("anchor", "more", "_key", "start", "end")
    shared = strings.groupBy("anchor", "more").count().where("count > 1").select("anchor", "more")
    by_hash = strings.join(shared, ["anchor", "more"]).select("_key", "start", "end")
    return by_group.union(local).union(by_hash)


def word_segments(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the runs of windows of some words with the same anchor: row, hash of the anchor, hash of all words, first window in the row, windows;
    then the first window in the piece, and the piece's prefix sums of word hashes."""
    size = 1 << 17
    data, bounds = vec.text_bytes(column)
    kind, hashes, rows = vec.table(vec.SPACES), [np.zeros(0, vec.U)], [np.zeros(0, np.int64)]
    for base, start, end in vec.stretches(data, bounds, kind, 1 << 18):
        if len(start):
            hashes.append(vec.span_hashes(vec.prefix_sums(data[base : base + int(end[-1])]), start, end))
            rows.append(vec.rows_of(start + base, bounds))
    word, row_of = np.concatenate(hashes), np.concatenate(rows)
    begin = np.searchsorted(row_of, np.arange(len(bounds)))
    anchor = min(ANCHOR_WORDS, words)
    reach = words - anchor + 1
    cuts: list[tuple[int, int]] = []  # at rows' bounds or counted from a row's first word, so that they don't depend on the batch
    for lo, hi in vec.pieces(begin, size):
        a, b = int(begin[lo]), int(begin[hi])
        cuts += [(a, b)] if b - a <= size else [(s, min(b, s + size + words - 1)) for s in range(a, max(b - words + 1, a + 1), size)]
    for a, b in cuts:
        if b - a < words:
            continue
        part, row = word[a:b], row_of[a:b]
        sums = np.zeros(len(part) + 1, vec.U)
        np.cumsum(part * vec.powers(vec._B, len(part)), out=sums[1:])
        at = np.arange(len(part) - anchor + 1)
        h = vec.span_hashes(sums, at, at + anchor)
        blocks = -(-len(at) // reach)
        padded = np.full(blocks * reach, 2**64 - 1, vec.U)
        padded[: len(at)] = (h >> vec.U(_PLACE) << vec.U(_PLACE)) | at.astype(vec.U)
        square = padded.reshape(blocks, reach)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(part) - words + 1
        low = np.minimum(behind[:count], ahead[reach - 1 : reach - 1 + count])
        place = (low & vec.U((1 << _PLACE) - 1)).astype(np.int64)
        # the windows that lie within one row
        whole = row[words - 1 :] == row[:count]
        new = np.ones(count, bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:count] != row[: count - 1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], count) - 1
        keep = whole[first]
        first, last = first[keep], last[keep]
        yield row[first], h[place[first]], vec.span_hashes(sums, first, last + words), first + a - begin[row[first]], last - first + 1, first, sums


def shared_passages(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 51, bits: int = 26) -> DataFrame:
    """_key of the row, first and end word of what its windows of so many words cover that another document has, too (another id or another text)."""
    spark = small_batches(documents.sparkSession)
    docs = _keyed(documents, id_col, text_col)
    short = (1 << 32) - 1  # bits of an anchor that are kept: others that share them are compared in vain

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h, *_ in word_segments(batch.column(0), words):
                once = np.unique(row.astype(vec.U) << vec.U(32) | (h & vec.U(short)))  # repeats within a text don't count
                yield pa.RecordBatch.from_arrays([pa.array(once.astype(np.uint32).view(np.int32))], ["anchor"])

    counts = docs.select("_text").mapInArrow(anchors, "anchor int").groupBy("anchor").count().where("count > 1")
    twice = spark.sparkContext.broadcast(_bit_map(counts.select(F.col("anchor").cast("long").alias("anchor")), bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h, same, first, n, *_ in word_segments(batch.column(0), words):
                hit = np.flatnonzero(_set(twice.value, h))
                columns = [pa.array(same[hit].view(np.int64)), pa.array((h[hit] & vec.U(short)).astype(np.uint32).view(np.int32)), batch.column(1).take(pa.array(row[hit])), pa.array(first[hit]), pa.array(n[hit])]
                yield pa.RecordBatch.from_arrays(columns, ["same", "anchor", "_key", "first", "n"])

    sent = stash(docs.select("_text", "_key").mapInArrow(send, "same long, anchor int, _key binary, first long, n long"))
    doc = F.xxhash64("_key")
    kinds = stash(sent.groupBy("same", "anchor").agg(F.min(doc).alias("low"), F.max(doc).alias("high"), F.count(F.lit(1)).alias("rows")))
    mixed = kinds.groupBy("anchor").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.count(F.lit(1)).alias("kinds"), F.bool_or(F.expr("low = high")).alias("alone"))
    looked_at = stash(kinds.join(mixed.where("a <> b and kinds > 1 and alone").select("anchor"), "anchor").select("same", F.expr("low = high").alias("alone")))
    wanted = spark.sparkContext.broadcast(_bit_map(looked_at.select(F.col("same").alias("anchor")), bits))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each distinct segment the hashes of its windows, for up to two documents."""
        met: dict[int, int | None] = {}  # forgetting only costs sending again
        for batch in batches:
            owners = batch.column(1).to_pylist()
            for row, _, same, _, n, first, sums in word_segments(batch.column(0), words):
                hit = np.flatnonzero(_set(wanted.value, same))
                if len(met) > 200_000:
                    met.clear()
                chosen = []
                for i, key, r in zip(hit.tolist(), same[hit].tolist(), row[hit].tolist(), strict=True):
                    if key not in met:
                        met[key] = owners[r]
                    elif met[key] is None or met[key] == owners[r]:
                        continue
                    else:
                        met[key] = None
                    chosen.append(i)
                chosen = np.array(chosen, np.int64)
                ends = np.cumsum(n[chosen])
                at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[chosen] - ends + n[chosen], n[chosen])
                hashes = pa.array(vec.span_hashes(sums, at, at + words).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), hashes)
                yield pa.RecordBatch.from_arrays([pa.array(same[chosen].view(np.int64)), batch.column(1).take(pa.array(row[chosen])), lists], ["same", "doc", "hashes"])

    shown = stash(docs.select("_text", doc.alias("doc")).mapInArrow(windows, "same long, doc long, hashes array<bigint>"))
    in_two = shown.select("doc", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("hash")
    own = shown.join(looked_at.where("alone").select("same"), "same", "left_semi").select("same", F.posexplode("hashes").alias("at", "hash"))
    parts = own.join(in_two, "hash", "left_semi").groupBy("same").agg(F.min("at").cast("long").alias("from"), F.max("at").cast("long").alias("to"))
    found = kinds.where("low <> high").select("same", F.lit(0).cast("long").alias("from"), F.lit(None).cast("long").alias("to")).union(parts)
    total = kinds.agg(F.sum("rows")).first()[0] or 0
    placed = spread_join(sent.select("same", "_key", "first", "n"), found, "same", hot_keys(kinds, "same", "rows", total), "_key")
    return placed.select("_key", (F.col("first") + F.col("from")).alias("start"), (F.col("first") + F.coalesce("to", F.col("n") - 1) + words).alias("end"))


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 400, words: int = 0, **options) -> DataFrame:
    """Per row: id, n_bytes, spans (removed byte ranges, merged), kept (the remaining bytes), passages (word ranges that are shared by ``words`` words
    or more with another document, merged; none if words is 0). Passages aren't removed."""
    spans = repeated_spans(documents, id_col=id_col, text_col=text_col, least=least, **options)
    span, none = F.struct("start", "end"), F.lit(None).cast("struct<start:bigint,end:bigint>")
    both = spans.select(F.col("_key").alias("_of"), span.alias("span"), none.alias("passage"))
    if words:
        passages = shared_passages(documents, id_col=id_col, text_col=text_col, words=words)
        both = both.union(passages.select("_key", none, span))
    per_row = stash(both.groupBy("_of").agg(F.collect_set("span").alias("_spans"), F.collect_set("passage").alias("_passages")))
    some = documents.sparkSession.sparkContext.broadcast(_bit_map(per_row.select(F.xxhash64("_of").alias("anchor")), 26))
    docs = _keyed(documents, id_col, text_col)
    id_type = documents.schema[id_col].dataType.simpleString()

    def those(batches: Iterator[pa.RecordBatch], hit: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_set(some.value, batch.column(3).to_numpy().view(np.uint64)) == hit)).select(["_id", "_text", "_key"])

    def with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from those(batches, True)

    placed = docs.select("_id", "_text", "_key", F.xxhash64("_key"))
    found = placed.mapInArrow(with_spans, f"_id {id_type}, _text string, _key binary").join(per_row, F.col("_key") == F.col("_of"), "left").select("_id", "_text", "_spans", "_passages")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, merged, kept = [], [], []
            passages = [[{"start": s, "end": e} for s, e in _merged([(x["start"], x["end"]) for x in found or ()])] for found in batch.column(3).to_pylist()]
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                mine = _merged([(x["start"], x["end"]) for x in found or ()])
                edges = [0, *(x for m in mine for x in m), len(raw)]
                n.append(len(raw))
                merged.append([{"start": s, "end": e} for s, e in mine])
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(merged, span_type), pa.array(kept, pa.binary()), pa.array(passages, span_type)], ["_id", "n_bytes", "spans", "kept", "passages"])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have no spans: they needn't be shuffled. One function, so that a task has one Python worker."""
        for batch in those(batches, False):
            empty = pa.nulls(batch.num_rows, pa.list_(span_type.value_type))
            yield from cut(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), empty, empty], ["_id", "_text", "_spans", "_passages"])]))

    schema = f"_id {id_type}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary, passages array<struct<start:bigint,end:bigint>>"
    return found.mapInArrow(cut, schema).union(placed.mapInArrow(without, schema)).withColumnRenamed("_id", id_col)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _batches(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    out: list[tuple] = []
    size = 0
    for r in rows:
        out.append(r)
        size += 100 + sum(len(x) for x in r if isinstance(x, bytes))
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _before(raw: bytes, at: int) -> int:
    """The byte before a place, -1 at the beginning of a text."""
    return raw[at - 1] if at else -1


def suffix_repeats(suffixes: Iterator[tuple[bytes, int, int, int, int, bytes]]) -> Iterator[tuple[bytes, int, int, int, int]]:
    """(hash, length, occurrences, first and last suffix) of each maximal repeat that the suffixes begin with.

    suffixes: the distinct ones in their order: the bytes that tell them apart, occurrences, least and greatest byte before them (-1: a text begins), whole length, hash
    of all bytes.
    """
    stack: list[list] = []  # depth, first suffix, occurrences, least and greatest byte before
    whole = b""
    last, rank = b"", -1

    def close(depth: int) -> Iterator[tuple[bytes, int, int, int, int]]:
        """Ends the intervals deeper than depth; what they hold goes to the one around them."""
        while stack and stack[-1][0] > depth:
            d, first, n, low, high = stack.pop()
            if n > 1 and (low < high or low < 0):
                # only the last suffix alone, all its copies, goes on behind the bytes that are known
                yield whole if d > len(last) else xxhash.xxh3_128_digest(memoryview(last)[:d]), d, n, first, rank
            if stack and stack[-1][0] >= depth:
                around = stack[-1]
                around[2:] = around[2] + n, min(around[3], low), max(around[4], high)
            elif depth >= 0:
                stack.append([depth, first, n, low, high])

    for suffix, n, low, high, length, name in suffixes:
        if rank >= 0:
            yield from close(_common(last, suffix))
        rank += 1
        stack.append([length, rank, n, low, high])
        last, whole = suffix, name
    yield from close(-1)


def _blocks(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """(level, block) of blocks of 2 ** level ranks that together hold lo to hi."""
    level, hi = 0, hi + 1
    while lo < hi:
        if lo & 1:
            yield level, lo
            lo += 1
        if hi & 1:
            hi -= 1
            yield level, hi
        lo, hi, level = lo >> 1, hi >> 1, level + 1


def differently_begun(before: list[int], texts: list[bytes], least: int, most: int = 1 << 22) -> Iterator[list[int]]:
    """For each text the places whose string of least bytes has different bytes before it, or begins a whole text; now and then others.

    Strings are compared by 64-bit hashes, of at most some ``most`` strings at once.
    """
    total = sum(len(t) - least + 1 for t in texts)
    parts = -(-total // most)
    factors = vec.powers(vec._INV, max(map(len, texts)) + 1)
    found = []
    for part in range(parts):
        hashes, lefts, wheres = [], [], []
        at = 0
        for b, t in zip(before, texts, strict=True):
            data = np.frombuffer(t, np.uint8)
            sums = vec.prefix_sums(data)
            n = len(t) - least + 1
            h = vec.mix((sums[least:] - sums[:-least]) * factors[:n])
            left = np.empty(n, np.int16)
            left[0] = b
            left[1:] = data[: n - 1]
            where = np.arange(at, at + n)
            if parts > 1:
                mine = h % vec.U(parts) == vec.U(part)
                h, left, where = h[mine], left[mine], where[mine]
            hashes.append(h)
            lefts.append(left)
            wheres.append(where)
            at += n
        h, left, where = np.concatenate(hashes), np.concatenate(lefts), np.concatenate(wheres)
        if not len(h):
            continue
        order = np.argsort(h)
        h, left, where = h[order], left[order], where[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        low, high = np.minimum.reduceat(left, new), np.maximum.reduceat(left, new)
        found.append(where[np.repeat((low < high) | (low < 0), np.diff(np.append(new, len(h))))])
    flat = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    edges = np.cumsum([0, *(len(t) - least + 1 for t in texts)])
    cuts = np.searchsorted(flat, edges)
    for i in range(len(texts)):
        yield (flat[cuts[i] : cuts[i + 1]] - edges[i]).tolist()


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


def repeat_groups(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 400, **options) -> DataFrame:
    """One row per occurrence of each maximal repeat: repeat (128-bit hash of its bytes), n_bytes, occurrences (of the repeat), id, start, end."""
    spark = small_batches(documents.sparkSession)
    docs = _keyed(documents, id_col, text_col)
    id_type = documents.schema[id_col].dataType.simpleString()
    spans = repeated_spans(documents, id_col=id_col, text_col=text_col, least=least, **options)
    per_row = stash(spans.groupBy(F.col("_key").alias("_of")).agg(F.collect_set(F.struct("start", "end")).alias("_spans")))
    # the numbers only name rows of this table; results don't depend on them
    texts = stash(docs.join(per_row, docs["_key"] == per_row["_of"]).select("_id", "_text", "_spans", F.monotonically_increasing_id().alias("_row")))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each segment the strings within a range: anchor, hash of them with the byte before, whether a text begins with them, places."""

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            data, bounds = vec.text_bytes(batch.column(0))
            rows_of = batch.column(1).to_pylist()
            ranges = [_merged([(x["start"], x["end"]) for x in r]) for r in batch.column(2).to_pylist()]
            edges = [([s for s, _ in r], [e for _, e in r]) for r in ranges]
            for base, row, h, first, last, _ in segments(data, bounds, least):
                for r, anchor, f, t in zip(row.tolist(), h.view(np.int64).tolist(), (first + base).tolist(), (last + base).tolist(), strict=True):
                    zero = int(bounds[r])
                    f, t = f - zero, t - zero
                    starts, ends = edges[r]
                    for k in range(bisect_right(ends, f), len(starts)):
                        if starts[k] > t:
                            break
                        lo, hi = max(f, starts[k]), min(t, ends[k] - least)
                        if lo <= hi:
                            told = data[zero + max(lo - 1, 0) : zero + hi + least].tobytes()
                            yield anchor, xxhash.xxh3_128_digest(told), lo == 0, rows_of[r], lo, hi

        for batch in batches:
            yield from _batches(rows(batch), run_schema)

    run_schema = pa.schema([("anchor", pa.int64()), ("same", pa.binary()), ("begins", pa.bool_()), ("_row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
    found = stash(texts.select("_text", "_row", "_spans").mapInArrow(runs, "anchor long, same binary, begins boolean, _row long, lo long, hi long"))
    mixed = found.groupBy("anchor").agg(F.min("same").alias("a"), F.max("same").alias("b"), F.max("begins").alias("begins")).where("begins or a <> b")
    # of equal segments of an anchor one is looked at
    one = found.join(mixed.select("anchor"), "anchor", "left_semi").groupBy("anchor", "same").agg(F.min(F.struct("_row", "lo", "hi")).alias("r"))
    per_text = one.groupBy("r._row").agg(F.collect_list(F.struct("anchor", "same", "r.lo", "r.hi")).alias("_runs"))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the given segments, with the one before."""

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for text, mine in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for r in mine:
                    yield r["anchor"], r["same"], _before(raw, r["lo"]), raw[r["lo"] : r["hi"] + least]

        for batch in batches:
            yield from _batches(rows(batch), shown_schema)

    shown_schema = pa.schema([("anchor", pa.int64()), ("same", pa.binary()), ("before", pa.int32()), ("bytes", pa.binary())])
    dealt = texts.join(per_text, "_row").select("_text", "_runs").mapInArrow(shown, "anchor long, same binary, before int, bytes binary")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per segment the places in it where a repeat may begin."""

        def sorted_rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def rows() -> Iterator[tuple]:
            for anchor, group in groupby(sorted_rows(), key=lambda r: r[0]):
                held = list(group)
                for (_, same, _, _), at in zip(held, differently_begun([r[2] for r in held], [r[3] for r in held], least), strict=True):
                    if at:
                        yield anchor, same, at

        yield from _batches(rows(), begin_schema)

    begin_schema = pa.schema([("anchor", pa.int64()), ("same", pa.binary()), ("at", pa.list_(pa.int64()))])
    begun = dealt.repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(begin, "anchor long, same binary, at array<bigint>")
    per_place = found.select("anchor", "same", "_row", "lo").join(begun, ["anchor", "same"]).groupBy("_row")
    places = stash(per_place.agg(F.array_distinct(F.flatten(F.collect_list(F.transform("at", lambda x: x + F.col("lo"))))).alias("_starts")))

    def suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each place: hashes of its string and of the rest of its range, of the lengths between them, byte before, row, id, place."""

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for of, text, row, spans_of, starts in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                raw = memoryview(text.as_buffer())
                ranges = _merged([(x["start"], x["end"]) for x in spans_of])
                begins = [s for s, _ in ranges]
                for p in starts:
                    end = ranges[bisect_right(begins, p) - 1][1]
                    told, n = xxhash.xxh3_128(raw[p : p + least]), least
                    string, begun = told.digest(), []
                    while p + 2 * n <= end:
                        told.update(raw[p + n : p + 2 * n])
                        begun.append((told.intdigest() & (1 << 64) - 1) - (1 << 63))
                        n *= 2
                    told.update(raw[p + n : end])
                    yield string, told.digest(), raw[p - 1] if p else -1, row, of, p, end, begun

        for batch in batches:
            schema = pa.schema([("string", pa.binary()), ("suffix", pa.binary()), ("before", pa.int32()), ("_row", pa.int64()), ("_id", batch.schema.field(0).type), ("start", pa.int64()), ("stop", pa.int64()), ("begun", pa.list_(pa.int64()))])
            yield from _batches(rows(batch), schema)

    cut = texts.join(places, "_row").select("_id", "_text", "_row", "_spans", "_starts")
    members = stash(cut.mapInArrow(suffix_rows, f"string binary, suffix binary, before int, _row long, _id {id_type}, start long, stop long, begun array<bigint>"))
    distinct = stash(members.groupBy("string", "suffix").agg(F.min(F.struct("_row", "start", "stop", "begun")).alias("r"), F.count(F.lit(1)).alias("n"), F.min("before").alias("low"), F.max("before").alias("high")))
    lengths = distinct.select("string", "suffix", F.posexplode("r.begun").alias("k", "hash"))
    alike = lengths.groupBy("string", "k", "hash").count().where("count > 1").drop("count")
    deepest = lengths.join(alike, ["string", "k", "hash"]).groupBy("string", "suffix").agg((F.max("k") + 1).alias("deep"))
    # one length more than those that others begin with, too
    enough = F.col("r.start") + F.call_function("shiftleft", F.lit(least).cast("long"), F.coalesce("deep", F.lit(0)) + 1)
    needed = distinct.join(deepest, ["string", "suffix"], "left").withColumn("cut", F.least("r.stop", enough))
    per_text = needed.groupBy("r._row").agg(F.collect_list(F.struct("string", "suffix", "r.start", "r.stop", "cut", "n", "low", "high")).alias("_rests"))

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct suffixes with the bytes that tell them apart."""

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for text, mine in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for r in mine:
                    yield r["string"], r["suffix"], raw[r["start"] : r["cut"]], r["n"], r["low"], r["high"], r["stop"] - r["start"]

        for batch in batches:
            yield from _batches(rows(batch), rest_schema)

    rest_schema = pa.schema([("string", pa.binary()), ("suffix", pa.binary()), ("bytes", pa.binary()), ("n", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("length", pa.int64())])
    with_bytes = texts.join(per_text, "_row").select("_text", "_rests").mapInArrow(rests, "string binary, suffix binary, bytes binary, n long, low int, high int, length long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: a suffix with its rank and the levels (as bits) of the blocks that hold it; a block of ranks (level, block) of a repeat."""

        def sorted_rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(0, batch.num_rows, 100):
                    yield from zip(*(c.to_pylist() for c in batch.slice(i, 100).columns), strict=True)

        def rows() -> Iterator[tuple]:
            for string, group in groupby(sorted_rows(), key=lambda r: r[0]):
                names: list[bytes] = []
                held: set[tuple[int, int]] = set()
                for repeat, n_bytes, n, lo, hi in suffix_repeats((*r[2:], r[1]) for r in group if names.append(r[1]) is None):
                    for level, block in _blocks(lo, hi):
                        held.add((level, block))
                        yield string, None, None, level, block, repeat, n_bytes, n
                for rank, name in enumerate(names):
                    levels = sum(1 << k for k in range(len(names).bit_length()) if (k, rank >> k) in held)
                    if levels:
                        yield string, name, rank, levels, None, None, None, None

        yield from _batches(rows(), node_schema)

    node_schema = pa.schema([("string", pa.binary()), ("suffix", pa.binary()), ("rank", pa.int64()), ("level", pa.int32()), ("block", pa.int64()), ("repeat", pa.binary()), ("n_bytes", pa.int64()), ("occurrences", pa.int64())])
    ordered = with_bytes.repartition(F.col("string")).sortWithinPartitions("string", "bytes")
    nodes = stash(ordered.mapInArrow(scan, "string binary, suffix binary, rank long, level int, block long, repeat binary, n_bytes long, occurrences long"))
    ranks = nodes.where("suffix is not null").select("string", "suffix", "rank", F.col("level").alias("levels"))
    placed = members.select("string", "suffix", "_id", "start").join(ranks, ["string", "suffix"])
    placed = placed.select("string", "_id", "start", "rank", F.explode(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.getbit("levels", k) == 1)).alias("level"))
    placed = placed.select("string", "level", F.call_function("shiftright", F.col("rank"), F.col("level")).alias("block"), "_id", "start")
    out = placed.join(nodes.where("suffix is null").select("string", "level", "block", "repeat", "n_bytes", "occurrences"), ["string", "level", "block"])
    return out.select("repeat", "n_bytes", "occurrences", F.col("_id").alias(id_col), "start", (F.col("start") + F.col("n_bytes")).alias("end"))


def op8_repeat_groups(spark, sf_dir: str) -> DataFrame:
    return repeat_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_repeats(spark, sf_dir: str) -> DataFrame:
    """The contract's columns; then of words: n_passage_words (within 51 words or more that another document has, too) and shares_passage (whether there are any)."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=51)
    removed, told = (F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]) for c in ("spans", "passages"))
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), told.alias("n_passage_words"), (told > 0).alias("shares_passage"))


def brute_force(texts: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """The removed ranges of each text, by looking at every string: for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - least + 1):
            k = hashlib.md5(t[i : i + least]).digest()
            count[k] = count.get(k, 0) + 1
    out = []
    for t in texts:
        mine: list[tuple[int, int]] = []
        for i in range(len(t) - least + 1):
            if count[hashlib.md5(t[i : i + least]).digest()] > 1:
                if mine and i <= mine[-1][1]:
                    mine[-1] = (mine[-1][0], i + least)
                else:
                    mine.append((i, i + least))
        out.append(mine)
    return out

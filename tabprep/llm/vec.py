"""Tokens and hashes of whole Arrow batches with numpy: no Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multiplier of the polynomial hash, and its inverse modulo 2 ** 64.
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: The separators of the contracts' words [^\x20\x09-\x0D]+
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = the polynomial of data[i:j], times base ** i."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(_B, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal strings get equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(_INV, len(sums))[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column (null: empty), and the bounds of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def pieces(bounds: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes each; a longer row stands alone."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = to


def table(separators: bytes = b"", lower: bool = False) -> np.ndarray:
    """Byte kinds for runs(): 0 for separators, 1 for others."""
    kind = np.ones(256, np.uint8)
    kind[list(separators)] = 0
    return kind


def lowered() -> np.ndarray:
    """Maps A-Z to a-z and leaves other bytes."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def runs(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of one kind other than 0; none crosses the rows' bounds."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = kind[data]
    new = np.ones(n, bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    inner = bounds[1:-1]
    new[inner[inner < n]] = True
    at = np.flatnonzero(new)
    end = np.append(at[1:], n)
    keep = k[at] != 0
    return at[keep], end[keep]


def rows_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each start its row's number."""
    return np.searchsorted(bounds, starts, "right") - 1


def stretches(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, starts, ends) of the runs of one kind other than 0, in parts of about size bytes that end at a row's bound or a byte of kind 0:
    long texts are taken in parts, too. Starts and ends count from the first byte."""
    at, n = 0, len(data)
    while at < n:
        to = at + size
        while to < n:
            gaps = np.flatnonzero(kind[data[to : to + size]] == 0)
            bound = bounds[np.searchsorted(bounds, to)]
            gap = to + int(gaps[0]) if len(gaps) else to + size
            to = int(min(gap, bound, n))
            if len(gaps) or to == bound:
                break
        to = min(to, n)
        inner = bounds[(bounds >= at) & (bounds <= to)] - at
        start, end = runs(data[at:to], np.unique(np.concatenate([[0], inner, [to - at]])), kind)
        yield at, start, end
        at = to

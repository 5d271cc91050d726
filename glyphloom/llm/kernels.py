"""Array helpers that run inside Spark tasks, on the bytes of many texts at once.

Texts reach a task as Arrow batches.  ``pieces`` cuts them into parts of a few
megabytes, so that memory depends on the longest text and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 500_000

#: odd multiplier of the polynomial hash, its inverse modulo 2**64, and a code for each byte
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if len(known) <= 4 * PIECE_BYTES:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, bytes, offsets``: parts of a string column, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(ends, ends[row] + PIECE_BYTES, side="right")) - 1
        last = min(max(last, row + 1), len(texts))
        yield row, raw[ends[row]:ends[last]], ends[row:last + 1] - ends[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray):
    """``starts, ends, first``: words of all texts; those of text i are first[i]..first[i+1]."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~between[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edges] = 0
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = 0
    inside = inside[1:-1].astype(bool)
    starts = np.flatnonzero(inside & (before == 0))
    ends = np.flatnonzero(inside & (after == 0)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * powers(BASE, len(data)), out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    back = powers(INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def labels_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For n nodes and links between them, the smallest node that each one reaches."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while not np.array_equal(label, nearer := label[label]):
            label = nearer
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, cut so that no key is in two of them."""
    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = table.column(key)
        if keys[0] == keys[-1] :
            rest = table
            continue
        values = keys.combine_chunks()
        values = values.to_numpy(zero_copy_only=False)
        cut = len(values) - int(np.argmax((values != values[-1])[::-1]))
        yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None:
        yield rest


def fixed_binary(column: pa.ChunkedArray, width: int, kind=np.uint8) -> np.ndarray:
    """A binary column of equal widths as a matrix."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(len(column), width)


def flat_lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``values, offsets`` of a list column without nulls."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    return values[ends[0]:ends[-1]], ends - ends[0]

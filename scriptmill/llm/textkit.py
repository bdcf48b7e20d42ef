"""Words, shingles and MinHash signatures of Arrow text columns in numpy. Plain functions for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SLAB = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (xor-shift, multiply, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, SLAB + 4096), _P if kind == "up" else _P_INVERSE, np.uint64)
        base[0] = 1
        have = _powers[kind] = np.cumprod(base)
    return have


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the offsets of its rows; null rows are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if column.null_count:  # a null row has no bytes in Spark's output; make sure of it
        length = np.diff(offsets)
        null = np.asarray(column.is_null())
        if length[null].any():
            keep = np.repeat(~null, length)
            raw, length = raw[keep], np.where(null, 0, length)
            offsets = np.concatenate([[0], np.cumsum(length)])
    return raw, offsets


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than space and \\t to \\r) of all rows: start, end, hash, and the offsets of rows in them."""
    starts, ends, hashes = [], [], []
    at, n = 0, len(raw)
    inner = offsets[1:-1]
    while at < n:
        to = min(n, at + SLAB)
        if to < n:  # go on to the end of a word or of a row
            row_end = int(offsets[np.searchsorted(offsets, to)])
            while to < row_end:
                window = raw[to : min(row_end, to + 65536)]
                hit = np.flatnonzero(_WS[window])
                if len(hit):
                    to += int(hit[0])
                    break
                to += len(window)
        part = raw[at:to]
        white = _WS[part]
        before = np.empty(len(part), bool)
        before[0] = True
        before[1:] = white[:-1]
        cuts = inner[np.searchsorted(inner, at) : np.searchsorted(inner, to)] - at
        before[cuts] = True
        s = np.flatnonzero(before & ~white)
        after = np.empty(len(part), bool)
        after[-1] = True
        after[:-1] = before[1:]
        after[:-1] |= white[1:]
        e = np.flatnonzero(after & ~white) + 1
        value = _BYTE[_LOWER[part] if lower else part] * _power("up", len(part))[: len(part)]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        h = (total[e] - total[s]) * _power("down", len(part))[s]
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix64(h + (e - s).astype(np.uint64)))
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offsets)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, from one running sum."""
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * _power("up", len(raw))[: len(raw)], out=total[1:])
    return mix64((total[end] - total[start]) * _power("down", len(raw))[start] + (end - start).astype(np.uint64))


_STEP = np.uint64(0x9FB21C651E98DF25)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive hashes, over row borders too."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * _STEP + hashes[k : k + n]
    return mix64(out)


def shingle_sets(word_hash: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every row (flat, with offsets). A row with fewer words has one shingle: all of them."""
    every = runs(word_hash, width)
    sets = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= width:
            s = np.sort(every[a : b - width + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif b > a:
            s = runs(word_hash[a:b], b - a) + np.uint64(b - a)
        else:
            s = np.zeros(0, np.uint64)
        sets.append(s)
    offsets = np.zeros(len(rows), np.int64)
    if sets:
        np.cumsum([len(s) for s in sets], out=offsets[1:])
        return np.concatenate(sets), offsets
    return np.zeros(0, np.uint64), offsets


def _pi(t: np.ndarray) -> None:
    """The second permutation, a bijection of 32-bit numbers, in place."""
    t ^= t >> np.uint32(16)
    t *= np.uint32(0x7FEB352D)
    t ^= t >> np.uint32(15)
    t *= np.uint32(0x846CA68B)
    t ^= t >> np.uint32(16)


def circulant_signatures(shingles: np.ndarray, offsets: np.ndarray, n: int, block: int = 1 << 15) -> np.ndarray:
    """Circulant MinHash: the first permutation places every shingle on a circle of 2^32 places, once; the second one,
    shifted by k places along the circle, gives coordinate k as the smallest value of the row. Rows without shingles
    get all ones."""
    out = np.full((len(offsets) - 1, n), 0xFFFFFFFF, np.uint32)
    places = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(offsets[full + 1], offsets[full[at]] + block, side="right")))
        rows = full[at:to]
        base = places[offsets[rows[0]] : offsets[rows[-1] + 1]]
        cut = offsets[rows] - offsets[rows[0]]
        for k in range(n):
            t = base - np.uint32(k)
            _pi(t)
            out[rows, k] = np.minimum.reduceat(t, cut)
        at = to
    return out


def band_keys(signatures: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit key per band of ``width`` coordinates; the number of the band is part of the key."""
    bands = signatures.shape[1] // width
    keys = np.empty((len(signatures), bands), np.uint64)
    for j in range(bands):
        key = np.full(len(signatures), j + 1, np.uint64)
        for k in range(j * width, (j + 1) * width):
            key = mix64(key * _STEP + signatures[:, k].astype(np.uint64))
        keys[:, j] = key
    return keys.view(np.int64)


def batched(batches: Iterator, max_bytes: int = 4 << 20) -> Iterator:
    """Record batches cut into slices of limited bytes; a row is never cut."""
    for batch in batches:
        step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)

"""Static range asymmetric numeral system over token ids: one frequency table, many independent blocks of interleaved
lanes, with checkpoints inside a block and checksums. Plain functions for use inside tasks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 18
LANES, ROWS, CHECK = 1024, 256, 128
_LOW = np.uint64(1 << 31)
_32, _SCALE = np.uint64(32), np.uint64(SCALE)
_WORD, _SLOT = np.uint64(0xFFFFFFFF), np.uint64((1 << SCALE) - 1)


class Table:
    """Frequencies scaled to a sum of 2^18; every id that occurs has at least 1."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.index = None

    @classmethod
    def of(cls, tokens: np.ndarray) -> Table:
        counts = np.bincount(tokens)
        ids = np.flatnonzero(counts)
        if len(ids) > 1 << SCALE:
            raise ValueError(f"{len(ids)} different ids; the table holds {1 << SCALE}")
        freq = np.maximum(1, counts[ids] * (1 << SCALE) // counts.sum())
        over = int(freq.sum()) - (1 << SCALE)
        order = np.argsort(-freq, kind="stable")
        while over > 0:  # take from the most frequent ones what the rounding up to 1 has added
            take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // (1 << SCALE)))
            take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
            freq[order] -= take
            over = int(freq.sum()) - (1 << SCALE)
        freq[order[0]] -= over
        return cls(ids, freq)

    def dump(self) -> bytes:
        return zlib.compress(struct.pack("<I", len(self.ids)) + np.diff(self.ids, prepend=np.uint32(0)).astype("<u4").tobytes()
                             + self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def load(cls, data: bytes) -> Table:
        raw = zlib.decompress(data)
        n = struct.unpack_from("<I", raw)[0]
        return cls(np.cumsum(np.frombuffer(raw, "<u4", n, 4)), np.frombuffer(raw, "<u4", n, 4 + 4 * n).astype(np.int64))

    def places(self, tokens: np.ndarray) -> np.ndarray:
        if self.index is None:
            self.index = np.zeros(int(self.ids[-1]) + 1, np.uint32)
            self.index[self.ids] = np.arange(len(self.ids), dtype=np.uint32)
        return self.index[tokens]

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(tokens: np.ndarray, table: Table, lanes: int = LANES, check: int = CHECK) -> bytes:
    """One block: token i is in row i // lanes and lane i % lanes. Rows are encoded from the last to the first, so they
    are decoded from the first on; the states before every ``check``-th row are checkpoints where decoding may begin."""
    lanes = max(1, min(lanes, len(tokens)))
    rows = -(-len(tokens) // lanes)
    grid = np.zeros(rows * lanes, np.uint32)
    grid[: len(tokens)] = table.places(tokens)
    grid[len(tokens):] = np.argmax(table.freq)
    grid = grid.reshape(rows, lanes)
    x = np.full(lanes, _LOW, np.uint64)
    words: list = [None] * rows
    marks: dict[int, np.ndarray] = {}
    most = np.uint64(31 - SCALE + 32)
    for r in range(rows - 1, -1, -1):
        f, c = table.freq[grid[r]], table.start[grid[r]]
        full = x >= (f << most)
        words[r] = (x[full] & _WORD).astype("<u4")
        x = np.where(full, x >> _32, x)
        q = x // f
        x = (q << _SCALE) + (x - q * f) + c
        if r % check == 0:
            marks[r] = x
    at = np.cumsum([0] + [len(w) for w in words])[:-1]
    head = struct.pack("<IIII", len(tokens), lanes, check, len(marks))
    points = b"".join(struct.pack("<I", at[r]) + marks[r].astype("<u8").tobytes() for r in sorted(marks))
    body = head + points + b"".join(w.tobytes() for w in words)
    return struct.pack("<I", zlib.crc32(body)) + body


def decode_block(data: bytes, table: Table, slots: np.ndarray, point: int = 0, points: int | None = None) -> np.ndarray:
    """The tokens from checkpoint ``point`` on, over ``points`` stretches (all that follow by default)."""
    if zlib.crc32(data[4:]) != struct.unpack_from("<I", data)[0]:
        raise ValueError("checksum of a block differs")
    n, lanes, check, marks = struct.unpack_from("<IIII", data, 4)
    size = 4 + 8 * lanes
    words = np.frombuffer(data, "<u4", offset=20 + marks * size)
    at = struct.unpack_from("<I", data, 20 + point * size)[0]
    x = np.frombuffer(data, "<u8", lanes, 24 + point * size).astype(np.uint64)
    rows = -(-n // lanes)
    first = point * check
    last = rows if points is None else min(rows, first + points * check)
    out = np.empty((last - first, lanes), np.uint32)
    for r in range(first, last):
        slot = x & _SLOT
        s = slots[slot]
        out[r - first] = s
        x = table.freq[s] * (x >> _SCALE) + slot - table.start[s]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << _32) | words[at : at + len(low)]
            at += len(low)
    return table.ids[out.ravel()[: min(n, last * lanes) - first * lanes]]

"""Token ids of documents in binary files, entropy-coded by ``rans``.

A file holds frames, each of them: b"TRF1", kind (1 byte), length of the payload (8 bytes, little-endian), CRC-32 of the
payload (4 bytes), payload, and a line feed, which is what Spark's text writer puts after a value. Kinds: T, the frequency
table of the frames that follow up to the next T; D, the directory of their documents (ids, numbers of tokens, checksums of
the tokens); B, a block of tokens. Documents lie in files in ascending order of their ids, and so do the numbers of files."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import rans, textkit
from scriptmill.llm.common import Stored, fresh_folder, ready, running_totals

# Text per file, and tokens after which a file begins a new table (bounds the memory of a task).
FILE_BYTES, SEGMENT_TOKENS = 32 << 20, 1 << 24
# Pieces of texts whose ids a task remembers, and ids of all of them.
KNOWN_PIECES, KNOWN_IDS = 1_500_000, 8_000_000
_SEGMENT = 1 << 20

_SPACE, _SIGN, _ALNUM, _ODD = (np.zeros(256, bool) for _ in range(4))
_SPACE[[32, 10]] = True
_SIGN[list(b".,!?;:")] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
# White space beyond ASCII, as UTF-8: NEL, no-break space, ogham space, U+2000 to U+200A, line and paragraph separator,
# narrow no-break space, mathematical space, ideographic space.
_WIDE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *[bytes([0xE2, 0x80, x]) for x in [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]],
         b"\xe2\x81\x9f", b"\xe3\x80\x80", b"<|"]
_LEAD = np.zeros(256, bool)
_LEAD[[w[0] for w in _WIDE]] = True
_PAIRS, _TRIPLES = ([int.from_bytes(w, "big") for w in _WIDE if len(w) == n] for n in (2, 3))


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, which sees every different piece of text once.

    A space or line feed behind another character always begins a new word of the tokenizer, and so does a point or comma
    behind an ASCII letter or digit, so a text may be cut there. Texts with other white space or with what may be a special
    token are encoded whole. Pieces are known by a 64-bit hash; the bytes that the ids found stand for are compared with
    the text, and a text that differs is encoded whole too, so a collision changes nothing."""

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # a character of a token stands for a byte: printable ones for themselves, the others, in order, for 256 and on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
        names = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            names[i] = token
        self.length = np.array([len(n) for n in names], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.array([byte[c] for n in names for c in n], np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Encode new pieces. Those that begin with a space and end without one are encoded side by side as one text, in
        which each begins a new word too; the bytes of the tokens tell where a piece ends."""
        joined = _SPACE[raw[start]] & ~_SPACE[raw[end - 1]]
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        n, at, ids, sizes = int(joined.sum()), 0, [], []
        length = (end - start)[order]
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(np.cumsum(length[at:n]), 1 << 17)) + at))
            part = slice(at, to)
            reach = np.cumsum(length[part])
            text = raw[np.repeat(start[order[part]] - (reach - length[part]), length[part]) + np.arange(reach[-1])]
            got = np.array(self._whole([text.tobytes().decode()])[0], np.int64)
            reached = np.cumsum(self.length[got])
            ends = np.searchsorted(reached, reach) + 1
            if not np.array_equal(reached[ends - 1], reach):
                raise ValueError("a token crosses the end of a word")
            ids.append(got.astype(np.uint32))
            sizes.append(np.diff(ends, prepend=0))
            at = to
        for got in self._whole([raw[start[i] : end[i]].tobytes().decode() for i in order[n:].tolist()]):
            ids.append(np.array(got, np.uint32))
            sizes.append(np.array([len(got)]))
        before = len(self.ends) - 1
        self.ids = np.concatenate([self.ids, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        place = np.empty(len(start), np.int64)
        place[order] = before + np.arange(len(start))
        where = np.searchsorted(self.known, hashes)
        self.known, self.place = np.insert(self.known, where, hashes), np.insert(self.place, where, place)

    def _pieces(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a stretch of text and where those of each part (between edges) end."""
        before = np.empty(len(raw), np.uint8)
        before[0], before[1:] = 32, raw[:-1]
        cut = (_SPACE[raw] & ~_SPACE[before]) | (_SIGN[raw] & _ALNUM[before])
        cut[edges[:-1][edges[:-1] < len(raw)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(raw))
        hashes = textkit.span_hashes(raw, start, end)
        seen, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, seen)
        new = np.ones(len(seen), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != seen
        if new.any():
            self._learn(raw, start[first[new]], end[first[new]], seen[new])
            at = np.searchsorted(self.known, seen)
        place = self.place[at][inverse]
        size = (self.ends[1:] - self.ends[:-1])[place]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.ends[:-1][place] - (total - size), size) + np.arange(total[-1])]
        # pieces do not cross edges, so an edge lies behind the last piece that starts before it
        ends = np.concatenate([[0], total])[np.searchsorted(start, edges[1:])]
        return ids, ends

    def _same(self, raw: np.ndarray, ids: np.ndarray) -> bool:
        n = self.length[ids]
        total = np.cumsum(n)
        if not len(raw) or total[-1] != len(raw):
            return not len(raw)
        return np.array_equal(self.bytes[np.repeat(self.first[ids] - (total - n), n) + np.arange(total[-1])], raw)

    def encode(self, column, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of texts, the end id behind each text, and the number of ids of each text."""
        if len(self.known) > KNOWN_PIECES or len(self.ids) > KNOWN_IDS:
            self._forget()
        raw, offsets = textkit.buffers(column)
        n = len(offsets) - 1
        odd = np.zeros(n, bool)
        hit = np.flatnonzero(_ODD[raw])
        lead = np.flatnonzero(_LEAD[raw])
        near = [raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int64) for k in range(3)] if len(lead) else [lead] * 3
        wide = np.isin(near[0] << 8 | near[1], _PAIRS) | np.isin(near[0] << 16 | near[1] << 8 | near[2], _TRIPLES)
        odd[np.searchsorted(offsets, lead[wide], side="right") - 1] = True
        odd[np.searchsorted(offsets, hit, side="right") - 1] = True
        parts: list = [None] * n
        row = 0
        while row < n:
            if odd[row] or offsets[row + 1] == offsets[row]:
                row += 1
                continue
            to = row + 1  # rows that make up a segment
            while to < n and not odd[to] and offsets[to + 1] - offsets[row] <= _SEGMENT:
                to += 1
            base = int(offsets[row])
            edges = offsets[row : to + 1] - base
            text = raw[base : int(offsets[to])]
            if len(text) <= 2 * _SEGMENT:
                ids, ends = self._pieces(text, edges)
                good = self._same(text, ids)
                for i, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())):
                    parts[row + i] = ids[a:b] if good else None
            else:  # one long text, cut before spaces
                found, at = [], 0
                while at < len(text):
                    stop = _next_cut(text, at + _SEGMENT)
                    found.append(self._pieces(text[at:stop], np.array([0, stop - at]))[0])
                    at = stop
                ids = np.concatenate(found)
                parts[row] = ids if self._same(text, ids) else None
            row = to
        left = [i for i in range(n) if parts[i] is None and offsets[i + 1] > offsets[i]]
        for i, ids in zip(left, self._whole([raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in left])):
            parts[i] = np.array(ids, np.uint32)
        end, none = np.array([end_id], np.uint32), np.zeros(0, np.uint32)
        sizes = np.array([1 + (0 if p is None else len(p)) for p in parts], np.int64)
        joined = [x for p in parts for x in (none if p is None else p, end)]
        return np.concatenate(joined) if joined else none, sizes


def _next_cut(text: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where a space follows another character; the end if there is none."""
    while at < len(text):
        window = _SPACE[text[at - 1 : at + 65536]]
        hit = np.flatnonzero(window[1:] & ~window[:-1])
        if len(hit):
            return at + int(hit[0])
        at += 65536
    return len(text)


def frame(kind: bytes, payload: bytes) -> bytes:
    return b"TRF1" + kind + struct.pack("<QI", len(payload), zlib.crc32(payload)) + payload


def frames(data: memoryview) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(data):
        if bytes(data[at : at + 4]) != b"TRF1":
            raise ValueError(f"no frame at {at}")
        kind = bytes(data[at + 4 : at + 5])
        n, crc = struct.unpack_from("<QI", data, at + 5)
        payload = bytes(data[at + 17 : at + 17 + n])
        if len(payload) != n or zlib.crc32(payload) != crc:
            raise ValueError(f"checksum of the frame at {at} differs")
        yield kind, payload
        at += 17 + n + 1


def _checksums(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    cut = np.concatenate([[0], np.cumsum(sizes)]) * 4
    return np.array([zlib.crc32(data[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], np.uint32)


def segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    """Frames of some documents with a frequency table of their own."""
    table = rans.Table.of(ids)
    yield frame(b"T", table.dump())
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    directory = struct.pack("<I", len(doc_ids)) + known.tobytes() + numbers.tobytes() + sizes.astype("<i8").tobytes() \
        + _checksums(ids, sizes).astype("<u4").tobytes()
    yield frame(b"D", zlib.compress(directory, 6))
    size = rans.LANES * rans.ROWS
    for at in range(0, len(ids), size):
        yield frame(b"B", rans.encode_block(ids[at : at + size], table))


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer_path: str, end_id: int, files: int) -> None:
    """Encode the texts of docs (doc_id, text) and write them in ascending order of doc_id, a file per range of ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, held = None, []

        def flush() -> Iterator:
            n = [x for x in held]
            held.clear()
            doc_ids = [d for x in n for d in x[0]]
            for out in segment(doc_ids, np.concatenate([x[2] for x in n]), np.concatenate([x[1] for x in n])):
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["frame"])

        for batch in textkit.batched(batches, 2 << 20):
            encoder = encoder or Encoder(shared.value)
            ids, sizes = encoder.encode(batch.column(1), end_id)
            held.append((batch.column(0).to_pylist(), ids.astype(np.uint16 if ids.max() < 1 << 16 else np.uint32), sizes))
            if sum(len(x[1]) for x in held) > SEGMENT_TOKENS:
                yield from flush()
        if held:
            yield from flush()

    order = ["doc_id", "crc"]
    rows = docs.withColumn("crc", F.crc32(F.col("text").cast("binary"))).repartitionByRange(files, *order)
    rows = rows.sortWithinPartitions(*order, "text").select("doc_id", "text")
    rows.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string").alias("value")).write.mode(
        "overwrite").option("lineSep", "\n").text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document in the files: doc_id, file_no, seq (place in the file), n_tokens, ids_crc32, and the ids
    themselves if asked for. The checksum is computed from the decoded ids and compared with the stored one."""

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                number = int(re.search(r"part-(\d+)", name.rsplit("/", 1)[-1]).group(1))
                seq, table, slots, parts, directory = 0, None, None, [], None
                for kind, payload in [*_with_end(memoryview(data.as_buffer()))]:
                    if kind == b"B":
                        parts.append(rans.decode_block(payload, table, slots))
                        continue
                    if kind in (b"T", b"") and directory is not None:
                        yield _rows(number, seq, directory, np.concatenate(parts), with_ids, pa)
                        seq += len(directory[0])
                        parts, directory = [], None
                    if kind == b"T":
                        table = rans.Table.load(payload)
                        slots = table.slots()
                    elif kind == b"D":
                        directory = _directory(payload)

    kinds = "doc_id long, file_no int, seq long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, kinds)


def _with_end(data: memoryview) -> Iterator[tuple[bytes, bytes]]:
    yield from frames(data)
    yield b"", b""


def _directory(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    raw = zlib.decompress(payload)
    n = struct.unpack_from("<I", raw)[0]
    known = np.frombuffer(raw, np.uint8, n, 4)
    numbers = np.frombuffer(raw, "<i8", n, 4 + n)
    sizes = np.frombuffer(raw, "<i8", n, 4 + 9 * n)
    return [d if k else None for d, k in zip(numbers.tolist(), known.tolist())], sizes, np.frombuffer(raw, "<u4", n, 4 + 17 * n)


def _rows(number: int, seq: int, directory: tuple, ids: np.ndarray, with_ids: bool, pa):
    doc_ids, sizes, stored = directory
    if int(sizes.sum()) != len(ids):
        raise ValueError("the blocks do not hold what the directory lists")
    crc = _checksums(ids, sizes)
    if not np.array_equal(crc, stored):
        raise ValueError("checksum of a document differs")
    n = len(doc_ids)
    columns = [pa.array(doc_ids, pa.int64()), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(seq, seq + n)),
               pa.array(sizes), pa.array(crc.astype(np.int64))]
    names = ["doc_id", "file_no", "seq", "n_tokens", "ids_crc32"]
    if with_ids:
        cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, doc_id: str = "doc_id",
                text: str = "text", path: str | None = None) -> DataFrame:
    """Write the ids of all texts to files and read them back: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, file_no, seq. The files stay in ``path`` (below the shared folder if none is given) as long as the session.

    Nulls: a null text is empty and has the end id alone; a null id comes first. Repeated rows and ids are kept, in the
    order of their checksums and texts. An empty table gives an empty result; other columns are ignored. A text of any
    length is encoded whole."""
    ready(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = path or fresh_folder(spark)
    write_tokens(spark, rows, path, tokenizer_path, end_id, max(1, -(-total // FILE_BYTES)))
    read = Stored(spark).keep(read_tokens(spark, path))
    return running_totals(read, "file_no", ["seq"], "n_tokens", "start", "number").select(
        "doc_id", "start", "n_tokens", "ids_crc32", "file_no", "seq")

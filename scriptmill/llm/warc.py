"""Web archives: writing WARC records, reading them back, and merging their indexes into capture histories."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import textkit
from scriptmill.llm.common import Stored, fresh_folder, partitions, ready, running_totals

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
# A gzip member ends with the size of its data, so its last byte is zero below 16 MB; that byte is what Spark's text
# writer puts after each line. A larger record gets an empty member behind it, whose last byte is zero too.
_BREAK = "\u0000"
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff" "0300" "00000000" "00000000")
FIRST_CAPTURE = "2024-01-01 00:00:00"


def surt(url: str) -> str:
    """Sort-friendly key of a URL: host parts reversed, no scheme, user, port 80/443 or fragment, lower-cased host."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url or "")
    host, port, rest = m.group(1).lower(), m.group(2), m.group(3)
    port = f":{port}" if port and port not in ("80", "443") else ""
    return f"{','.join(reversed(host.split('.')))}{port}){rest or '/'}"


def with_revisits(pages: DataFrame, revisit_bytes: int, store: Stored) -> DataFrame:
    """Add payload digests and, for a row whose payload an equal one with a larger id stands for, that id (refers_to).

    Payloads are equal if their SHA-256, SHA-1 and length are. The groups are counted before the shuffle, so a payload
    that a third of the pages share is a few rows; the join back has a stored right side, and skewed keys are split."""
    big = F.col("payload_bytes") >= revisit_bytes
    digests = store.keep(pages.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("sha256"),
        F.sha1("payload").alias("payload_digest")).filter(big))
    groups = store.keep(digests.groupBy("sha256", "payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("original"), F.count(F.lit(1)).alias("m")).filter("m > 1").select(
        F.col("sha256").alias("g"), "original"))
    rows = digests.join(groups, F.col("sha256") == F.col("g")).filter("page_id < original")
    refers = store.keep(rows.select(F.col("page_id").alias("revisit_id"), "original").distinct())
    # page ids are spread evenly, so this join has no hot key but for repeated rows of one id
    return pages.join(refers, F.col("page_id") == F.col("revisit_id"), "left").withColumn(
        "refers_to", F.when(F.octet_length("payload") >= revisit_bytes, F.col("original"))).drop("revisit_id", "original")


def _member(page_id, url, date: str, payload: bytes, refers_to) -> bytes:
    sha1 = hashlib.sha1(payload).digest()
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m.group()):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block = http + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = http
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = gz.compress(record) + gz.flush()
    return out[:-1] if len(record) < 1 << 24 else out + _EMPTY_MEMBER[:-1]


def write_archives(pages: DataFrame, path: str, files: int) -> None:
    """Write rows (page_id, url, payload, captured_at, refers_to) as gzipped WARC files, a member per record. The rows are
    dealt by a hash of id and url and sorted by them, so a task that runs again writes the same file."""

    def records(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in textkit.batched(batches):
            ids, urls, dates, bodies, refers = (batch.column(i).to_pylist() for i in range(5))
            members = [_member(i, u, d, b or b"", r) for i, u, d, b, r in zip(ids, urls, dates, bodies, refers)]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    date = F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    dealt = pages.select("page_id", "url", date.alias("date"), F.col("payload"), "refers_to").repartition(
        files, F.xxhash64("page_id", "url")).sortWithinPartitions("page_id", "url")
    dealt.mapInArrow(records, "member binary").select(F.col("member").cast("string").alias("value")).write.mode(
        "overwrite").option("lineSep", _BREAK).text(path)


def _header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m.group(1)) if m else None


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every gzip member that holds something."""
    at = 0
    while at < len(data):
        gz = zlib.decompressobj(31)
        record = gz.decompress(data[at:] if at else data)
        record += gz.flush()
        if not gz.eof:
            raise ValueError(f"the archive ends inside the member at {at}")
        to = len(data) - len(gz.unused_data)
        if record:
            yield at, to - at, record
        at = to


RECORD = ("page_id long, url_key string, url string, date string, payload_bytes long, payload_digest string, "
          "record_type string, refers_to long, payload binary")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Read WARC files: one row per record, with its file, offset and length. The payload of a response is measured and
    its digest computed and compared with the header; a revisit has no payload, its length and digest are those it states.
    ``payloads`` returns the bytes too."""

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                held = 0
                for at, length, record in _windowed(memoryview(data.as_buffer())):
                    head, _, rest = record.partition(b"\r\n\r\n")
                    h = _header(head)
                    block = rest[: int(h["content-length"])]
                    body = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                    stated = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if body is not None and hashlib.sha1(body).hexdigest() != stated:
                        raise ValueError(f"payload digest differs in {file} at {at}")
                    n = len(body) if body is not None else int(h["x-payload-length"])
                    uri = h["warc-target-uri"]
                    rows.append((_page(h["warc-record-id"]), surt(uri), uri, h["warc-date"], n, stated, h["warc-type"],
                                 _page(h.get("warc-refers-to")), body if payloads else None, file, at, length))
                    held += len(record)
                    if held > 4 << 20:
                        yield _batch(rows, pa)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, pa)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, RECORD + ", file string, offset long, length long")


def _windowed(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """``members`` over a large file, without copying what is left of it for every member."""
    at, window = 0, 1 << 16
    while at < len(data):
        gz, parts, pos = zlib.decompressobj(31), [], at
        while not gz.eof:
            if pos >= len(data):
                raise ValueError(f"the archive ends inside the member at {at}")
            parts.append(gz.decompress(data[pos : pos + window]))
            pos = min(len(data), pos + window)
        to = pos - len(gz.unused_data)
        if record := b"".join(parts):
            yield at, to - at, record
        at = to


def _batch(rows: list[tuple], pa):
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
             pa.binary(), pa.string(), pa.int64(), pa.int64()]
    names = ["page_id", "url_key", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload",
             "file", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class LoserTree:
    """Merges k sorted runs: inner nodes hold the loser of their match, so the next head costs log k comparisons along
    one path. A run is a list of sort keys; ``take`` gives (run, position) in merged order."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.losers = [-1] * max(1, self.k)
        winner = [0] * (2 * self.k)
        for i in range(self.k):
            winner[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.best = winner[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def take(self) -> Iterator[tuple[int, int]]:
        for _ in range(sum(map(len, self.runs))):
            run = self.best
            yield run, self.at[run]
            self.at[run] += 1
            node = (self.k + run) // 2
            while node:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.best = run


def merge_indexes(spark: SparkSession, index: DataFrame, store: Stored) -> DataFrame:
    """Sorted runs of capture lines (one per archive file) merged into one order by (url_key, date, page_id, file, offset):
    adds capture_number, gapless from 0 over all captures, and nth_capture, from 0 within a URL.

    Key ranges are dealt to tasks, each gets its stretch of every run and merges the stretches with a loser tree. A range is
    cut by the full key, so a URL with a third of all captures spreads over many tasks."""
    key = ["url_key", "date", "page_id", "file", "offset"]
    run_sorted = index.repartition("file").sortWithinPartitions("file", *key)
    runs = store.keep(run_sorted.withColumn("place", F.monotonically_increasing_id()))
    schema = runs.drop("place").schema
    columns = [f.name for f in schema]

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = list(batches)  # index lines of one range, without payloads
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        # the stretches of runs lie one after the other, each in its own order
        files = table.column("file").to_pylist()
        keys = list(zip(*(table.column(c).to_pylist() for c in key)))
        keys = [(u, d, p is not None, p or 0, f, o) for u, d, p, f, o in keys]
        cuts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]] + [len(files)]
        tree = LoserTree([keys[a:b] for a, b in zip(cuts, cuts[1:])])
        order = pa.array([cuts[run] + at for run, at in tree.take()], pa.int64())
        merged = table.take(order).select(columns)
        n = pa.array(range(len(order)), pa.int64())
        yield from merged.append_column("at", n).to_batches(max_chunksize=20_000)

    ranges = runs.repartitionByRange(partitions(spark), *key).sortWithinPartitions("file", "place")
    merged = ranges.mapInArrow(merge, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", at long")
    merged = store.keep(merged.withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1)))
    numbered = store.keep(running_totals(merged, "part", ["at"], "one", "n", "capture_number").drop("n", "one", "at", "part"))
    first = store.keep(numbered.groupBy("url_key").agg(F.min("capture_number").alias("first")).withColumnRenamed("url_key", "u"))
    return numbered.join(first, F.col("url_key") == F.col("u")).withColumn(
        "nth_capture", F.col("capture_number") - F.col("first")).drop("u", "first")


def archive(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            captured_at: str | None = None, revisit_bytes: int = REVISIT_BYTES, path: str | None = None) -> DataFrame:
    """Write a WARC record per row, read the archives back and merge their indexes. One row per record, from the files:
    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, date, file, offset, length, capture_number,
    nth_capture.

    Of equal payloads of ``revisit_bytes`` or more the one with the largest id is the response. The archive files stay in
    ``path`` (below the shared folder if none is given) as long as the session.

    Nulls: a null payload is empty, a null URL has an empty target and the key ")/", a null id is written as an empty
    number and is never a revisit (nor an original, unless all ids of its group are null). Repeated rows are records of
    their own: if several have the largest id of a payload, each is a response. Without ``captured_at`` the date is a fixed
    day plus page_id seconds. An empty table gives an empty result; other columns are ignored."""
    ready(spark)
    store = Stored(spark)
    when = F.col(captured_at) if captured_at else F.lit(FIRST_CAPTURE).cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.pmod(F.coalesce(F.col(page_id), F.lit(0)), F.lit(1_000_000_000)).cast("decimal(18,6)"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"), when.alias("captured_at"))
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    path = path or fresh_folder(spark)
    write_archives(with_revisits(rows, revisit_bytes, store), path, max(1, -(-total // ARCHIVE_BYTES)))
    index = store.keep(read_archives(spark, path, payloads=False).drop("payload", "url"))
    return merge_indexes(spark, index, store).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "date", "file", "offset",
        "length", "capture_number", "nth_capture")

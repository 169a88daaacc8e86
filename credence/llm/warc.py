"""Web archives: WARC records written and read back, and one globally ordered index of all captures.

Records lie in archives: runs of WARC/1.1 records, each its own gzip member, one archive per row
of a stored table, so that writing is committed by Spark and any executor can read any archive.
An archive is closed at `archive_bytes`; a longer record makes a longer archive of its own.

The index is an external merge. Every archive gives one run of captures sorted by URL key and
timestamp. Runs are dealt by ranges of (URL key, timestamp, page), so a popular URL is spread
over tasks, and each task merges what it has of all runs by a loser tree.

Of records with equal payloads of at least `revisit_from` bytes the one with the largest page_id
is a response and the others revisit it, whole ties included; a revisit record carries no
payload, and its length and digest are those of the full payload. Pages without a page_id are left out. Null html is an empty payload,
null urls are empty. Repeated rows give repeated records. Extra columns are left out. An empty
table gives empty archives and an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.session import settle

ARCHIVE_BYTES = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
INDEX = "url_key string, timestamp string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, place long, size long"
FIELDS = [f.split()[0] for f in INDEX.split(", ")]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def capture_date(page_id: int) -> str:
    """Pages have no time of capture: one second per id, in order of the ids."""
    return (FIRST_CAPTURE + timedelta(seconds=page_id % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, in lower case, without scheme or www."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower())
    host, slash, path = re.sub(r"#.*$", "", rest).partition("/")
    host = re.sub(r"^www\d*\.", "", host.rpartition("@")[2])
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if colon and port not in ("80", "443") else "") + ")/" + (path if slash else "")


def record(page_id: int, url: str, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record as its own gzip member."""
    revisit = refers_to is not None
    # HTTP's blank line ends the headers; a payload may hold anything, its length is stated.
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {capture_date(page_id)}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def members(archive: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Place, size and content of every gzip member."""
    import zlib

    at = 0
    while at < len(archive):
        unpack = zlib.decompressobj(31)
        content = unpack.decompress(memoryview(archive)[at:]) + unpack.flush()
        size = len(archive) - at - len(unpack.unused_data)
        yield at, size, content
        at += size


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record; refuses a torn one."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    length = int(fields["content-length"])
    if version != "WARC/1.1" or rest[length:] != b"\r\n\r\n":
        raise ValueError("torn WARC record")
    return fields, rest[:length]


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html with payload_bytes and payload_digest."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [p.as_buffer() if p.is_valid else b"" for p in batch.column(2).cast(pa.binary())]
            found = [payload_digest(p) for p in payloads]
            sizes = [len(p) if isinstance(p, bytes) else p.size for p in payloads]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=["page_id", "url", "html", "payload_bytes", "payload_digest"])

    return pages.select("page_id", "url", "html").filter("page_id is not null").mapInArrow(digests, "page_id long, url string, html string, payload_bytes long, payload_digest string")


def write_archives(pages: DataFrame, revisit_from: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, content: stored archives that hold one record per row of `pages`."""
    digested = with_digests(pages)
    long_enough = digested.filter(F.col("payload_bytes") >= F.lit(revisit_from))
    # The map side reduces every digest to one row, so a payload any number of pages share never gathers.
    kept = long_enough.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    # Only payloads that occur more than once matter. Pages are not dealt by digest but meet this table by a join Spark can split.
    shared = kept.filter("copies > 1").select("payload_digest", "kept_id")
    refers = F.when((F.col("payload_bytes") >= F.lit(revisit_from)) & (F.col("kept_id") != F.col("page_id")), F.col("kept_id"))
    ready = digested.join(shared, "payload_digest", "left").select(
        "page_id", "url", refers.alias("refers_to"), "payload_bytes", "payload_digest", F.when(refers.isNull(), F.col("html")).alias("html")
    )

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first = io.BytesIO(), 0, None
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(6)), strict=True):
                page_id, url, refers_to, length, digest, html = (x.as_py() for x in row)
                piece = record(page_id, url or "", (html or "").encode(), digest, length, refers_to)
                if held.tell() and held.tell() + len(piece) > archive_bytes:
                    yield _archive(first, held)
                    held, first = io.BytesIO(), None
                first = page_id if first is None else first
                held.write(piece)
        if held.tell():
            yield _archive(first, held)

    return settle(ready.mapInArrow(archives, "archive string, content binary"))


def _archive(first: int, held: io.BytesIO) -> pa.RecordBatch:
    content = held.getvalue()
    name = f"pages-{first}-{hashlib.sha1(content).hexdigest()[:16]}.warc.gz"
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])


def capture_runs(archives: DataFrame) -> DataFrame:
    """The captures of every archive as one run sorted by URL key, timestamp and page.

    A response's digest is computed from the payload read back and must be the recorded one.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for place, size, record_bytes in members(content.as_buffer()):
                    fields, block = parse(record_bytes)
                    payload = block.partition(b"\r\n\r\n")[2]
                    http = dict(line.split(": ", 1) for line in block.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind, length = fields["warc-type"], int(http["Content-Length"])
                    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
                        raise ValueError(f"payload differs from its digest in {name} at {place}")
                    target = fields.get("warc-refers-to")
                    page = int(fields["warc-record-id"][10:-1])
                    stamp = re.sub(r"\D", "", fields["warc-date"])
                    url = fields["warc-target-uri"]
                    rows.append((url_key(url), stamp, page, url, kind, length, digest, int(target[10:-1]) if target else None, name, place, size))
                rows.sort(key=lambda r: r[:3])
                yield _captures(rows)

    return archives.select("archive", "content").mapInArrow(runs, INDEX)


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[f.split()[1]]) for c, f in zip(columns, INDEX.split(", "), strict=True)], names=FIELDS)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = runs, key
        self.heads: list = [next(r, None) for r in runs]
        self.keys: list = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, len(runs))
        for leaf in range(len(runs)):
            self._rise(leaf, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _rise(self, winner: int, filling: bool = False) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            rival = self.losers[node]
            if rival < 0 and filling:
                self.losers[node] = winner
                return
            if self._beats(rival, winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and self.keys[self.losers[0]] is not None:
            best = self.losers[0]
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            self.keys[best] = None if self.heads[best] is None else self.key(self.heads[best])
            self._rise(best)


def merge_runs(runs: DataFrame, batch_rows: int = 10_000) -> DataFrame:
    """All captures, in order of URL key, timestamp and page within and across partitions."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches, schema) if (batches := list(batches)) else None
        if whole is None:
            return
        whole = whole.combine_chunks()
        names = whole.column("archive").to_pylist()
        keys = list(zip(*(whole.column(c).to_pylist() for c in FIELDS[:3]), strict=True))
        edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        merged = list(LoserTree([iter(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)], keys.__getitem__))
        yield from whole.take(pa.array(merged, pa.int64())).combine_chunks().to_batches(max_chunksize=batch_rows)

    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in INDEX.split(", ")])
    # Sorting by archive first keeps every run in one piece; in it the order is the one it was written in.
    dealt = runs.repartitionByRange("url_key", "timestamp", "page_id").sortWithinPartitions("archive", "url_key", "timestamp", "page_id")
    return dealt.mapInArrow(merge, INDEX)


def archive_pages(pages: DataFrame, revisit_from: int = 0) -> tuple[DataFrame, DataFrame]:
    """Writes the archives and returns them with the merged index read back from them."""
    archives = write_archives(pages, revisit_from)
    return archives, merge_runs(settle(capture_runs(archives)))


def read_payloads(archives: DataFrame, index: DataFrame) -> DataFrame:
    """page_id and payload of every capture, a revisit's taken from the response it refers to."""

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [parse(c) for _, _, c in members(content.as_buffer())]
                kept = [(int(f["warc-record-id"][10:-1]), b.partition(b"\r\n\r\n")[2]) for f, b in rows if f["warc-type"] == "response"]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([p for _, p in kept], pa.binary())], names=["kept_id", "payload"])

    stored = archives.select("content").mapInArrow(payloads, "kept_id long, payload binary").dropDuplicates(["kept_id"])
    wanted = index.select("page_id", F.coalesce("refers_to", "page_id").alias("kept_id"))
    return wanted.join(stored, "kept_id").select("page_id", "payload")

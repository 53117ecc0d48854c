"""WARC archives with a two-level capture index.

Pages are sorted by their reversed-host key (`com,example,www)/path`) and id, dealt out by range. Each task
streams its rows into archives (one gzip member per record) and at the same time into its part of the
index: lines in key order, `block_lines` to a compressed block, and a sparse directory with the first key
of each block. A lookup sends every key to the part whose range holds it; there, it searches the
directory, reads one block by its range, searches the lines, and reads one record by its range.

Pages with equal payloads of at least `min_bytes` are stored once: the smallest page_id is the response,
the others are revisits that refer to it.

Files go through `pyarrow.fs`, to any store it knows. Each attempt of a task writes files of its own, and
only the files of attempts that Spark commits are named in the parts table, so a lost executor costs a
repeated task and nothing else.

Cases: a NULL html is an empty payload; a NULL url has the key `-` and no target; a NULL page_id sorts
last and is a response only where no equal payload has an id; rows that tie on the smallest page_id are
all responses; equal rows are records each; an empty table gives no archive and an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from base64 import b32encode
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.llm.common import pieces, settle, shared_folder, tidy

COLUMNS = {"page_id": "bigint", "url": "string", "html": "string"}
LAST = (1 << 63) - 1
CAPTURE = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "target_uri string, payload string")
# Fixed value of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_host_key(url: Column) -> Column:
    """`https://www.Example.com:8080/a?b#c` -> `com,example,www:8080)/a?b`."""
    part = lambda k: F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://(?:[^/?#@]*@)?([^/:?#]*)(:[0-9]*)?)?([^#]*)", k)
    host = F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ",")
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    return F.when(url.isNull(), F.lit("-")).otherwise(F.concat(host, part(2), F.lit(")"), path))


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    seed = str(page_id) if page_id is not None else f"{url}\n{digest}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(seed.encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, url, digest)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, None, digest)), ("X-Refers-To-Page", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """One record; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[:int(named["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = named["WARC-Type"]
    if kind == "response" and (len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {named['WARC-Record-ID']}")
    number = lambda k: int(named[k]) if k in named else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": number("X-Refers-To-Page"), "target_uri": named.get("WARC-Target-URI"),
            "payload": payload.decode() if kind == "response" else None}


class _Part:
    """What one task writes: archives of limited size, and its part of the index."""

    def __init__(self, folder: str, file_bytes: int, block_lines: int):
        self.fs, self.base = _store(folder)
        self.name, self.file_bytes, self.block_lines = uuid.uuid4().hex, file_bytes, block_lines
        self.archive, self.number, self.at = None, -1, 0
        self.index, self.index_at, self.lines, self.directory, self.last = None, 0, [], [], None

    def _open(self, name: str):
        return self.fs.open_output_stream(f"{self.base}/{name}", compression=None)

    def add(self, key: tuple[str, int], raw: bytes) -> None:
        if self.archive is None or self.at >= self.file_bytes:
            if self.archive:
                self.archive.close()
            self.number, self.at = self.number + 1, 0
            self.archive = self._open(f"{self.name}-{self.number:05d}.warc.gz")
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.archive.write(packed)
        self.lines.append([*key, self.number, self.at, len(packed)])
        self.at, self.last = self.at + len(packed), key
        if len(self.lines) >= self.block_lines:
            self._flush()

    def _flush(self) -> None:
        if self.index is None:
            self.index = self._open(f"{self.name}.idx")
        packed = zlib.compress("\n".join(json.dumps(x) for x in self.lines).encode())
        self.index.write(packed)
        self.directory.append([self.lines[0][0], self.lines[0][1], self.index_at, len(packed)])
        self.index_at, self.lines = self.index_at + len(packed), []

    def close(self) -> list[tuple]:
        if self.archive is None:
            return []
        if self.lines:
            self._flush()
        self.archive.close()
        self.index.close()
        with self._open(f"{self.name}.dir") as f:
            f.write(zlib.compress(json.dumps(self.directory).encode()))
        return [(self.name, *self.directory[0][:2], *self.last, len(self.directory))]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads travel compressed: they are shuffled twice, and text packs far better by itself than in a shuffle block."""
    for b in pieces(batches, "html"):
        packed = [zlib.compress((h or "").encode(), 6) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("twin"), pa.array(packed, pa.binary())],
                                         names=["page_id", "url", "twin", "packed"])


def _write(folder: str, file_bytes: int, block_lines: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part(folder, file_bytes, block_lines)
        for b in pieces(batches, "packed"):
            for key, rank, page, url, packed, refers in zip(*(b.column(c).to_pylist() for c in ("key", "rank", "page_id", "url", "packed", "refers_to"))):
                part.add((key, rank), record(page, url, zlib.decompress(packed), refers, date))
        rows = part.close()
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["part", "first_key", "first_rank", "last_key", "last_rank", "blocks"]),
                                         schema=pa.schema([("part", pa.string()), ("first_key", pa.string()), ("first_rank", pa.int64()),
                                                           ("last_key", pa.string()), ("last_rank", pa.int64()), ("blocks", pa.int64())]),
                                         preserve_index=False)

    return run


@dataclass
class Archive:
    folder: str
    parts: DataFrame  # one row per part: name, first and last key, number of blocks


def write_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, file_bytes: int = 1 << 30,
                  block_lines: int = 3000, date: str = "2024-01-01T00:00:00Z") -> Archive:
    spark = pages.sparkSession
    folder = f"{folder or shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    html = F.coalesce("html", F.lit(""))
    p = tidy(pages, COLUMNS).withColumn("sha", F.unhex(F.sha1(html)))
    p = p.withColumn("twin", F.when(F.octet_length(html) >= min_bytes, F.col("sha")))
    keepers = (
        p.filter("twin IS NOT NULL").groupBy("twin").agg(F.min("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND keeper IS NOT NULL").select(F.col("twin").alias("t"), "keeper")
    )
    refers = F.when(F.coalesce(F.col("page_id") != F.col("keeper"), F.col("keeper").isNotNull()), F.col("keeper"))
    rows = (
        p.select("page_id", "url", "html", "twin").mapInArrow(_pack, "page_id long, url string, twin binary, packed binary")
        .join(keepers, F.col("twin") == F.col("t"), "left")
        .select("page_id", "url", "packed", refers.alias("refers_to"), reversed_host_key(F.col("url")).alias("key"),
                F.coalesce("page_id", F.lit(LAST)).alias("rank"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = (
        rows.repartitionByRange(parts, "key", "rank").sortWithinPartitions("key", "rank")
        .mapInArrow(_write(folder, file_bytes, block_lines, date),
                    "part string, first_key string, first_rank long, last_key string, last_rank long, blocks long")
    )
    return Archive(folder, settle(written))


class _Reader:
    """One part of the archive, opened for lookups."""

    def __init__(self, folder: str, part: str):
        self.fs, self.base = _store(folder)
        self.part, self.open, self.block = part, {}, (None, None, None)
        self.directory = json.loads(zlib.decompress(self._file(f"{part}.dir").read()))
        self.keys = [(k, r) for k, r, _, _ in self.directory]

    def _file(self, name: str):
        if name not in self.open:
            self.open[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return self.open[name]

    def _range(self, name: str, at: int, size: int) -> bytes:
        return self._file(name).read_at(size, at)

    def _lines(self, number: int) -> tuple[list, list]:
        if self.block[0] != number:
            _, _, at, size = self.directory[number]
            lines = [json.loads(x) for x in zlib.decompress(self._range(f"{self.part}.idx", at, size)).split(b"\n")]
            self.block = (number, lines, [(x[0], x[1]) for x in lines])
        return self.block[1:]

    def find(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[dict]:
        """Records with low <= key <= high."""
        number = max(0, bisect_left(self.keys, low) - 1)
        while number < len(self.keys) and self.keys[number] <= high:
            lines, keys = self._lines(number)
            for i in range(bisect_left(keys, low), bisect_right(keys, high)):
                _, _, file, at, size = lines[i]
                raw = self._range(f"{self.part}-{file:05d}.warc.gz", at, size)
                yield parse(zlib.decompress(raw, 31))
            number += 1

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def _parts_of(bounds: list[tuple]):
    """Adds the parts in which a key may lie."""
    lasts = [(b[3], b[4]) for b in bounds]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, low, high in zip(b.key, b.low, b.high):
                k = bisect_left(lasts, (key, low))
                while k < len(bounds) and (bounds[k][1], bounds[k][2]) <= (key, high):
                    rows.append((bounds[k][0], key, low, high))
                    k += 1
            if not rows:
                continue
            yield pd.DataFrame(rows, columns=["part", "key", "low", "high"])

    return run


def _look_up(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        reader = None

        def pack(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in zip(names, types)], names=names)

        for b in batches:
            found, size = [], 0
            for part, key, low, high in zip(*(b.column(c).to_pylist() for c in ("part", "key", "low", "high"))):
                if reader is None or reader.part != part:
                    if reader:
                        reader.close()
                    reader = _Reader(folder, part)
                for capture in reader.find((key, low), (key, high)):
                    found.append(capture)
                    size += capture["payload_bytes"]
                    if size > 4_000_000:
                        yield pack(found)
                        found, size = [], 0
            yield pack(found)
        if reader:
            reader.close()

    return run


def look_up(archive: Archive, queries: DataFrame) -> DataFrame:
    """The captures of each distinct (url, page_id) of `queries`; without page_id, of each url.

    The driver and each task hold one row per part; parts are as many as the writing job had tasks.
    """
    spark = queries.sparkSession
    bounds = sorted(map(tuple, archive.parts.collect()), key=lambda b: (b[1], b[2]))
    by_id = "page_id" in queries.columns
    rank = F.coalesce(F.col("page_id"), F.lit(LAST)) if by_id else None
    keys = queries.select(reversed_host_key(F.col("url")).alias("key"), (rank if by_id else F.lit(-LAST - 1)).alias("low"),
                          (rank if by_id else F.lit(LAST)).alias("high")).distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        keys.mapInPandas(_parts_of(bounds), "part string, key string, low long, high long")
        .repartition(n, "part").sortWithinPartitions("part", "key", "low")
        .mapInArrow(_look_up(archive.folder), CAPTURE)
    )

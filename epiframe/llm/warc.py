"""WARC records in seekable Zstandard bundles (operator 3).

A bundle is a WARC file compressed as independent Zstandard frames of whole records, followed by the seek table of the
public seekable format (a skippable frame that lists each frame's compressed and plain size, and a footer). An index
table maps each record to its bundle, frame, and offset inside the plain frame, so that one record costs one frame.

Records with equal payloads of at least ``REVISIT_BYTES`` bytes are stored once: the one with the largest page_id is
the response, the others are revisits that refer to it and keep only its headers.

Defined cases: a null html is an empty payload; a null url gives no target URI; rows that repeat the largest page_id
of a payload are all responses; a null page_id is smaller than any other and gives the record id ``urn:x-page:null``;
a payload of any length is one record, in a frame of its own if it is longer than ``FRAME_BYTES``; a url that has to be
escaped in the header also stands there as it is; an empty table gives no bundle and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, open_in, open_out, shared_path, slices, small_side

REVISIT_BYTES = 1000
#: Keys into which a shared payload is dealt where digests are joined by shuffle.
SALTS = 32
FRAME_BYTES = 1 << 20
SLICE_BYTES = 8 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, path string, frame long, offset long, length long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; digest is the payload's SHA-1 in hex."""
    name = lambda x: f"<urn:x-page:{'null' if x is None else x}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        coded = quote(url, safe="%/:=&?~#+!$,;@()*[]'")
        head += [f"WARC-Target-URI: {coded}"]
        head += [f"X-Source-URL: {base64.b64encode(url.encode()).decode()}"] if coded != url else []  # escapes can't be told from the url's own
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a place of a plain frame, and the place after it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = data[end + 4 : (stop := end + 4 + int(head["Content-Length"]))]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda x: None if x is None or x.endswith(":null>") else int(x[len("<urn:x-page:") : -1])
    return {
        "page_id": number(head["WARC-Record-ID"]), "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To")),
        "target_uri": base64.b64decode(head["X-Source-URL"]).decode() if "X-Source-URL" in head else head.get("WARC-Target-URI"),
        "payload": payload, "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]), "payload_digest": base64.b32decode(head["WARC-Payload-Digest"][5:]).hex(),
    }, stop + 4


class BundleWriter:
    """Writes a bundle frame by frame; holds one plain frame and the seek table."""

    def __init__(self, uri: str):
        self.uri, self.out, self.zstd = uri, open_out(uri), zstandard.ZstdCompressor(level=LEVEL)
        self.parts, self.size, self.table = [], 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record added."""
        if self.parts and self.size + len(data) > FRAME_BYTES:
            self.flush()
        at = self.size
        self.parts.append(data)
        self.size += len(data)
        return len(self.table), at

    def flush(self) -> None:
        packed = self.zstd.compress(b"".join(self.parts))
        self.out.write(packed)
        self.table.append((len(packed), self.size))
        self.parts, self.size = [], 0

    def close(self) -> None:
        if self.parts:
            self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Bundle:
    """Reads frames of a bundle by number."""

    def __init__(self, uri: str):
        self.file = open_in(uri)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = struct.unpack(f"<{2 * count}I", self._read(size - 9 - 8 * count, 8 * count))
        self.places, at = [], 0
        for packed, plain in zip(table[::2], table[1::2]):
            self.places.append((at, packed, plain))
            at += packed

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.places[k]
        return zstandard.ZstdDecompressor().decompress(self._read(at, packed), max_output_size=plain)

    def records(self) -> Iterator[dict]:
        for k in range(len(self.places)):
            data, at = self.frame(k), 0
            while at < len(data):
                found, at = parse(data, at)
                yield found

    def record(self, frame: int, offset: int) -> dict:
        """The record that the index places there."""
        return parse(self.frame(frame), offset)[0]


def write_warc(pages: DataFrame, path: str) -> None:
    """Bundles of pages(page_id, url, html) under path/bundles and their index under path/index."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = F.octet_length("html") >= REVISIT_BYTES
    # ids and digests alone are counted; payloads move only if too many digests are shared for a broadcast
    shared = rows.where(large).groupBy(F.col("digest").alias("key")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first", F.lit(True).alias("shared"))
    shared = materialize(shared, "shared-digests")
    side = small_side(shared)
    keyed = rows.withColumn("key", F.when(large, F.col("digest")))
    if side is shared:
        # a payload of very many pages is dealt out; what can't be a revisit has a key of its own
        salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("string")
        keyed = rows.withColumn("key", F.when(large, F.concat(F.col("digest"), F.lit("-"), salt)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "digest").cast("string"))))
        side = shared.withColumn("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.concat(F.col("key"), F.lit("-"), k.cast("string")))))
    joined = keyed.join(side, "key", "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = joined.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            out, places = out or BundleWriter(f"{path}/bundles/{uuid.uuid4().hex}.warc.zst"), []
            for part in slices(batch, "html", SLICE_BYTES):
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit"))):
                    data = record(row[0], row[1], row[2].encode(), *row[3:])
                    places.append((row[0], out.uri, *out.add(data), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*places), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))] if places else [[]] * 5, names=["page_id", "path", "frame", "offset", "length"])
        if out:
            out.close()

    joined.mapInArrow(write, INDEX).write.parquet(f"{path}/index")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the bundles under path, a bundle to a task, a frame in memory at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["path"]:
                rows = []
                for r in Bundle(uri).records():
                    if r["record_type"] == "response" and hashlib.sha1(r["payload"]).hexdigest() != r["payload_digest"]:
                        raise ValueError(f"damaged record {r['page_id']} in {uri}")
                    rows.append([r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")])
                    if len(rows) == 5000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    paths = materialize(spark.read.parquet(f"{path}/index").select("path").distinct(), "bundles")
    # dealt out in turn from one partition, so that each task gets one; they are as many rows as bundles
    return paths.coalesce(1).repartition(max(1, paths.count())).mapInPandas(read, ROWS)


def _frame(rows: list[list]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"], dtype=object)
    return df.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def archive(pages: DataFrame) -> DataFrame:
    """Write pages as bundles in the shared folder and return what they hold."""
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)

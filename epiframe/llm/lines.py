"""Line dedup: hashes in ranges, sorted by document and position, streamed into keep bitmaps (operator 11).

A line's key is the line without white space at both ends and with A-Z lower-cased. Every document gives one entry to
a key: the key's 128-bit digest, the document, and the positions of its lines. Entries are dealt out by ranges of
(digest, document) and sorted within them, so that a key's entries follow one another in the order of documents, and a
key of very many documents fills several ranges instead of one task. Each task streams its entries: it holds fewer
than ``min_docs`` of them, passes a key's entries on as lost once the key is in ``min_docs`` documents, and marks the
first occurrence. Only the first and the last key of a range may go on in another one. What is held of these is
settled afterwards by the sums of their counts, of which there are two a range at most.

The result is not text: ``keep_bitmaps`` returns a compressed bitmap of the lines that stay for each document that
loses one. ``apply_bitmaps`` applies them to the texts.

Defined cases: a null or empty text is one empty line; every row is a document, rows that repeat an id and a text share
their fate, and rows of one id with different texts are told apart by a digest of the text; a null doc_id sorts before
all others; a text of any length is one row of each table, its lines are never cut; an empty table gives no rows;
extra columns stay, and columns with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, own_name, slices, small_side

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = b" \t\n\v\f\r"
MIN_DOCS = 10
MIN_CHARS = 1
SLICE_BYTES = 2 << 20
ENTRY = "h1 long, h2 long, doc_id long, digest binary, n_lines int, positions array<int>"
RESULTS = ("n_lines", "n_dropped", "kept_text")


def text_digest(text: Column) -> Column:
    """16 bytes that tell texts of one id apart."""
    return F.unhex(F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")))


def keys_of(text: str | None) -> list[bytes]:
    return [line.strip(SPACE) for line in (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n")]


def line_entries(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row to each document's key: digest, document, number of its lines, positions of the key's lines."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                digests, rows, lines, positions = [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    places: dict[bytes, list[int]] = {}
                    for k, key in enumerate(keys := keys_of(text)):
                        if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                            places.setdefault(key, []).append(k)
                    digests += [hashlib.blake2b(key, digest_size=16).digest() for key in places]
                    positions += places.values()
                    rows += [row] * len(places)
                    lines += [len(keys)] * len(places)
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                own = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), part.column("doc_id").take(own), part.column("digest").take(own).cast(pa.binary()), pa.array(lines, pa.int32()), pa.array(positions, pa.list_(pa.int32()))],
                    names=["h1", "h2", "doc_id", "digest", "n_lines", "positions"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_digest(F.col("text")).alias("digest")).mapInArrow(find, ENTRY)


class Stream:
    """Sorted entries of one range, batch by batch. ``kind`` of what comes out is ``lost`` (the key is in ``least``
    documents), ``held`` (it may be, counting other ranges) or ``edge`` (the count ``n`` of a key that may go on in
    another range, at its first entry here); ``lead`` marks a key's first entry here."""

    def __init__(self, least: int):
        self.least = least
        self.key, self.n, self.held, self.edge, self.first = None, 0, [], None, True

    def take(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
        cuts = [0, *(np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1).tolist(), len(h1)]
        yield from self.grow((h1[0], h2[0]), rows.slice(0, cuts[1]))
        if len(cuts) > 3:  # keys that begin and end in this batch need no state
            yield from self.close()
            sizes = np.diff(cuts[1:-1])
            lead = np.zeros(cuts[-2] - cuts[1], bool)
            lead[np.array(cuts[1:-2]) - cuts[1]] = True
            lost = np.repeat(sizes >= self.least, sizes)
            yield self.out(rows.slice(cuts[1], cuts[-2] - cuts[1]).filter(pa.array(lost)), "lost", lead[lost])
        if len(cuts) > 2:
            yield from self.grow((h1[-1], h2[-1]), rows.slice(cuts[-2]))

    def grow(self, key: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """More rows of a key, which may be the one the last batch ended in."""
        if key != self.key:
            yield from self.close()
            self.key, self.n, self.edge = key, 0, rows.slice(0, 1)
        lead = np.arange(self.n, self.n + rows.num_rows) == 0
        self.n += rows.num_rows
        self.held.append((rows, lead))
        if self.n >= self.least:
            yield from self.release("lost")

    def release(self, kind: str) -> Iterator[pa.RecordBatch]:
        for rows, lead in self.held:
            yield self.out(rows, kind, lead)
        self.held = []

    def close(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """The key ends here; that of a range's first and last key may not."""
        if self.key is not None and (self.first or last):
            yield from self.release("held")
            yield self.out(self.edge, "edge", np.ones(1, bool), self.n)
        if self.key is not None:
            self.key, self.held, self.first = None, [], False

    def out(self, rows: pa.RecordBatch, kind: str, lead: np.ndarray, n: int = 0) -> pa.RecordBatch:
        more = [pa.array([kind] * rows.num_rows, pa.string()), pa.array(lead), pa.array([n] * rows.num_rows, pa.int64())]
        return pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, "kind", "lead", "n"])


def _streamed(entries: DataFrame, least: int) -> DataFrame:
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Stream(least)
        for batch in batches:
            if batch.num_rows:
                yield from state.take(batch)
        yield from state.close(last=True)

    dealt = entries.repartitionByRange("h1", "h2", "doc_id", "digest").sortWithinPartitions("h1", "h2", "doc_id", "digest")
    return dealt.mapInArrow(stream, ENTRY + ", kind string, lead boolean, n long")


def lost_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(doc_id, digest, n_lines, positions): lines of keys of at least min_chars code points in at least min_docs
    documents. With keep_first a key's first line, by document and position, stays."""
    least = max(1, min_docs)
    entries = materialize(line_entries(docs, min_chars), "line-entries")
    found = materialize(_streamed(entries, least), "line-stream")
    # two rows a range at most: the keys that reach over an edge of their range
    edges = found.where("kind = 'edge'").groupBy("h1", "h2").agg(F.sum("n").alias("_n"), F.min(F.struct("doc_id", "digest")).alias("_first"), F.lit(True).alias("_edge"))
    edges = F.broadcast(edges)
    lost, held = found.where("kind = 'lost'"), found.where("kind = 'held'").join(edges, ["h1", "h2"]).where(F.col("_n") >= least)
    columns = ["doc_id", "digest", "n_lines", "positions"]
    if not keep_first:
        return lost.select(*columns).unionByName(held.select(*columns))
    rows = lost.join(edges, ["h1", "h2"], "left").unionByName(held)
    leads = F.col("lead") & (F.col("_edge").isNull() | F.struct("doc_id", "digest").eqNullSafe(F.col("_first")))
    rest = F.when(leads, F.slice("positions", F.lit(2), F.size("positions"))).otherwise(F.col("positions"))
    return rows.select("doc_id", "digest", "n_lines", rest.alias("positions")).where(F.size("positions") > 0)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(doc_id, digest, n_lines, keep) of the documents that lose a line; ``keep`` is a compressed bitmap, see ``unpack``."""
    lost = lost_lines(docs, min_docs, min_chars, keep_first)
    by = lost.groupBy("doc_id", "digest").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_set("positions")).alias("positions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("positions")):
                keep = np.ones(n, bool)
                keep[gone.values.to_numpy()] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest").cast(pa.binary()), batch.column("n_lines"), pa.array(maps, pa.binary())], names=["doc_id", "digest", "n_lines", "keep"])

    return by.mapInArrow(pack, "doc_id long, digest binary, n_lines int, keep binary")


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    """The lines that stay, as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text. Bitmaps (materialized) are broadcast only if they are few and
    small; else texts move to them."""
    names = [c for c in docs.columns if c.lower() not in RESULTS]
    key, digest, keep = own_name(names, "id"), own_name(names, "digest"), own_name(names, "keep")
    df = docs.select(*names, text_digest(F.col("text")).alias(digest))
    side = bitmaps.select(F.col("doc_id").alias(key), F.col("digest").alias(f"{digest}_"), F.col("keep").alias(keep))
    weight = F.ceil(F.octet_length(keep) / F.lit(64))
    df = df.join(small_side(side, weight), F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(digest) == F.col(f"{digest}_")), "left").select(*names, keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                n, dropped, kept = [], [], []
                for text, bits in zip(part.column("text").to_pylist(), part.column(keep).to_pylist()):
                    lines = (text or "").split("\n")
                    rest = lines if bits is None else [x for x, stays in zip(lines, unpack(bits, len(lines)).tolist()) if stays]
                    n.append(len(lines))
                    dropped.append(len(lines) - len(rest))
                    kept.append((text or "") if bits is None else "\n".join(rest))
                arrays = [pc.cast(part.column(c), part.schema.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*names, *RESULTS])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.select(*names).schema.fields]).add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
    return df.mapInArrow(cut, schema)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept_text."""
    return apply_bitmaps(docs, materialize(keep_bitmaps(docs, min_docs, min_chars, keep_first), "keep-bitmaps"))

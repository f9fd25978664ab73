"""Decoding of images and depths that were read as bytes.

Plain PNG files (``plain_png``) are unpacked where they are read. All else (JPEG, other PNG and what more the JVM reads,
and what may be damaged) is decoded by Spark's own ``image`` source. It takes files, so these images are written to a
folder that all executors share, decoded, and the folder is removed when the pixels have been written as a table. Only
what is left after quality cuts and thinning should come here (``members.with_media``): each such image is a small file
for a while. Pixels are joined to their rows by shuffle: Spark reckons them by the size of the files, which
may be a thousandth of theirs, and would send all of them through the driver. Small files share a task.

Pixels are bytes in rows of red, green and blue; grey images have the same value three times, transparency is dropped.
Depths are NumPy arrays: 16-bit integers are millimetres and become float32 metres, floats are metres.

Defined cases: null data stays null; damaged or empty data is an error that names the row's locator; equal rows
are decoded each; no rows give no rows; other columns stay.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import image_names
from ..steps import Run, Step, chained, through, widened
from .files import make_folder, open_out, remove, shared_path
from .shards import array_of

#: Files to a folder, so that no folder gets very many.
FOLDER = 10_000
#: Bytes that opening a file counts as, so that a task reads some hundreds of small ones; and bytes to a batch of pixels.
READING = {"spark.sql.files.openCostInBytes": str(256 << 10), "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}
#: Bytes of an image that a worker unpacks, at most.
LARGEST = 256 << 20
#: Bytes of pixels or depths that a worker gives at once.
GIVEN = 8 << 20
PIXELS = "height int, width int, pixels binary"
_SIGN = b"\x89PNG\r\n\x1a\n"


def rgb(data: bytes, height: int, width: int, channels: int) -> bytes:
    """Rows of red, green and blue from Spark's rows of blue, green, red and perhaps transparency, or of grey."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    a = np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]
    return np.ascontiguousarray(a).tobytes()


def plain_png(data: bytes) -> tuple[int, int, bytes] | None:
    """Height, width and pixels of a PNG file of grey or of three or four colours of 8 bits, in rows from top to bottom
    that are stored as they are or as differences to the left or above; none of any other and of one with a fault."""
    if data[:8] != _SIGN or data[12:16] != b"IHDR" or data[8:12] != b"\0\0\0\r":
        return None
    at, parts, ended = 8, [], False
    while not ended:
        size, name = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        end = at + 12 + size
        if end > len(data) or len(name) < 4 or zlib.crc32(data[at + 4 : end - 4]) != int.from_bytes(data[end - 4 : end]):
            return None
        if name == b"IDAT":
            parts.append(data[at + 8 : end - 4])
        elif name == b"IEND":
            ended = True
        elif at > 8:
            return None
        at = end
    width, height, depth, colours, *rest = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 6: 4}.get(colours, 0)
    line = 1 + width * channels
    if depth != 8 or any(rest) or not channels or not 0 < height * width * channels <= LARGEST:
        return None
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(parts), height * line + 1)
    except zlib.error:
        return None
    if len(raw) != height * line or not unpack.eof or unpack.unused_data:
        return None
    kinds = raw[::line]
    if max(kinds) > 2:
        return None
    if colours == 2 and not any(kinds):
        return height, width, b"".join([raw[k + 1 : k + line] for k in range(0, height * line, line)])
    a = np.frombuffer(raw, np.uint8).reshape(height, line)[:, 1:].reshape(height, width, channels).copy()
    for k, kind in enumerate(kinds):
        if kind == 1:
            np.cumsum(a[k], axis=0, dtype=np.uint8, out=a[k])
        elif kind == 2 and k:
            a[k] += a[k - 1]
    a = np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]
    return height, width, a.tobytes()


def decode_images(rows: DataFrame, locator: Sequence[str], data: str = "data", made: Sequence[Step] = ()) -> DataFrame:
    """rows with height, width and pixels instead of ``data``; ``locator`` columns are named where data is damaged. Steps
    ``made`` give the data of other rows, in the worker that writes files."""
    schema, make = chained(rows.schema, made)
    spark, names = rows.sparkSession, [c for c in schema.names if c not in (data, "height", "width", "pixels")]
    folder, listed, decoded = (shared_path(spark, n) for n in ("images", "image-list", "pixels"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = uuid.uuid4().hex, 0

        def given(values: pa.Array) -> Iterator[tuple]:
            """Path, or else height, width and pixels."""
            nonlocal n
            for value in values:
                held = value.as_py()
                path, found = None, (None, None, None) if held is None else plain_png(held)
                if found is None:
                    path, found = f"{task}-{n // FOLDER}/{n % FOLDER}", (None, None, None)
                    with open_out(f"{folder}/{path}") as out:
                        out.write(held)
                    n += 1
                yield path, *found

        for batch in make(batches):
            yield from widened(batch, names, given(batch.column(data)), kinds, GIVEN)

    kinds = {"_path": pa.string(), "height": pa.int32(), "width": pa.int32(), "pixels": pa.binary()}
    kept = [schema[c] for c in names]
    given_kind = T.StructType([*kept, T.StructField("_path", T.StringType()), *T.StructType.fromDDL(PIXELS).fields])
    rows = rows if made else rows.select(*names, F.col(data).cast("binary").alias(data))
    rows.mapInArrow(write, given_kind).write.parquet(listed)
    given_rows = spark.read.schema(given_kind).parquet(listed)
    there = given_rows.where("_path IS NOT NULL").select(*names, "_path")
    make_folder(folder)  # also if no image is left to Spark
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("image.origin", r"([^/]+/[^/]+)$", 1).alias("_file"), "image.height", "image.width", "image.nChannels", F.col("image.data").alias("_data"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one image at a time: a batch of pixels may be large
            rows = (tuple(x.as_py() for x in row) for row in zip(*batch.columns[1:]))
            pixels = ((rgb(held, h, w, channels) if h >= 0 else None,) for h, w, channels, held in rows)
            yield from widened(batch, ["_file", "height", "width"], pixels, {"pixels": pa.binary()}, GIVEN)

    found = images.mapInArrow(turn, f"_file string, {PIXELS}")
    joined = there.join(found.hint("merge"), F.col("_path") == F.col("_file"), "left")
    where = F.concat_ws(" of ", *(F.col(c).cast("string") for c in reversed(locator)))
    damaged = F.col("_path").isNotNull() & F.col("pixels").isNull()
    pixels = F.when(damaged, F.raise_error(F.concat(F.lit("damaged image: "), where)).cast("binary")).otherwise(F.col("pixels"))
    own = {k: spark.conf.get(k) for k in READING}
    try:
        for k, v in READING.items():
            spark.conf.set(k, v)
        joined.select(*names, "height", "width", pixels.alias("pixels")).write.parquet(decoded)
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    remove(folder)
    done = spark.read.schema(T.StructType([*kept, *T.StructType.fromDDL(PIXELS).fields])).parquet(decoded)
    return given_rows.where("_path IS NULL").drop("_path").unionByName(done)


def png(pixels: bytes, height: int, width: int) -> bytes:
    """A PNG file of rows of red, green and blue."""
    rows = b"".join(b"\0" + pixels[k * 3 * width : (k + 1) * 3 * width] for k in range(height))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return _SIGN + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def metres(data: bytes) -> np.ndarray:
    a = array_of(data)
    return a.astype(np.float32) / np.float32(1000) if a.dtype == np.uint16 else a.astype(np.float32)


def depths_of(locator: Sequence[str], data: str = "data") -> Step:
    """The step of ``decode_depths``."""

    def step(schema: T.StructType) -> tuple[T.StructType, Run]:
        names = [c for c in schema.names if c not in (data, "shape", "depth")]
        kinds = {"shape": pa.list_(pa.int32()), "depth": pa.binary()}

        def decoded(batch: pa.RecordBatch) -> Iterator[tuple]:
            for k, value in enumerate(batch.column(data)):
                if not value.is_valid:
                    yield None, None
                    continue
                try:
                    a = metres(value.as_py())
                except (ValueError, EOFError) as e:
                    raise ValueError("damaged depth: " + " of ".join(str(batch.column(c)[k].as_py()) for c in reversed(locator))) from e
                yield list(a.shape), a.astype("<f4").tobytes()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from widened(batch, names, decoded(batch), kinds, GIVEN)

        return T.StructType([*(schema[c] for c in names), *T.StructType.fromDDL("shape array<int>, depth binary").fields]), run

    return step


def decode_depths(rows: DataFrame, locator: Sequence[str], data: str = "data") -> DataFrame:
    """rows with shape and float32 metres (little-endian bytes) instead of ``data``."""
    return through(rows, depths_of(locator, data))


def depth_values(schema: T.StructType) -> tuple[T.StructType, Run]:
    """The step of ``with_depth_values``."""
    names = [c for c in schema.names if c != "depths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(x.as_buffer(), "<f4") if x.is_valid else None for x in batch.column("depth")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values, pa.list_(pa.float32()))], names=[*names, "depths"])

    return T.StructType([*(schema[c] for c in names), T.StructField("depths", T.ArrayType(T.FloatType()))]), run


def with_depth_values(rows: DataFrame) -> DataFrame:
    """rows(depth, ..) with ``depths``, its metres as an array."""
    return through(rows, depth_values)


def qa_images(frames: DataFrame, keys: Sequence[str] = ("shard", "key")) -> DataFrame:
    """One row to each ``image_*.jpg`` member of located frames, numbered in the order of names; a frame without any is
    an error, as a question about images can't be asked of it."""
    names = image_names(F.map_keys("members"))
    lost = F.raise_error(F.concat(F.lit("no image_*.jpg in "), F.col("key"), F.lit(" of "), F.col("shard"))).cast("array<string>")
    rows = frames.select(*keys, "members", F.posexplode(F.when(F.size(names) > 0, names).otherwise(lost)).alias("n", "suffix"))
    return rows.select(*keys, "n", "suffix", F.element_at("members", F.col("suffix"))["offset"].alias("offset"), F.element_at("members", F.col("suffix"))["size"].alias("size"))

"""Test pictures of the queries: made from numbers, and summed up after decoding. Each is a step over Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import media
from ..steps import Run

ENCODED = "key string, meta string, lowdim array<float>, image binary, depth binary"
ALBUM = "key string, meta string, members map<string, binary>"
SUMS = "vec_id long, height int, width int, red long, green long, blue long, corner int, millimetres long"


def pictures(_: T.StructType) -> tuple[T.StructType, Run]:
    """Eight rows of eight pixels from 64 numbers, as PNG, and the numbers as millimetres."""
    kind = T.StructType.fromDDL(ENCODED)
    made = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, depths = [], []
            for v in batch.column("v"):
                a = np.asarray(v.values, np.int64)
                pixels = np.stack([a % 256, 255 - a % 256, a // 7 % 256], axis=1).astype(np.uint8)
                images.append(media.png(pixels.tobytes(), 8, 8))
                held = io.BytesIO()
                np.save(held, a.astype(np.uint16).reshape(8, 8))
                depths.append(held.getvalue())
            columns = [batch.column("key"), batch.column("meta"), [[0.0]] * batch.num_rows, images, depths]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, made)], names=made.names)

    return kind, run


def sums(_: T.StructType) -> tuple[T.StructType, Run]:
    """Height, width and sums of a frame's pixels and depths."""
    kind = T.StructType.fromDDL(SUMS)
    made = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values in zip(*(batch.column(c) for c in ("key", "height", "width", "pixels", "depth"))):
                key, h, w, pixels, depth = (x.as_py() for x in values)
                a = np.frombuffer(pixels, np.uint8).reshape(h, w, 3)
                row = [int(key[6:]), h, w, *a.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist(), int(a[-1, -1, 2]), int(np.rint(np.frombuffer(depth, "<f4").astype(np.float64) * 1000).sum())]
                rows.append(dict(zip(made.names, row)))
            yield pa.RecordBatch.from_pylist(rows, made)

    return kind, run


def albums(_: T.StructType) -> tuple[T.StructType, Run]:
    kind = T.StructType.fromDDL(ALBUM)
    made = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [[(f"image_{n}.jpg", media.png(bytes([k % 256, n, 7]) * (n + 1), 1, n + 1)) for n in range(1 + k % 12)] for k in batch.column("conv_id").to_pylist()]
            columns = [batch.column("key").cast(made.field("key").type), batch.column("meta").cast(made.field("meta").type), pa.array(members, made.field("members").type)]
            yield pa.RecordBatch.from_arrays(columns, names=made.names)

    return kind, run

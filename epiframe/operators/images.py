"""Resizing and augmentation of decoded frames, in numpy, a sample at a time.

A sample's frames have one size: bytes in rows of red, green and blue, and depths as float32 metres. Images are
resized bilinearly and depths by the nearest value; a pixel's place in the source is the centre of its square, and
beyond the edge the edge repeats. Augmentation follows a key: the same sample is changed the same way on every run, and
all its frames alike (noise of depths apart, which differs by pixel and frame).

Defined cases: null images or depths stay null; frames that have the size already are returned as they are; a sample
without frames stays empty; a pixel without depth (0) gets no noise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..steps import Run, Step, through

#: Factors of brightness, contrast and saturation, noise by metre of depth, share of samples that lose a
#: rectangle, and its greatest part of a side.
JITTER, NOISE, DROPOUT, PART = (0.7, 1.3), 0.005, 0.5, 0.4
GREY = np.array([0.299, 0.587, 0.114], np.float32)


def bilinear(frames: np.ndarray, height: int, width: int) -> np.ndarray:
    """Frames (n, h, w) or (n, h, w, c) at another size, of the same type; whole numbers are rounded."""
    if frames.shape[1:3] == (height, width):
        return frames

    def places(new: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, old - 1), (at - low).astype(np.float32)

    y0, y1, fy = places(height, frames.shape[1])
    x0, x1, fx = places(width, frames.shape[2])
    more = (1,) * (frames.ndim - 3)
    fy, fx = fy.reshape(1, -1, 1, *more), fx.reshape(1, 1, -1, *more)
    rows = frames[:, y0].astype(np.float32) * (1 - fy) + frames[:, y1].astype(np.float32) * fy
    out = rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx
    return np.floor(out + np.float32(0.5)).astype(frames.dtype) if frames.dtype.kind in "ui" else out.astype(frames.dtype)


def nearest(frames: np.ndarray, height: int, width: int) -> np.ndarray:
    """Frames at another size, each value one of the old."""
    if frames.shape[1:3] == (height, width):
        return frames
    y = np.minimum(np.arange(height) * frames.shape[1] // height, frames.shape[1] - 1)
    x = np.minimum(np.arange(width) * frames.shape[2] // width, frames.shape[2] - 1)
    return frames[:, y][:, :, x]


def as_rgb(a: np.ndarray) -> np.ndarray:
    """Colours as bytes: numbers up to 1 are shares of 255; what is beyond a byte is cut."""
    x = np.asarray(a, np.float32)
    x = x * 255 if x.size and x.max() <= 1 else x
    return np.clip(x, 0, 255).astype(np.uint8)


def as_gray(a: np.ndarray) -> np.ndarray:
    """Numbers as bytes from their least to their greatest; all alike are 0."""
    x = np.asarray(a, np.float32)
    low, high = (float(x.min()), float(x.max())) if x.size else (0.0, 0.0)
    return np.zeros(x.shape, np.uint8) if high <= low else np.clip((x - low) / (high - low) * 255, 0, 255).astype(np.uint8)


def scaled_intrinsic(k: Sequence[float], old: tuple[int, int], new: tuple[int, int]) -> list[float]:
    """fx, fy, cx, cy at another size (height, width)."""
    sy, sx = new[0] / old[0], new[1] / old[1]
    return [k[0] * sx, k[1] * sy, k[2] * sx, k[3] * sy]


def generator(seed: int, *key) -> np.random.Generator:
    """Random numbers that a key alone decides."""
    digest = hashlib.blake2b("|".join(map(str, (seed, *key))).encode(), digest_size=16).digest()
    return np.random.default_rng(int.from_bytes(digest, "little"))


def augment_color(images: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """uint8 images with brightness, contrast and saturation changed in this order, by factors that all frames share."""
    brightness, contrast, saturation = rng.uniform(*JITTER, 3).astype(np.float32)
    x = np.clip(images.astype(np.float32) * brightness, 0, 255)
    middle = (x @ GREY).mean(dtype=np.float64) if x.size else 0.0
    x = np.clip((x - np.float32(middle)) * contrast + np.float32(middle), 0, 255)
    grey = (x @ GREY)[..., None]
    return np.floor(np.clip(grey + (x - grey) * saturation, 0, 255) + np.float32(0.5)).astype(np.uint8)


def augment_depth(depths: np.ndarray, rng: np.random.Generator, noise: float = NOISE, dropout: float = DROPOUT) -> np.ndarray:
    """Depths with noise in proportion to them, never below 0, and in some samples a rectangle without depth."""
    out = depths.astype(np.float32)
    there = out > 0
    out = np.maximum(np.where(there, out + rng.standard_normal(out.shape, np.float32) * np.float32(noise) * out, out), 0)
    if rng.random() < dropout and out.size:
        _, height, width = out.shape
        h, w = (int(rng.integers(1, max(1, int(n * PART)) + 1)) for n in (height, width))
        y, x = int(rng.integers(0, height - h + 1)), int(rng.integers(0, width - w + 1))
        out[:, y : y + h, x : x + w] = 0
    return out


def process(images: np.ndarray, depths: np.ndarray | None = None, intrinsic: Sequence[float] | None = None, rng: np.random.Generator | None = None, clip: tuple[float, float] | None = None, size: tuple[int, int] | None = None) -> tuple:
    """Images, depths and intrinsic of a sample: resized, then augmented if ``rng`` is given, then depths cut to a range."""
    if size is not None and len(images) and images.shape[1:3] != tuple(size):
        intrinsic = None if intrinsic is None else scaled_intrinsic(intrinsic, images.shape[1:3], size)
        images, depths = bilinear(images, *size), None if depths is None else nearest(depths, *size)
    if rng is not None:
        images, depths = augment_color(images, rng), None if depths is None else augment_depth(depths, rng)
    if clip is not None and depths is not None:
        depths = np.clip(depths, *clip)
    return images, depths, intrinsic


def processed(key: Sequence[str], size: tuple[int, int] | None = None, augment: int | None = None, clip: tuple[float, float] | None = None) -> Step:
    """The step of ``process_frames``."""

    def step(schema: T.StructType) -> tuple[T.StructType, Run]:
        names, has = schema.names, {c: c in schema.names for c in ("depth", "intrinsic")}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):  # one sample at a time: pixels of a batch may be many
                    part = batch.slice(k, 1)
                    row = {c: part.column(c)[0].as_py() for c in ("height", "width", "pixels", *(c for c in has if has[c]), *key)}
                    if row["pixels"] is None:
                        yield part
                        continue
                    h, w = row["height"], row["width"]
                    images = np.frombuffer(row["pixels"], np.uint8).reshape(-1, h, w, 3)
                    depth, intrinsic = row.get("depth"), row.get("intrinsic")
                    depths = None if depth is None else np.frombuffer(depth, "<f4").reshape(-1, h, w)
                    rng = None if augment is None else generator(augment, *(row[c] for c in key))
                    images, depths, intrinsic = process(images, depths, intrinsic, rng, clip, size)
                    new = {"height": images.shape[1], "width": images.shape[2], "pixels": np.ascontiguousarray(images).tobytes()}
                    new |= {"depth": None if depths is None else depths.astype("<f4").tobytes()} if has["depth"] else {}
                    new |= {"intrinsic": intrinsic} if has["intrinsic"] else {}
                    yield pa.RecordBatch.from_arrays([pa.array([new[c]], part.schema.field(c).type) if c in new else part.column(c) for c in names], names=names)

        return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]), run

    return step


def process_frames(rows: DataFrame, key: Sequence[str], size: tuple[int, int] | None = None, augment: int | None = None, clip: tuple[float, float] | None = None) -> DataFrame:
    """rows(height, width, pixels, ..) processed; ``pixels`` holds the frames of a sample one after the other, ``depth``
    and ``intrinsic`` may be there. ``augment`` is a seed, which ``key`` columns make each sample's own."""
    return through(rows, processed(key, size, augment, clip))


def channel_stats(schema: T.StructType) -> tuple[T.StructType, Run]:
    """The step of ``with_channel_stats``."""
    names = [c for c in schema.names if c not in ("means", "stds")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, stds = [], []
            for value in batch.column("pixels"):
                a = np.frombuffer(value.as_buffer(), np.uint8).reshape(-1, 3) if value.is_valid else np.empty((0, 3))
                means.append(a.mean(axis=0).tolist() if len(a) else None)
                stds.append(a.std(axis=0).tolist() if len(a) else None)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(means, kind), pa.array(stds, kind)], names=[*names, "means", "stds"])

    return T.StructType([*(T.StructField(c, schema[c].dataType) for c in names), T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("stds", T.ArrayType(T.DoubleType()))]), run


def with_channel_stats(rows: DataFrame) -> DataFrame:
    """rows(height, width, pixels, ..) with ``means`` and ``stds`` (of the population) of the three colours over all
    frames of a sample, which ``quality_gate.image_fails`` judges; null without pixels."""
    return through(rows, channel_stats)

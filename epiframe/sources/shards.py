"""Frame shards: tar files whose members ``<key>.<suffix>`` of one key, side by side, are one frame.

A task streams one shard after another and holds one frame; members that a query doesn't need are skipped unread, as
the pruning of columns is for Parquet. JSON and low-dimensional vectors are decoded at once, images stay binary.

Defined cases: a frame without meta.json or lowdim.npy has nulls there, which the quality gate rejects; a member without
a dot is a key of its own without suffix; unreadable JSON or NPY data is an error that names shard and key.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import FRAMES
from ..steps import Step, chained
from .files import open_at, open_out
from .packed import SUFFIX
from .tars import Bytes, Writer, array_of, members, npy

#: Suffixes of members and the columns they fill.
MEDIA = {"image.jpg": "image", "depth.npy": "depth", "chest_image.jpg": "chest_image", "chest_depth.npy": "chest_depth"}
ALWAYS = ("meta.json", "lowdim.npy")
#: Frames, and bytes of media, to an output batch.
BATCH, BATCH_BYTES = 256, 16 << 20


def expand(spark: SparkSession, patterns: str | Sequence[str]) -> list[str]:
    """Shard paths: of each pattern with wildcards the files that Spark lists, in order; other paths as they are."""
    if not isinstance(patterns, str) and not isinstance(patterns, Iterable):
        raise TypeError(f"neither a path nor a list of paths: {patterns!r}")
    out: list[str] = []
    for p in [patterns] if isinstance(patterns, str) else patterns:
        if any(c in p for c in "*?["):
            out += sorted(r[0] for r in spark.read.format("binaryFile").load(p).select("path").collect())  # one row to a shard
        else:
            out.append(p)
    return out


def listed_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Paths as rows, a task to each. They are given as an Arrow table: rows of Python values would go through workers of
    another kind, which stay beside those that read."""
    return spark.createDataFrame(pa.table({"path": pa.array(paths, pa.string())}), "path string").repartition(max(1, len(paths)))


def wanted(image: bool = True, depth: bool = True, chest: bool = True) -> tuple[str, ...]:
    """Suffixes to read: meta and vector always; the chest's depth only if both depth and chest are wanted."""
    on = {"image.jpg": image, "depth.npy": depth, "chest_image.jpg": chest, "chest_depth.npy": depth and chest}
    return (*ALWAYS, *(s for s in MEDIA if on[s]))


#: Frames of an episode mostly have the same metadata; what is kept is only read.
_meta = functools.lru_cache(1024)(json.loads)
_meta_text = functools.lru_cache(1024)(lambda data: json.dumps(json.loads(data)))


def frame(shard: str, pos: int, key: str, data: dict[str, bytes], text_of_meta: bool = True) -> dict:
    """One row of the frames table from a key's members."""
    try:
        meta = _meta(data["meta.json"]) if "meta.json" in data else {}
        vector = array_of(data["lowdim.npy"]).astype(np.float32, copy=False).ravel() if "lowdim.npy" in data else None
    except ValueError as e:
        raise ValueError(f"damaged member of {key} in {shard}") from e
    text = meta.get("instruction")
    return {
        "shard": shard, "pos": pos, "key": key, "dataset_name": meta.get("dataset_name", ""), "episode_index": meta.get("episode_index"), "high_quality": meta.get("high_quality", 1),
        "cameras": meta.get("cameras", ["head"]), "instruction": [text] if isinstance(text, str) else text, "instruction_num": meta.get("instruction_num"), "lowdim": vector,
        **{c: data.get(s) for s, c in MEDIA.items()}, "meta": _meta_text(data["meta.json"]) if text_of_meta and "meta.json" in data else None,
    }


def batch_of(rows: Sequence[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch of the columns of a schema; vectors are put together without a Python number each."""
    return pa.RecordBatch.from_arrays([_vectors([r["lowdim"] for r in rows], f.type) if f.name == "lowdim" else pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _vectors(rows: Sequence[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    there = [a for a in rows if a is not None]
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in rows)], dtype=np.int32)
    nulls = pa.array([a is None for a in rows], pa.bool_()) if len(there) < len(rows) else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(there) if there else np.zeros(0, np.float32), kind.value_type), kind, mask=nulls)


def frames_of(shard: str, suffixes: Sequence[str] | None, text_of_meta: bool = True) -> Iterator[dict]:
    """Frames of one shard in its order."""
    with open_at(shard) as file:
        held, key, data, pos = Bytes(file), None, {}, 0
        for path, offset, size in members(held):
            folder, slash, name = path.rpartition("/")
            stem, _, suffix = name.partition(".")
            this = folder + slash + stem
            if this != key and key is not None:
                yield frame(shard, pos, key, data, text_of_meta)
                data, pos = {}, pos + 1
            key = this
            if suffixes is None or suffix in suffixes:
                data[suffix] = held.member(offset, size)
        if key is not None:
            yield frame(shard, pos, key, data, text_of_meta)


def read_frames(spark: SparkSession, patterns: str | Sequence[str], image: bool = True, depth: bool = True, chest: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """The frames table of shards, as many tasks as shards; only these ``columns``, if they are given."""
    kind = T.StructType([FRAMES[c] for c in columns or FRAMES.names])
    paths, suffixes, schema, text = expand(spark, patterns), wanted(image, depth, chest), to_arrow_schema(kind), "meta" in kind.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in frames_of(shard, suffixes, text):
                    rows.append(row)
                    held += sum(len(row[c] or b"") for c in MEDIA.values())
                    if len(rows) == BATCH or held >= BATCH_BYTES:
                        yield batch_of(rows, schema)
                        rows, held = [], 0
                yield batch_of(rows, schema)

    return listed_paths(spark, paths).mapInArrow(read, kind)


def write_frames(frames: DataFrame, path: str, *made: Step, pack: bool = False) -> list[str]:
    """One shard to each partition of frames(key, meta, lowdim, media..), in its order, under path; returns their paths.
    Without a column lowdim there are no vectors; a map ``members`` adds data by suffix. Steps ``made`` make frames of
    other rows, in the worker that writes them. Shards are tar files, packed in blocks (``packed``) if that is asked for."""
    schema, make = chained(frames.schema, made)
    media = {s: c for s, c in MEDIA.items() if c in schema.names}
    vectors, more = "lowdim" in schema.names, "members" in schema.names
    read = ["key", "meta", *media.values(), *(["members"] if more else [])]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, tar, n = f"{path}/{uuid.uuid4().hex}.tar{SUFFIX if pack else ''}", None, 0
        for batch in make(batches):
            if vectors:
                lists = batch.column("lowdim")
                flat, ends, there = lists.values.to_numpy(zero_copy_only=False).astype(np.float32), lists.offsets.to_pylist(), lists.is_valid().to_pylist()
            for k in range(0, batch.num_rows, 32):
                rows = {c: batch.slice(k, 32).column(c).to_pylist() for c in read}
                for i, key in enumerate(rows["key"]):
                    parts = {"meta.json": (rows["meta"][i] or "{}").encode()}
                    if vectors:
                        parts["lowdim.npy"] = npy(flat[ends[k + i] : ends[k + i + 1]] if there[k + i] else flat[:0])
                    parts |= {s: rows[c][i] for s, c in media.items() if rows[c][i] is not None} | (dict(rows["members"][i] or []) if more else {})
                    tar = tar or Writer(open_out(uri))
                    tar.add_frame(key, parts)
                    n += 1
        if tar is not None:
            tar.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "n": [n]})

    listed = f"{path}/shards"
    frames.mapInArrow(write, "path string, n long").write.parquet(listed)
    return sorted(r[0] for r in frames.sparkSession.read.parquet(listed).collect())  # one row to a shard

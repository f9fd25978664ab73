"""Late materialization: frames with the places of their media members instead of bytes, read by range once they are needed.

``located_frames`` reads a shard's headers, metadata and vectors and seeks over the rest. A frame carries a map from the
suffix of each other member to its place in the shard. Windows, quality cuts and thinning then move places, and
``with_media`` reads the members of the windows that are left: places are dealt out by shard and by stretches of
``SPAN`` bytes, so that a large shard is several tasks, sorted by offset and read in order, each once a stretch even
if many windows share it.

Defined cases: a member that the last frame of a window lacks is null for the window; one that the last frame has and
another one lacks is an error that names shard and key, as is a range beyond the shard's end; a window without frames
has null media; a member of no bytes is empty, not null; no shards or no windows give no rows; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import FRAMES
from ..steps import Run, Step, through
from .files import open_at, shared_path
from .shards import ALWAYS, BATCH, MEDIA, batch_of, expand, frame, listed_paths
from .tars import Bytes, members

PLACES = T.MapType(T.StringType(), T.StructType([T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())]))
LOCATED = T.StructType([*(f for f in FRAMES.fields if f.name not in MEDIA.values()), T.StructField("members", PLACES)])
#: Bytes of a shard that one task reads at most, and that one output batch holds.
SPAN, CHUNK = 256 << 20, 8 << 20
#: Bytes between two members that are read along instead of skipped.
GAP = 4096


def places_of(shard: str, suffixes: Sequence[str] | None, columns: Sequence[str]) -> Iterator[dict]:
    """Located frames of one shard in its order; only what ``columns`` need is decoded."""
    decoded = [s for s, needs in zip(ALWAYS, (set(columns) - {"shard", "pos", "key", "lowdim", "members"}, "lowdim" in columns)) if needs]
    with open_at(shard) as file:
        held, key, data, places, pos = Bytes(file), None, {}, {}, 0
        for path, offset, size in members(held):
            folder, slash, name = path.rpartition("/")
            stem, _, suffix = name.partition(".")
            if (this := folder + slash + stem) != key and key is not None:
                yield _row(shard, pos, key, data, places, columns)
                data, places, pos = {}, {}, pos + 1
            key = this
            if suffix in ALWAYS:
                if suffix in decoded:
                    data[suffix] = held.member(offset, size)
            elif suffixes is None or suffix in suffixes:
                places[suffix] = {"offset": offset, "size": size}
        if key is not None:
            yield _row(shard, pos, key, data, places, columns)


def _row(shard: str, pos: int, key: str, data: dict, places: dict, columns: Sequence[str]) -> dict:
    whole = frame(shard, pos, key, data, "meta" in columns) | {"members": list(places.items())}
    return {c: whole[c] for c in columns}


def located_frames(spark: SparkSession, patterns: str | Sequence[str], suffixes: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Frames of shards with the places of their members; only those with one of ``suffixes``, and only these ``columns``,
    if they are given. Members that no column needs are not decoded."""
    kind = T.StructType([LOCATED[c] for c in columns or LOCATED.names])
    paths, schema, names = expand(spark, patterns), to_arrow_schema(kind), kind.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                rows = []
                for row in places_of(shard, suffixes, names):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch_of(rows, schema)
                        rows = []
                yield batch_of(rows, schema)

    return listed_paths(spark, paths).mapInArrow(read, kind)


def locator() -> Column:
    """What a window holds of a located frame."""
    return F.struct("shard", "pos", "key", "members")


def _runs(shards: list, offsets: list, ends: list, chunk: int, gap: int) -> Iterator[tuple[int, int]]:
    """Rows in order of shard and offset, cut where bytes between are not worth reading or a chunk is full."""
    a, end = 0, ends[0] if ends else 0
    for k in range(1, len(shards)):
        if shards[k] != shards[a] or offsets[k] > end + gap or max(end, ends[k]) - offsets[a] > chunk:
            yield a, k
            a, end = k, 0
        end = max(end, ends[k])
    if shards:
        yield a, len(shards)


def _with(batch: pa.RecordBatch, first: int, data: list, n_read: list) -> pa.RecordBatch:
    part = batch.slice(first, len(data))
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary()), pa.array(n_read, pa.int64())], names=[*part.schema.names, "data", "n_read"])


def with_data(batches: Iterator[pa.RecordBatch], chunk: int, gap: int) -> Iterator[pa.RecordBatch]:
    """Batches with ``data`` and ``n_read``; members that are read apart are given together, up to a chunk."""
    shard, file = None, None
    for batch in batches:
        shards, offsets, sizes = (batch.column(c).to_pylist() for c in ("shard", "offset", "size"))
        first, data, n_read, held = 0, [], [], 0
        for a, b in _runs(shards, offsets, [o + n for o, n in zip(offsets, sizes)], chunk, gap):
            if shards[a] != shard:
                if file is not None:
                    file.close()
                shard, file = shards[a], open_at(shards[a])
            start, stop = offsets[a], max(o + n for o, n in zip(offsets[a:b], sizes[a:b]))
            file.seek(start)
            if len(blob := file.read(stop - start)) < stop - start:
                raise ValueError(f"{shard} ends before the member of {batch.column('key')[b - 1].as_py()}")
            more = [blob[o - start : o - start + n] for o, n in zip(offsets[a:b], sizes[a:b])]
            size = sum(map(len, more))
            if data and held + size > chunk:  # what runs give is put together up to a chunk
                yield _with(batch, first, data, n_read)
                first, data, n_read, held = a, [], [], 0
            data += more
            n_read += [len(blob)] + [0] * (b - a - 1)
            held += size
        if data:
            yield _with(batch, first, data, n_read)
    if file is not None:
        file.close()


def dealt(places: DataFrame, span: int = SPAN) -> DataFrame:
    """places(shard, offset, size, ..) by shard and stretch, in the order of reading."""
    return places.repartition("shard", F.floor(F.col("offset") / span)).sortWithinPartitions("shard", "offset", "size")


def reading(chunk: int = CHUNK, gap: int = GAP) -> Step:
    """The step of ``fetch``, over places that are dealt out."""

    def step(schema: T.StructType) -> tuple[T.StructType, Run]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return with_data(batches, chunk, gap)

        return T.StructType([*schema.fields, T.StructField("data", T.BinaryType()), T.StructField("n_read", T.LongType())]), run

    return step


def fetch(places: DataFrame, span: int = SPAN, chunk: int = CHUNK, gap: int = GAP) -> DataFrame:
    """places(shard, key, offset, size, ..) with ``data`` and with ``n_read``, the bytes read for a row and the rows after it."""
    return through(dealt(places, span), reading(chunk, gap))


def media_places(windows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row to each member that windows need: keys, name of the output, place in the window, shard, key, offset, size.

    ``wanted`` names, for each output, the column with the window's locators and the members' suffix.
    """
    parts = []
    for name, (refs, suffix) in wanted.items():
        at = lambda r, s=suffix: F.element_at(r["members"], s)
        carried = at(F.element_at(refs, -1)).isNotNull()
        lost = F.raise_error(F.concat(F.lit(f"{suffix} is missing in "), F.col("r.key"), F.lit(" of "), F.col("r.shard")))
        rows = windows.where((F.size(refs) > 0) & carried).select(*keys, F.posexplode(refs).alias("k", "r"))
        found = at(F.col("r"))
        # the error stands in a column that is read, so that no optimizer drops it
        parts.append(rows.select(*keys, F.lit(name).alias("output"), "k", F.col("r.shard").alias("shard"), F.col("r.key").alias("key"), F.when(found.isNull(), lost.cast("long")).otherwise(found["offset"]).alias("offset"), found["size"].alias("size")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Outputs of a window: the column with locators, and the suffix that fills the output.
WINDOW_MEDIA = {c: ("image_refs", s) for s, c in MEDIA.items()}
FUTURE_MEDIA = {"future_frames": ("future_refs", "image.jpg"), "chest_future_frames": ("future_refs", "chest_image.jpg")}


def with_media(windows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, str]] = WINDOW_MEDIA) -> DataFrame:
    """windows with an array of bytes for each output, in the order of its locators; ``keys`` tell windows apart. Windows,
    which hold places alone, are written once in the shared folder, as they are read twice."""
    spark, path, schema = windows.sparkSession, shared_path(windows.sparkSession, "windows"), windows.schema
    windows.write.parquet(path)
    windows = spark.read.schema(schema).parquet(path)
    own = [f"_{k}" for k in keys]
    places = media_places(windows.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), *dict.fromkeys(r for r, _ in wanted.values())), own, wanted)
    member = F.collect_list(F.struct("output", "k", "data"))
    found = fetch(places).groupBy(*own).agg(F.array_sort(member).alias("_found"))  # as many as a window has frames
    on = F.lit(True)
    for k, o in zip(keys, own):
        on = on & F.col(k).eqNullSafe(F.col(o))
    out = windows.drop(*wanted).join(found, on, "left")
    of = lambda name: F.transform(F.filter("_found", lambda x: x["output"] == name), lambda x: x["data"])
    return out.withColumns({name: F.when(F.size(of(name)) > 0, of(name)) for name in wanted}).drop("_found", *own)

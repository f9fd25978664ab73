"""A source without an end: shards drawn anew each epoch, with offsets that survive a restart, and bounded batches.

An epoch draws as many shards as there are, by a seed and the epoch's number alone: each once (``permute``) or each
independently (``replace``). The stream is the frames of the drawn shards, one after the other, and an offset is an epoch
and the number of frames before it in the epoch; so a batch is the same rows whenever and wherever it is read.

Admission: a batch takes at most ``rows`` frames, and at most ``bytes`` counted by the largest frame of each shard,
but one frame at least; what is not admitted waits for the next batch. Each drawn shard that a batch touches is one
partition, cut into parts of ``part`` frames (``PART``; times the number of lanes where these run side by side, as a task
costs as much as a thousand frames). The list of shards is one row to a shard, on the driver, with the place of
every ``MARK``th frame, so that a part is read from there and not from the shard's first header.

Lanes: with ``lanes`` readers, as a loader has workers, reader ``lane`` takes each ``lanes``-th drawn shard of an epoch.
Each lane is a stream of its own with bounded batches, offsets and ``progress``; together they give each drawn shard
once, and a shard is never parted between lanes.

``progress`` names a folder in which the end of the last planned batch is kept: Spark doesn't tell a source where a
restarted query stands, and this is the end of a batch that its own log has.

Defined cases: no frames at all is an error, as such a stream would never deliver; an empty shard gives no rows;
``epochs`` ends the stream after so many (0: never).
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import FRAMES
from ..sources.files import open_at, open_in, open_out, shared_path
from ..sources.shards import ALWAYS, BATCH, batch_of, expand, frame, listed_paths, wanted
from ..sources.tars import BLOCK, Bytes, members

NAME = "resampled_shards"
#: Frames between two places of a shard that are kept, and frames to a part.
MARK, PART = 500, 1000
SCHEMA = T.StructType([*FRAMES.fields, T.StructField("epoch", T.LongType()), T.StructField("draw", T.LongType())])


class Shard(NamedTuple):
    path: str
    rows: int
    #: Bytes of media in its largest frame.
    largest: int
    #: Where the header of frame MARK, 2 * MARK and so on is, as far as all headers before it are plain.
    marks: Sequence[int] = ()

    def before(self, first: int) -> tuple[int, int]:
        """The last marked frame up to ``first``, and its place."""
        k = min(first // MARK, len(self.marks))
        return k * MARK, self.marks[k - 1] if k else 0


class Slice(InputPartition):
    """Frames first to last of a drawn shard, found from a marked frame on."""

    def __init__(self, path: str, first: int, last: int, epoch: int, draw: int, mark: tuple[int, int] = (0, 0)):
        super().__init__(path)
        self.path, self.first, self.last, self.epoch, self.draw, self.mark = path, first, last, epoch, draw, mark


@functools.lru_cache(2)
def drawn(n: int, epoch: int, seed: int, how: str) -> tuple[int, ...]:
    """Numbers of an epoch's shards of n, drawn once for all batches of the epoch."""
    rng = np.random.default_rng([seed, epoch])
    if how not in ("permute", "replace"):
        raise ValueError(f"unknown way to draw: {how}")
    return tuple((rng.permutation(n) if how == "permute" else rng.integers(0, n, n)).tolist())


def draws(shards: Sequence[Shard], epoch: int, seed: int, how: str) -> list[int]:
    """Numbers of the shards of an epoch, in order."""
    return list(drawn(len(shards), epoch, seed, how))


def walk(shards: Sequence[Shard], epoch: int, at: int, seed: int, how: str, epochs: int = 0, lane: int = 0, lanes: int = 1) -> Iterator[tuple[int, int, int, Shard]]:
    """(epoch, draw, first frame, shard) of a lane from an offset on, without end if ``epochs`` is 0."""
    while not epochs or epoch < epochs:
        for draw, k in list(enumerate(draws(shards, epoch, seed, how)))[lane::lanes]:
            if at < shards[k].rows:
                yield epoch, draw, at, shards[k]
            at = max(0, at - shards[k].rows)
        epoch, at = epoch + 1, 0


def admit(shards: Sequence[Shard], start: dict, rows: int, most: int, seed: int, how: str, epochs: int = 0, lane: int = 0, lanes: int = 1) -> dict:
    """The offset that a batch from ``start`` may reach."""
    end, taken, size = dict(start), 0, 0
    for epoch, _, first, shard in walk(shards, start["epoch"], start["at"], seed, how, epochs, lane, lanes):
        if epoch != end["epoch"]:
            end = {"epoch": epoch, "at": 0}
        room = min(rows - taken, shard.rows - first)
        if most:
            room = min(room, max((most - size) // max(1, shard.largest), 0 if taken else 1))
        end["at"] += room
        taken, size = taken + room, size + room * shard.largest
        if room < shard.rows - first:
            break
    return end


def slices(shards: Sequence[Shard], start: dict, end: dict, seed: int, how: str, part: int, lane: int = 0, lanes: int = 1) -> list[Slice]:
    """Partitions of a batch."""
    out, at = [], dict(start)
    for epoch, draw, first, shard in walk(shards, start["epoch"], start["at"], seed, how, lane=lane, lanes=lanes):
        if epoch != at["epoch"]:
            at = {"epoch": epoch, "at": 0}
        if (epoch, at["at"]) >= (end["epoch"], end["at"]):
            break
        last = shard.rows if epoch < end["epoch"] else min(shard.rows, first + end["at"] - at["at"])
        out += [Slice(shard.path, k, min(k + part, last), epoch, draw, shard.before(k)) for k in range(first, last, part)]
        at["at"] += last - first
    return out


def frames_between(shard: str, first: int, last: int, suffixes: Sequence[str], mark: tuple[int, int] = (0, 0), text_of_meta: bool = True) -> Iterator[dict]:
    """Frames first to last (not included) of a shard, from a frame before them and its place on; what belongs to others
    is passed over unread."""
    with open_at(shard) as file:
        held, key, data, pos = Bytes(file), None, {}, mark[0] - 1
        for path, offset, size in members(held, mark[1]):
            folder, slash, name = path.rpartition("/")
            stem, _, suffix = name.partition(".")
            if (this := folder + slash + stem) != key:
                if first <= pos < last:
                    yield frame(shard, pos, key, data, text_of_meta)
                key, data, pos = this, {}, pos + 1
                if pos >= last:
                    return
            if pos >= first and suffix in suffixes:
                data[suffix] = held.member(offset, size)
        if first <= pos < last:
            yield frame(shard, pos, key, data, text_of_meta)


def columns_of(options: dict[str, str]) -> list[str]:
    return json.loads(options["columns"]) if "columns" in options else SCHEMA.names


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        with open_in(options["shards"]) as f:
            self.shards = [Shard(*x) for x in json.loads(f.read())]
        if not sum(s.rows for s in self.shards):
            raise ValueError("no frames in any shard")
        number = lambda name, default: int(options.get(name, default))
        self.seed, self.how, self.epochs, self.rows, self.most, self.part = number("seed", 0), options.get("draw", "permute"), number("epochs", 0), max(1, number("rows", 10_000)), number("bytes", 0), max(1, number("part", PART))
        self.suffixes, self.progress, self.columns = json.loads(options["suffixes"]), options.get("progress"), columns_of(options)
        self.lane, self.lanes = number("lane", 0), number("lanes", 1)
        if not 0 <= self.lane < self.lanes <= max(1, len(self.shards)):
            raise ValueError(f"lane {self.lane} of {self.lanes}, {len(self.shards)} shards")
        self.at = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shards": []}  # tasks read slices and need no list

    def initialOffset(self) -> dict:
        return {"epoch": 0, "at": 0}

    def latestOffset(self) -> dict:
        return admit(self.shards, self._reached(), self.rows, self.most, self.seed, self.how, self.epochs, self.lane, self.lanes)

    def _reached(self) -> dict:
        """The end of the last batch that was planned, by this reader or by the one before a restart."""
        if self.at is None and self.progress:
            try:
                with open_in(f"{self.progress}/reached.json") as f:
                    self.at = json.loads(f.read())
            except FileNotFoundError:
                pass
        return self.at or self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = end
        if self.progress:
            with open_out(f"{self.progress}/reached.json") as f:
                f.write(json.dumps(end).encode())
        return slices(self.shards, start, end, self.seed, self.how, self.part, self.lane, self.lanes)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        schema, rows = to_arrow_schema(T.StructType([SCHEMA[c] for c in self.columns])), []
        for row in frames_between(partition.path, partition.first, partition.last, self.suffixes, partition.mark, "meta" in self.columns):
            row["epoch"], row["draw"] = partition.epoch, partition.draw
            rows.append(row)
            if len(rows) == BATCH:
                yield batch_of(rows, schema)
                rows = []
        yield batch_of(rows, schema)


class ResampledShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return T.StructType([SCHEMA[c] for c in columns_of({k.lower(): v for k, v in self.options.items()})])

    def streamReader(self, schema: T.StructType) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def measured(shard: str) -> Shard:
    """A shard's frames, its largest one and its marks, from headers alone."""
    with open_at(shard) as file:
        key, rows, size, largest, marks, end, plain = None, 0, 0, 0, [], 0, True
        for path, offset, n in members(Bytes(file)):
            folder, slash, name = path.rpartition("/")
            stem, _, suffix = name.partition(".")
            plain = plain and offset == end + BLOCK
            if (this := folder + slash + stem) != key:
                if rows and rows % MARK == 0 and plain:
                    marks.append(end)
                key, rows, size = this, rows + 1, 0
            size += 0 if suffix in ALWAYS else n
            largest, end = max(largest, size), offset + -(-n // BLOCK) * BLOCK
    return Shard(shard, rows, largest, marks)


def list_shards(spark: SparkSession, patterns: str | Sequence[str], path: str) -> str:
    """Write the list of shards with their frames, largest frame and marks; returns its path."""
    paths, kind = expand(spark, patterns), T.StructType.fromDDL("path string, rows long, largest long, marks array<long>")
    schema = to_arrow_schema(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([measured(p)._asdict() for p in batch.column(0).to_pylist()], schema)

    listed = listed_paths(spark, paths)
    rows = sorted(r for r in listed.mapInArrow(read, kind).collect() if r.rows)  # one row to a shard
    with open_out(f"{path}/shards.json") as f:
        f.write(json.dumps([tuple(r) for r in rows]).encode())
    return f"{path}/shards.json"


def resampled(spark: SparkSession, patterns: str | Sequence[str], progress: str | None = None, seed: int = 0, draw: str = "permute", epochs: int = 0, rows: int = 10_000, most_bytes: int = 0, image: bool = True, depth: bool = False, chest: bool = False) -> DataFrame:
    """A stream of frames of shards that are drawn anew each epoch; ``progress`` belongs to one query, like its checkpoint."""
    options = {"seed": seed, "draw": draw, "epochs": epochs, "rows": rows, "bytes": most_bytes, "suffixes": json.dumps(wanted(image, depth, chest))} | ({"progress": progress} if progress else {})
    return _stream(spark, options | {"shards": list_shards(spark, patterns, shared_path(spark, "resampled"))})


def resampled_lanes(spark: SparkSession, patterns: str | Sequence[str], lanes: int, seed: int = 0, draw: str = "permute", epochs: int = 0, rows: int = 10_000, most_bytes: int = 0, image: bool = True, depth: bool = False, chest: bool = False, columns: Sequence[str] | None = None) -> list[DataFrame]:
    """The same frames as ``resampled`` gives, as ``lanes`` streams side by side (fewer, if there are fewer shards); only
    these ``columns``, if they are given."""
    listed = list_shards(spark, patterns, shared_path(spark, "resampled"))
    with open_in(listed) as f:
        lanes = max(1, min(lanes, len(json.loads(f.read()))))
    options = {"shards": listed, "seed": seed, "draw": draw, "epochs": epochs, "rows": rows, "bytes": most_bytes, "suffixes": json.dumps(wanted(image, depth, chest)), "columns": json.dumps(columns or SCHEMA.names), "lanes": lanes, "part": PART * lanes}
    return [_stream(spark, options | {"lane": k}) for k in range(lanes)]


def _stream(spark: SparkSession, options: dict) -> DataFrame:
    spark.dataSource.register(ResampledShards)
    return spark.readStream.format(NAME).options(**{k: str(v) for k, v in options.items()}).load()

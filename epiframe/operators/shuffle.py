"""Shuffling by buckets and bounded buffers.

Rows go to random buckets, by a hash, so that any row may meet any other; a task then passes its rows, in a given
order, through a buffer that gives out a random row for each that comes in. It holds ``buffer`` rows and one batch, and
begins to give out when ``initial`` are there; until it is full it takes in two for each it gives out. A row leaves at
most ``buffer`` places before the place it came in at. Order and choices follow the seed, so a lost task repeats itself.

Defined cases: a buffer of 0, none or less switches the shuffle off; ``initial`` is at least 1 and at most the
buffer, which it is by default; an empty table stays empty; rows that repeat stay as often as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the buffer, and how many are there before the first is given out.
BUFFER, INITIAL = 16384, 4096


def warm_up(buffer: int | None, initial: int | None) -> int:
    """Rows that are there before the first is given out; 0 if there is no shuffle."""
    if not buffer or buffer <= 0:
        return 0
    return buffer if initial is None else max(1, min(initial, buffer))


class Buffer:
    """The state of one task: rows that wait, as a table."""

    def __init__(self, buffer: int, initial: int, rng: np.random.Generator):
        self.buffer, self.initial, self.rng = buffer, initial, rng
        self.table, self.pool, self.owed = None, [], False

    def pick(self) -> int:
        k = int(self.rng.integers(len(self.pool)))
        self.pool[k], self.pool[-1] = self.pool[-1], self.pool[k]
        return self.pool.pop()

    def put(self, batch: pa.RecordBatch) -> pa.Table:
        """What leaves while the batch comes in."""
        new, before = pa.Table.from_batches([batch]), len(self.pool)
        table = new if self.table is None else pa.concat_tables([self.table, new])
        out: list[int] = []
        for k in range(before, before + batch.num_rows):
            self.pool.append(k)
            if not self.owed and len(self.pool) < self.buffer:
                self.owed = True  # one more comes in before the next leaves
                continue
            self.owed = False
            if len(self.pool) >= self.initial:
                out.append(self.pick())
        left = table.take(pa.array(out, pa.int64()))
        self.table, self.pool = table.take(pa.array(self.pool, pa.int64())), list(range(len(self.pool)))
        return left

    def rest(self) -> pa.Table | None:
        """What is left at the end, in random order."""
        if self.table is None:
            return None
        out = [self.pick() for _ in range(len(self.pool))]
        return self.table.take(pa.array(out, pa.int64()))


def buffer_shuffle(df: DataFrame, order: Sequence[str], buffer: int | None = BUFFER, initial: int | None = INITIAL, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """df with its rows in another order inside each partition; ``order`` is the order in which rows come in.

    With ``buckets`` rows are dealt out at random to so many partitions first; else each stays in its own.
    """
    first = warm_up(buffer, initial)
    if not first:
        return df
    key = F.xxhash64(*order, F.lit(seed))
    dealt = df.repartition(buckets, key) if buckets else df
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Buffer(buffer, first, np.random.default_rng([seed, TaskContext.get().partitionId()]))
        for batch in batches:
            yield from state.put(batch).to_batches()
        if (left := state.rest()) is not None:
            yield from left.to_batches(10_000)

    return dealt.sortWithinPartitions(*order).mapInArrow(run, schema)

"""Steps over Arrow batches, several in one Python worker.

Spark gives each ``mapInArrow`` of a task a worker of its own, and those of one stage live side by side: three in a row
hold three times the memory of one. ``through`` passes a task's batches through all its steps in one worker.

A step takes the schema of its rows and gives the schema of its result and a function from batches to batches, which
finds columns by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]
Run = Callable[[Batches], Batches]
Step = Callable[[T.StructType], tuple[T.StructType, Run]]


def chained(schema: T.StructType, steps: Sequence[Step]) -> tuple[T.StructType, Run]:
    """Steps one after the other; none leave batches as they are."""
    runs = []
    for step in steps:
        schema, run = step(schema)
        runs.append(run)

    def whole(batches: Batches) -> Batches:
        for run in runs:
            batches = run(batches)
        return batches

    return schema, whole


def through(rows: DataFrame, *steps: Step) -> DataFrame:
    """rows after steps that share a worker."""
    schema, run = chained(rows.schema, steps)
    return rows.mapInArrow(run, schema)


def widened(batch: pa.RecordBatch, names: Sequence[str], rows: Iterable[tuple], kinds: Mapping[str, pa.DataType], most: int) -> Batches:
    """Columns ``names`` of a batch and new ones of ``kinds``, whose values ``rows`` gives for each of its rows, in parts
    that end before their new bytes are more than ``most``."""
    first, held, size = 0, [], 0

    def part() -> pa.RecordBatch:
        old = batch.slice(first, len(held))
        return pa.RecordBatch.from_arrays([*(old.column(c) for c in names), *(pa.array(x, k) for x, k in zip(zip(*held), kinds.values()))], names=[*names, *kinds])

    for row in rows:
        more = sum(len(x) for x in row if isinstance(x, bytes))
        if held and size + more > most:
            yield part()
            first, held, size = first + len(held), [], 0
        held.append(row)
        size += more
    if held:
        yield part()

"""Two streams laid into batches by a ratio, and one view over a first and a second dataset.

Rows of each stream are numbered from 0 in lanes, which are independent of one another, so that lanes spread over
tasks. ``blend_streams`` gives each row of the first its slot as soon as it arrives, and after a round of them assigns
rows of the second, from its start again once it has ended. The state of a lane is four numbers: rows seen of each
stream, rows of the second that were assigned, and whether the second has ended. Slots hold numbers of rows, not
their content, which is looked up where it is needed; rows of the second that have not arrived yet are assigned
when they do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blend import chain, interleave, interleave_sizes

#: Slots to an output frame.
PART = 100_000


def assigned(v: int, m: int, batch: int, before: tuple, after: tuple) -> Iterator[pd.DataFrame]:
    """Slots that become known between two states (first seen, second seen, second assigned, second ended)."""
    for k in range(before[0], after[0], PART):
        n = np.arange(k, min(k + PART, after[0]))
        yield pd.DataFrame({"slot": n // v * batch + n % v, "source": "first", "n": n})
    for k in range(before[2], after[2], PART):
        j = np.arange(k, min(k + PART, after[2]))
        yield pd.DataFrame({"slot": j // max(1, m) * batch + v + j % max(1, m), "source": "second", "n": j % after[1] if after[3] else j})


def blend_streams(first: DataFrame, second: DataFrame, ratio: float = 5 / 6, batch: int = 20, lane: str = "lane", final: str = "final") -> DataFrame:
    """(lane, slot, source, n) of streams whose rows arrive in the order of their numbers, each lane's from 0.

    ``final`` of the second marks a lane's last row; it may come with the row or as its repetition with a null number
    (column ``n``), which is not counted.
    """
    v, m = interleave_sizes(ratio, batch)
    rows = first.select(F.col(lane).alias("lane"), F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("final")).unionByName(
        second.select(F.col(lane).alias("lane"), F.lit(0).alias("a"), F.col("n").isNotNull().cast("int").alias("b"), F.coalesce(F.col(final), F.lit(False)).alias("final"))
    )

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a, b, done, ended = before = state.get if state.exists else (0, 0, 0, False)
        for part in parts:
            a, b, ended = a + int(part["a"].sum()), b + int(part["b"].sum()), ended or bool(part["final"].any())
        due = a // v * m
        done = (due if b else 0) if ended else min(due, b)
        state.update(after := (a, b, done, ended))
        for out in assigned(v, m, batch, before, after):
            yield out.assign(lane=key[0])[["lane", "slot", "source", "n"]]

    kind = first.schema[lane].dataType.simpleString()
    return rows.groupBy("lane").applyInPandasWithState(step, f"lane {kind}, slot long, source string, n long", "a long, b long, done long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def unified(first: DataFrame, second: DataFrame | None = None, ratio: float = 5 / 6, batch: int = 20, mode: str = "train", number: str = "n") -> DataFrame:
    """A first and an optional second dataset as one. ``train``: slots in the ratio (of streams, or of numbered rows);
    the second starts anew when it ends. ``val``: all of the first, then all of the second, told apart by source_ord."""
    interleave_sizes(ratio, batch)  # the ratio is checked in every mode
    if mode not in ("train", "val"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "val":
        return chain([first] if second is None else [first, second])
    if second is None:
        return first
    if first.isStreaming or second.isStreaming:
        return blend_streams(first, second, ratio, batch)
    return interleave(first, second, second.count(), ratio, batch, number)

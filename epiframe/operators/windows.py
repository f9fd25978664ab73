"""Strided history and future windows inside episodes, as offsets of one sorted window: no self-join, one shuffle.

Payloads are wrapped in structs, so that null payloads stay rows. Filters on anchors come after the windows: an anchor
that is dropped remains history and future of others.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


class Reach(NamedTuple):
    """How far a stream of a sample goes: sampled frames, frames from one to the next, and what stands for missing ones."""

    horizon: int
    stride: int = 1
    pad: str = "repeat"

    def frames(self, first: int = 0) -> int:
        """Frames from the anchor to the last sampled one, which are ``first`` strides more where sampling starts later."""
        return max(0, self.horizon - 1 + first) * self.stride if self.horizon else 0


class WindowConfig(NamedTuple):
    """What a sample holds: past states and images, actions from the anchor on, frames after it."""

    #: What samples hold by default.
    actions: Reach = Reach(32, 1, "truncate")
    states: Reach = Reach(16, 2)
    images: Reach = Reach(1, 30)
    later: Reach = Reach(0, 30)
    quality_filter: bool = True

    def past(self) -> int:
        return max(self.states.frames(), self.images.frames())

    def ahead(self) -> int:
        return 1 + max(self.actions.frames(), self.later.frames(1))

    def checked(self) -> WindowConfig:
        """Itself, if all its streams pad in a known way."""
        odd = {r.pad for r in self[:4]} - {"repeat", "truncate"}
        if odd:
            raise ValueError(f"unknown ways to pad: {sorted(odd)}")
        return self


def segments(df: DataFrame, stream: Sequence[str], order: Sequence[str], key: Sequence[str], name: str = "run") -> DataFrame:
    """Number maximal runs of equal keys within a stream, from 1: a key that comes again is a new run."""
    w = Window.partitionBy(*stream).orderBy(*order)
    same = F.lit(True)
    for k in key:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    changed = F.when((F.row_number().over(w) > 1) & same, 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w)).drop("_changed")


def history(payload: Column, spec: WindowSpec, horizon: int, stride: int, pad: str = "repeat") -> Column:
    """Array of payloads, oldest first and the current one last; missing ones repeat the episode's first or are left out."""
    whole = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    boxed = F.struct(payload.alias("v"))
    past = [F.lag(boxed, k * stride).over(spec) for k in range(horizon - 1, 0, -1)]
    if pad == "repeat":
        first = F.first(boxed).over(whole)
        past = [F.coalesce(p, first) for p in past]
    return F.transform(F.filter(F.array(*past, boxed), lambda x: x.isNotNull()), lambda x: x["v"])


def future(payload: Column, spec: WindowSpec, horizon: int, stride: int, pad: str = "truncate", base: int = 0, quality: Column | None = None) -> Column:
    """Array of payloads at offsets base, base + stride, ...; with quality, cut before the first sampled frame of
    quality 0, which also ends padding; past the episode's end, repeat its last frame or leave out."""
    boxed = F.struct(payload.alias("v"), (quality if quality is not None else F.lit(1)).alias("q"))
    there = F.filter(F.array(*(F.lead(boxed, base + k * stride).over(spec) if base + k else boxed for k in range(horizon))), lambda x: x.isNotNull())
    cut = F.array_position(F.transform(there, lambda x: x["q"]), 0) if quality is not None else F.lit(0).cast("long")
    kept = F.when(cut > 0, F.slice(there, 1, F.greatest(cut - 1, F.lit(0)).cast("int"))).otherwise(there)
    if pad == "repeat":
        last = F.last(boxed).over(spec.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        kept = F.when(cut > 0, kept).otherwise(F.concat(kept, F.array_repeat(last, F.lit(horizon) - F.size(there))))
    return F.transform(kept, lambda x: x["v"])


def compose(frames: DataFrame, config: WindowConfig, payload: str = "payload", episode: Sequence[str] = ("dataset_name", "episode_index"), order: Sequence[str] = ("pos",)) -> DataFrame:
    """Window samples of frames: states, actions, future_frames with their counts; anchors of high quality only."""
    spec = Window.partitionBy(*episode).orderBy(*order)
    quality = F.coalesce(F.col("high_quality"), F.lit(1))
    cut, later = quality if config.quality_filter else None, config.checked().later
    df = frames.withColumns(
        {
            "states": history(F.col(payload), spec, *config.states),
            "actions": future(F.col(payload), spec, *config.actions, 0, cut),
            "future_frames": future(F.col(payload), spec, *later, later.stride, cut) if later.horizon else F.array().cast("array<double>"),
        }
    )
    df = df.withColumns({"n_states": F.size("states"), "n_actions": F.size("actions"), "n_future_frames": F.size("future_frames")})
    return df.where(quality == 1) if config.quality_filter else df


def pad_with_mask(values: Column, horizon: int, zero: Column) -> tuple[Column, Column]:
    """values padded with zero to horizon, and a mask that is true at the values."""
    n = F.least(F.size(values), F.lit(horizon))
    padded = F.concat(F.slice(values, 1, horizon), F.array_repeat(zero, F.lit(horizon) - n))
    return padded, F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda k: k < n)

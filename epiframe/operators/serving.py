"""What a served model takes: observations as padded rows, and the visual entries of a batch in the order of their places.

Everything is column expressions over one row, or one explode; nothing is shuffled.

Defined cases: an observation without an instruction takes the default, and without that is an error; one without the
head's image or intrinsic is an error; a chest's image without its intrinsic, or the other way, leaves the head alone;
no states give zeros and a count of 0; a longer prefix than the horizon is cut to its first steps; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import intrinsic_vector
from .samples import history


class Horizon(NamedTuple):
    """Lengths of a model's inputs, numbers to a state, and how short histories are filled."""

    images: int = 1
    states: int = 16
    actions: int = 32
    width: int = 48
    pad: str = "repeat"
    #: Frames a second before sampling, and frames from one sampled image to the next.
    fps: float = 30.0
    stride: int = 30


def _scaled(steps: Column, scale: Sequence[float] | None, offset: Sequence[float] | None) -> Column:
    """An array of steps with a normalizer's scale and offset by dimension."""
    if scale is None:
        return steps
    a, b = F.array(*(F.lit(float(x)) for x in scale)), F.array(*(F.lit(float(x)) for x in offset or [0.0] * len(scale)))
    return F.transform(steps, lambda step: F.zip_with(F.zip_with(step, a, lambda x, y: x * y), b, lambda x, y: x + y))


def _zero_padded(steps: Column, length: int, width: int) -> Column:
    zero = F.array_repeat(F.lit(0.0), width)
    return F.concat(F.slice(steps, 1, length), F.array_repeat(zero, F.greatest(F.lit(0), F.lit(length) - F.size(steps))))


def observations(df: DataFrame, horizon: Horizon = Horizon(), default_instruction: str | None = None, scale: Sequence[float] | None = None, offset: Sequence[float] | None = None) -> DataFrame:
    """df(instruction, head_images, chest_images, head_intrinsic, chest_intrinsic, states, prefix) as a model takes it.

    Images are arrays of frames, intrinsics four numbers or a flat matrix, states and prefix arrays of steps. States
    are normalized, given their history and padded with zeros; a prefix of known actions is normalized and padded, and
    its length is the delay.
    """
    text = F.coalesce(F.when(F.col("instruction") != "", F.col("instruction")), F.lit(default_instruction) if default_instruction is not None else F.raise_error(F.lit("an observation needs an instruction")).cast("string"))
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"an observation needs {c}")).cast(df.schema[c].dataType.simpleString())).otherwise(F.col(c))
    two = F.col("chest_images").isNotNull() & F.col("chest_intrinsic").isNotNull()
    states = _scaled(F.coalesce(F.col("states"), F.array().cast("array<array<double>>")), scale, offset)
    past, count = history(states, horizon.states, horizon.pad)
    some = F.size(states) > 0
    prefix = _scaled(F.col("prefix"), scale, offset)
    return df.withColumns(
        {
            "instruction": text, "head_images": history(need("head_images"), horizon.images, horizon.pad)[0], "chest_images": F.when(two, history(F.col("chest_images"), horizon.images, horizon.pad)[0]),
            "head_intrinsic": intrinsic_vector(need("head_intrinsic")), "chest_intrinsic": F.when(two, intrinsic_vector(F.col("chest_intrinsic"))),
            "active_views": F.when(two, F.array(F.lit("head"), F.lit("chest"))).otherwise(F.array(F.lit("head"))), "view_mask": F.array(F.lit(True), F.coalesce(two, F.lit(False))),
            "states": F.when(some, _zero_padded(past, horizon.states, horizon.width)).otherwise(_zero_padded(states, horizon.states, horizon.width)), "n_states": F.when(some, count).otherwise(F.lit(0)),
            "prefix": F.when(F.col("prefix").isNotNull(), _zero_padded(prefix, horizon.actions, horizon.width)), "delay": F.when(F.col("prefix").isNotNull(), F.least(F.size("prefix"), F.lit(horizon.actions))),
            "n_actions": F.lit(horizon.actions), "video_fps": F.lit(horizon.fps / horizon.stride),
        }
    )


def vision_entries(df: DataFrame, sample: str, kind: str, views: str, frames: str, chest_frames: str, fps: str) -> DataFrame:
    """(sample, place, kind, view, frames, fps, indices): a row to each image of an image sample, and to each view's video
    of a video sample, the head's first. ``frames`` counts a sample's images, or the frames of its head's video.
    ``indices`` are a video's frames, which are not sampled again."""
    n, n_chest, k = F.col(frames), F.col(chest_frames), F.col(kind)
    entry = lambda view, count, rate: F.struct(view.alias("view"), count.alias("frames"), rate.alias("fps"))
    images = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda _: entry(F.lit(None).cast("string"), F.lit(1), F.lit(None).cast("double")))
    missing = F.raise_error(F.concat(F.lit("chest view without frames in "), F.col(sample).cast("string"))).cast("int")
    odd = F.raise_error(F.concat(F.lit("unknown view or kind in "), F.col(sample).cast("string"))).cast("int")
    count = lambda v: F.when(v == "head", n).when((v == "chest") & n_chest.isNotNull(), n_chest).when(v == "chest", missing).otherwise(odd)
    videos = F.transform(views, lambda v: entry(v, count(v).cast("int"), F.col(fps).cast("double")))
    none = F.filter(images, lambda _: F.lit(False))
    entries = F.when((k == "image") & (n > 0), images).when(k == "image", none).when(k == "video", videos).otherwise(F.when(odd.isNull(), none))
    rows = df.select(F.col(sample), k.alias("kind"), F.posexplode(entries).alias("place", "e"))
    indices = F.when(F.col("kind") == "video", F.when(F.col("e.frames") > 0, F.sequence(F.lit(0), F.col("e.frames") - 1)).otherwise(F.array().cast("array<int>")))
    return rows.select(sample, "place", "kind", "e.view", "e.frames", "e.fps", indices.alias("indices"))

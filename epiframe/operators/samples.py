"""Rows that a model takes: named slices, states and actions in the camera's frame, padding, QA rows, evaluation picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schema import lowdim_slices
from .blend import unit_hash


def named_slices(lowdim: Column, cameras: list[str]) -> dict[str, Column]:
    """Columns of a low-dimensional vector by name."""
    return {name: F.slice(lowdim, start + 1, end - start) for name, (start, end) in lowdim_slices(cameras).items()}


def truncated_hands(hands: G.Vector, each: int) -> G.Vector:
    """The first numbers of each hand's half."""
    half = len(hands) // 2
    return [*hands[:each], *hands[half : half + each]]


Poses = tuple[G.Matrix, G.Matrix]


def process_state_action(poses: Poses, hands: G.Vector, extrinsic: G.Matrix, each: int, motion: str = "mano") -> G.Vector:
    """A pose in the camera's frame: 18 wrist numbers, then both hands, as they are (mano) or, as points, in their wrist's
    frame (fingertips). Each hand keeps its first numbers."""
    hands = truncated_hands(hands, each)
    if motion == "fingertips":
        hands = [x for p in G.hand_to_wrist([hands[k : k + 3] for k in range(0, len(hands), 3)], *poses) for x in p]
    elif motion != "mano":
        raise ValueError(f"unknown motion: {motion}")
    return [*(G.finite_or_zero(x) for x in G.wrist_vector(*(G.matmul(extrinsic, p) for p in poses))), *hands]


def relative_action(state: Poses, action: Poses, state_hands: G.Vector, action_hands: G.Vector) -> G.Vector:
    """An action seen from a state: wrists by the inverse of the state's poses, hands by difference."""
    wrists = [G.relative_pose(s, a) for s, a in zip(state, action)]
    return [*G.wrist_vector(*wrists), *(a - s for s, a in zip(state_hands, action_hands))]


def absolute_action(state: Poses, relative: Poses, state_hands: G.Vector, relative_hands: G.Vector) -> G.Vector:
    """The inverse of relative_action."""
    wrists = [G.matmul(s, a) for s, a in zip(state, relative)]
    return [*G.wrist_vector(*wrists), *(a + s for s, a in zip(state_hands, relative_hands))]


def hand_points_to_camera(points: list[G.Vector], poses: Poses) -> list[G.Vector]:
    """Points of both hands, each in its wrist's frame, by the wrists' poses in the camera's frame."""
    return [G.transform_point(poses[k >= len(points) // 2], p) for k, p in enumerate(points)]


def history(values: Column, horizon: int, pad: str = "repeat") -> tuple[Column, Column]:
    """The last values of an array and how many there are; a short one repeats its first, or stays."""
    n = F.least(F.size(values), F.lit(horizon))
    last = F.slice(values, F.size(values) - n + 1, n)
    if pad == "repeat":
        return F.concat(F.array_repeat(F.get(values, 0), F.lit(horizon) - n), last), F.lit(horizon)
    return last, n


def qa_row(turn: Column, source: Column, dataset: Column, number: Column) -> dict[str, Column]:
    """Columns of a question row: the chosen turn (user, assistant), no views, names and numbers with their defaults."""
    return {
        "question": turn["user"], "answer": turn["assistant"], "is_vla_data": F.lit(False), "view_mask": F.array(F.lit(False), F.lit(False)),
        "dataset_name": F.coalesce(source, dataset, F.lit("unknown")), "episode_index": F.coalesce(number, F.lit(-1)),
    }


def zero_filled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns that it lacks, and their fill where they are null."""
    return df.withColumns({c: F.coalesce(F.col(c), fill) if c in df.columns else fill for c, fill in columns.items()})


def scatter_slots(tokens: DataFrame, values: DataFrame, sample: str, place: str, masked: Column, k: str = "k", value: str = "value") -> DataFrame:
    """tokens with ``value``: the k-th masked place of a sample, counted from 0, takes its k-th row of values, others
    null. A sample with more masked places than values, or fewer, is an error."""
    w = Window.partitionBy(sample).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tokens.drop(value).withColumns({"_there": F.lit(True), "_masked": F.coalesce(masked, F.lit(False))})
    rows = rows.withColumn("_k", F.when(F.col("_masked"), F.count_if(F.col("_masked")).over(w) - 1).cast("long"))
    side = values.select(F.col(sample), F.col(k).cast("long").alias("_k"), F.col(value).alias("_value"), F.lit(True).alias("_found"))
    joined = rows.join(side, [sample, "_k"], "full_outer")
    odd = F.col("_there").isNull() | (F.col("_masked") & F.col("_found").isNull())
    wrong = F.raise_error(F.concat(F.lit(f"slots and values differ in {sample} "), F.coalesce(F.col(sample).cast("string"), F.lit("null"))))
    kind = values.schema[value].dataType.simpleString()
    return joined.withColumn(value, F.when(odd, wrong.cast(kind)).otherwise(F.col("_value"))).select(*tokens.drop(value).columns, value)


def view_intrinsics(df: DataFrame, keys: Sequence[str], views: str, intrinsics: str) -> DataFrame:
    """(keys, place, view, intrinsic): a row to each active view, sample by sample, looked up by name with the first
    camera as fallback."""
    flat = df.select(*keys, intrinsics, F.posexplode(views).alias("place", "view"))
    found = F.coalesce(F.element_at(F.col(intrinsics), F.col("view")), F.get(F.map_values(intrinsics), 0))
    return flat.select(*keys, "place", "view", found.alias("intrinsic"))


def head_entries(df: DataFrame, sample: str, entries: str, samples: Column) -> DataFrame:
    """df with entry: where a sample's head video is among a batch's entries, of which there are as many as samples, or
    twice as many; else the first entries, and null beyond them. One batch to a row group with the same counts."""
    n = F.col(entries)
    place = F.when(n == samples, F.col(sample)).when(n == 2 * samples, 2 * F.col(sample)).otherwise(F.col(sample))
    return df.withColumn("entry", F.when(place < n, place))


def eval_subsample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, in order of their key; the choice follows a hash of it."""
    return df.withColumn("_u", unit_hash(key, seed=seed)).orderBy("_u", key).limit(n).drop("_u").orderBy(key)


def report_rows(pred: DataFrame, delay: int = 0) -> DataFrame:
    """Samples by falling error over valid entries after a known prefix, with their rank; without any entry they come last."""
    on = (F.col("step") >= delay) & F.col("valid")
    by = pred.groupBy("sample_id").agg(F.avg(F.when(on, F.abs(F.col("gt") - F.col("pred")))).alias("mae"), F.count_if(on).alias("n"), F.avg(F.when(F.col("step") < delay, F.abs(F.col("gt") - F.col("pred")))).alias("prefix_l1"))
    return by.orderBy(F.desc_nulls_last("mae"), "sample_id")


def scored(pred: DataFrame) -> DataFrame:
    """Predictions that have both sides; rows without either are left to the report alone."""
    return pred.where("gt IS NOT NULL AND pred IS NOT NULL")

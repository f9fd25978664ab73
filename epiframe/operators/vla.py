"""Rows of a vision-language-action model: windows turned into padded states, actions and camera motions, and back.

A window has arrays of wrist vectors (18 numbers: two translations, two 6-D rotations) and hand vectors for its states and
its actions, the extrinsic of its frame and, perhaps, those of frames after it. ``model_rows`` brings wrists into the
camera's frame, hands as they are or as points into their wrist's frame, turns actions into motions from the last
state if they are relative, normalizes, and pads with zeros to fixed lengths, with counts and a mask. A window is some
dozen small matrices, so that a task computes rows in numpy, slice by slice; windows themselves come from
``windows.compose``, which is one shuffle.

Defined cases: a window without states has none to be relative to, and its relative actions are an error that names it;
more states, actions or frames than a length are cut to its first; missing extrinsics of later frames give no motions;
a number that is not finite in a wrist becomes 0 after the move into the camera's frame; nulls in arrays are not a
number; no rows give no rows; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

WRIST = 18
SLICE = 256


class Shape(NamedTuple):
    """Lengths and modes of a model's rows."""

    states: int = 16
    actions: int = 32
    later: int = 0
    #: Numbers of each hand that are kept.
    hand: int = 15
    motion: str = "mano"
    relative: bool = False

    @property
    def width(self) -> int:
        return WRIST + 2 * self.hand

    def checked(self) -> Shape:
        if self.motion not in ("mano", "fingertips"):
            raise ValueError(f"unknown motion: {self.motion}")
        if self.motion == "fingertips" and self.hand % 3:
            raise ValueError(f"points need three numbers each: {self.hand}")
        return self


# numpy, over any leading dimensions


def rotations(r6: np.ndarray) -> np.ndarray:
    """Rotations whose first two columns span the given ones."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    a = unit(r6[..., :3])
    b = unit(r6[..., 3:] - (a * r6[..., 3:]).sum(-1, keepdims=True) * a)
    return np.stack([a, b, np.cross(a, b)], axis=-1)


def poses(wrists: np.ndarray) -> np.ndarray:
    """Left and right pose (.., 2, 4, 4) of wrist vectors."""
    out = np.zeros((*wrists.shape[:-1], 2, 4, 4))
    out[..., :3, :3] = rotations(wrists[..., 6:18].reshape(*wrists.shape[:-1], 2, 6))
    out[..., :3, 3] = wrists[..., :6].reshape(*wrists.shape[:-1], 2, 3)
    out[..., 3, 3] = 1.0
    return out


def wrist_vectors(m: np.ndarray) -> np.ndarray:
    lead = m.shape[:-3]
    turned = np.swapaxes(m[..., :3, :2], -1, -2).reshape(*lead, 12)
    return np.concatenate([m[..., :3, 3].reshape(*lead, 6), turned], axis=-1)


def inverse(m: np.ndarray) -> np.ndarray:
    """Of rigid matrices."""
    out, rt = np.zeros_like(m), np.swapaxes(m[..., :3, :3], -1, -2)
    out[..., :3, :3], out[..., 3, 3] = rt, 1.0
    out[..., :3, 3] = -(rt @ m[..., :3, 3:])[..., 0]
    return out


def moved(m: np.ndarray, hands: np.ndarray) -> np.ndarray:
    """Points of both hands (.., 2, points, 3) by a matrix to each hand."""
    return (hands @ np.swapaxes(m[..., :3, :3], -1, -2) + m[..., None, :3, 3]) / (1 + 1e-6)


def in_camera(wrists: np.ndarray, hands: np.ndarray, extrinsic: np.ndarray, shape: Shape) -> np.ndarray:
    """Wrists in the camera's frame beside hands, of one window: (n, width)."""
    half, n = hands.shape[-1] // 2, len(hands)
    hands = np.concatenate([hands[:, : shape.hand], hands[:, half : half + shape.hand]], axis=1)
    at = poses(wrists)
    if shape.motion == "fingertips":
        hands = moved(inverse(at), hands.reshape(n, 2, shape.hand // 3, 3)).reshape(n, 2 * shape.hand)
    wrists = wrist_vectors(extrinsic @ at)
    return np.concatenate([np.where(np.isfinite(wrists), wrists, 0.0), hands], axis=1)


def relative(state: np.ndarray, actions: np.ndarray) -> np.ndarray:
    """Actions (.., width) as seen from a state (width)."""
    wrists = wrist_vectors(inverse(poses(state[:WRIST])) @ poses(actions[..., :WRIST]))
    return np.concatenate([wrists, actions[..., WRIST:] - state[WRIST:]], axis=-1)


def absolute(state: np.ndarray, motions: np.ndarray) -> np.ndarray:
    """The inverse of relative."""
    wrists = wrist_vectors(poses(state[:WRIST]) @ poses(motions[..., :WRIST]))
    return np.concatenate([wrists, motions[..., WRIST:] + state[WRIST:]], axis=-1)


def camera_motions(now: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Poses of later cameras in the frame of the one now: world-to-camera matrix times the inverse of each later one."""
    return (now @ np.linalg.inv(later)).reshape(len(later), 16)


def padded(rows: np.ndarray, length: int, width: int) -> tuple[np.ndarray, int]:
    n = min(len(rows), length)
    out = np.zeros((length, width))
    out[:n] = rows[:n]
    return out, n


# rows


STEPS = T.ArrayType(T.ArrayType(T.DoubleType()))
ADDED = T.StructType([T.StructField("states", STEPS), T.StructField("n_states", T.IntegerType()), T.StructField("actions", STEPS), T.StructField("actions_valid", T.ArrayType(T.BooleanType())), T.StructField("n_actions", T.IntegerType()), T.StructField("later_motions", STEPS), T.StructField("n_later", T.IntegerType())])


def _scales(params: DataFrame | None, shape: Shape) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Scale and offset by key and dimension: as many rows as a model's row has numbers."""
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for key, dim, scale, offset in params.select("key", "dim", "scale", "offset").collect() if params is not None else ():
        a, b = out.setdefault(key, (np.ones(shape.width), np.zeros(shape.width)))
        a[dim], b[dim] = scale, offset
    return out


def _matrix(rows, width: int) -> np.ndarray:
    return np.array(rows or [], np.float64).reshape(-1, width)


def model_rows(windows: DataFrame, shape: Shape = Shape(), params: DataFrame | None = None, locator: Sequence[str] = ("shard", "key")) -> DataFrame:
    """windows(wrist_states, hand_states, wrist_actions, hand_actions, extrinsic, and perhaps later_extrinsics) with a
    model's arrays. ``params`` are a normalizer's: of keys states and actions if actions are relative, else of motions."""
    shape.checked()
    scales = _scales(params, shape)
    names, has_later = [c for c in windows.columns if c not in ADDED.names], "later_extrinsics" in windows.columns
    schema = T.StructType([*(windows.schema[c] for c in names), *ADDED.fields])
    arrow = to_arrow_schema(ADDED)

    def normal(key: str, x: np.ndarray) -> np.ndarray:
        scale, offset = scales.get(key, (1.0, 0.0))
        return x * scale + offset

    def one(row: dict) -> dict:
        extrinsic = np.array(row["extrinsic"], np.float64).reshape(4, 4)
        hands = len((row["hand_states"] or row["hand_actions"] or [[0.0] * 2 * shape.hand])[0])
        states = in_camera(_matrix(row["wrist_states"], WRIST), _matrix(row["hand_states"], hands), extrinsic, shape)
        actions = in_camera(_matrix(row["wrist_actions"], WRIST), _matrix(row["hand_actions"], hands), extrinsic, shape)
        if shape.relative and len(actions):
            if not len(states):
                raise ValueError("no state that actions can be relative to: " + ", ".join(f"{c}={row.get(c)}" for c in locator))
            actions = relative(states[-1], actions)
        states, n_states = padded(normal("states" if shape.relative else "motions", states), shape.states, shape.width)
        actions, n_actions = padded(normal("actions" if shape.relative else "motions", actions), shape.actions, shape.width)
        later = np.array((row["later_extrinsics"] if has_later else None) or [], np.float64).reshape(-1, 4, 4)[: shape.later]
        motions, n_later = padded(camera_motions(extrinsic, later) if len(later) else np.zeros((0, 16)), shape.later, 16)
        return {"states": states.tolist(), "n_states": n_states, "actions": actions.tolist(), "actions_valid": [k < n_actions for k in range(shape.actions)], "n_actions": n_actions, "later_motions": motions.tolist(), "n_later": n_later}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                new = pa.RecordBatch.from_pylist([one(r) for r in part.to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new.columns], names=[*names, *ADDED.names])

    return windows.mapInArrow(run, schema)


def fit_rows(rows: DataFrame, relative: bool) -> DataFrame:
    """Rows (key, dim, x) that a normalizer is fitted on, without padding: states and actions each, or both as motions."""
    parts = []
    for name, count in (("states", "n_states"), ("actions", "n_actions")):
        steps = rows.select(F.explode(F.slice(name, F.lit(1), F.col(count))).alias("_step"))
        parts.append(steps.select(F.lit(name if relative else "motions").alias("key"), F.posexplode("_step").alias("dim", "x")))
    return parts[0].unionByName(parts[1])


def empty_row(shape: Shape) -> dict[str, Column]:
    """What a question row has in a model's columns: zeros of a row's shape, nothing valid. With ``samples.zero_filled``."""
    zeros = lambda n, width: F.array_repeat(F.array_repeat(F.lit(0.0), width), n)
    return {"states": zeros(shape.states, shape.width), "n_states": F.lit(0), "actions": zeros(shape.actions, shape.width), "actions_valid": F.array_repeat(F.lit(False), shape.actions), "n_actions": F.lit(0), "later_motions": zeros(shape.later, 16), "n_later": F.lit(0)}


def required(df: DataFrame, column: str, locator: Sequence[str] = ("shard", "key")) -> DataFrame:
    """df, of which a row without ``column`` ends the job, named by its locator: a required view is no reason to skip."""
    where = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in locator))
    kind = df.schema[column].dataType.simpleString()
    return df.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.concat(F.lit(f"{column} is missing: "), where)).cast(kind)).otherwise(F.col(column)))


REPORT = T.StructType([T.StructField("mae", T.DoubleType()), T.StructField("n_valid", T.IntegerType()), *(T.StructField(c, STEPS) for c in ("pred_wrists", "pred_hands", "gt_wrists", "gt_hands"))])


def report(rows: DataFrame, shape: Shape = Shape(), params: DataFrame | None = None, delay: int = 0) -> DataFrame:
    """rows(states, n_states, pred, gt, actions_valid) with what an evaluation shows of a sample: absolute wrists, and the
    hands' points in the camera's frame, of prediction and truth; and the mean error over valid steps after a known
    prefix, of the actions as they were given. ``params`` of states undo their normalization."""
    scale, offset = _scales(params, shape).get("states", (np.ones(shape.width), np.zeros(shape.width)))
    names, arrow = [c for c in rows.columns if c not in REPORT.names], to_arrow_schema(REPORT)

    def side(state: np.ndarray | None, steps: np.ndarray) -> tuple[list, list]:
        at = steps if state is None else absolute(state, steps)
        hands = moved(poses(at[:, :WRIST]), at[:, WRIST:].reshape(len(at), 2, shape.hand // 3, 3)).reshape(len(at), 2 * shape.hand)
        return at[:, :WRIST].tolist(), hands.tolist()

    def one(row: dict) -> dict:
        pred, gt = _matrix(row["pred"], shape.width), _matrix(row["gt"], shape.width)
        state = (np.array(row["states"][row["n_states"] - 1]) - offset) / scale if shape.relative and row["n_states"] else None
        on = np.array([v and k >= delay for k, v in enumerate(row["actions_valid"][: len(gt)])], bool)
        (pw, ph), (gw, gh) = side(state, pred), side(state, gt)
        return {"mae": float(np.abs(pred[on] - gt[on]).mean()) if on.any() else None, "n_valid": int(on.sum()), "pred_wrists": pw, "pred_hands": ph, "gt_wrists": gw, "gt_hands": gh}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                new = pa.RecordBatch.from_pylist([one(r) for r in part.to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new.columns], names=[*names, *REPORT.names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), *REPORT.fields]))

"""Tables of the engine and the fixed layout of low-dimensional vectors."""

from __future__ import annotations

from pyspark.sql import types as T

#: Named slices (start, end) of the base vector, then 20 numbers to each camera.
BASE_SLICES = {"wrist_state": (0, 18), "hand_state": (18, 48), "wrist_action": (48, 66), "hand_action": (66, 96)}
CAMERA_PARTS = (("extrinsic", 16), ("intrinsic", 4))
#: Dimensions of states and actions that no normalizer touches.
IGNORED_DIMENSIONS = (6, 18)

FRAMES = T.StructType(
    [
        T.StructField("shard", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("key", T.StringType()), T.StructField("dataset_name", T.StringType()),
        T.StructField("episode_index", T.LongType()), T.StructField("high_quality", T.IntegerType()), T.StructField("cameras", T.ArrayType(T.StringType())),
        T.StructField("instruction", T.ArrayType(T.StringType())), T.StructField("instruction_num", T.IntegerType()), T.StructField("lowdim", T.ArrayType(T.FloatType())),
        T.StructField("image", T.BinaryType()), T.StructField("depth", T.BinaryType()), T.StructField("chest_image", T.BinaryType()), T.StructField("chest_depth", T.BinaryType()), T.StructField("meta", T.StringType()),
    ]
)

NORM_PARAMS = T.StructType([T.StructField("key", T.StringType()), T.StructField("dim", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("min", "max", "mean", "std", "q01", "q99", "scale", "offset")), T.StructField("ignored", T.BooleanType())])


def lowdim_slices(cameras: list[str]) -> dict[str, tuple[int, int]]:
    """Slices of a vector with these cameras, the first of which is the head's; its parts also go without a prefix."""
    if not cameras or cameras[0] != "head":
        raise ValueError(f"the first camera must be head: {cameras}")
    out, at = dict(BASE_SLICES), 96
    for camera in cameras:
        for part, size in CAMERA_PARTS:
            out[f"{camera}_{part}"] = (at, at + size)
            at += size
    return out | {part: out[f"head_{part}"] for part, _ in CAMERA_PARTS}

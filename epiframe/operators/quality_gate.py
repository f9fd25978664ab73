"""Ordered row checks: the first that fails gives the row's reason; rows without a reason pass.

A check is a pair of a reason and a boolean column that is true where the row fails. Reasons are one coalesce, which
stops at the first failure, so that cheap checks go first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

Check = tuple[str, Column]

#: Texts that are no instruction.
PLACEHOLDERS = ("", "none", "unknown", "n/a", "null", "todo")
#: Tolerances of an extrinsic's last row and determinant, a focal length's bound, an image's least and
#: greatest channel mean and least deviation, the least share of valid depths, the greatest cosine of rotation columns.
ROW, DETERMINANT, FOCAL, MEANS, SPREAD, VALID, COSINE = 1e-3, 0.1, 10_000.0, (5.0, 250.0), 3.0, 0.05, 0.1


def any_of(xs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, xs)


def not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def array_not_finite(a: Column) -> Column:
    return F.exists(a, lambda x: not_finite(x.cast("double")))


def schema_fails(required: Sequence[str], sizes: dict[str, int]) -> Column:
    fails = [F.col(c).isNull() for c in required] + [F.col(c).isNull() | (F.size(c) != n) for c, n in sizes.items()]
    return F.coalesce(any_of(fails), F.lit(True))


def extrinsic_fails(m: G.Matrix, row_tolerance: float = ROW, det_tolerance: float = DETERMINANT) -> Column:
    """Not finite, last row not 0 0 0 1 within tolerance, or a determinant too far from 1."""
    flat = [x for row in m for x in row]
    want = (0.0, 0.0, 0.0, 1.0)
    last = any_of([F.abs(x - w) > row_tolerance + 1e-5 * abs(w) for x, w in zip(m[3], want)])
    return any_of([not_finite(x) for x in flat]) | last | (F.abs(G.determinant3(m) - 1) > det_tolerance)


def intrinsic_fails(k: G.Vector, most: float = FOCAL) -> Column:
    return any_of([not_finite(x) for x in k]) | (k[0] <= 0) | (k[1] <= 0) | (k[0] >= most) | (k[1] >= most)


def text_is_placeholder(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*PLACEHOLDERS), F.lit(True))


def instruction_fails(instructions: Column, number: Column) -> Column:
    """No number of instructions, or none of the list is one."""
    return instructions.isNull() | number.isNull() | (number <= 0) | F.forall(instructions, text_is_placeholder)


def image_fails(means: Column, stds: Column, low: float = MEANS[0], high: float = MEANS[1], spread: float = SPREAD) -> Column:
    """By arrays of channel means and population deviations of an image."""
    return (F.array_min(means) < low) | (F.array_max(means) > high) | (F.array_min(stds) < spread)


def depth_fails(depth: Column, least: float = VALID) -> Column:
    valid = F.size(F.filter(depth, lambda x: x > 0)) / F.nullif(F.size(depth), F.lit(0))
    return array_not_finite(depth) | F.coalesce(valid < least, F.lit(True))


def rot6d_fails(rot6d: G.Vector, threshold: float = COSINE) -> Column:
    """Columns not orthogonal: zero columns pass by the guard of the division."""
    a, b = rot6d[:3], rot6d[3:]
    inner = G.dot(a, b) / ((G.norm(a) + G.NORM_EPS) * (G.norm(b) + G.NORM_EPS))
    return any_of([not_finite(x) for x in rot6d]) | (F.abs(inner) > threshold)


def translation_delta(a: G.Vector, b: G.Vector) -> Column:
    return G.norm([x - y for x, y in zip(a, b)])


def fingertip_delta(a: G.Vector, b: G.Vector) -> Column:
    """Mean distance of points given as flat coordinates."""
    n = len(a) // 3
    return G.total([translation_delta(a[3 * k : 3 * k + 3], b[3 * k : 3 * k + 3]) for k in range(n)]) / n


def rotation_delta(a: G.Vector, b: G.Vector) -> Column:
    """Angle between two 6-D rotations, columns normalized apart; it can't exceed pi."""
    return G.rotation_angle(G.matmul(G.transpose(G.plain_rotation(a)), G.plain_rotation(b)))


def outlier(a: Column, threshold: float = 10.0) -> Column:
    return F.array_max(F.transform(a, F.abs)) > threshold


def with_reason(df: DataFrame, checks: Sequence[Check], name: str = "reason") -> DataFrame:
    return df.withColumn(name, F.coalesce(*(F.when(fails, F.lit(code)) for code, fails in checks), F.lit(None).cast("string")))


def gate(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    return with_reason(df, checks, "_reason").where("_reason IS NULL").drop("_reason")


def reason_counts(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    return with_reason(df, checks).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def skip_ratio(df: DataFrame, fails: Column) -> DataFrame:
    seen, skipped = F.count("*"), F.count_if(fails)
    return df.agg(seen.alias("seen"), skipped.alias("skipped"), F.round(100.0 * skipped / F.nullif(seen, F.lit(0)), 6).alias("percent"))


def non_finite_summary(df: DataFrame, column: str) -> DataFrame:
    """Counts of NaN and infinities, and minimum, maximum and mean of the rest, of an array column by row set."""
    x = F.col("x").cast("double")
    bad = not_finite(x)
    fine = F.when(~bad, x)
    return df.select(F.explode(column).alias("x")).agg(F.count_if(F.isnan(x)).alias("nan"), F.count_if(F.abs(x) == float("inf")).alias("inf"), F.min(fine).alias("min"), F.max(fine).alias("max"), F.avg(fine).alias("mean"))

"""Rigid geometry as column expressions: vectors and matrices are Python lists of columns, computed in double.

Expressions stay inside whole-stage code generation; nothing is exploded or sent to Python.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = list[Column]
Matrix = list[list[Column]]

#: Guards of the divisions below.
HOMOGENEOUS_EPS, NORM_EPS, DEPTH_EPS = 1e-6, 1e-8, 1e-6


def vector(array: Column | str, start: int, size: int) -> Vector:
    a = F.col(array) if isinstance(array, str) else array
    return [F.get(a, F.lit(start + k)).cast("double") for k in range(size)]


def total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def dot(a: Vector, b: Vector) -> Column:
    return total([x * y for x, y in zip(a, b)])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def scaled(a: Vector, s: Column) -> Vector:
    return [x * s for x in a]


def unit(a: Vector) -> Vector:
    """a over its length; zero stays zero, by the guard that torch's normalize has too."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return [x / n for x in a]


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return [[total([a[i][k] * b[k][j] for k in range(len(b))]) for j in range(len(b[0]))] for i in range(len(a))]


def transpose(a: Matrix) -> Matrix:
    return [list(r) for r in zip(*a)]


def determinant3(m: Matrix) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def rotation_of(rot6d: Vector) -> Matrix:
    """Rotation whose first two columns span the two given ones, by Gram-Schmidt."""
    a = unit(rot6d[:3])
    b = rot6d[3:]
    p = dot(a, b)
    b = unit([y - p * x for x, y in zip(a, b)])
    return transpose([a, b, cross(a, b)])


def rot6d_of(r: Matrix) -> Vector:
    return [r[i][0] for i in range(3)] + [r[i][1] for i in range(3)]


def pose(trans: Vector, rot6d: Vector) -> Matrix:
    r = rotation_of(rot6d)
    return [[*r[i], trans[i]] for i in range(3)] + [[F.lit(0.0)] * 3 + [F.lit(1.0)]]


def rigid_inverse(m: Matrix) -> Matrix:
    rt = transpose([row[:3] for row in m[:3]])
    t = [m[i][3] for i in range(3)]
    return [[*rt[i], -dot(rt[i], t)] for i in range(3)] + [[F.lit(0.0)] * 3 + [F.lit(1.0)]]


def general_inverse(m: Matrix) -> Matrix:
    """Inverse of any regular 4x4 matrix by cofactors."""

    def minor(i: int, j: int) -> Column:
        return determinant3([[m[r][c] for c in range(4) if c != j] for r in range(4) if r != i])

    cof = [[minor(i, j) * float((-1) ** (i + j)) for j in range(4)] for i in range(4)]
    det = total([m[0][j] * cof[0][j] for j in range(4)])
    return [[cof[j][i] / det for j in range(4)] for i in range(4)]


def homogeneous(p: Vector) -> Vector:
    return [*p, F.lit(1.0)]


def cartesian(p: Vector) -> Vector:
    return [x / (p[3] + F.lit(HOMOGENEOUS_EPS)) for x in p[:3]]


def transform_point(m: Matrix, p: Vector) -> Vector:
    return cartesian([dot(row, homogeneous(p)) for row in m])


def matrix4(array: Column | str, start: int = 0) -> Matrix:
    v = vector(array, start, 16)
    return [v[4 * i : 4 * i + 4] for i in range(4)]


def finite_or_zero(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))


def wrist_poses(array: Column | str, start: int = 0) -> tuple[Matrix, Matrix]:
    """Left and right pose of 18 numbers: both translations, then both 6-D rotations."""
    v = vector(array, start, 18)
    return pose(v[0:3], v[6:12]), pose(v[3:6], v[12:18])


def flat(m: Matrix) -> Column:
    return F.array(*(x for row in m for x in row))


def with_poses(df: DataFrame, array: str, left: str, right: str, start: int = 0) -> DataFrame:
    """df with both poses of an array as flat matrices: computed once, for expressions that use them many times."""
    return df.withColumns({left: flat(wrist_poses(array, start)[0]), right: flat(wrist_poses(array, start)[1])})


def wrist_vector(left: Matrix, right: Matrix) -> Vector:
    t = [[m[i][3] for i in range(3)] for m in (left, right)]
    return [*t[0], *t[1], *rot6d_of(left), *rot6d_of(right)]


def wrist_to_frame(array: Column | str, extrinsic: Matrix, start: int = 0) -> Vector:
    return [finite_or_zero(x) for x in wrist_vector(*(matmul(extrinsic, p) for p in wrist_poses(array, start)))]


def hand_to_wrist(hand: list[Vector], left: Matrix, right: Matrix) -> list[Vector]:
    """Points of both hands in their own wrist's frame."""
    half = len(hand) // 2
    inv = rigid_inverse(left), rigid_inverse(right)
    return [transform_point(inv[k >= half], p) for k, p in enumerate(hand)]


def relative_pose(state: Matrix, action: Matrix) -> Matrix:
    return matmul(rigid_inverse(state), action)


def relative_motion(current: Matrix, later: Matrix) -> Matrix:
    """Current times the inverse of the later matrix, both world to camera."""
    return matmul(current, general_inverse(later))


def rotation_angle(r: Matrix) -> Column:
    """Angle of a rotation; not finite gives 0."""
    trace = F.greatest(F.lit(-1.0), F.least(F.lit(3.0), r[0][0] + r[1][1] + r[2][2]))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))
    return finite_or_zero(angle)


def plain_rotation(rot6d: Vector) -> Matrix:
    """Columns normalized each on their own, for checks: no Gram-Schmidt."""
    grow = lambda v: [x / (norm(v) + F.lit(NORM_EPS)) for x in v]
    a, b = grow(rot6d[:3]), grow(rot6d[3:])
    return transpose([a, b, grow(cross(a, b))])


def project(p: Vector, intrinsic: Vector) -> Vector:
    z = F.greatest(p[2], F.lit(DEPTH_EPS))
    return [intrinsic[0] * p[0] / z + intrinsic[2], intrinsic[1] * p[1] / z + intrinsic[3]]


# Euler angles and quaternions (w, x, y, z). A sequence is a frame letter (s static, r rotating) and three axes.


def euler_matrix(ai: Column, aj: Column, ak: Column, axes: str = "sxyz") -> Matrix:
    """Rotation about three axes in turn; in a static frame later rotations multiply from the left."""
    turns = [_axis_rotation(a, x) for a, x in zip(axes[1:], (ai, aj, ak))]
    if axes[0] == "s":
        turns.reverse()
    return matmul(matmul(turns[0], turns[1]), turns[2])


def _axis_rotation(axis: str, angle: Column) -> Matrix:
    c, s, o, z = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return {"x": [[o, z, z], [z, c, -s], [z, s, c]], "y": [[c, z, s], [z, o, z], [-s, z, c]], "z": [[c, -s, z], [s, c, z], [z, z, o]]}[axis]


def euler_quaternion(ai: Column, aj: Column, ak: Column, axes: str = "sxyz") -> Vector:
    turns = [_axis_quaternion(a, x) for a, x in zip(axes[1:], (ai, aj, ak))]
    if axes[0] == "s":
        turns.reverse()
    return quaternion_product(quaternion_product(turns[0], turns[1]), turns[2])


def _axis_quaternion(axis: str, angle: Column) -> Vector:
    return [F.cos(angle / 2), *(F.sin(angle / 2) if a == axis else F.lit(0.0) for a in "xyz")]


def quaternion_product(p: Vector, q: Vector) -> Vector:
    v = cross(p[1:], q[1:])
    return [p[0] * q[0] - dot(p[1:], q[1:]), *(p[0] * y + q[0] * x + c for x, y, c in zip(p[1:], q[1:], v))]


def quaternion_matrix(q: Vector) -> Matrix:
    w, x, y, z = [c / norm(q) for c in q]
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]


def quaternion_axis_angle(q: Vector) -> tuple[Vector, Column]:
    w, *v = [c / norm(q) for c in q]
    n = norm(v)
    flat = n < NORM_EPS
    axis = [F.when(flat, F.lit(1.0 if k == 0 else 0.0)).otherwise(x / F.when(flat, F.lit(1.0)).otherwise(n)) for k, x in enumerate(v)]
    return axis, F.when(flat, 0.0).otherwise(2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w))))


def matrix_euler(m: Matrix) -> Vector:
    """Static x, y, z angles of a rotation; at the poles the third is 0."""
    cy = F.sqrt(m[0][0] * m[0][0] + m[1][0] * m[1][0])
    pole = cy < 4 * 2.220446049250313e-16
    return [F.when(pole, F.atan2(-m[1][2], m[1][1])).otherwise(F.atan2(m[2][1], m[2][2])), F.atan2(-m[2][0], cy), F.when(pole, 0.0).otherwise(F.atan2(m[1][0], m[0][0]))]


def is_rotation(m: Matrix, eps: float = 1e-4) -> Column:
    product = matmul(m, transpose(m))
    near = total([(product[i][j] - float(i == j)) * (product[i][j] - float(i == j)) for i in range(3) for j in range(3)])
    return (F.sqrt(near) < eps) & (F.abs(determinant3(m) - 1) < eps)


def sinusoid(t: Column, size: int, base: float = 10_000.0) -> Vector:
    """Sines, then cosines, of t at falling frequencies."""
    half = size // 2
    freq = [math.exp(-math.log(base) * k / max(1, half - 1)) for k in range(half)]
    return [F.sin(t * f) for f in freq] + [F.cos(t * f) for f in freq]

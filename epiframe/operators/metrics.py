"""Trajectory metrics over long rows (sample_id, step, dim, gt, pred, valid): group-bys and offsets, no dense arrays.

Masked metrics count valid entries alone. Unmasked ones count every row, so that entries which were zeroed on both sides
count as perfect; both are kept, under names that say which they are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of an action vector, and thresholds of offline evaluation.
PARTS = (("wrist_trans", 0, 6), ("wrist_rot", 6, 18), ("hand", 18, 48))
THRESHOLDS = (0.1, 0.2, 0.3, 0.5)


def with_error(pred: DataFrame) -> DataFrame:
    return pred.withColumn("err", F.abs(F.col("gt") - F.col("pred")))


def action_accuracy(pred: DataFrame, thresholds: Sequence[float] = THRESHOLDS, masked: bool = True) -> DataFrame:
    """Share of steps whose every dimension is nearer than each threshold; masked, of steps with any valid dimension."""
    steps = with_error(pred).groupBy("sample_id", "step").agg(F.max("err").alias("worst"), F.bool_or("valid").alias("valid"))
    on = F.col("valid") if masked else F.lit(True)
    ok = [F.count_if(on & (F.col("worst") < t)) / F.greatest(F.lit(1), F.count_if(on)) for t in thresholds]
    return steps.agg(*(x.alias(f"t{i}") for i, x in enumerate(ok))).select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("accuracy")) for i, t in enumerate(thresholds)))).alias("r")).select("r.*")


def part_l1(pred: DataFrame, parts=PARTS) -> DataFrame:
    """Mean error of valid entries by part; a part without any counts one."""
    part = F.coalesce(*(F.when((F.col("dim") >= a) & (F.col("dim") < b), name) for name, a, b in parts))
    return with_error(pred).withColumn("part", part).where("part IS NOT NULL").groupBy("part").agg((F.sum(F.when(F.col("valid"), F.col("err")).otherwise(0.0)) / F.greatest(F.lit(1), F.count_if("valid"))).alias("l1"))


def smoothness(pred: DataFrame) -> DataFrame:
    """Mean error of first and second differences by (order, step, dim), steps counted from 0 in each order."""
    w = Window.partitionBy("sample_id", "dim").orderBy("step")
    df = pred.select("sample_id", "dim", "step", (F.col("gt") - F.col("pred")).alias("d"))
    df = df.withColumn("d1", F.col("d") - F.lag("d").over(w)).withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    both = df.select("dim", F.explode(F.array(F.struct(F.lit(1).alias("k"), (F.col("step") - 1).alias("s"), F.col("d1").alias("x")), F.struct(F.lit(2).alias("k"), (F.col("step") - 2).alias("s"), F.col("d2").alias("x")))).alias("r"))
    return both.where("r.x IS NOT NULL").groupBy(F.col("r.k").alias("diff"), F.col("r.s").alias("step"), "dim").agg(F.avg(F.abs("r.x")).alias("error"))


def error_heatmap(pred: DataFrame) -> DataFrame:
    return with_error(pred).groupBy("step", "dim").agg(F.avg("err").alias("error"))


def loss_over_time(pred: DataFrame) -> DataFrame:
    return with_error(pred).groupBy("step").agg(F.avg("err").alias("l1"), F.avg(F.col("err") * F.col("err")).alias("l2"), F.count("*").alias("n"))


def per_dim_mae(pred: DataFrame) -> DataFrame:
    return with_error(pred).groupBy("dim").agg(F.avg("err").alias("mae"))


def trajectory(pred: DataFrame) -> DataFrame:
    """By sample: error at the last step, difference of path lengths, mean and greatest error."""
    w = Window.partitionBy("sample_id", "dim").orderBy("step")
    df = with_error(pred).withColumns({"dg": F.col("gt") - F.lag("gt").over(w), "dp": F.col("pred") - F.lag("pred").over(w)})
    steps = df.groupBy("sample_id", "step").agg(F.avg("err").alias("mean"), F.max("err").alias("worst"), F.sum("err").alias("total"), F.count("*").alias("n"), F.sqrt(F.sum(F.col("dg") * F.col("dg"))).alias("lg"), F.sqrt(F.sum(F.col("dp") * F.col("dp"))).alias("lp"))
    return steps.groupBy("sample_id").agg(
        F.max_by("mean", "step").alias("endpoint_error"), F.abs(F.coalesce(F.sum("lg"), F.lit(0.0)) - F.coalesce(F.sum("lp"), F.lit(0.0))).alias("length_error"),
        (F.sum("total") / F.sum("n")).alias("mean_error"), F.max("worst").alias("max_error"),
    )


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample covariances of columns as rows (i, j, cov), in one aggregation: pairs are of columns, not of rows."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    one = df.agg(*(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs if i <= j))
    cell = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("cov"))
    return one.select(F.explode(F.array(*(cell(i, j) for i, j in pairs))).alias("r")).select("r.*")


def covariance_summaries(pred: DataFrame) -> DataFrame:
    """(of, size, trace, determinant, matrix) of the covariances of truth, prediction and error over all steps, from long
    rows (sample_id, step, dim, gt, pred). Sums of products are over the rows of a step, never of pairs of steps; the
    matrices are as large as the number of dimensions squared."""
    err = F.struct((F.col("gt") - F.col("pred")).alias("x"), F.lit("error").alias("of"))
    sides = F.array(F.struct(F.col("gt").alias("x"), F.lit("gt").alias("of")), F.struct(F.col("pred").alias("x"), F.lit("pred").alias("of")), err)
    rows = pred.select("sample_id", "step", "dim", F.inline(sides)).groupBy("of", "sample_id", "step").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    pairs = F.transform("v", lambda a: F.transform("v", lambda b: F.struct(a["dim"].alias("i"), b["dim"].alias("j"), a["x"].alias("x"), b["x"].alias("y"))))
    cells = rows.select("of", F.inline(F.flatten(pairs))).groupBy("of", "i", "j").agg(F.covar_samp("x", "y").alias("c"))
    by = cells.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("i", "j", "c"))).alias("_c"), F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))).alias("trace"))
    size = F.sqrt(F.size("_c")).cast("int")
    by = by.select("of", size.alias("size"), "trace", F.transform("_c", lambda c: c["c"]).alias("matrix"))
    return by.withColumn("determinant", determinant("matrix"))


@F.pandas_udf(T.DoubleType())
def determinant(matrix: pd.Series) -> pd.Series:
    """Determinants of flat square matrices; 0 for a singular one, null for one with a null or of no square size."""

    def one(m) -> float | None:
        size = 0 if m is None else math.isqrt(len(m))
        if m is None or size * size != len(m) or np.isnan(a := np.asarray(m, np.float64)).any():
            return None
        a = a.reshape(size, size)
        return 1.0 if not size else float(np.linalg.det(a)) if np.linalg.matrix_rank(a) == size else 0.0

    return matrix.map(one).astype("float64")


def mean_of_batch_means(df: DataFrame, value: str, batch: str) -> DataFrame:
    """The mean of batches' means, which is not the mean of samples."""
    return df.groupBy(batch).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_of_means"), F.count("*").alias("batches"))


def loss_average(df: DataFrame, loss: str) -> DataFrame:
    """Sum over the number of entries above 1e-8."""
    return df.agg((F.sum(loss) / F.greatest(F.lit(1), F.count_if(F.col(loss) > 1e-8))).alias("average"))


def extreme_samples(df: DataFrame, loss: str, order: Sequence[str]) -> DataFrame:
    """The samples of least and greatest loss, the first in order among equals; two-row result by two aggregates."""
    key = F.struct(*order)
    low = F.min(F.struct(F.col(loss).alias("loss"), key.alias("key")))
    high = F.min(F.struct((-F.col(loss)).alias("loss"), key.alias("key")))
    one = df.agg(low.alias("lo"), high.alias("hi"))
    rows = F.array(F.struct(F.lit("min").alias("which"), F.col("lo.loss").alias(loss), F.col("lo.key").alias("key")), F.struct(F.lit("max").alias("which"), (-F.col("hi.loss")).alias(loss), F.col("hi.key").alias("key")))
    return one.select(F.explode(rows).alias("r")).select("r.which", f"r.{loss}", *(F.col("r.key")[c].alias(c) for c in order))


def document(pred: DataFrame) -> DataFrame:
    """One nested row of all unmasked metrics, as an evaluation writes it."""
    heat = error_heatmap(pred).agg(F.struct(F.avg("error").alias("mean"), F.stddev_samp("error").alias("std"), F.max("error").alias("max"), F.min("error").alias("min")).alias("heatmap"))
    acc = action_accuracy(pred, masked=False).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("threshold").cast("string").alias("k"), "accuracy")))).alias("accuracy"))
    traj = trajectory(pred).agg(F.struct(*(F.avg(c).alias(c) for c in ("endpoint_error", "length_error", "mean_error", "max_error"))).alias("trajectory"))
    smooth = smoothness(pred).groupBy().pivot("diff", [1, 2]).agg(F.avg("error")).toDF("first_diff_error", "second_diff_error")
    one = lambda df: df.withColumn("_k", F.lit(1))  # noqa: E731  single rows side by side
    return one(heat).join(one(acc), "_k").join(one(traj), "_k").join(one(smooth), "_k").drop("_k")

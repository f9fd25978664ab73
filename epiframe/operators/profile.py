"""Summaries of samples, objects and observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_profile(df: DataFrame, timings: Sequence[str], worker: str, batch: Sequence[str] = ()) -> DataFrame:
    """Sums and means of timings, samples, and the distinct workers in order, by batch."""
    sums = [f(c).alias(f"{c}_{name}") for c in timings for f, name in ((F.sum, "sum"), (F.avg, "avg"))]
    return df.groupBy(*batch).agg(F.count("*").alias("samples"), *sums, F.array_sort(F.collect_set(worker)).alias("workers"))


def array_stats(a: Column) -> Column:
    """Size, finite minimum, maximum, mean and population deviation of an array."""
    x = F.filter(F.transform(a, lambda v: v.cast("double")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    n = F.nullif(F.size(x), F.lit(0))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    spread = F.sqrt(F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / n)
    return F.struct(F.size(a).alias("size"), F.array_min(x).alias("min"), F.array_max(x).alias("max"), mean.alias("mean"), spread.alias("std"))


def contrast(df: DataFrame, view: str, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Low and high quantile of each view, and of all in a row named (joint), by a mergeable sketch."""
    q = F.percentile_approx(value, F.array(F.lit(low), F.lit(high)), 10_000)
    return df.rollup(view).agg(q.alias("q"), F.grouping(view).alias("_g")).select(F.when(F.col("_g") == 1, "(joint)").otherwise(F.col(view)).alias(view), F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))

"""Column statistics and linear normalizers in long form: rows (key, dim, x).

Quantiles are exact whatever the number of rows, with linear interpolation. A mergeable sketch of bounded size brackets
them in the first pass; a second pass counts the rows below each bracket and the distinct values inside it, which are
about a thousandth of a group's rows, and the wanted order statistics are read off the running counts. With
``quantiles="sketch"`` the sketch's own values are taken, whose rank error is at most 1/10,000, in one pass. Parameters
are a table of one row to each key and dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import IGNORED_DIMENSIONS


def melt(df: DataFrame, columns: Sequence[str], key: str = "rows") -> DataFrame:
    """Rows (key, dim, x) of numeric columns, in one pass."""
    parts = F.array(*(F.struct(F.lit(i).alias("dim"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)))
    return df.select(F.explode(parts).alias("p")).select(F.lit(key).alias("key"), "p.dim", "p.x")


def melt_array(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.select(F.posexplode(column).alias("dim", "x")).select(F.lit(key).alias("key"), "dim", F.col("x").cast("double").alias("x"))


#: Error of the sketch's ranks, as one over a share of rows, and the half width of a bracket, five times as much.
ACCURACY, HALF = 10_000, 5e-4
#: Rows of a group up to which its brackets hold all values.
WHOLE = 10_000


def order_statistics(rows: DataFrame, brackets: DataFrame, levels: Sequence[float]) -> DataFrame:
    """(key, dim, q0, q1 ..) of exact quantiles; brackets(key, dim, n, low0, high0, low1, high1 ..) hold them, in rising order."""
    x, slot = F.col("x"), F.lit(2 * len(levels))
    for k in reversed(range(len(levels))):
        slot = F.when(x < F.col(f"low{k}"), 2 * k).when(x <= F.col(f"high{k}"), 2 * k + 1).otherwise(slot)
    inside = rows.where("x IS NOT NULL").join(F.broadcast(brackets), ["key", "dim"]).withColumn("_slot", slot)
    counts = inside.groupBy("key", "dim", "_slot", F.when(F.col("_slot") % 2 == 1, x).alias("_v")).agg(F.count("*").alias("_n"), F.max("n").alias("n"))
    running = Window.partitionBy("key", "dim").orderBy("_slot", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_n").over(running)).withColumn("_before", F.col("_upto") - F.col("_n"))

    def at(place: Column) -> Column:
        """The value at a place, and whether it is in a bracket; else the sketch has broken its bound."""
        here = F.struct((F.col("_slot") % 2).alias("ok"), F.col("_v").alias("v"))
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_upto")), here))

    out = []
    for k, p in enumerate(levels):
        place = (F.col("n") - 1) * F.lit(float(p))
        out += [at(F.floor(place)).alias(f"_a{k}"), at(F.ceil(place)).alias(f"_b{k}")]
    found = counts.groupBy("key", "dim").agg(F.max("n").alias("n"), *out)
    for k, p in enumerate(levels):
        place, a, b = (F.col("n") - 1) * F.lit(float(p)), F.col(f"_a{k}"), F.col(f"_b{k}")
        mixed = F.when(F.floor(place) == F.ceil(place), a["v"]).otherwise((F.ceil(place) - place) * a["v"] + (place - F.floor(place)) * b["v"])
        found = found.withColumn(f"q{k}", F.when((a["ok"] == 1) & (b["ok"] == 1), mixed).otherwise(F.raise_error(F.lit("a quantile is outside of its bracket")).cast("double")))
    return found.select("key", "dim", *(f"q{k}" for k in range(len(levels))))


def statistics(rows: DataFrame, quantiles: str = "exact") -> DataFrame:
    """n, min, max, mean, std (0 for one row), q01, q99 by key and dim; ``quantiles`` is exact or sketch."""
    if quantiles not in ("exact", "sketch"):
        raise ValueError(f"unknown quantiles: {quantiles}")
    levels = (0.01, 0.99)
    near = [0.01, 0.99] if quantiles == "sketch" else [y for p in levels for y in (p - HALF, p + HALF)]
    plain = rows.groupBy("key", "dim").agg(
        F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
        F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.percentile_approx("x", F.array(*(F.lit(p) for p in near)), ACCURACY).alias("_q"),
    ).where("n > 0")
    if quantiles == "sketch":
        return plain.withColumns({"q01": F.get("_q", 0), "q99": F.get("_q", 1)}).drop("_q")
    brackets = plain.select("key", "dim", "n", *(F.when(F.col("n") <= WHOLE, F.col(side)).otherwise(F.get("_q", 2 * k + j)).alias(f"{name}{k}") for k in range(2) for j, (name, side) in enumerate((("low", "min"), ("high", "max")))))
    found = order_statistics(rows, brackets, levels)
    return plain.drop("_q").join(found.select("key", "dim", F.col("q0").alias("q01"), F.col("q1").alias("q99")), ["key", "dim"])


def parameters(stats: DataFrame, mode: str = "limits", output: tuple[float, float] = (-1.0, 1.0), eps: float = 1e-4, fit_offset: bool = True, ignore: tuple[int, int] | None = None, ignored_keys: Sequence[str] = ("states", "actions", "motions")) -> DataFrame:
    """stats with scale, offset and ignored; mode is limits (quantile range to the output range) or gaussian."""
    low, high = output
    lo, hi, mean, std = (F.col(c) for c in ("q01", "q99", "mean", "std"))
    span = hi - lo
    if mode == "limits" and fit_offset:
        flat = span < eps
        scale = F.lit(high - low) / F.when(flat, F.lit(high - low)).otherwise(span)
        offset = F.when(flat, F.lit((high + low) / 2) - lo).otherwise(F.lit(low) - scale * lo)
    elif mode == "limits":
        reach = F.greatest(F.abs(lo), F.abs(hi))
        scale = F.when(reach < eps, 1.0).otherwise(F.lit(min(abs(low), abs(high))) / F.when(reach < eps, F.lit(1.0)).otherwise(reach))
        offset = F.lit(0.0)
    elif mode == "gaussian":
        scale = F.lit(1.0) / F.when(std < eps, 1.0).otherwise(std)
        offset = -mean * scale if fit_offset else F.lit(0.0)
    else:
        raise ValueError(f"unknown mode: {mode}")
    skip = F.lit(False)
    if ignore:
        skip = F.col("key").isin(*ignored_keys) & (F.col("dim") >= ignore[0]) & (F.col("dim") < ignore[1])
    return stats.withColumns({"scale": F.when(skip, 1.0).otherwise(scale), "offset": F.when(skip, 0.0).otherwise(offset), "ignored": skip})


def fit(rows: DataFrame, quantiles: str = "exact", **options) -> DataFrame:
    return parameters(statistics(rows, quantiles), **({"ignore": IGNORED_DIMENSIONS} | options))


def normalize(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows with y = x * scale + offset; the parameters are one row to a key and dimension, and are broadcast."""
    return rows.join(F.broadcast(params.select("key", "dim", "scale", "offset")), ["key", "dim"]).withColumn("y", F.col("x") * F.col("scale") + F.col("offset"))


def unnormalize(y: Column, scale: Column, offset: Column) -> Column:
    return (y - offset) / scale


def outliers(normalized: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Rows beyond the threshold by dimension."""
    return normalized.groupBy("key", "dim").agg(F.count("*").alias("n"), F.count_if(F.abs("y") > threshold).alias("n_outliers"), F.max(F.abs("y")).alias("max_abs"))

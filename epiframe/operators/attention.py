"""Attention over image patches in long form: rows (sample keys, step, layer, head, query, frame, y, x, w).

Layers without any number (null or NaN) are left out. Reductions are group-bys in a chain, so that no task holds a grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATCH = ("frame", "y", "x")


def middle_layers(n: int) -> tuple[int, int]:
    """The layers from 3/14 to 11/14 of n, halves to even."""
    return round(n * 3 / 14), round(n * 11 / 14)


def valid_layers(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows without layers that hold no number."""
    w = Window.partitionBy(*keys, "layer")
    number = F.when(~F.isnan("w"), F.col("w"))
    return rows.withColumn("w", number).withColumn("_n", F.count("w").over(w)).where("_n > 0").drop("_n")


def at_step(rows: DataFrame, keys: Sequence[str], step: int | str = 0) -> DataFrame:
    """One denoising step, or the mean of all (mean) or of the first three (early), numbers alone counting."""
    if isinstance(step, int):
        return rows.where(F.col("step") == step).drop("step")
    if step not in ("mean", "early"):
        raise ValueError(f"unknown step: {step}")
    some = rows if step == "mean" else rows.where("step < 3")
    return some.groupBy(*keys, "layer", "head", "query", *PATCH).agg((F.coalesce(F.sum(F.when(~F.isnan("w"), F.col("w"))), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if(~F.isnan("w")))).alias("w"))


def aggregate(rows: DataFrame, keys: Sequence[str], strategy: str = "middle_layers_mean_heads", layers: tuple[int, int] | None = None) -> DataFrame:
    """(keys, frame, y, x, w): queries are averaged, then heads (or their greatest is taken), then layers."""
    if strategy == "middle_layers_mean_heads":
        if layers is None or layers[0] >= layers[1]:
            raise ValueError("a range of layers is needed")
        rows = rows.where((F.col("layer") >= layers[0]) & (F.col("layer") < layers[1]))
    elif strategy not in ("mean_layers_heads", "max_heads", "last_layer_mean_heads"):
        raise ValueError(f"unknown strategy: {strategy}")
    rows = valid_layers(rows, keys)
    if strategy == "last_layer_mean_heads":
        rows = rows.withColumn("_last", F.max("layer").over(Window.partitionBy(*keys))).where("layer = _last")
    heads = rows.groupBy(*keys, "layer", "head", *PATCH).agg(F.avg("w").alias("w"))
    per_layer = heads.groupBy(*keys, "layer", *PATCH).agg((F.max("w") if strategy == "max_heads" else F.avg("w")).alias("w"))
    return per_layer.groupBy(*keys, *PATCH).agg(F.avg("w").alias("w"))


def renormalized(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weights that sum to 1 in each sample; a sample whose sum is not positive stays."""
    total = F.sum("w").over(Window.partitionBy(*keys))
    return grid.withColumn("w", F.when(total > 0, F.col("w") / total).otherwise(F.col("w")))


def entropy(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread of a sample's weights from 0 (one patch) to 1 (all alike)."""
    p = F.col("w") / F.greatest(F.lit(1e-12), F.sum("w").over(Window.partitionBy(*keys)))
    terms = grid.withColumn("_p", p).groupBy(*keys).agg(F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.log("_p")).otherwise(0.0)).alias("h"), F.count("*").alias("n"))
    return terms.select(*keys, F.when(F.col("n") > 1, F.col("h") / F.log(F.col("n").cast("double"))).otherwise(0.0).alias("entropy"))


def segments(grids: DataFrame, keys: Sequence[str], order: str, counts: Column) -> DataFrame:
    """grids with first and last (exclusive) token of each video among its sample's tokens."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grids.withColumn("last_token", F.sum(counts).over(w)).withColumn("first_token", F.col("last_token") - counts)

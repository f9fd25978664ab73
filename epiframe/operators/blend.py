"""Choosing shards, mixing sources and laying rows into batches by slot arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_path


def unit_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from the columns' digest: the same on any engine and in any partitioning."""
    text = F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def select_floor_budget(shards: DataFrame, dataset: str, shard: str, floor: int, budget: int, seed: int = 0) -> DataFrame:
    """At least ``floor`` shards of each dataset, then others up to ``budget`` in all, both in order of a hash."""
    ranked = shards.withColumn("_u", unit_hash(dataset, shard, seed=seed))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(dataset).orderBy("_u", shard)))
    base = ranked.where(F.col("_rank") <= floor).withColumn("picked_by", F.lit("floor"))
    left = ranked.where(F.col("_rank") > floor).orderBy("_u", shard).limit(max(0, budget - base.count()))
    return base.unionByName(left.withColumn("picked_by", F.lit("budget"))).drop("_u", "_rank")


def coverage(shards: DataFrame, dataset: str, picked: Column) -> DataFrame:
    """Shards, picked ones and their share by dataset, and for all in a row named (total)."""
    n, got = F.count("*"), F.count_if(picked)
    return shards.rollup(dataset).agg(n.alias("shards"), got.alias("picked"), F.round(got / n, 6).alias("fraction"), (got == n).alias("full"), F.grouping(dataset).alias("_g")).withColumn(dataset, F.when(F.col("_g") == 1, "(total)").otherwise(F.col(dataset))).drop("_g")


def number_rows(df: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Dense row numbers from 0 in a total order, by ranges: rows are counted by range, then numbered inside each."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "ranged")
    # written once, so that counting and numbering see the same partitions whatever plan each runs under
    df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    offsets = ranged.groupBy("_p").count()  # one row to a range
    offsets = offsets.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_local")).drop("_p", "_before", "_local")


def with_next(df: DataFrame, key: str, order: str, column: str, name: str = "nxt") -> DataFrame:
    """df with ``column`` of the next row of its key, in an order without ties; null for a key's last row.

    Rows are dealt out by ranges of (key, order), so that a key of very many rows fills several; over the edge of a
    range goes one row, the first of the next."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "ranged")
    # written once, so that both readings see the same partitions
    df.repartitionByRange(key, order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    edges = ranged.groupBy("_p").agg(F.min(F.struct(F.col(key).isNotNull().alias("there"), F.col(key).alias("key"), F.col(order).alias("order"), F.struct(F.col(column).alias("v")).alias("boxed"))).alias("_first"))  # one row to a range
    edges = edges.select("_p", F.lead("_first").over(Window.orderBy("_p")).alias("_edge"))
    inside = F.lead(F.struct(F.col(column).alias("v"))).over(Window.partitionBy("_p", key).orderBy(order))
    over = F.when(F.col("_edge.key").eqNullSafe(F.col(key)), F.col("_edge.boxed"))
    return ranged.withColumn("_next", inside).join(F.broadcast(edges), "_p").withColumn(name, F.coalesce("_next", over)["v"]).drop("_p", "_next", "_edge")


def interleave_sizes(ratio: float, batch: int) -> tuple[int, int]:
    """Rows of the first and of the second source to a batch."""
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must be over 0 and at most 1: {ratio}")
    first = math.ceil(ratio * batch)
    return first, batch - first


def interleave(first: DataFrame, second: DataFrame, n_second: int, ratio: float, batch: int, number: str = "n") -> DataFrame:
    """Slots of numbered rows: after v rows of the first source come m of the second, which starts anew when it ends.

    Returns (slot, source, number): each row of the first once, and as many of the second as full rounds need. A slot
    of the second holds its row number modulo their count, so no row is copied before it is looked up.
    """
    v, m = interleave_sizes(ratio, batch)
    n = F.col(number)
    a = first.select((F.floor(n / v) * batch + n % v).alias("slot"), F.lit("first").alias("source"), n.alias(number))
    if not m or not n_second:
        return a
    ends = first.where(n % v == v - 1).select(F.floor(n / v).alias("round"))
    j = F.col("round") * m + F.col("k")
    b = ends.select("round", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k")).select((F.col("round") * batch + v + F.col("k")).alias("slot"), F.lit("second").alias("source"), (j % n_second).alias(number))
    return a.unionByName(b)


def weighted_blend(sources: Sequence[tuple[DataFrame, float]], id_column: str, seed: int = 0) -> DataFrame:
    """Rows of sources thinned so that expected shares follow the weights; the most wanted source stays whole."""
    counts = [df.count() for df, _ in sources]
    rates = [w / c if c else 0.0 for (_, w), c in zip(sources, counts)]
    top = max(rates, default=0.0) or 1.0
    parts = [df.where(unit_hash(id_column, seed=seed + i) < F.lit(r / top)).withColumn("source", F.lit(i)) for i, ((df, _), r) in enumerate(zip(sources, rates))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


#: Slots to a block of a random mix, in which picks of a source are numbered.
MIX_BLOCK = 1 << 16


def random_mix(slots: DataFrame, weights: Sequence[float], sizes: Sequence[int], slot: str = "slot", seed: int = 0) -> DataFrame:
    """slots with source and number: each slot draws a source by weight, on its own, and takes the source's next row;
    a source starts anew when it ends. Picks are numbered by blocks of slots, so that no task gets all of a source's.

    ``sizes`` are the sources' rows; one without rows, or of weight 0, is never drawn, and without any that can be it is an error."""
    if len(weights) != len(sizes) or any(w < 0 for w in weights):
        raise ValueError(f"a weight of at least 0 to each source: {weights}")
    use = [w if n else 0.0 for w, n in zip(weights, sizes)]
    if not sum(use):
        raise ValueError("no source that can be drawn")
    u, source, below = unit_hash(slot, seed=seed), None, 0.0
    last = max(k for k, w in enumerate(use) if w)
    for k, w in enumerate(use[:last]):
        below += w / sum(use)
        source = F.when(u < F.lit(below), k) if source is None else source.when(u < F.lit(below), k)
    drawn = slots.withColumn("source", F.lit(last) if source is None else source.otherwise(last)).withColumn("_block", F.floor(F.col(slot) / MIX_BLOCK))
    counts = drawn.groupBy("source", "_block").agg(F.count("*").alias("_n"))  # a row to a block and source
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_block")) - F.col("_n")
    local = F.row_number().over(Window.partitionBy("source", "_block").orderBy(slot)) - 1
    size = F.element_at(F.array(*(F.lit(max(1, n)) for n in sizes)), F.col("source") + 1)
    joined = drawn.withColumn("_local", local).join(counts.select("source", "_block", before.alias("_before")), ["source", "_block"])
    return joined.withColumn("number", (F.col("_before") + F.col("_local")) % size).drop("_block", "_local", "_before")


def chain(sources: Sequence[DataFrame]) -> DataFrame:
    """Sources one after the other, told apart by source_ord; missing columns are null."""
    out = sources[0].withColumn("source_ord", F.lit(0))
    for i, df in enumerate(sources[1:], 1):
        out = out.unionByName(df.withColumn("source_ord", F.lit(i)), allowMissingColumns=True)
    return out

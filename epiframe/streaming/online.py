"""Incremental forms: running statistics, and window samples composed as frames arrive."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import WindowConfig
from ..sources.files import shared_path

#: Groups of episodes that are composed at once.
BUCKETS = 32
#: Tasks of a bounded micro-batch behind its shuffle.
TASKS = 4


def moments(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Running n, sum, sum of squares, least and greatest value by key: partial sums before the shuffle, one row of state to a key."""
    x = F.col(value).cast("double")
    return stream.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("total_sq"), F.min(x).alias("low"), F.max(x).alias("high"))


def compose(frames: DataFrame, config: WindowConfig, episode: Sequence[str], order: str, anchor: str = "event_id", payload: str = "payload", quality: str = "high_quality", final: str = "final", buckets: int = BUCKETS) -> DataFrame:
    """States and actions of each anchor of high quality, as soon as its future has arrived or its episode has ended.

    Frames of an episode arrive in order over the micro-batches; ``final`` marks an episode's last. Episodes are dealt to
    ``buckets`` groups, as a call for a group costs much more than an episode in it. A micro-batch's frames of a group are
    held in its task, so the source should bound its batches, as ``resampled`` does. State per open episode is its first
    payload and the frames that a coming anchor can still need. A null payload counts as a frame.
    """
    past, ahead = config.past(), (config.actions.horizon - 1) * config.actions.stride

    def sample(i: int, base: int, first, ids: list, xs: list, qs: list) -> tuple:
        back = [k * config.states.stride for k in range(config.states.horizon - 1, -1, -1)]
        states = [xs[i - k] if base + i >= k else first for k in back if base + i >= k or config.states.pad == "repeat"]
        actions, cut = [], False
        for j in (i + k * config.actions.stride for k in range(config.actions.horizon)):
            cut = cut or j < len(xs) and config.quality_filter and qs[j] == 0
            if not cut and (j < len(xs) or config.actions.pad == "repeat"):
                actions.append(xs[min(j, len(xs) - 1)])
        return ids[i], states, actions

    def extend(held: tuple | None, new: tuple[list, list, list], ended: bool) -> tuple[list, tuple | None]:
        """Samples of an episode whose anchors are complete with these frames, and what is held of it."""
        first, base, at, ids, xs, qs = held or (None, 0, 0, [], [], [])
        ids, xs, qs = (old + more for old, more in zip((ids, xs, qs), new))
        first = first if held else xs[0]
        ready = max(at, len(xs) if ended else len(xs) - ahead)
        rows = [sample(i, base, first, ids, xs, qs) for i in range(at, ready) if qs[i] == 1 or not config.quality_filter]
        drop = max(0, ready - past)
        return rows, None if ended else (first, base + drop, ready - drop, ids[drop:], xs[drop:], qs[drop:])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, rows = {r[0]: tuple(r[1:]) for r in state.get[0]} if state.exists else {}, []
        new = pd.concat(list(parts)).sort_values(["_episode", order, anchor])
        names, ids = new["_episode"].tolist(), new[anchor].tolist()
        xs = [None if pd.isna(x) else float(x) for x in new[payload].tolist()]
        qs = [1 if pd.isna(q) else int(q) for q in new[quality].tolist()]
        finals, a = new[final].tolist(), 0
        for b in range(1, len(names) + 1):
            if b == len(names) or names[b] != names[a]:
                out, left = extend(held.pop(names[a], None), (ids[a:b], xs[a:b], qs[a:b]), any(x is True or x == 1 for x in finals[a:b]))
                rows += out
                if left:
                    held[names[a]] = left
                a = b
        if held:
            state.update(([(k, *v) for k, v in held.items()],))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=[anchor, "states", "actions"])

    kept = "open array<struct<episode string, first double, base long, at long, ids array<long>, xs array<double>, qs array<int>>>"
    named = frames.select(F.to_json(F.struct(*episode), {"ignoreNullFields": "false"}).alias("_episode"), *dict.fromkeys((order, anchor, payload, quality, final)))
    dealt = named.withColumn("_bucket", F.pmod(F.xxhash64("_episode"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(step, f"{anchor} long, states array<double>, actions array<double>", kept, "append", GroupStateTimeout.NoTimeout)


def counted(stream: DataFrame, time: str, keys: Sequence[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows by tumbling (or, with slide, sliding) windows of event time and by key; rows later than ``late`` are dropped."""
    w = F.window(time, size, slide)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(stream: DataFrame, time: str, keys: Sequence[str], gap: str, late: str) -> DataFrame:
    """Rows by session, which ends after a gap without rows of its keys; rows later than ``late`` are dropped."""
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def run_available(result: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming result over all input there is and return its rows, kept as Parquet in the shared folder."""
    spark = result.sparkSession
    path, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint")
    if mode == "append":
        writer = result.writeStream.format("parquet").option("path", path)
    else:
        writer = result.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    query = writer.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


def run_to_end(*results: DataFrame, tasks: int = TASKS) -> DataFrame:
    """Run streaming results side by side, batch by batch, as their sources admit them, until these have no more; returns
    all rows, kept as Parquet in the shared folder. For sources that end and bound their batches: each batch is shuffled
    to ``tasks`` tasks, as state costs much more a task than a batch has rows for."""
    spark, name, paths, queries = results[0].sparkSession, "spark.sql.shuffle.partitions", [], []
    own = spark.conf.get(name)
    try:
        try:
            spark.conf.set(name, str(tasks))
            for result in results:
                path, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint")
                paths.append(path)
                queries.append(result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start())
        finally:
            spark.conf.set(name, own)
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    # each path has its sink's own list of files, so they are not read as one
    return functools.reduce(DataFrame.unionByName, [spark.read.schema(results[0].schema).parquet(p) for p in paths])

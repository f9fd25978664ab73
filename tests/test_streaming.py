"""Windows composed from micro-batches equal those of one batch."""

import time
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from epiframe.operators import windows
from epiframe.streaming import online


def test_compose_over_micro_batches(spark, tmp_path):
    rows = [("d", e, n, 100 * e + n, None if (e, n) == (2, 3) else float(10 * e + n), 0 if (e + n) % 4 == 0 else 1, n == size - 1) for e, size in enumerate((1, 3, 9, 14)) for n in range(size)]
    schema = "dataset_name string, episode_index long, ts long, event_id long, payload double, high_quality int, final boolean"
    for mode, pad in (("repeat", "truncate"), ("truncate", "repeat")):
        path = str(tmp_path / mode)
        for low, high in ((0, 2), (2, 5), (5, 6), (6, 99)):  # four files, one after the other
            spark.createDataFrame([r for r in rows if low <= r[2] < high], schema).coalesce(1).write.mode("append").parquet(path)
        config = windows.WindowConfig(windows.Reach(3, 2, pad), windows.Reach(3, 2, mode))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = online.run_available(online.compose(stream, config, ["dataset_name", "episode_index"], "ts"))
        spec = Window.partitionBy("dataset_name", "episode_index").orderBy("ts")
        want = spark.createDataFrame(rows, schema).withColumns({"states": windows.history(F.col("payload"), spec, 3, 2, mode), "actions": windows.future(F.col("payload"), spec, 3, 2, pad, quality=F.col("high_quality"))}).where("high_quality = 1")
        key = lambda r: (r.event_id, r.states, r.actions)
        assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.select("event_id", "states", "actions").collect()), key=str)


def test_compose_calls_a_group_once_for_many_episodes(spark, tmp_path):
    """Forty episodes of four buckets are four rows of state at most, and of odd names and none, too."""
    rows = [(name, n, 100 * e + n, float(n), 1, n == 5) for e, name in enumerate([None, "", "null", '"', *map(str, range(36))]) for n in range(6)]
    schema = "episode string, ts long, event_id long, payload double, high_quality int, final boolean"
    for low, high in ((0, 3), (3, 5), (5, 6)):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    config = windows.WindowConfig(windows.Reach(2, 1, "truncate"), windows.Reach(2, 1))
    out = online.compose(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), config, ["episode"], "ts", buckets=4)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert all(p["stateOperators"][0]["numRowsTotal"] <= 4 for p in query.recentProgress if p["stateOperators"]) and query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0
    got = {r.event_id: (r.states, r.actions) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 240 and got[105] == ([4.0, 5.0], [5.0]) and got[3] == ([2.0, 3.0], [3.0, 4.0])


def batches(spark, tmp_path, parts, schema):
    """A stream that gets one file a micro-batch, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


#: The fifth batch has a row of a closed window: minute 2 is later than the ten minutes before the latest event of the
#: batches before the last, which is what Spark goes by.
PARTS = [[(at(1), "a"), (at(4), "b")], [(at(12), "a")], [(at(40), "a")], [(at(41), "a")], [(at(2), "a"), (at(35), "b")], [(at(100), "b")]]


def test_late_rows_are_dropped(spark, tmp_path):
    """Tumbling windows close once the watermark passes them; a row within its lateness still counts."""
    stream = batches(spark, tmp_path, PARTS, "ts timestamp, kind string")
    got = sorted(tuple(r) for r in online.run_available(online.counted(stream, "ts", ["kind"], "10 minutes", "10 minutes")).collect())
    assert got == sorted([(at(0), "a", 1), (at(0), "b", 1), (at(10), "a", 1), (at(40), "a", 2), (at(30), "b", 1)])


def test_sliding_windows(spark, tmp_path):
    stream = batches(spark, tmp_path, PARTS, "ts timestamp, kind string")
    got = {(r.start, r.kind): r.n for r in online.run_available(online.counted(stream, "ts", ["kind"], "10 minutes", "10 minutes", "5 minutes")).collect()}
    want = {}
    for part in PARTS[:5]:
        for ts, kind in part:
            if ts != at(2):  # late
                for start in (ts - timedelta(minutes=ts.minute % 5), ts - timedelta(minutes=ts.minute % 5 + 5)):
                    want[start, kind] = want.get((start, kind), 0) + 1
    assert got == want


def test_sessions_in_a_stream(spark, tmp_path):
    """Sessions end after a gap; one that a late row would have joined is closed."""
    stream = batches(spark, tmp_path, PARTS, "ts timestamp, kind string")
    got = sorted(tuple(r) for r in online.run_available(online.session_counts(stream, "ts", ["kind"], "6 minutes", "10 minutes")).collect())
    assert got == sorted([(at(1), at(7), "a", 1), (at(4), at(10), "b", 1), (at(12), at(18), "a", 1), (at(40), at(47), "a", 2), (at(35), at(41), "b", 1)])

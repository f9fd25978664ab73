"""Resampled shards: same rows after a restart, bounded batches; blending of streams over any cut into batches."""

import json
import pickle
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.operators.blend import interleave
from epiframe.sources import shards
from epiframe.sources.tars import members
from epiframe.streaming import blend, online, resampled


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    """Shards of 7, 1, 12 and 4 frames."""
    out = []
    for k, n in enumerate((7, 1, 12, 4)):
        rows = [(f"s{k}f{i:02}", json.dumps({"episode_index": k}), [1.0], b"x" * (10 * k + i)) for i in range(n)]
        out += shards.write_frames(spark.createDataFrame(rows, "key string, meta string, lowdim array<float>, image binary").coalesce(1), f"file://{tmp_path_factory.mktemp('s')}/{k}")
    return out


def run(stream, path, checkpoint, until=None):
    """Rows of each batch, by way of a sink that is run until ``until`` batches or the end of the source."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    if until is None:
        query.processAllAvailable()
    else:
        while len([p for p in query.recentProgress if p["numInputRows"]]) < until and query.isActive:
            query.awaitTermination(0.2)
    done = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    return done


def rows_of(spark, stream, path):
    return sorted((r.epoch, r.draw, r.pos, r.key, len(r.image)) for r in spark.read.schema(stream.schema).parquet(path).select("epoch", "draw", "pos", "key", "image").collect())


def expected(spark, paths, seed, epochs, how="permute"):
    frames = {}
    for r in shards.read_frames(spark, paths, depth=False, chest=False).collect():
        frames.setdefault(r.shard, []).append((r.pos, r.key, len(r.image)))
    listed = [resampled.Shard(p, len(f), 0) for p, f in sorted(frames.items())]
    return sorted((e, d, *f) for e in range(epochs) for d, k in enumerate(resampled.draws(listed, e, seed, how)) for f in frames[listed[k].path])


@pytest.mark.parametrize("how", ["permute", "replace"])
def test_epochs_and_bounded_batches(spark, paths, tmp_path, how):
    stream = resampled.resampled(spark, paths, seed=3, draw=how, epochs=3, rows=9)
    batches = run(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    want = expected(spark, paths, 3, 3, how)
    assert rows_of(spark, stream, f"{tmp_path}/out") == want
    assert max(batches) <= 9 and sum(batches) == len(want)


def test_same_rows_after_a_restart(spark, paths, tmp_path):
    """Stopped in the middle and started anew: no row twice or missing, batches bounded all along."""
    make = lambda: resampled.resampled(spark, paths, progress=f"file://{tmp_path}/progress", seed=5, epochs=2, rows=5)
    batches = run(make(), f"{tmp_path}/out", f"{tmp_path}/cp", until=2)
    stream = make()
    batches += run(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert rows_of(spark, stream, f"{tmp_path}/out") == expected(spark, paths, 5, 2)
    assert max(batches) <= 5


def test_without_end(spark, paths, tmp_path):
    stream = resampled.resampled(spark, paths, progress=f"file://{tmp_path}/progress", seed=1, rows=10)
    assert run(stream, f"{tmp_path}/out", f"{tmp_path}/cp", until=6)[:6] == [10] * 6
    got = rows_of(spark, stream, f"{tmp_path}/out")
    assert got == expected(spark, paths, 1, 9)[: len(got)] and got[-1][0] >= 2


def test_admission():
    s = [resampled.Shard("a", 4, 100), resampled.Shard("b", 0, 0), resampled.Shard("c", 6, 10), resampled.Shard("d", 2, 1000)]
    for how in ("permute", "replace"):
        for rows, most in ((3, 0), (100, 250), (5, 120), (1, 0), (7, 1)):
            at, seen = {"epoch": 0, "at": 0}, []
            while at["epoch"] < 3:
                end = resampled.admit(s, at, rows, most, 9, how, 4)
                batch = [(x.epoch, x.draw, k, x.path) for x in resampled.slices(s, at, end, 9, how, 3) for k in range(x.first, x.last)]
                assert 1 <= len(batch) <= rows and all(x.last - x.first <= 3 for x in resampled.slices(s, at, end, 9, how, 3))
                size = sum(next(y.largest for y in s if y.path == b[3]) for b in batch)
                assert not most or size <= most or len(batch) == 1
                seen, at = seen + batch, end
            want = [(e, d, k, x.path) for e, d, first, x in resampled.walk(s, 0, 0, 9, how, 4) for k in range(first, x.rows)]
            assert seen == want[: len(seen)] and len(seen) > 20


def test_end_of_the_last_epoch():
    s = [resampled.Shard("a", 4, 1)]
    assert resampled.admit(s, {"epoch": 1, "at": 2}, 100, 0, 0, "permute", 2) == {"epoch": 1, "at": 4} == resampled.admit(s, {"epoch": 1, "at": 4}, 100, 0, 0, "permute", 2)
    assert resampled.slices(s, {"epoch": 1, "at": 4}, {"epoch": 1, "at": 4}, 0, "permute", 9) == []
    with pytest.raises(ValueError, match="unknown way"):
        resampled.draws(s, 0, 0, "other")


def test_an_epoch_is_drawn_once(monkeypatch):
    """Batches of an epoch share its order of shards."""
    s, made, own = [resampled.Shard(str(k), 3, 1) for k in range(50)], [], np.random.default_rng
    monkeypatch.setattr(resampled.np.random, "default_rng", lambda x: made.append(tuple(x)) or own(x))
    at = {"epoch": 0, "at": 0}
    for _ in range(30):
        end = resampled.admit(s, at, 9, 0, 123, "permute", 2)
        assert sum(x.last - x.first for x in resampled.slices(s, at, end, 123, "permute", 2)) == 9
        at = end
    assert len(made) == len(set(made)) <= 2


def test_lanes_share_an_epoch(spark, paths, tmp_path):
    """Lanes side by side give each drawn shard once, each in bounded batches of its own."""
    for how in ("permute", "replace"):
        streams = resampled.resampled_lanes(spark, paths, 3, seed=3, draw=how, epochs=3, rows=9)
        assert len(streams) == 3 and len(resampled.resampled_lanes(spark, paths, 9, seed=3)) == 4
        got = [tuple(r) for r in online.run_to_end(*(s.select("epoch", "draw", "pos", "key", F.octet_length("image")) for s in streams)).collect()]
        assert sorted(got) == expected(spark, paths, 3, 3, how)
    s, seen = [resampled.Shard(str(k), 3 * k, 1) for k in range(5)], []
    for lane in range(2):
        at = {"epoch": 0, "at": 0}
        while (end := resampled.admit(s, at, 7, 0, 1, "permute", 2, lane, 2)) != at:
            batch = [(x.epoch, x.draw, k) for x in resampled.slices(s, at, end, 1, "permute", 4, lane, 2) for k in range(x.first, x.last)]
            assert len(batch) <= 7 and {d % 2 for _, d, _ in batch} == {lane}
            seen, at = seen + batch, end
    assert len(seen) == len(set(seen)) == 2 * sum(x.rows for x in s)


def test_parts_are_read_from_marks(paths, monkeypatch):
    """A part begins at the last marked frame before it, and no header before that is read."""
    monkeypatch.setattr(resampled, "MARK", 3)
    (path,) = [p for p in paths if resampled.measured(p).rows == 12]
    shard = resampled.measured(path)
    assert len(shard.marks) == 3 and shard.largest == 31 and [shard.before(k)[0] for k in (0, 2, 3, 8, 11)] == [0, 0, 3, 6, 9]
    whole, starts = list(resampled.frames_between(path, 0, 12, ["meta.json", "image.jpg"])), []
    monkeypatch.setattr(resampled, "members", lambda held, at=0: starts.append(at) or members(held, at))
    for x in resampled.slices([shard], {"epoch": 0, "at": 2}, {"epoch": 0, "at": 12}, 0, "permute", 4):
        assert str(list(resampled.frames_between(path, x.first, x.last, ["meta.json", "image.jpg"], x.mark))) == str(whole[x.first : x.last])
    assert starts == [0, shard.marks[1], shard.marks[2]]


def test_tasks_get_no_list_of_shards(paths, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([("a", 3, 1, [])] * 1000))
    reader = resampled.Reader({"shards": f"file://{tmp_path}/s.json", "suffixes": "[]"})
    assert len(reader.shards) == 1000 and len(pickle.dumps(reader)) < 1000


def test_no_frames(spark, tmp_path):
    with pytest.raises(Exception, match="no frames in any shard"):
        run(resampled.resampled(spark, []), f"{tmp_path}/out", f"{tmp_path}/cp")


A = {0: 17, 1: 6, 2: 0, 3: 8}
B = {0: 5, 1: 9, 2: 3, 3: 0}


def wanted(spark, ratio, batch):
    out = set()
    for lane, n in A.items():
        first, second = (spark.range(k).withColumnRenamed("id", "n") for k in (n, B[lane]))
        out |= {(lane, *r) for r in interleave(first, second, B[lane], ratio, batch).collect()}
    return sorted(out)


@pytest.mark.parametrize("ratio, batch", [(5 / 6, 6), (0.5, 4), (0.34, 3), (1.0, 5)])
@pytest.mark.parametrize("cuts", [[99], [3, 4, 99], [1, 2, 5, 8, 99]])
def test_blend_over_any_cut(spark, tmp_path, ratio, batch, cuts):
    """Files of both streams arrive batch by batch, the query restarts from its checkpoint after each."""
    fa, fb = (str(tmp_path / x) for x in "ab")
    for x in "ab":
        (tmp_path / x).mkdir()
    first = spark.readStream.schema("lane int, n long").parquet(fa)
    second = spark.readStream.schema("lane int, n long, final boolean").parquet(fb)
    out, low, written = blend.blend_streams(first, second, ratio, batch), 0, []
    for high in cuts:
        rows = lambda sizes: [(lane, n) for lane, size in sizes.items() for n in range(low, min(size, high))]
        a, b = rows(A), [(lane, n, n == B[lane] - 1) for lane, n in rows(B)] + ([(3, None, True)] if high == 99 else [])
        spark.createDataFrame(a, "lane int, n long").coalesce(1).write.mode("append").parquet(fa)
        spark.createDataFrame(b, "lane int, n long, final boolean").coalesce(1).write.mode("append").parquet(fb)
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        low = high
    got = [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == wanted(spark, ratio, batch) and max(Counter(x[:2] for x in got).values()) == 1


def test_large_rounds_come_in_parts(monkeypatch):
    monkeypatch.setattr(blend, "PART", 4)
    parts = list(blend.assigned(3, 2, 5, (0, 0, 0, False), (9, 4, 6, True)))
    assert [len(p) for p in parts] == [4, 4, 1, 4, 2]
    assert np.concatenate([p["slot"] for p in parts]).tolist() == [0, 1, 2, 5, 6, 7, 10, 11, 12, 3, 4, 8, 9, 13, 14]
    assert parts[-1]["n"].tolist() == [0, 1]


def test_unified(spark):
    first, second = (spark.range(k).withColumnRenamed("id", "n") for k in (7, 2))
    assert sorted(map(tuple, blend.unified(first, second, 0.5, 4).collect())) == sorted(map(tuple, interleave(first, second, 2, 0.5, 4).collect()))
    assert blend.unified(first).count() == 7
    assert [tuple(r) for r in blend.unified(first, second, mode="val").groupBy("source_ord").count().orderBy("source_ord").collect()] == [(0, 7), (1, 2)]
    for ratio in (0, 1.5, -1):
        for mode in ("train", "val"):
            with pytest.raises(ValueError, match="ratio"):
                blend.unified(first, second, ratio, mode=mode)
    with pytest.raises(ValueError, match="mode"):
        blend.unified(first, second, mode="test")

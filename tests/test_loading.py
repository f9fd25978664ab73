"""Shuffles, guarded functions, batches, image processing, slots, determinants and Beta times against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.functions import sampling
from epiframe.operators import collate, guarded, images, metrics, samples, shuffle

# shuffle


def test_warm_up():
    assert [shuffle.warm_up(b, i) for b, i in ((0, 5), (None, 5), (-1, None), (10, None), (10, 0), (10, -3), (10, 4), (10, 99))] == [0, 0, 0, 10, 1, 1, 4, 10]


@pytest.mark.parametrize("buffer, initial, buckets", [(1, 1, None), (7, 3, None), (50, None, None), (50, 50, 3), (10_000, 4096, None), (16, 99, 2)])
def test_displacement_and_multiset(spark, monkeypatch, buffer, initial, buckets):
    df = spark.range(0, 2000, 1, 3).select((F.col("id") % 700).alias("x"), "id")
    run = lambda seed: [[r.id for r in part] for part in shuffle.buffer_shuffle(df, ["x", "id"], buffer, initial, seed, buckets).rdd.glom().collect()]
    parts = run(1)
    assert sorted(x for p in parts for x in p) == list(range(2000)) and parts == run(1)
    for p in parts:
        came = {x: k for k, x in enumerate(sorted(p, key=lambda x: (x % 700, x)))}
        assert all(k >= came[x] - buffer for k, x in enumerate(p))
    if buffer > 1:
        assert parts != run(2) and any(p != sorted(p, key=lambda x: (x % 700, x)) for p in parts)


def test_shuffle_off_and_empty(spark):
    df = spark.range(9)
    assert shuffle.buffer_shuffle(df, ["id"], 0) is df and shuffle.buffer_shuffle(df, ["id"], None) is df
    assert shuffle.buffer_shuffle(df.limit(0), ["id"], 8, 2).collect() == []


def test_buffer_over_batches(spark):
    """Batches of the state are small against its buffer, and large."""
    import pyarrow as pa

    for sizes in ([1] * 40, [7, 0, 33], [40]):
        state, out, at = shuffle.Buffer(10, 4, np.random.default_rng(5)), [], 0
        for n in sizes:
            out += state.put(pa.RecordBatch.from_arrays([pa.array(range(at, at + n), pa.int64())], names=["x"]))["x"].to_pylist()
            at += n
            assert len(state.pool) <= 10
        assert sorted(out + state.rest()["x"].to_pylist()) == list(range(40)) and len(out) == 31


# guarded


def _risky():
    """A function that workers get by value, as they don't import this module."""

    def risky(row):
        if row["x"] is None:
            raise guarded.Skip("no value", f"id {row['id']}")
        if row["x"] < 0:
            return None
        if row["x"] > 100:
            raise KeyError("too large")
        return {"id": row["id"], "y": row["x"] * 2, "more": 1}

    return risky


risky = _risky()


def test_rows_and_skipped(spark):
    rows = [(k, None if k % 5 == 0 else -1.0 if k % 7 == 0 else float(k % 50), f"shard{k % 3}") for k in range(600)] + [(None, None, None)]
    out = guarded.map_rows(spark.createDataFrame(rows, "id long, x double, shard string").repartition(4), risky, "id long, y double, z string", ["shard", "id"])
    ok = [r for r in rows if r[1] is not None and r[1] >= 0]
    assert sorted(map(tuple, out.rows.collect())) == sorted((r[0], 2 * r[1], None) for r in ok)
    lost = sorted(((r.shard, r.id, r.reason, r.detail) for r in out.skipped.collect()), key=str)
    assert lost == sorted(((s, i, "no value", f"id {i}") if x is None else (s, i, "none", "") for i, x, s in rows if x is None or x < 0), key=str)
    assert out.counts == {"rows_in": 601, "rows_out": len(ok), "skipped": 601 - len(ok)}
    assert {r.reason: r.n for r in guarded.by_reason(out.skipped).collect()} == {"no value": 121, "none": sum(1 for r in rows if r[1] == -1.0)}


def test_other_errors_end_the_job(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 500.0, "b")], "id long, x double, shard string")
    with pytest.raises(Exception, match="data error on shard=b, id=2"):
        guarded.map_rows(df, risky, "id long, y double", ["shard", "id"])


def test_guarded_empty(spark):
    out = guarded.map_rows(spark.createDataFrame([], "id long, x double"), risky, "id long, y double", ["id"])
    assert out.rows.collect() == out.skipped.collect() == [] and out.counts == {"rows_in": 0, "rows_out": 0, "skipped": 0}


def test_recorder_failures_do_not_end_the_stream(spark, tmp_path):
    log, seen = [], []

    def record(df, batch):
        if batch == 1:
            raise OSError("disk full")
        seen.append(df.count())

    spark.range(0, 30, 1, 3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(guarded.collect_dropped(record, log.append)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [10, 10] and log == ["batch 1 dropped: disk full"]


# collate


def brute_batches(rows, size, fill, drop_last):
    out = {}
    for b in range(0, len(rows), size):
        part = rows[b : b + size]
        if len(part) == size or not drop_last:
            width = max(len(x or []) for _, x in part)
            out[b // size] = ([i for i, _ in part], [(x or []) + [fill] * (width - len(x or [])) for _, x in part], [[k < len(x or []) for k in range(width)] for _, x in part], [len(x or []) for _, x in part])
    return out


@pytest.mark.parametrize("size", [1, 4, 7, 500])
@pytest.mark.parametrize("drop_last", [False, True])
def test_batches(spark, size, drop_last):
    rng = random.Random(2)
    rows = [(k, None if k % 11 == 0 else [rng.randrange(9) for _ in range(rng.randrange(6) if k % 20 else 40)]) for k in range(101)] + [(k, []) for k in range(101, 109)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "id long, x array<long>").repartition(5)
    got = {r.batch: (r.id, r.x, r.x_mask, r.x_length) for r in collate.collate(df, ["id"], size, {"x": F.lit(0).cast("long")}, ["id"], drop_last=drop_last).collect()}
    assert got == brute_batches(rows, size, 0, drop_last)


def test_fixed_width_and_errors(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, x array<double>")
    assert collate.collate(df, ["id"], 2, {"x": F.lit(0.0)}, width={"x": 3}).first().x == [[1.0, 0.0, 0.0], [1.0, 2.0, 0.0]]
    with pytest.raises(Exception, match="x is longer than 1"):
        collate.collate(df, ["id"], 2, {"x": F.lit(0.0)}, width={"x": 1}).collect()
    with pytest.raises(ValueError, match="at least one row"):
        collate.collate(df, ["id"], 0, {"x": F.lit(0.0)})
    assert collate.collate(df.limit(0), ["id"], 2, {"x": F.lit(0.0)}).collect() == []


# images


def slow_bilinear(a, height, width):
    out = np.zeros((len(a), height, width, *a.shape[3:]))
    for y in range(height):
        for x in range(width):
            sy, sx = (min(max((p + 0.5) * old / new - 0.5, 0), old - 1) for p, old, new in ((y, a.shape[1], height), (x, a.shape[2], width)))
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, a.shape[1] - 1), min(x0 + 1, a.shape[2] - 1)
            fy, fx = sy - y0, sx - x0
            out[:, y, x] = (a[:, y0, x0] * (1 - fx) + a[:, y0, x1] * fx) * (1 - fy) + (a[:, y1, x0] * (1 - fx) + a[:, y1, x1] * fx) * fy
    return out


@pytest.mark.parametrize("size", [(3, 5), (16, 9), (1, 1), (7, 7), (13, 2)])
def test_resize(size):
    rng = np.random.default_rng(4)
    color, depth = rng.integers(0, 256, (2, 7, 9, 3)).astype(np.uint8), rng.random((2, 7, 9)).astype(np.float32)
    assert np.abs(images.bilinear(color, *size).astype(float) - slow_bilinear(color.astype(float), *size)).max() <= 0.5 + 1e-3
    assert np.allclose(images.bilinear(depth, *size), slow_bilinear(depth.astype(float), *size), atol=1e-5)
    n = images.nearest(depth, *size)
    assert all(n[f, y, x] == depth[f, y * 7 // size[0], x * 9 // size[1]] for f in range(2) for y in range(size[0]) for x in range(size[1]))
    assert images.bilinear(color, 7, 9) is color and images.nearest(depth, 7, 9) is depth


def test_augmentation_by_key():
    rng = np.random.default_rng(1)
    color, depth = rng.integers(0, 256, (3, 20, 30, 3)).astype(np.uint8), np.where(rng.random((3, 20, 30)) < 0.3, 0, 2.0).astype(np.float32)
    one = lambda *key: images.process(color, depth, [1.0, 1.0, 1.0, 1.0], images.generator(7, *key), (0.0, 1.99))
    a, b, c = one("s", 1), one("s", 1), one("s", 2)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and (a[0] != c[0]).any() and (a[1] != c[1]).any()
    assert a[0].dtype == np.uint8 and a[1].max() <= 1.99 and (a[1][depth == 0] == 0).all() and a[2] == [1.0] * 4
    assert (images.augment_color(np.zeros((1, 2, 2, 3), np.uint8), rng) == 0).all()


def test_jitter_is_shared_and_depth_noise_follows_depth():
    flat = np.full((4, 50, 50, 3), 90, np.uint8)
    factors = {int(images.augment_color(flat, images.generator(0, k))[0, 0, 0, 0]) for k in range(60)}
    out = images.augment_color(flat, images.generator(0, 3))
    assert (out == out[0, 0, 0, 0]).all() and min(factors) >= 62 and max(factors) <= 118 and len(factors) > 10
    deep = images.augment_depth(np.full((2, 200, 200), 4.0, np.float32), images.generator(1), dropout=0.0)
    assert abs(deep.std() - 0.02) < 0.001 and abs(deep.mean() - 4) < 0.001
    holes = [float((images.augment_depth(np.ones((2, 40, 40), np.float32), images.generator(2, k), noise=0.0) == 0).mean()) for k in range(300)]
    assert max(holes) <= 0.16 + 1e-9 and 100 < sum(h > 0 for h in holes) < 200


def test_process_frames(spark):
    rng = np.random.default_rng(3)
    color, depth = rng.integers(0, 256, (2, 6, 8, 3)).astype(np.uint8), rng.random((2, 6, 8)).astype("<f4")
    rows = [("a", 6, 8, color.tobytes(), depth.tobytes(), [8.0, 6.0, 4.0, 3.0]), ("b", 6, 8, color.tobytes(), None, None), ("c", None, None, None, None, None), ("d", 6, 8, b"", b"", [1.0] * 4)]
    df = spark.createDataFrame(rows, "key string, height int, width int, pixels binary, depth binary, intrinsic array<double>")
    got = {r.key: r for r in images.process_frames(df, ["key"], (3, 4), 5, (0.1, 0.9)).collect()}
    for key, d in (("a", depth), ("b", None)):
        want = images.process(color, d, [8.0, 6.0, 4.0, 3.0] if d is not None else None, images.generator(5, key), (0.1, 0.9), (3, 4))
        assert bytes(got[key].pixels) == want[0].tobytes() and (got[key].height, got[key].width) == (3, 4) and got[key].intrinsic == want[2]
        assert (got[key].depth and bytes(got[key].depth)) == (None if d is None else want[1].astype("<f4").tobytes())
    assert got["a"].intrinsic == [4.0, 3.0, 2.0, 1.5] and got["c"].pixels is None and bytes(got["d"].pixels) == b""
    plain = images.process_frames(df.drop("depth", "intrinsic"), ["key"])
    assert {r.key: r.pixels and bytes(r.pixels) for r in plain.collect()} == {"a": color.tobytes(), "b": color.tobytes(), "c": None, "d": b""}


# slots


def test_slots(spark):
    tokens = spark.createDataFrame([(s, p, t) for s, ts in enumerate(["aSbSS", "S", "abc", ""]) for p, t in enumerate(ts)], "s int, p int, t string")
    values = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0]), (0, 2, None), (1, 0, [4.0])], "s int, k int, value array<double>")
    out = samples.scatter_slots(tokens, values, "s", "p", F.col("t") == "S")
    assert {(r.s, r.p): r.value for r in out.collect()} == {(0, 0): None, (0, 1): [1.0], (0, 2): None, (0, 3): [2.0], (0, 4): None, (1, 0): [4.0], (2, 0): None, (2, 1): None, (2, 2): None}
    for odd in (values.where("NOT (s = 0 AND k = 1)"), values.union(spark.createDataFrame([(2, 0, [0.0])], values.schema)), values.union(spark.createDataFrame([(1, 1, [0.0])], values.schema)), values.union(spark.createDataFrame([(9, 0, [0.0])], values.schema))):
        with pytest.raises(Exception, match="slots and values differ in s "):
            samples.scatter_slots(tokens, odd, "s", "p", F.col("t") == "S").collect()


# determinants


def test_covariances(spark):
    rng = np.random.default_rng(6)
    gt, pred = rng.normal(size=(40, 3, 4)), rng.normal(size=(40, 3, 4))
    pred[..., 3] = 2 * pred[..., 0] - pred[..., 1]  # singular
    rows = [(s, t, d, float(gt[s, t, d]), float(pred[s, t, d])) for s in range(40) for t in range(3) for d in range(4)]
    got = {r["of"]: r for r in metrics.covariance_summaries(spark.createDataFrame(rows, "sample_id int, step int, dim int, gt double, pred double")).collect()}
    for of, a in (("gt", gt), ("pred", pred), ("error", gt - pred)):
        want = np.cov(a.reshape(-1, 4), rowvar=False)
        assert np.allclose(np.array(got[of].matrix).reshape(4, 4), want) and math.isclose(got[of].trace, np.trace(want))
        assert math.isclose(got[of].determinant, 0.0 if of == "pred" else np.linalg.det(want), rel_tol=1e-9)


def test_determinants(spark):
    rows = [([2.0, 1.0, 7.0, 4.0],), ([0.0, 1.0, 1.0, 0.0],), ([1.0, 2.0, 2.0, 4.0],), ([5.0],), ([],), (None,), ([1.0, 2.0],), ([1.0, None, 0.0, 1.0],)]
    got = [r[0] for r in spark.createDataFrame(rows, "m array<double>").coalesce(1).select(metrics.determinant("m")).collect()]
    assert [x if x is None else round(x, 9) for x in got] == [1.0, -1.0, 0.0, 5.0, 1.0, None, None, None]


# Beta times


@pytest.mark.parametrize("a, b", [(1.5, 1.0), (2.0, 5.0), (0.5, 0.5), (30.0, 2.0), (1.0, 1.0), (200.0, 300.0)])
def test_beta_quantiles(a, b):
    """Against the integral of the density, by substitution z = sin(t) ** 2, which takes its poles away."""
    t = np.linspace(0, np.pi / 2, 400_001)
    middle = (t[1:] + t[:-1]) / 2
    with np.errstate(divide="ignore"):
        logs = (2 * a - 1) * np.log(np.sin(middle)) + (2 * b - 1) * np.log(np.cos(middle))
    f = np.exp(logs - logs.max())
    share = np.concatenate([[0], np.cumsum(f)]) / f.sum()
    u = np.array([0.001, 0.05, 0.3, 0.5, 0.77, 0.99])
    assert np.allclose(sampling.beta_quantile(u, a, b), np.sin(np.interp(u, share, t)) ** 2, atol=2e-6)


def test_beta_time(spark):
    df = spark.createDataFrame([(x / 20,) for x in range(1, 20)], "u double")
    rows = df.select(sampling.beta_time_of(F.col("u"), 1.5, 1.0, 0.001).alias("any"), sampling.beta_time(F.col("u"), 1.5, 0.001).alias("one")).collect()
    assert all(abs(r["any"] - r.one) < 1e-9 for r in rows)
    with pytest.raises(ValueError, match="positive"):
        sampling.beta_time_of(F.col("u"), 0, 1)


# random mix


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_random_mix(spark, monkeypatch, block):
    """Each source's rows in order and over again, in any blocks; shares near the weights."""
    from epiframe.operators import blend

    monkeypatch.setattr(blend, "MIX_BLOCK", block)
    slots = spark.range(4000).withColumnRenamed("id", "slot")
    rows = sorted((r.slot, r.source, r.number) for r in blend.random_mix(slots, [3, 0, 1, 5], [50, 9, 7, 0], seed=2).collect())
    assert [r[0] for r in rows] == list(range(4000)) and {r[1] for r in rows} == {0, 2}
    for source, size in ((0, 50), (2, 7)):
        picks = [n for _, s, n in rows if s == source]
        assert picks == [k % size for k in range(len(picks))]
    assert abs(sum(r[1] == 0 for r in rows) / 4000 - 0.75) < 0.03
    assert blend.random_mix(slots, [0, 1], [5, 5]).select("source").distinct().collect()[0][0] == 1
    for weights, sizes in (([1], [1, 2]), ([-1, 2], [1, 2]), ([0, 1], [5, 0])):
        with pytest.raises(ValueError, match="weight|no source"):
            blend.random_mix(slots, weights, sizes)

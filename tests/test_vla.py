"""Model rows against the column expressions of single steps, and against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.functions import geometry as G
from epiframe.operators import normalizer, samples, vla

SCHEMA = "key string, wrist_states array<array<double>>, hand_states array<array<double>>, wrist_actions array<array<double>>, hand_actions array<array<double>>, extrinsic array<double>, later_extrinsics array<array<double>>"


def rigid(rng):
    m = np.eye(4)
    m[:3, :3] = vla.rotations(rng.normal(size=6))
    m[:3, 3] = rng.normal(size=3)
    return m


def windows(spark, n=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        s, a, f = 1 + k % 4, k % 6, k % 5
        rows.append((f"w{k}", rng.normal(size=(s, 18)).tolist(), rng.normal(size=(s, 30)).tolist(), rng.normal(size=(a, 18)).tolist(), rng.normal(size=(a, 30)).tolist(), rigid(rng).ravel().tolist(), None if k % 7 == 3 else [rigid(rng).ravel().tolist() for _ in range(f)]))
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("motion, hand", [("mano", 10), ("fingertips", 6)])
def test_steps_equal_column_expressions(spark, motion, hand):
    """Each step on its own, by the expressions that the registered queries hold against SQL."""
    rows, df = windows(spark)
    shape = vla.Shape(4, 6, 0, hand, motion)
    got = {r.key: r for r in vla.model_rows(df, shape, locator=["key"]).collect()}
    for name, count in (("states", "n_states"), ("actions", "n_actions")):
        wrist, hands = f"wrist_{name}", f"hand_{name}"
        steps = df.select("key", "extrinsic", F.posexplode(F.arrays_zip(F.col(wrist).alias("w"), F.col(hands).alias("h"))).alias("k", "x")).select("key", "k", "extrinsic", F.col("x.w").alias("w"), F.col("x.h").alias("h"))
        steps = G.with_poses(steps, "w", "left", "right")
        out = samples.process_state_action((G.matrix4("left"), G.matrix4("right")), G.vector("h", 0, 30), G.matrix4("extrinsic"), hand, motion)
        n = dict.fromkeys(got, 0)
        for r in steps.select("key", "k", F.array(*out).alias("x")).collect():
            assert got[r.key][name][r.k] == pytest.approx(r.x, abs=2e-6), (name, r.key, r.k)
            n[r.key] = max(n[r.key], r.k + 1)
        assert all(got[k][count] == n[k] for k in got)
    for r in rows:
        g = got[r[0]]
        assert np.shape(g.states) == (4, shape.width) and np.shape(g.actions) == (6, shape.width)
        assert np.all(np.array(g.states)[g.n_states :] == 0) and np.all(np.array(g.actions)[g.n_actions :] == 0)
        assert g.actions_valid == [k < g.n_actions for k in range(6)]


@pytest.mark.parametrize("motion", ["mano", "fingertips"])
def test_relative_actions(spark, motion):
    rows, df = windows(spark)
    plain = {r.key: r for r in vla.model_rows(df, vla.Shape(4, 6, 0, 15, motion), locator=["key"]).collect()}
    for r in vla.model_rows(df, vla.Shape(4, 6, 0, 15, motion, True), locator=["key"]).collect():
        state = np.array(plain[r.key].states[plain[r.key].n_states - 1])
        for k in range(r.n_actions):
            full, part = np.array(plain[r.key].actions[k]), np.array(r.actions[k])
            want = [np.linalg.pinv(vla.poses(state[:18])[s]) @ vla.poses(full[:18])[s] for s in range(2)]
            assert np.allclose(vla.poses(part[:18]), want) and np.allclose(part[18:], full[18:] - state[18:])
            assert np.allclose(vla.poses(vla.absolute(state, part)[:18]), vla.poses(full[:18])) and np.allclose(vla.absolute(state, part)[18:], full[18:])


def test_relative_to_nothing(spark):
    df = spark.createDataFrame([("w", [], [], [[0.0] * 18], [[0.0] * 30], np.eye(4).ravel().tolist(), None)], SCHEMA)
    assert vla.model_rows(df, vla.Shape(2, 2), locator=["key"]).first().n_states == 0
    with pytest.raises(Exception, match="relative to: key=w"):
        vla.model_rows(df, vla.Shape(2, 2, relative=True), locator=["key"]).collect()


def test_camera_motions(spark):
    """Each of the later frames, up to a length, in the frame of the one now."""
    rows, df = windows(spark)
    got = {r.key: r for r in vla.model_rows(df, vla.Shape(4, 6, 3), locator=["key"]).collect()}
    for r in rows:
        later, now = (r[6] or [])[:3], np.array(r[5]).reshape(4, 4)
        assert got[r[0]].n_later == len(later) and np.shape(got[r[0]].later_motions) == (3, 16)
        for k in range(3):
            want = now @ np.linalg.inv(np.array(later[k]).reshape(4, 4)) if k < len(later) else np.zeros((4, 4))
            assert np.allclose(np.array(got[r[0]].later_motions[k]).reshape(4, 4), want)


def test_lengths_are_cut_and_numbers_finite(spark):
    rows, df = windows(spark)
    bad = spark.createDataFrame([("x", [[float("nan")] * 18, [None] + [1.0] * 17, [1.0] * 18], [[1.0] * 30] * 3, [[1.0] * 18] * 9, [[2.0] * 30] * 9, np.eye(4).ravel().tolist(), [np.eye(4).ravel().tolist()] * 9)], SCHEMA)
    r = vla.model_rows(bad, vla.Shape(2, 4, 5), locator=["key"]).first()
    assert (r.n_states, r.n_actions, r.n_later) == (2, 4, 5) and np.isfinite(np.array(r.states)).all()
    assert vla.model_rows(df.limit(0), vla.Shape()).collect() == []
    for shape in (vla.Shape(motion="other"), vla.Shape(motion="fingertips", hand=10)):
        with pytest.raises(ValueError, match="unknown motion|three numbers"):
            vla.model_rows(df, shape)


@pytest.mark.parametrize("relative", [False, True])
def test_normalizer_fits_and_applies(spark, relative):
    """Rows without padding are fitted; normalized rows stay within the fitted range."""
    _, df = windows(spark, 40, 5)
    shape = vla.Shape(4, 6, relative=relative)
    plain = vla.model_rows(df, shape, locator=["key"])
    rows = vla.fit_rows(plain, relative)
    keys = {r.key: r.n for r in rows.groupBy("key").agg(F.count("*").alias("n")).collect()}
    total = plain.agg(F.sum("n_states"), F.sum("n_actions")).first()
    assert keys == ({"states": total[0] * 48, "actions": total[1] * 48} if relative else {"motions": (total[0] + total[1]) * 48})
    params = normalizer.fit(rows, ignore=None)
    by = {(p.key, p.dim): (p.scale, p.offset) for p in params.collect()}
    scaled = {r.key: r for r in vla.model_rows(df, shape, params, ["key"]).collect()}
    for r in plain.collect():
        for name, n in (("states", r.n_states), ("actions", r.n_actions)):
            key = name if relative else "motions"
            for k in range(len(r[name])):
                want = [x * by[key, d][0] + by[key, d][1] for d, x in enumerate(r[name][k])] if k < n else [0.0] * 48
                assert scaled[r.key][name][k] == pytest.approx(want, abs=1e-9)


def test_question_rows_have_the_same_columns(spark):
    shape = vla.Shape(2, 3, 1)
    df = spark.createDataFrame([("q", None, 7)], "question string, n_states int, other int")
    r = samples.zero_filled(df, vla.empty_row(shape)).first()
    assert r.states == [[0.0] * 48] * 2 and r.actions_valid == [False] * 3 and r.later_motions == [[0.0] * 16] and (r.n_states, r.n_actions, r.other) == (0, 0, 7)


def test_required_view(spark):
    df = spark.createDataFrame([("s", "a", b"x"), ("s", "b", None)], "shard string, key string, chest_image binary")
    assert vla.required(df.where("key = 'a'"), "chest_image").count() == 1
    with pytest.raises(Exception, match="chest_image is missing: shard=s, key=b"):
        vla.required(df, "chest_image").collect()


@pytest.mark.parametrize("relative", [False, True])
def test_report(spark, relative):
    """Truth that was made relative comes back; hands of the fingertips mode are where the camera saw them."""
    rows, df = windows(spark)
    shape = vla.Shape(4, 6, 0, 15, "fingertips", relative)
    plain = {r.key: r for r in vla.model_rows(df, vla.Shape(4, 6, 0, 15, "fingertips"), locator=["key"]).collect()}
    made = vla.model_rows(df, shape, locator=["key"]).select("key", "states", "n_states", "n_actions", "actions_valid", F.col("actions").alias("gt"), F.transform("actions", lambda a: F.transform(a, lambda x: x + 0.25)).alias("pred"))
    for r in vla.report(made, shape, delay=1).collect():
        n, want = r.n_actions, np.array(plain[r.key].actions)
        assert r.n_valid == max(0, n - 1) and (r.mae == pytest.approx(0.25) if n > 1 else r.mae is None)
        assert np.allclose(np.array(r.gt_wrists)[:n], want[:n, :18], atol=1e-9)
        source = {x[0]: x for x in rows}[r.key]
        for k in range(n):
            world = np.array(source[4][k]).reshape(10, 3)
            camera = (np.array(source[5]).reshape(4, 4) @ np.concatenate([world, np.ones((10, 1))], axis=1).T).T[:, :3]
            assert np.allclose(np.array(r.gt_hands[k]).reshape(10, 3), camera, atol=1e-4)

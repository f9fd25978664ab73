"""Observations and visual entries: errors, defaults and short histories; byte images."""

import numpy as np
import pytest

from epiframe.operators import images, serving

SCHEMA = "id int, instruction string, head_images array<string>, chest_images array<string>, head_intrinsic array<double>, chest_intrinsic array<double>, states array<array<double>>, prefix array<array<double>>"
K = [1.0, 2.0, 3.0, 4.0]
FLAT = [float(x) for x in range(9)]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.id: r for r in serving.observations(df, serving.Horizon(2, 3, 2, 2, options.pop("pad", "repeat")), **options).collect()}


def test_rows(spark):
    rows = [
        (1, "go", ["a"], ["c", "d", "e"], FLAT, K, [[1.0, 2.0]], [[5.0, 6.0]]), (2, None, ["a", "b", "c"], ["c"], K, None, [[float(k), 0.0] for k in range(5)], None),
        (3, "", ["a"], None, K, K, [], [[1.0, 1.0]] * 4), (4, "x", ["a"], None, K, None, None, []),
    ]
    got = run(spark, rows, default_instruction="wait", scale=[2.0, 1.0], offset=[0.0, 1.0])
    assert [got[k].instruction for k in (1, 2, 3, 4)] == ["go", "wait", "wait", "x"]
    assert (got[1].head_images, got[1].chest_images, got[1].head_intrinsic, got[1].active_views, got[1].view_mask) == (["a", "a"], ["d", "e"], [0.0, 4.0, 2.0, 5.0], ["head", "chest"], [True, True])
    assert (got[2].head_images, got[2].chest_images, got[2].active_views, got[2].view_mask) == (["b", "c"], None, ["head"], [True, False])
    assert got[1].states == [[2.0, 3.0]] * 3 and got[2].states == [[4.0, 1.0], [6.0, 1.0], [8.0, 1.0]] and got[3].states == got[4].states == [[0.0, 0.0]] * 3
    assert [got[k].n_states for k in (1, 2, 3, 4)] == [3, 3, 0, 0] and [got[k].delay for k in (1, 2, 3, 4)] == [1, None, 2, 0]
    assert got[1].prefix == [[10.0, 7.0], [0.0, 0.0]] and got[2].prefix is None and got[3].prefix == [[2.0, 2.0]] * 2 and got[4].prefix == [[0.0, 0.0]] * 2
    assert got[1].video_fps == 1.0 and got[1].n_actions == 2


def test_short_histories_stay_short(spark):
    got = run(spark, [(1, "go", ["a"], None, K, None, [[1.0, 2.0]], None)], pad="truncate")
    assert (got[1].head_images, got[1].states, got[1].n_states) == (["a"], [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]], 1)


@pytest.mark.parametrize("row, match", [((1, None, ["a"], None, K, None, [], None), "needs an instruction"), ((1, "go", None, ["c"], K, K, [], None), "needs head_images"), ((1, "go", ["a"], None, None, None, [], None), "needs head_intrinsic")])
def test_what_must_be_there(spark, row, match):
    with pytest.raises(Exception, match=match):
        run(spark, [row])
    assert run(spark, []) == {}


ENTRIES = "id int, kind string, views array<string>, n int, n_chest int, fps double"


def entries(spark, rows):
    out = serving.vision_entries(spark.createDataFrame(rows, ENTRIES), "id", "kind", "views", "n", "n_chest", "fps")
    return sorted((r.id, r.place, r.kind, r.view, r.frames, r.fps, r.indices) for r in out.collect())


def test_entries(spark):
    rows = [(1, "image", None, 2, None, None), (2, "video", ["head", "chest"], 3, 1, 2.0), (3, "video", ["chest", "head"], 0, 2, 1.0), (4, "image", None, 0, None, None), (5, "video", ["head"], 1, None, 1.0)]
    assert entries(spark, rows) == [(1, 0, "image", None, 1, None, None), (1, 1, "image", None, 1, None, None), (2, 0, "video", "head", 3, 2.0, [0, 1, 2]), (2, 1, "video", "chest", 1, 2.0, [0]), (3, 0, "video", "chest", 2, 1.0, [0, 1]), (3, 1, "video", "head", 0, 1.0, []), (5, 0, "video", "head", 1, 1.0, [0])]
    for row, match in (((1, "video", ["chest"], 3, None, 1.0), "chest view without frames in 1"), ((1, "video", ["side"], 3, None, 1.0), "unknown view or kind in 1"), ((1, "sound", ["head"], 3, None, 1.0), "unknown view or kind in 1")):
        with pytest.raises(Exception, match=match):
            entries(spark, [row])


def test_byte_images():
    assert images.as_rgb(np.array([0.0, 0.5, 1.0])).tolist() == [0, 127, 255] and images.as_rgb(np.array([-3.0, 7.9, 300.0])).tolist() == [0, 7, 255]
    assert images.as_gray(np.array([[2.0, 4.0], [3.0, 2.5]])).tolist() == [[0, 255], [127, 63]] and images.as_gray(np.full((2, 2), 7.0)).tolist() == [[0, 0], [0, 0]]
    assert images.as_gray(np.zeros((0, 3))).shape == (0, 3) and images.as_rgb(np.zeros((0, 3))).shape == (0, 3)

"""Late materialization against eager reading, and decoding of known and damaged images."""

import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from epiframe.plans.queries import QUERIES
from epiframe.sources import media, members, shards, tars


def jvm_image(spark, path, kind, pixels, name="png"):
    """An image file by the JVM's own encoder: kind 5 is BGR, 6 ABGR, 10 grey."""
    jvm = spark._jvm
    h, w = len(pixels), len(pixels[0])
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    for y in range(h):
        for x in range(w):
            r, g, b = pixels[y][x]
            value = (255 << 24) | (r << 16) | (g << 8) | b
            image.setRGB(x, y, value - (1 << 32))
    assert jvm.javax.imageio.ImageIO.write(image, name, jvm.java.io.File(str(path)))
    return path.read_bytes()


def write(spark, path, rows, schema="key string, meta string, lowdim array<float>, image binary, chest_image binary"):
    return shards.write_frames(spark.createDataFrame(rows, schema).coalesce(1), f"file://{path}")


FRAMES = [(f"f{k}", f'{{"episode_index": {k // 3}}}', [float(k)], b"%d" % k * (k + 1), b"" if k == 2 else b"c%d" % k if k != 4 else None) for k in range(6)]


def test_places_equal_eager_frames(spark, tmp_path):
    paths = write(spark, tmp_path / "s", FRAMES)
    eager = spark.createDataFrame(shards.read_frames(spark, paths).collect(), shards.FRAMES)
    located = members.located_frames(spark, paths)
    light = [c for c in located.columns if c != "members"]
    assert sorted(map(str, located.select(light).collect())) == sorted(map(str, eager.select(light).collect()))
    out = members.with_media(located.withColumn("image_refs", F.array(members.locator())), ["shard", "pos"])
    got = {r.key: (r.image and bytes(r.image[0]), r.chest_image and bytes(r.chest_image[0]), r.depth) for r in out.collect()}
    assert got == {r.key: (bytes(r.image), None if r.chest_image is None else bytes(r.chest_image), None) for r in eager.collect()} and got["f2"][1] == b""


def windows_of(spark, paths, refs):
    """A window for each list of frame numbers."""
    located = {r.pos: r for r in members.located_frames(spark, paths).select(members.locator().alias("r"), "pos").collect()}
    schema = members.located_frames(spark, paths).select(members.locator().alias("r")).schema[0].dataType.simpleString()
    return spark.createDataFrame([(k, [located[n].r for n in ns]) for k, ns in enumerate(refs)], f"id int, image_refs array<{schema}>")


@pytest.mark.parametrize("span, chunk, gap", [(256 << 20, 8 << 20, 4096), (2048, 8 << 20, 0), (256 << 20, 1, 0), (1, 1, 0)])
def test_windows_share_members(spark, tmp_path, monkeypatch, span, chunk, gap):
    paths = write(spark, tmp_path / "s", FRAMES)
    plain = members.fetch
    monkeypatch.setattr(members, "fetch", lambda places: plain(places, span, chunk, gap))
    refs = [[0, 0, 0], [0, 0, 2], [1, 3, 5], [], [5], [0, 0, 2]]
    out = members.with_media(windows_of(spark, paths, refs), ["id"], {"image": ("image_refs", "image.jpg"), "image_2": ("image_refs", "chest_image.jpg")})
    got = {r.id: r for r in out.collect()}
    for k, ns in enumerate(refs):
        assert got[k].image == ([bytearray(FRAMES[n][3]) for n in ns] or None)
        assert got[k].image_2 == ([bytearray(FRAMES[n][4]) for n in ns] or None)


def test_read_bytes_are_those_of_members(spark, tmp_path):
    paths = write(spark, tmp_path / "s", FRAMES)
    places = members.media_places(windows_of(spark, paths, [[0, 1], [1, 1], [1]]), ["id"], {"image": ("image_refs", "image.jpg")})
    assert places.count() == 5
    assert members.fetch(places, gap=0).agg(F.sum("n_read")).first()[0] == len(FRAMES[0][3]) + len(FRAMES[1][3])


def test_runs_are_put_together(tmp_path):
    """Members that are far from each other are read apart and given as one batch, up to a chunk."""
    (tmp_path / "a").write_bytes(bytes(range(100)))
    batch = pa.RecordBatch.from_pydict({"shard": [f"file://{tmp_path}/a"] * 4, "key": list("abcd"), "offset": [0, 20, 40, 42], "size": [3, 3, 2, 2]})
    for chunk, sizes in ((100, [4]), (6, [2, 2]), (1, [1, 1, 1, 1])):
        out = list(members.with_data(iter([batch]), chunk, 0))
        assert [b.num_rows for b in out] == sizes
        rows = [r for b in out for r in b.to_pylist()]
        assert [(r["key"], r["data"]) for r in rows] == [("a", b"\0\1\2"), ("b", bytes([20, 21, 22])), ("c", b"()"), ("d", b"*+")]
        assert [r["n_read"] for r in rows] == [3, 3, *((4, 0) if chunk > 1 else (2, 2))]


def test_columns_that_nobody_wants_are_not_decoded(spark, tmp_path):
    (tmp_path / "s").mkdir()
    writer = tars.Writer(open(tmp_path / "s/a.tar", "wb"))
    for name, data in (("f.meta.json", b"no json"), ("f.lowdim.npy", b"no array"), ("f.image.jpg", b"abc")):
        writer.add(name, data)
    writer.close()
    (row,) = members.located_frames(spark, f"file://{tmp_path}/s/a.tar", columns=["key", "members"]).collect()
    assert row.key == "f" and row.members["image.jpg"].size == 3
    for columns in (None, ["episode_index"], ["lowdim"]):
        with pytest.raises(Exception, match="damaged member of f"):
            members.located_frames(spark, f"file://{tmp_path}/s/a.tar", columns=columns).collect()


def test_member_that_the_last_frame_alone_has_is_an_error(spark, tmp_path):
    paths = write(spark, tmp_path / "s", FRAMES)
    wanted = {"chest_image": ("image_refs", "chest_image.jpg")}
    assert members.with_media(windows_of(spark, paths, [[3, 4]]), ["id"], wanted).first().chest_image is None
    with pytest.raises(Exception, match="chest_image.jpg is missing in f4 of file:"):
        members.with_media(windows_of(spark, paths, [[3, 4, 5]]), ["id"], wanted).collect()


def test_range_beyond_the_shard(spark, tmp_path):
    (path,) = write(spark, tmp_path / "s", FRAMES)
    places = spark.createDataFrame([(path, "f9", 1 << 30, 10)], "shard string, key string, offset long, size long")
    with pytest.raises(Exception, match="ends before the member of f9"):
        members.fetch(places).collect()


def test_no_frames(spark, tmp_path):
    paths = write(spark, tmp_path / "s", FRAMES)
    assert members.located_frames(spark, []).count() == 0
    assert members.with_media(windows_of(spark, paths, [[0]]).limit(0), ["id"]).collect() == []
    images = spark.createDataFrame([], "shard string, key string, data binary")
    assert media.decode_images(images, ["shard", "key"]).collect() == [] and media.decode_depths(images, ["shard", "key"]).collect() == []


GRADIENT = [[(10 * y, 20 * x, 255 - 5 * x * y) for x in range(5)] for y in range(4)]


def test_decoded_pixels(spark, tmp_path):
    """Colour, transparency, grey, and JPEG, which loses little on smooth pictures."""
    flat = bytes(c for row in GRADIENT for p in row for c in p)
    grey = [[(40 * y, 40 * y, 40 * y) for _ in range(3)] for y in range(3)]
    smooth = [[(60 + x, 60 + x, 60 + x) for x in range(16)] for _ in range(16)]
    rows = [("s", "colour", jvm_image(spark, tmp_path / "a", 5, GRADIENT)), ("s", "alpha", jvm_image(spark, tmp_path / "b", 6, GRADIENT)), ("s", "own", media.png(flat, 4, 5)), ("s", "own", media.png(flat, 4, 5)),
            ("s", "grey", jvm_image(spark, tmp_path / "c", 10, grey)), ("s", "jpeg", jvm_image(spark, tmp_path / "d", 5, smooth, "jpg")), ("s", "none", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "shard string, key string, data binary, height int").repartition(3)
    out = [(r.key, r.height, r.width, None if r.pixels is None else bytes(r.pixels)) for r in media.decode_images(df, ["shard", "key"]).collect()]
    by = {k: (h, w, p) for k, h, w, p in out}
    assert len(out) == 7 and by["none"] == (None, None, None)
    assert by["colour"] == by["alpha"] == by["own"] == (4, 5, flat)
    h, w, p = by["grey"]
    a = np.frombuffer(p, np.uint8).reshape(h, w, 3)
    assert (a[..., 0] == a[..., 1]).all() and (a[..., 1] == a[..., 2]).all() and a[0, 0, 0] == 0 and (np.diff(a[:, 0, 0].astype(int)) > 0).all()
    a = np.frombuffer(by["jpeg"][2], np.uint8).reshape(16, 16, 3).astype(int)
    assert by["jpeg"][:2] == (16, 16) and np.abs(a - np.array(smooth)).max() <= 4


def test_pixels_are_not_sent_through_the_driver(spark, monkeypatch):
    """Pixels are joined by shuffle however small their files are; settings stay as they were."""
    plans, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(self._df._jdf.queryExecution().toString()), plain(self, *a, **b))[1])
    own = {k: spark.conf.get(k) for k in media.READING}
    df = spark.createDataFrame([("s", f"f{k}", media.png(bytes(3), 1, 1)) for k in range(300)], "shard string, key string, data binary").coalesce(1)
    out = media.decode_images(df, ["shard", "key"])
    assert out.where("octet_length(pixels) = 3").count() == 300
    joins = [p for p in plans if "Join" in p]
    assert joins and all("SortMergeJoin" in p and "Broadcast" not in p for p in joins)
    assert {k: spark.conf.get(k) for k in media.READING} == own


def workers(node, most):
    """Python steps of the stage that ends in a plan's node; ``most`` gets those of all stages."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return workers(node.initialPlan(), most)
    kids = node.children()
    n = sum(workers(kids.apply(k), most) for k in range(kids.size())) + name.startswith(("MapInArrow", "MapInPandas"))
    most.append(n)
    return 0 if "Exchange" in name else n


@pytest.mark.parametrize("name", ["decoded_media_gate", "decoded_frames", "processed_frames", "qa_images_decoded"])
def test_a_task_has_one_python_worker(spark, sf, monkeypatch, name):
    """Workers of a task live side by side: more steps in a row must not be more workers."""
    most, plain = [], DataFrameWriter.parquet
    plan = lambda df: workers(df._jdf.queryExecution().executedPlan(), most)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plan(self._df), plain(self, *a, **b))[1])
    plan(QUERIES[name](spark, sf))
    assert max(most) == 1


def test_shards_are_listed_without_python(spark, tmp_path):
    paths = write(spark, tmp_path / "s", FRAMES)
    for df in (members.located_frames(spark, paths), shards.read_frames(spark, paths)):
        assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()


def test_decoded_depths_are_given_in_parts(spark, monkeypatch):
    """Many rows to a batch, but no more than the bytes allowed; a larger row is a batch of its own."""
    monkeypatch.setattr(media, "GIVEN", 100)
    sizes = [1, 12, 13, None, 40, 1]
    rows = [("s", f"f{k}", n and saved(np.full(n, k, np.float32))) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "shard string, key string, data binary")
    _, run = media.depths_of(["shard", "key"])(df.schema)
    out = list(run(iter([df.toArrow().combine_chunks().to_batches()[0]])))
    assert [b.num_rows for b in out] == [2, 2, 1, 1]
    got = [r for b in out for r in b.to_pylist()]
    assert [(r["key"], r["shape"], r["depth"]) for r in got] == [(f"f{k}", n and [n], n and np.full(n, k, "<f4").tobytes()) for k, n in enumerate(sizes)]


@pytest.mark.parametrize("data", [b"no image", b"", b"\x89PNG\r\n\x1a\n"])
def test_damaged_image_names_shard_and_key(spark, data):
    df = spark.createDataFrame([("s1", "f7", data)], "shard string, key string, data binary")
    with pytest.raises(Exception, match="damaged image: f7 of s1"):
        media.decode_images(df, ["shard", "key"]).collect()


def saved(a):
    held = io.BytesIO()
    np.save(held, a)
    return held.getvalue()


def test_depths(spark):
    rows = [("s", "mm", saved(np.array([[1500, 0], [65535, 1]], np.uint16))), ("s", "m", saved(np.array([[0.25]], np.float64))), ("s", "none", None)]
    got = {r.key: (r.shape, r.depth and np.frombuffer(r.depth, "<f4").tolist()) for r in media.decode_depths(spark.createDataFrame(rows, "shard string, key string, data binary"), ["shard", "key"]).collect()}
    assert got == {"mm": ([2, 2], [1.5, 0.0, np.float32(65.535), np.float32(0.001)]), "m": ([1, 1], [0.25]), "none": (None, None)}
    for data in (b"junk", b"", saved(np.zeros(3))[:-4]):
        with pytest.raises(Exception, match="damaged depth: f1 of s2"):
            media.decode_depths(spark.createDataFrame([("s2", "f1", data)], "shard string, key string, data binary"), ["shard", "key"]).collect()


def test_question_without_images(spark, tmp_path):
    paths = shards.write_frames(spark.createDataFrame([("q1", "{}", {"notes.txt": b"x"})], "key string, meta string, members map<string, binary>"), f"file://{tmp_path}/q")
    with pytest.raises(Exception, match=r"no image_\*.jpg in q1 of file:"):
        media.qa_images(members.located_frames(spark, paths)).collect()

"""Packed shards: the plain tar file behind them, ranges from any place, and little disk for queries over them."""

import glob
import io
import os
import tarfile

import numpy as np
import pytest
import zstandard

from epiframe.plans.queries import QUERIES
from epiframe.sources import files, members, packed, shards, tars
from epiframe.streaming import online, resampled

ROWS = [(f"f{k:03}", f'{{"episode_index": {k // 30}}}', [float(k)] if k != 7 else None, b"%d" % k * (k * 40)) for k in range(90)]


@pytest.fixture
def both(spark, tmp_path, monkeypatch):
    """A shard, and the same one packed in blocks of 5,000 bytes."""
    monkeypatch.setattr(packed, "BLOCK", 5000)
    rows = spark.createDataFrame(ROWS, "key string, meta string, lowdim array<float>, image binary")
    (plain,) = shards.write_frames(rows.coalesce(1), f"file://{tmp_path}/a")
    out = files.open_out(f"file://{tmp_path}/b.tar.zst")
    with open(plain.removeprefix("file://"), "rb") as f:
        while data := f.read(7001):
            out.write(data)
    out.close()
    return plain, f"file://{tmp_path}/b.tar.zst"


def test_unpacks_to_the_plain_file(both):
    plain, small = (open(p.removeprefix("file://"), "rb").read() for p in both)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(small), read_across_frames=True).read() == plain
    with tarfile.open(fileobj=io.BytesIO(plain)) as tar:
        assert [m.name for m in tar][:3] == ["f000.meta.json", "f000.lowdim.npy", "f000.image.jpg"]
    assert len(small) < len(plain) / 10


def test_any_range(both):
    plain = open(both[0].removeprefix("file://"), "rb").read()
    with files.open_at(both[1]) as f:
        assert f.size() == len(plain) and len(f.plain) > 20
        rng = np.random.default_rng(1)
        for at, n in [(0, 0), (0, len(plain) + 5), (len(plain), 3), (len(plain) + 9, 3), (5000, 5000), (4999, 2), *rng.integers(0, len(plain), (200, 2)).tolist()]:
            f.seek(at)
            assert f.read(n) == plain[at : at + n] and f.tell() == min(max(at, 0) + len(plain[at : at + n]), max(at, len(plain)))


def test_same_frames(spark, both):
    a, b = (sorted(map(str, shards.read_frames(spark, p).drop("shard").collect())) for p in both)
    assert a == b and len(a) == len(ROWS)
    a, b = (sorted(map(str, members.located_frames(spark, p).drop("shard").collect())) for p in both)
    assert a == b
    a, b = (resampled.measured(p) for p in both)
    assert a[1:] == b[1:] and a.rows == len(ROWS)
    assert shards.read_frames(spark, both[1], columns=["key", "lowdim"]).columns == ["key", "lowdim"]


def test_odd_names_in_a_packed_shard(tmp_path):
    """Headers that are left to tarfile are found there as well."""
    parts, held = [("a" * 120, b"1"), ("b", b"22"), ("é", b"333")], io.BytesIO()
    tar = tars.Writer(files.open_out(f"file://{tmp_path}/t.tar.zst"))
    with tarfile.open(fileobj=held, mode="w") as want:
        for key, data in parts:
            tar.add_frame(key, {"image.jpg": data, "x" * 95: data, "ü": data})
            for suffix in ("image.jpg", "x" * 95, "ü"):
                info = tarfile.TarInfo(f"{key}.{suffix}")
                info.size = len(data)
                want.addfile(info, io.BytesIO(data))
    tar.close()
    with files.open_at(f"file://{tmp_path}/t.tar.zst") as f:
        assert f.read() == held.getvalue()
        bytes_ = tars.Bytes(f)
        assert [(n, bytes_.member(o, s)) for n, o, s in tars.members(bytes_)] == [(f"{k}.{s}", d) for k, d in parts for s in ("image.jpg", "x" * 95, "ü")]


def test_damaged(tmp_path):
    out = files.open_out(f"file://{tmp_path}/t.zst")
    out.write(bytes(range(256)) * 100)
    out.close()
    data = (tmp_path / "t.zst").read_bytes()
    for bad in (b"", data[:-5], b"x" * 50):
        (tmp_path / "u.zst").write_bytes(bad)
        with pytest.raises(ValueError, match="no table of blocks at the end of file:.*u.zst"):
            files.open_at(f"file://{tmp_path}/u.zst")
    (tmp_path / "u.zst").write_bytes(b"junk" + data[4:])
    with pytest.raises(ValueError, match="damaged block 0 of file:.*u.zst"):
        files.open_at(f"file://{tmp_path}/u.zst").read(1)


def bytes_of_shards(spark, sf, monkeypatch, name):
    """Bytes of shards a frame of events that a query leaves in the shared folder."""
    made, plain = [], shards.write_frames
    monkeypatch.setattr(shards, "write_frames", lambda frames, path, *a, **b: (made.append(path), plain(frames, path, *a, **b))[1])
    QUERIES[name](spark, sf)
    found = [p for path in made for p in glob.glob(f"{path.removeprefix('file://')}/*.tar*")]
    assert found
    return sum(map(os.path.getsize, found)) / spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.mark.parametrize("name", ["frame_shard_roundtrip", "late_media_bytes", "resampled_epochs", "windows_of_resampled_shards"])
def test_little_disk(spark, sf, monkeypatch, name):
    """Plain tar files take 4,600 and 3,300 bytes a frame."""
    assert bytes_of_shards(spark, sf, monkeypatch, name) < 300


def test_lanes_over_packed_shards(spark, both):
    """Only the columns that are asked for, from any frame on, in parts that grow with the number of lanes."""
    streams = resampled.resampled_lanes(spark, both, 2, seed=1, epochs=2, rows=25, columns=["epoch", "key", "meta", "lowdim"])
    assert [s.columns for s in streams] == [["epoch", "key", "meta", "lowdim"]] * 2
    got = [(r.epoch, r.key, r.meta, r.lowdim) for r in online.run_to_end(*streams).collect()]
    want = [(e, key, meta, vector or []) for e in range(2) for key, meta, vector, _ in ROWS for _ in both]
    assert sorted(got) == sorted(want)
    x = resampled.Slice(both[1], 50, 80, 0, 0)
    assert [r["key"] for r in resampled.frames_between(x.path, x.first, x.last, ["meta.json"])] == [r[0] for r in ROWS[50:80]]


def test_parts_of_lanes(spark, both, monkeypatch):
    made = []
    monkeypatch.setattr(resampled, "_stream", lambda spark, options: made.append(options))
    resampled.resampled_lanes(spark, both, 2)
    assert [x["part"] for x in made] == [2 * resampled.PART] * 2


def test_albums_are_packed(spark, sf, monkeypatch):
    """Plain tar files take 1,000 bytes an image."""
    made, plain = [], shards.write_frames
    monkeypatch.setattr(shards, "write_frames", lambda frames, path, *a, **b: (made.append(path), plain(frames, path, *a, **b))[1])
    images = QUERIES["qa_images_decoded"](spark, sf).count()
    assert sum(map(os.path.getsize, glob.glob(f"{made[0].removeprefix('file://')}/*.tar.zst"))) in range(1, 200 * images)

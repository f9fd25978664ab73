"""PNG files that workers unpack, against Spark's image source; all others are left to that."""

import glob
import struct
import zlib

import numpy as np
import pytest

from epiframe.plans.queries import QUERIES
from epiframe.sources import media


def part(name, data, crc=0):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data) ^ crc)


def filtered(a, kinds):
    """Rows of (height, width, channels) as PNG stores them, by the filter of each row."""
    out, a = [], a.astype(int)
    for k, kind in enumerate(kinds):
        left, above = np.pad(a[k], ((1, 0), (0, 0)))[:-1], a[k - 1] if k else np.zeros_like(a[k])
        less = {0: 0, 1: left, 2: above, 3: (left + above) // 2}[kind]
        out.append(bytes([kind]) + ((a[k] - less) % 256).astype(np.uint8).tobytes())
    return b"".join(out)


def png(a, kinds, colours, depth=8, interlaced=0, more=b"", crc=0, cut=0, extra=b""):
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, colours, 0, 0, interlaced)
    data = zlib.compress(filtered(a, kinds) + extra)
    half = len(data) // 2
    whole = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + more + part(b"IDAT", data[:half]) + part(b"IDAT", data[half:], crc) + part(b"IEND", b"")
    return whole[: len(whole) - cut]


RNG = np.random.default_rng(5)
A = {n: RNG.integers(0, 256, (5, 7, n), dtype=np.uint8) for n in (1, 3, 4)}
PLAIN = {f"{c}-{'-'.join(map(str, kinds))}": (png(A[n], kinds, c), A[n]) for c, n in ((0, 1), (2, 3), (6, 4)) for kinds in ((0, 0, 0, 0, 0), (2, 1, 0, 2, 2), (1, 1, 2, 2, 1))}


def test_plain_files_as_spark_decodes_them(spark, tmp_path):
    for name, (data, _) in PLAIN.items():
        (tmp_path / name).write_bytes(data)
    seen = {r.origin.rpartition("/")[2]: (r.height, r.width, media.rgb(bytes(r.data), r.height, r.width, r.nChannels)) for r in spark.read.format("image").load(f"file://{tmp_path}").select("image.*").collect()}
    assert len(seen) == len(PLAIN) == 9
    for name, (data, a) in PLAIN.items():
        want = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]
        assert media.plain_png(data) == seen[name] == (5, 7, want.tobytes())


def test_all_else_is_left_to_spark():
    a, flat, plain = A[3], (0,) * 5, PLAIN["2-0-0-0-0-0"][0]
    odd = [
        b"", b"no image", b"\x89PNG\r\n\x1a\n", plain[:30], plain[:-1], b"\xff\xd8\xff" + plain[3:], png(a, flat, 2, crc=1), png(a, flat, 2, cut=12), png(a, flat, 2, extra=b"x"), png(a[:4], flat[:4], 2, extra=b"")[:-20],
        png(a, (0, 3, 0, 0, 0), 2), png(a, flat, 2, interlaced=1), png(a, flat, 2, depth=16), png(A[1], flat, 3), png(a, flat, 4), png(a, flat, 2, more=part(b"gAMA", struct.pack(">I", 45455))),
        png(a, flat, 2, more=part(b"tRNS", bytes(6))), png(a, flat, 6), png(np.zeros((5, 0, 3), np.uint8), flat, 2), plain.replace(b"IDAT", b"IDAX"),
        b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"")) + part(b"IEND", b""),
    ]
    assert [media.plain_png(x) for x in odd] == [None] * len(odd)


def files_left(monkeypatch):
    """Files that were written for Spark's image source, each time before they are removed."""
    seen, plain = [], media.remove
    monkeypatch.setattr(media, "remove", lambda uri: (seen.append(len(glob.glob(f"{uri.removeprefix('file://')}/*/*"))), plain(uri)))
    return seen


def test_both_ways_at_once(spark, monkeypatch):
    """No file for a plain image, one for another; null stays null; other columns stay."""
    seen, odd = files_left(monkeypatch), png(A[3], (0, 3, 0, 3, 3), 2)
    rows = [("s", k, data, a[:, :, :3].tobytes() if a.shape[2] > 1 else np.repeat(a, 3, axis=2).tobytes()) for k, (data, a) in PLAIN.items()] + [("s", "odd", odd, A[3].tobytes()), ("s", "odd", odd, A[3].tobytes()), ("s", "none", None, None)]
    out = media.decode_images(spark.createDataFrame(rows, "shard string, key string, data binary, want binary"), ["shard", "key"]).collect()
    assert sorted(r.key for r in out) == sorted(r[1] for r in rows) and all(r.pixels == r.want for r in out) and seen == [2]
    assert {(r.height, r.width) for r in out if r.key != "none"} == {(5, 7)}


@pytest.mark.parametrize("name", ["qa_images_decoded"])
def test_query_writes_no_small_files(spark, sf, monkeypatch, name):
    seen = files_left(monkeypatch)
    assert QUERIES[name](spark, sf).count() > 100 and seen == [0]

"""Plain headers read and written without tarfile: the same files and members, and nothing less of odd ones."""

import io
import tarfile
import time

import numpy as np
import pytest
from pyarrow import fs

from epiframe.sources import tars


def listed(data, path):
    path.write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        held = tars.Bytes(f)
        return [(n, s, held.member(o, s)) for n, o, s in tars.members(held)]


def made(names, **more):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w", **more) as tar:
        for k, name in enumerate(names):
            info = tarfile.TarInfo(name)
            info.size = k * 700
            if name.endswith("/"):
                info.type, info.size = tarfile.DIRTYPE, 0
            tar.addfile(info, io.BytesIO(bytes([k % 256]) * info.size))
    return held.getvalue()


NAMES = ["a.meta.json", "folder/", "folder/b.image.jpg", "x" * 100, "y" * 130 + ".jpg", "é.jpg", "after.jpg"]


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT])
def test_members(tmp_path, form):
    names = [n for n in NAMES if form != tarfile.USTAR_FORMAT or len(n) <= 100]
    data = made(names, format=form)
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        want = [(m.name, m.size, tar.extractfile(m).read()) for m in tar if m.isfile()]
    assert listed(data, tmp_path / "t.tar") == want and len(want) == len(names) - 1


def test_written_as_tarfile_does(tmp_path):
    for names in (["a.json", "b.jpg", "c.npy"], NAMES[2:], [f"frame_{k:08d}.image.jpg" for k in range(50)]):
        out = fs.LocalFileSystem().open_output_stream(str(tmp_path / "w.tar"))
        tar = tars.Writer(out)
        for k, name in enumerate(names):
            tar.add(name, bytes([k % 256]) * (k * 700))
        tar.close()
        assert (tmp_path / "w.tar").read_bytes() == made(names)


def test_damaged(tmp_path):
    data = made(["a.jpg", "b.jpg", "c.jpg"])
    with pytest.raises(tarfile.ReadError):
        listed(data[:2500], tmp_path / "t.tar")
    with pytest.raises(tarfile.ReadError):
        listed(b"x" * 2000, tmp_path / "t.tar")
    with pytest.raises(tarfile.ReadError):
        listed(b"", tmp_path / "t.tar")
    assert listed(bytes(10240), tmp_path / "t.tar") == []


def test_vectors():
    for a in (np.arange(116, dtype=np.float32), np.zeros(0, np.float32), np.arange(6.0).reshape(2, 3), np.arange(6.0).reshape(2, 3).T, np.arange(4, dtype=">i2")):
        held = io.BytesIO()
        np.save(held, a)
        got = tars.array_of(held.getvalue())
        assert got.dtype == a.dtype and got.shape == a.shape and (got == a).all()
        if a.dtype == np.float32:
            assert tars.npy(a) == held.getvalue()
        for bad in (held.getvalue()[:-1] if a.size else b"", b"", b"junk"):
            with pytest.raises((ValueError, EOFError)):
                tars.array_of(bad)


def test_many_members(tmp_path):
    """A fifth of what tarfile takes, at most a half."""
    names = [f"frame_{k:08d}.image.jpg" for k in range(20_000)]
    begin = time.process_time()
    tar = tars.Writer(fs.LocalFileSystem().open_output_stream(str(tmp_path / "m.tar")))
    for name in names:
        tar.add(name, b"12345678")
    tar.close()
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "m.tar")) as f:
        assert [n for n, _, _ in tars.members(tars.Bytes(f))] == names
    own, begin = time.process_time() - begin, time.process_time()
    with tarfile.open(tmp_path / "n.tar", "w") as tar:
        for name in names:
            info = tarfile.TarInfo(name)
            info.size = 8
            tar.addfile(info, io.BytesIO(b"12345678"))
    with tarfile.open(tmp_path / "n.tar") as tar:
        assert [m.name for m in tar] == names
    assert own < (time.process_time() - begin) / 2

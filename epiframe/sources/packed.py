"""Files packed with Zstandard in blocks, which can be read from any place.

Each block is a Zstandard frame of its own, and a table of their sizes stands at the end, in a frame that unpackers skip
(the Zstandard seekable format): ``zstd -d`` gives the plain file. Headers and padding of tar files pack to little,
so a shard of small members takes a fraction of its size; images that are packed already stay as large as they are.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa

#: The end of a packed file's name; bytes of the plain file to a block, at most.
SUFFIX, BLOCK = ".zst", 256 << 10
_SKIPPED, _TABLE = 0x184D2A5E, 0x8F92EAB1
_FOOT = struct.Struct("<IBI")


@functools.cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


class PackedOut:
    """An output stream that packs what it is given."""

    def __init__(self, out):
        self.out, self.sizes, self.held = out, [], b""

    def write(self, data: bytes) -> None:
        data = self.held + data if self.held else data
        whole = len(data) - len(data) % BLOCK
        for at in range(0, whole, BLOCK):
            self._put(data[at : at + BLOCK])
        self.held = data[whole:]

    def _put(self, block: bytes) -> None:
        packed = _codec().compress(block, asbytes=True)
        self.out.write(packed)
        self.sizes += (len(packed), len(block))

    def close(self) -> None:
        if self.held:
            self._put(self.held)
        n = len(self.sizes) // 2
        self.out.write(struct.pack("<II", _SKIPPED, 8 * n + _FOOT.size) + np.array(self.sizes, "<u4").tobytes() + _FOOT.pack(n, 0, _TABLE))
        self.out.close()


class PackedIn:
    """The plain file of a packed one; the block that was read last is kept."""

    def __init__(self, file, name: str):
        self.file, self.name, self.at, self.block, self.kept = file, name, 0, -1, b""
        size = file.size()
        foot = self._packed(size - _FOOT.size, _FOOT.size) if size >= _FOOT.size else b""
        n, _, mark = _FOOT.unpack(foot) if foot else (0, 0, 0)
        if mark != _TABLE or size < 8 * n + 8 + _FOOT.size:
            raise ValueError(f"no table of blocks at the end of {name}")
        sizes = np.frombuffer(self._packed(size - _FOOT.size - 8 * n, 8 * n), "<u4").astype(np.int64).reshape(n, 2)
        self.packed, self.plain = (np.concatenate([[0], np.cumsum(sizes[:, k])]) for k in (0, 1))

    def _packed(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def _unpacked(self, k: int) -> bytes:
        if k != self.block:
            start, stop = self.packed[k : k + 2].tolist()
            size = int(self.plain[k + 1] - self.plain[k])
            try:
                self.kept = _codec().decompress(self._packed(start, stop - start), size, asbytes=True)
            except OSError as e:
                raise ValueError(f"damaged block {k} of {self.name}") from e
            if len(self.kept) != size:
                raise ValueError(f"damaged block {k} of {self.name}")
            self.block = k
        return self.kept

    def size(self) -> int:
        return int(self.plain[-1])

    def tell(self) -> int:
        return self.at

    def seek(self, at: int) -> int:
        self.at = at
        return at

    def read(self, size: int = -1) -> bytes:
        """What there is from the current place on."""
        stop = self.size() if size < 0 else min(self.at + size, self.size())
        if self.at >= stop:
            return b""
        parts, k = [], int(np.searchsorted(self.plain, self.at, "right")) - 1
        while self.at < stop:
            base, end = self.plain[k : k + 2].tolist()
            parts.append(self._unpacked(k)[self.at - base : stop - base])
            self.at, k = min(end, stop), k + 1
        return b"".join(parts)

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> PackedIn:
        return self

    def __exit__(self, *_) -> None:
        self.close()

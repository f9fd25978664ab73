"""Members of tar files at few steps each: plain headers are read and written here, with their checksums, and all else
(long or non-ASCII names, links, folders, extended headers) is left to ``tarfile`` from there on."""

from __future__ import annotations

import functools
import io
import tarfile
from collections.abc import Iterator, Mapping

import numpy as np

BLOCK = tarfile.BLOCKSIZE
#: Bytes that are read at once: smaller members that nobody wants are read along, larger ones are skipped.
AHEAD = 64 << 10
#: Bytes that a writer gathers before it writes.
GATHERED = 1 << 20
_PLAIN = tarfile.TarInfo("").tobuf(tarfile.PAX_FORMAT)
_MODE, _TIME, _TAIL = _PLAIN[100:124], _PLAIN[136:148], _PLAIN[156:]
_SUM_TAIL = sum(_TAIL)
_SUM = 256 + sum(_MODE) + sum(_TIME) + _SUM_TAIL
_PADS = [bytes(-n % BLOCK) for n in range(BLOCK)]


def header(name: str, size: int) -> bytes:
    """The header of a regular file."""
    if len(name) > 100 or not name.isascii() or not 0 <= size < 8**11:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf(tarfile.PAX_FORMAT, tarfile.ENCODING, "surrogateescape")
    stem, length = name.encode(), b"%011o\0" % size
    return b"".join((stem.ljust(100, b"\0"), _MODE, length, _TIME, b"%06o\0 " % (_SUM + sum(stem) + sum(length)), _TAIL))


@functools.lru_cache(4096)
def _middle(stem: int, suffix: str, size: int) -> tuple[bytes, int] | None:
    """What stands between a stem of so many characters and the checksum of a plain header, and the checksum without the
    stem; none where the header is not plain."""
    if stem + 1 + len(suffix) > 100 or not suffix.isascii() or size >= 8**11:
        return None
    name, length = f".{suffix}".encode(), b"%011o\0" % size
    return b"".join((name.ljust(100 - stem, b"\0"), _MODE, length, _TIME)), _SUM + sum(name) + sum(length)


class Writer:
    """Appends regular files to an output stream."""

    def __init__(self, out):
        self.out, self.parts, self.held, self.n = out, [], 0, 0

    def add(self, name: str, data: bytes) -> None:
        self._put(header(name, len(data)))
        self._put(data)
        self._put(bytes(-len(data) % BLOCK))

    def add_frame(self, key: str, parts: Mapping[str, bytes]) -> None:
        """Members ``<key>.<suffix>`` side by side."""
        stem = key.encode("utf-8", "surrogateescape")
        total, plain, n = sum(stem), key.isascii(), 0
        for suffix, data in parts.items():
            size = len(data)
            if plain and (known := _middle(len(stem), suffix, size)):
                pad = _PADS[size % BLOCK]
                self.parts += (stem, known[0], b"%06o\0 " % (known[1] + total), _TAIL, data, pad)
                n += BLOCK + size + len(pad)
            else:
                self.add(f"{key}.{suffix}", data)
        self.held, self.n = self.held + n, self.n + n
        self._put(b"")

    def _put(self, data: bytes) -> None:
        self.parts.append(data)
        self.held += len(data)
        self.n += len(data)
        if self.held >= GATHERED:
            self.out.write(b"".join(self.parts))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self._put(bytes(2 * BLOCK))
        self._put(bytes(-self.n % tarfile.RECORDSIZE))
        self.out.write(b"".join(self.parts))
        self.out.close()


class Bytes:
    """Ranges of a file that can be read from any place, mostly in its order."""

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def read(self, start: int, size: int) -> bytes:
        """What there is of a range."""
        if not self.at <= start <= start + size <= self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(size, AHEAD))
        return self.held[start - self.at : start - self.at + size]

    def member(self, start: int, size: int) -> bytes:
        if len(data := self.read(start, size)) < size:
            raise tarfile.ReadError("unexpected end of data")
        return data


@functools.lru_cache(4096)
def _known(part: bytes) -> tuple[str, int, int] | None:
    """The rest of a name, the size and the sum of a header from some place in its name to its time; none where they are
    not plain. Most members of a shard share these."""
    name, size = part[:-48].partition(b"\0")[0], part[-24:-13]
    if len(part) < 48 or size.translate(None, b"01234567") or part[-13:-12] not in (b"\0", b" "):
        return None
    return name.decode("utf-8", "surrogateescape"), int(size, 8), sum(part)


def members(held: Bytes, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """Name, offset and size of the regular files of a tar file, in its order, from the header at ``at`` on."""
    stem, text, total = b"", "", 256
    while True:
        first = at - held.at
        head = held.held[first : first + BLOCK] if 0 <= first <= len(held.held) - BLOCK else held.read(at, BLOCK)
        ours = len(head) == BLOCK and head.endswith(_TAIL)
        if not (ours or head[156:157] == b"0" and head[257:262] == b"ustar" and head[345:346] == b"\0"):
            break
        dot = max(head.find(b".", 0, 100), 0)
        if b"\0" in (this := head[:dot]):
            dot, this = 0, b""
        if not (known := _known(head[dot:148])):
            break
        if this != stem:
            stem, text, total = this, this.decode("utf-8", "surrogateescape"), 256 + sum(this)
        if head[148:154] != b"%06o" % (total + known[2] + (_SUM_TAIL if ours else sum(head[156:]))):
            break
        size = known[1]
        yield text + known[0], at + BLOCK, size
        at += BLOCK + -(-size // BLOCK) * BLOCK
        if at > held.size:
            raise tarfile.ReadError("unexpected end of data")
    if at and not any(head):
        return
    held.file.seek(at)
    try:
        rest = tarfile.open(fileobj=held.file, mode="r:")
    except tarfile.ReadError:
        if at:  # a file without an end mark, or with something else behind its last member
            return
        raise
    with rest:
        while (member := rest.next()) is not None:
            rest.members = []  # else the archive keeps a record of each member
            if member.isfile():
                yield member.name, member.offset_data, member.size


@functools.lru_cache(1024)
def _npy_head(n: int) -> bytes:
    held = io.BytesIO()
    np.save(held, np.zeros(n, np.float32))
    return held.getvalue()[: held.tell() - 4 * n]


def npy(vector: np.ndarray) -> bytes:
    """A float32 vector as ``np.save`` writes it."""
    return _npy_head(len(vector)) + vector.tobytes()


@functools.lru_cache(1024)
def _npy_vector(head: bytes) -> tuple[np.dtype, int] | None:
    """Type and length of a vector from its header; none for arrays of other shapes and for headers that can't be read."""
    held = io.BytesIO(head)
    try:
        np.lib.format.read_magic(held)
        shape, _, dtype = np.lib.format.read_array_header_1_0(held)
    except ValueError:
        return None
    return (dtype, shape[0]) if len(shape) == 1 and not dtype.hasobject else None


def array_of(data: bytes) -> np.ndarray:
    """An array as ``np.load`` reads it."""
    start = 10 + int.from_bytes(data[8:10], "little")
    if data[:8] == b"\x93NUMPY\x01\x00" and start <= len(data) and (known := _npy_vector(data[:start])) and len(data) - start == known[0].itemsize * known[1]:
        return np.frombuffer(data, *known, start)
    return np.load(io.BytesIO(data), allow_pickle=False)

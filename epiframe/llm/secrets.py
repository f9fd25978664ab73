"""Secret scanning with a recursive decoding worklist (operator 7).

Each text is scanned for the base kinds. Encoded parts of it (percent escapes, backslash-u escapes, base64, also over
several lines, and zlib, gzip, bz2 or xz data inside that) are decoded into layers, which are scanned and decoded in turn until nothing new
comes up; a layer that was seen before at the same place is not followed again, which ends cycles. Every
character of a layer knows the span of the original text it came from, and whether it was decoded, so that a find deep
inside is reported where its encoded form stands. Finds in layers have the kinds' names with ``decoded_`` before them,
unless they lie on a base find of the same kind.

Escapes are decoded once, and, since they may be escapes of escapes, to the end in one pass over the text, whatever the
depth: between the first and the last level nothing is scanned. Base64 may stand behind anything, as ``/``, ``-``,
letters and digits before a token belong to the run: a run is decoded from its start, at the three other alignments,
and from each place where compressed data may begin.

Defined cases: a null or empty text has no spans; an empty table gives no rows; a text of any length is scanned whole;
decompressed data of more than
``LAYER_BYTES`` is scanned in pieces that end after a newline which no base64 of several lines goes over, so that only a
longer line or block of base64 takes more memory; compressed data is read member by member, broken data as far as it
goes, and what follows the last member is a layer of its own; data compressed again and again is followed to any depth,
and beyond ``STREAMED`` levels that are larger than ``LAYER_BYTES`` each it is scanned as it stands; repeated rows are
scanned alike; extra columns stay, and columns with the names of results are replaced.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate([*KINDS, *(f"decoded_{k}" for k in KINDS)])}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Longer decompressed data is scanned in pieces of about this size; it comes out in steps of the other.
LAYER_BYTES, STEP_BYTES = 1 << 24, 1 << 20
STREAMED = 100

TOKEN = re.compile(r"\S+")
ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}")
# all that an escape, or an escape of an escape, can be made of
NESTED = re.compile(r"[0-9A-Fa-fu%\\]{3,}")
ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}")
HEX_DIGITS = {ord(c): int(c, 16) for c in "0123456789abcdefABCDEF"}
# the shortest find has 12 bytes
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# base64 over several lines, as mail and key files have it
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t]*+)+[A-Za-z0-9+/_-]++={0,2}")

# how compressed data begins in base64
MAGIC = re.compile(r"(?=H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|Qlpo|/Td6WFoA)")
# the end of a line that base64 may go on after
OPEN = re.compile(rb"[A-Za-z0-9+/_-]{16}$")

#: Per character of a layer: start and end of its original span, and whether it was decoded. None for the original text.
Origin = tuple[np.ndarray, np.ndarray, np.ndarray] | None


class Layer(NamedTuple):
    text: str
    origin: Origin
    #: Whether its escapes are still to be decoded.
    escapes: bool = True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Finds of the base kinds, each kind leftmost and without overlap."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _origin(origin: Origin, start: int, end: int) -> tuple[int, int]:
    """Original span of characters start to end of a layer; places in a layer never go backwards."""
    if origin is None:
        return start, end
    return int(origin[0][start]), int(origin[1][end - 1])


def _coded(origin: Origin, start: int, end: int) -> bool:
    """Whether a decoded character is among start to end of a layer, or beside them."""
    return origin is None or bool(origin[2][max(0, start - 1) : end + 1].any())


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    """Characters of a run of percent escapes, and the place of each in the layer."""
    out, used = [], m.start()
    for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
        broken = 0xDC80 <= ord(c) < 0xDD00  # a byte of no character
        end = used + 3 * (1 if broken else len(c.encode()))
        out.append(("\ufffd" if broken else c, used, end))
        used = end
    return out


def _unicode(m: re.Match) -> list[tuple[str, int, int]]:
    c = chr(int(m[0][2:], 16))
    return [(c if not 0xD800 <= ord(c) < 0xE000 else "�", m.start(), m.end())]


def _reduced(m: re.Match) -> list[tuple[str, int, int]]:
    """What a run of escapes, and of escapes of escapes, comes to. An escape is replaced as soon as its last character
    is there, by one that may end another escape or begin one; so each replacement takes characters away for good."""
    out: list[tuple[int, int, int]] = []  # code point, or a byte of UTF-8 as a negative number, and its place
    for k, c in enumerate(m[0], m.start()):
        out.append((ord(c), k, k + 1))
        while out[-1][0] in HEX_DIGITS:
            size = 3 if len(out) >= 3 and out[-3][0] == 37 else 6 if len(out) >= 6 and out[-6][0] == 92 and out[-5][0] == 117 else 0
            digits = out[-2:] if size == 3 else out[-4:]
            if not size or any(d not in HEX_DIGITS for d, _, _ in digits):
                break
            value = 0
            for d, _, _ in digits:
                value = value * 16 + HEX_DIGITS[d]
            value = -value if size == 3 and value >= 128 else 0xFFFD if 0xD800 <= value < 0xE000 else value
            out[-size:] = [(value, out[-size][1], out[-1][2])]
    chars, k = [], 0
    while k < len(out):
        code, a, b = out[k]
        if code >= 0:
            chars.append((chr(code), a, b))
            k += 1
            continue
        end = next((j for j in range(k, len(out)) if out[j][0] >= 0), len(out))
        for c in bytes(-x for x, _, _ in out[k:end]).decode("utf-8", "surrogateescape"):
            broken = 0xDC80 <= ord(c) < 0xDD00  # a byte of no character
            size = 1 if broken else len(c.encode())
            chars.append(("\ufffd" if broken else c, out[k][1], out[k + size - 1][2]))
            k += size
    return chars


def _nested(m: re.Match) -> list[tuple[str, int, int]] | None:
    return _reduced(m) if ESCAPE.search(m[0]) else None


def _unescaped(layer: Layer, at: int, end: int, pattern: re.Pattern, decode: Callable[[re.Match], list[tuple[str, int, int]] | None]) -> Layer:
    """Characters at to end of a layer, with what the pattern finds decoded and the plain text beside it kept."""
    text, origin, _ = layer
    parts, first, last, coded, k = [], [], [], [], at

    def plain(to: int) -> None:
        parts.append(text[k:to])
        first.append(np.arange(k, to) if origin is None else origin[0][k:to])
        last.append(np.arange(k + 1, to + 1) if origin is None else origin[1][k:to])
        coded.append(np.zeros(to - k, bool) if origin is None else origin[2][k:to])

    for m in pattern.finditer(text, at, end):
        if (chars := decode(m)) is None:
            continue
        plain(m.start())
        spans = [_origin(origin, a, max(b, a + 1)) for _, a, b in chars]
        parts.append("".join(c for c, _, _ in chars))
        first.append(np.array([a for a, _ in spans], np.int64))
        last.append(np.array([b for _, b in spans], np.int64))
        # a character of the run that is itself still has been decoded further out, or not at all
        coded.append(np.array([b - a > 1 or (origin is not None and bool(origin[2][a])) for _, a, b in chars], bool))
        k = m.end()
    plain(end)
    return Layer("".join(parts), (np.concatenate(first), np.concatenate(last), np.concatenate(coded)), False)


def _packed(head: bytes) -> str | None:
    """Kind of compression that data begins with."""
    if head[:2] in (b"\x1f\x8b", b"x\x01", b"x^", b"x\x9c", b"x\xda"):
        return "zlib"
    return "bz2" if head[:3] == b"BZh" else "xz" if head[:6] == b"\xfd7zXZ\x00" else None


def _inflated(chunks: Iterator[bytes], rest: list[bytes]) -> Iterator[bytes]:
    """Chunks of compressed data decompressed, member after member, as far as it isn't broken; data after the last
    member goes to rest."""
    d, kind, data = None, None, b""
    try:
        for chunk in chunks:
            data += chunk
            while data:
                if d is None:
                    data = data.lstrip(b"\0")  # padding between members
                    if len(data) < 6 and (more := next(chunks, b"")):
                        data += more
                        continue
                    if (kind := _packed(data)) is None:
                        rest.append(data)
                        return
                    d = zlib.decompressobj(47) if kind == "zlib" else bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor()
                yield d.decompress(data, STEP_BYTES)
                if kind == "zlib":
                    data = d.unused_data if d.eof else d.unconsumed_tail
                    # output can be held back although all input was taken
                    while not d.eof and not data and (more := d.decompress(b"", STEP_BYTES)):
                        yield more
                        data = d.unused_data if d.eof else d.unconsumed_tail
                else:
                    while not d.eof and not d.needs_input:
                        yield d.decompress(b"", STEP_BYTES)
                    data = d.unused_data if d.eof else b""
                if d.eof:
                    d = None
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return


def unpack(chunks: Iterable[bytes], above: frozenset[bytes] = frozenset(), streamed: int = 0) -> Iterator[bytes | None]:
    """Chunks of decompressed data, or of data itself if it isn't compressed, and None at the end of each run of it.
    Data compressed again and again is followed until it begins like one further out, which ends cycles."""
    work = [(iter(chunks), above)]
    while work:
        chunks, above = work.pop()
        head = b""
        while len(head) < STEP_BYTES and (chunk := next(chunks, None)) is not None:
            head += chunk
        if not head:
            continue
        at = hashlib.sha256(head).digest()
        if _packed(head) is None or at in above or streamed > STREAMED:
            yield head
            yield from chunks
            yield None
            continue
        rest: list[bytes] = []
        inside, held, size = _inflated(itertools.chain([head], chunks), rest), [], 0
        while size <= LAYER_BYTES and (chunk := next(inside, None)) is not None:
            held.append(chunk)
            size += len(chunk)
        if size > LAYER_BYTES:
            # too large to hold: one generator to a level
            yield from unpack(itertools.chain(held, inside), above | {at}, streamed + 1)
            held = []
        if rest:
            work.append((itertools.chain(rest, chunks), above))
        if held:
            work.append((iter(held), above | {at}))


def _text(data: bytes | bytearray) -> Iterator[str]:
    """Data as text, binary data too: what is no character in it can't be part of a find."""
    if data:
        yield data.decode("utf-8", "replace")


def _bytes(token: str) -> bytes | None:
    """Base64 of either alphabet, with padding or without, decoded."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _closed(held: bytearray) -> int:
    """Where to cut data: after the last newline that no base64 of several lines can go over; 0 if there is none."""
    k = held.rfind(b"\n")
    while k >= 0:
        line = bytes(held[max(0, k - 200) : k]).rstrip(b" \t\r")
        if (line or k <= 200) and not OPEN.search(line):
            return k + 1
        k = held.rfind(b"\n", 0, k)
    return 0


def _base64(token: str) -> Iterator[str]:
    """Texts in a base64 token: one, or more if it holds several runs of data or more than LAYER_BYTES."""
    if (data := _bytes(token)) is None:
        return
    held, most = bytearray(), LAYER_BYTES
    for chunk in unpack([data]):
        if chunk is None:
            yield from _text(held)
            held, most = bytearray(), LAYER_BYTES
            continue
        held += chunk
        if len(held) > most:
            if cut := _closed(held):
                yield from _text(held[:cut])
                held, most = held[cut:], LAYER_BYTES
            else:
                most = 2 * len(held)
    yield from _text(held)


def _opens(body: str, k: int) -> bool:
    """Whether compressed data begins there that can be read."""
    head = _bytes(body[k : k + 64]) or b""
    kind = _packed(head)
    if kind == "zlib":
        return any(_inflated(iter([head]), []))
    return kind == "xz" or kind == "bz2" and head[4:10] == b"1AY&SY"


def _inside(layer: Layer, body: str, places: np.ndarray) -> Iterator[Layer]:
    """Layers inside a run of base64, whose characters stand at ``places`` of a layer."""
    body = body.rstrip("=").replace("-", "+").replace("_", "/")

    def whole(k: int) -> Iterator[Layer]:
        start, end = _origin(layer.origin, int(places[k]), int(places[-1]) + 1)
        for text in _base64(body[k:]):
            yield Layer(text, (np.full(len(text), start), np.full(len(text), end), np.ones(len(text), bool)))

    yield from whole(0)
    for k in (1, 2, 3):
        # a token behind others: each byte comes from two characters; bytes of no ASCII are in no find
        if data := _bytes(body[k:]):
            i = np.arange(len(data))
            a = places[k + i // 3 * 4 + i % 3]
            b = places[k + i // 3 * 4 + i % 3 + 1]
            first, last = (a, b + 1) if layer.origin is None else (layer.origin[0][a], layer.origin[1][b])
            yield Layer(data.decode("latin-1"), (first, last, np.ones(len(data), bool)))
    for m in () if _opens(body, 0) else MAGIC.finditer(body, 1):
        if _opens(body, m.start()):
            yield from whole(m.start())


def decoded(layer: Layer) -> Iterator[Layer]:
    """The layers inside a layer. Escapes are decoded over the whole layer, as a find may begin or end in plain text, and
    in each token alone, as a find may begin inside one of the whole layer's; once, and to the end."""
    text, origin, escapes = layer
    for mark, pattern, search, decode in (("%", ESCAPES, ESCAPES, _percent), ("\\u", UNICODE, UNICODE, _unicode), ("", NESTED, ESCAPE, _nested)):
        if escapes and mark in text and search.search(text):
            yield _unescaped(layer, 0, len(text), pattern, decode)
            for m in TOKEN.finditer(text):
                if mark in m[0] and search.search(m[0]) and len(m[0]) < len(text):
                    yield _unescaped(layer, m.start(), m.end(), pattern, decode)
    for m in BASE64.finditer(text):
        # one in plain text was followed a layer further up
        if _coded(origin, m.start(), m.end()):
            yield from _inside(layer, m[0], np.arange(m.start(), m.end()))
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        if _coded(origin, m.start(), m.end()):
            yield from _inside(layer, "".join(m[0].split()), np.array([k for k, c in enumerate(m[0], m.start()) if not c.isspace()], np.int64))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and spans of finds in decoded layers, both in order."""
    if not text:
        return [], []
    key = lambda s: (s[1], ORDER[s[0]], s[2])
    base, more = sorted(base_spans(text), key=key), set()
    seen, work = set(), [decoded(Layer(text, None))]
    # generators, so that one layer of each depth is held at a time
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        at = hashlib.sha256(b"".join([b"%d" % layer.escapes, layer.text.encode("utf-8", "surrogatepass"), *(x.tobytes() for x in layer.origin)])).digest()
        if at in seen:
            continue
        seen.add(at)
        for kind, a, b in base_spans(layer.text):
            start, end = _origin(layer.origin, a, b)
            if _coded(layer.origin, a, b) and not any(k == kind and s < end and start < e for k, s, e in base):
                more.add((f"decoded_{kind}", start, end))
        work.append(decoded(layer))
    return base, sorted(more, key=key)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULTS = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs with counts of base finds, their digest, and all spans."""
    names = [c for c in docs.columns if c not in RESULTS]
    df = docs.select(*names)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields], *[T.StructField(c, T.LongType() if c[:2] == "n_" else T.StringType()) for c in RESULTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 24):
                rows = []
                for text in part.column("text").to_pylist():
                    base, more = scan(text)
                    kinds = [k for k, _, _ in base]
                    everything = sorted(base + more, key=lambda s: (s[1], ORDER[s[0]], s[2]))
                    rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(everything)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), RESULTS.values()))], names=[*names, *RESULTS])

    return df.mapInArrow(run, schema)

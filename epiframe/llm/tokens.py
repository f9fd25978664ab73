"""Token ids packed at a fixed bit width, in shard files with block offsets (operator 1).

A shard file holds, all little-endian:

* blocks of ``BLOCK`` ids, each id in ``bits`` bits, lowest bit first; every block starts on a byte;
* a footer: block offsets (int64, one more than blocks), document ids (int64), a byte per document that is 1 where
  the id is null, and document starts in ids (int64, one more than documents);
* a trailer of 40 bytes: magic, bits, documents, ids, footer offset.

``bits`` is the least width that holds the vocabulary. A document, or any range of ids, is read by seeking to its
blocks; unpacking is one numpy expression per block. Tasks write to names of their own attempt and report them in
rows that Spark commits, so that a repeated or lost task leaves no wrong file in the manifest.

Defined cases: a null text is empty and gives the end id alone; an empty table gives no rows and no files; rows with
equal doc_id follow each other ordered by text, and rows that tie in both are alike; a null doc_id comes first; a text
of any length is encoded whole; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_in, open_out, shared_path, slices

MAGIC = b"EPITOK01"
TRAILER = struct.Struct("<8sqqqq")
BLOCK = 65_536
#: Distinct pieces whose ids a worker keeps; at this number those go that were not used again, and half at least.
CACHE = 500_000
#: Pieces that are encoded at once.
WORDS = 4096
MANIFEST = "shard long, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long"


def bit_width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in ``bits`` bits each, lowest bit first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int, first: int = 0) -> np.ndarray:
    """``count`` ids of a block from its id number ``first``."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    low = first * bits
    flat = np.unpackbits(np.frombuffer(data, np.uint8)[low // 8 :], bitorder="little")[low % 8 : low % 8 + count * bits]
    return (flat.reshape(count, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype(np.uint32)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a copy with room to grow, that holds n items."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class Encoder:
    """Encodes whole texts with a tokenizer file of the tokenizers library, keeping the ids of repeated pieces.

    A byte-level BPE never joins a character that is not white space with white space after it, so a text falls into
    pieces (white space, then the rest) whose encodings follow each other. Nor does it join a line end with a character
    after it that is not white space, or a letter with a punctuation mark after it. Texts with the four separators
    that only Python counts as white space are encoded whole.

    A special token written out in a text is that token, as the library has it by default. It ends a piece's parts on
    both sides, so pieces that hold one are encoded whole.

    Pieces are kept under keys: a word stands for itself after one space, a piece that begins with a line end for
    itself, and any other piece has ``AS_IS`` before it.
    """

    AS_IS, MARKS = "\x1f", frozenset(".,;:!?")

    def __init__(self, path: str, end_id: int):
        import re

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker to a core
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = re.compile(r"\s*\S+|\s+").findall
        self.odd = re.compile("[\x1c-\x1f]").search
        self.end_id = end_id
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how byte-level tokens write a space
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat = np.array([self.end_id], np.uint32)
        self.starts, self.lengths, self.used = np.zeros(1, np.int64), np.ones(1, np.int64), 1
        self.uses = np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keep the pieces of most uses, at most half of CACHE; their uses count half from then on."""
        uses, least = self.uses[: len(self.index)], 2
        while np.count_nonzero(uses >= least) > CACHE // 2:
            least *= 2
        kept = uses >= least
        kept[0] = True
        at = np.flatnonzero(kept)
        self.flat, self.lengths = self.gather(at)
        self.index = dict(zip(compress(self.index, kept.tolist()), range(len(at))))
        self.starts, self.used, self.uses = np.cumsum(self.lengths) - self.lengths, len(self.flat), uses[at] // 2

    def keys(self, text: str) -> list[str]:
        if not text:
            return []
        if text.replace("\n", " ") == " ".join(text.split()):  # words that one space or line end parts
            keys = text.replace("\n", " \n").split(" ")
            keys[0] = self.AS_IS + keys[0]
            return keys
        if self.odd(text):
            return [self.AS_IS + text]
        return [p[1:] if p[0] == " " and not p[1:2].isspace() and len(p) > 1 else p if p[0] == "\n" else self.AS_IS + p for p in self.pieces(text)]

    def parts(self, key: str) -> tuple[str, ...]:
        """Keys whose ids follow each other in those of key; key alone if it must be encoded."""
        if key[0] == "\n" and len(key) > 1 and not key[1].isspace():
            return (self.AS_IS + "\n", *self.parts(self.AS_IS + key[1:]))
        if key[-1] in self.MARKS and len(key) > 1 and key[-2].isalpha():
            return (key[:-1], self.AS_IS + key[-1])
        return (key,)

    def learn(self, keys: list[str]) -> None:
        split = {k: x for k in keys if (k[0] == "\n" or k[-1] in self.MARKS) and len(x := self.parts(k)) > 1}
        raw = [k for k in dict.fromkeys([*(k for k in keys if k not in split), *(p for x in split.values() for p in x)]) if k not in self.index]
        words = [k for k in raw if k[0] not in "\x1f\n"]
        for k in range(0, len(words), WORDS):
            self.add_words(words[k : k + WORDS])
        self.add_pieces([k for k in raw if k[0] in "\x1f\n"])
        ids, lengths = self.gather(np.array([self.index[p] for x in split.values() for p in x], np.int64))
        ends = np.cumsum([len(x) for x in split.values()], dtype=np.int64)
        self.add(list(split), ids, np.diff(np.cumsum(lengths)[ends - 1], prepend=0))

    def add_words(self, words: list[str]) -> None:
        """Words after one space are encoded as one text: a token that begins with a space begins a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) == len(words):
            self.add(words, ids, np.diff(starts, append=len(ids)))
        else:
            self.add_pieces(words)

    def add_pieces(self, keys: list[str]) -> None:
        for k in range(0, len(keys), WORDS):
            part = keys[k : k + WORDS]
            pieces = [k[1:] if k[0] == self.AS_IS else k if k[0] == "\n" else " " + k for k in part]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            self.add(part, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.index), len(self.index) + len(keys)
        self.index.update(zip(keys, range(n, m)))
        self.starts, self.lengths, self.flat = _room(self.starts, m), _room(self.lengths, m), _room(self.flat, self.used + len(ids))
        self.uses = _room(self.uses, m)
        self.uses[n:m] = 0
        self.starts[n:m] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n:m] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the keys of these numbers, one after the other, and how many each has."""
        lengths = self.lengths[at]
        past = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[at] - past + lengths, lengths) + np.arange(past[-1] if len(past) else 0)], lengths

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, an end id after each text; and the number of each text's ids with it."""
        if len(self.index) > CACHE:
            self.forget()
        keys: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            keys += self.keys(text)
            keys.append("")
            ends[k] = len(keys)
        at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        if len(missing := np.flatnonzero(at < 0)):
            unknown = [keys[j] for j in missing.tolist()]
            self.learn(list(dict.fromkeys(unknown)))
            at[missing] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(unknown))
        self.uses[: len(self.index)] += np.bincount(at, minlength=len(self.index))
        ids, lengths = self.gather(at)
        return ids, np.diff(np.cumsum(lengths)[ends - 1], prepend=0)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One to each Python worker, which Spark uses for many tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


class ShardWriter:
    """Writes one shard file as ids come; holds a block of ids and the documents' places."""

    def __init__(self, uri: str, bits: int):
        self.out, self.bits = open_out(uri), bits
        self.rest, self.n_tokens, self.at = np.empty(0, np.uint32), 0, 0
        self.offsets, self.doc_ids, self.nulls, self.lengths = [0], [], [], []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.nulls.append(nulls)
        self.lengths.append(lengths)
        self.n_tokens += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // BLOCK * BLOCK
        for k in range(0, full, BLOCK):
            self._block(self.rest[k : k + BLOCK])
        self.rest = self.rest[full:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> int:
        if len(self.rest):
            self._block(self.rest)
        lengths = np.concatenate(self.lengths)
        for x in (np.array(self.offsets, "<i8"), np.concatenate(self.doc_ids).astype("<i8"), np.concatenate(self.nulls).astype(np.uint8), np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")):
            self.out.write(x.tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.bits, len(lengths), self.n_tokens, self.at))
        self.out.close()
        return len(lengths)


class Shard:
    """Random access to a shard file."""

    def __init__(self, uri: str):
        self.file = open_in(uri)
        size = self.file.size()
        magic, self.bits, self.n_docs, self.n_tokens, footer = TRAILER.unpack(self._read(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        data = self._read(footer, size - TRAILER.size - footer)
        blocks, n = -(-self.n_tokens // BLOCK), self.n_docs
        self.offsets = np.frombuffer(data, "<i8", blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", n, 8 * (blocks + 1))
        self.nulls = np.frombuffer(data, np.uint8, n, 8 * (blocks + 1 + n)).astype(bool)
        self.starts = np.frombuffer(data, "<i8", n + 1, 8 * (blocks + 1 + n) + n)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard, reading only the blocks that hold them."""
        if start >= end:
            return np.empty(0, np.uint32)
        a, b = start // BLOCK, -(-end // BLOCK)
        data, base = self._read(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a])), int(self.offsets[a])
        parts = [unpack(data[self.offsets[k] - base : self.offsets[k + 1] - base], min(BLOCK, self.n_tokens - k * BLOCK), self.bits) for k in range(a, b)]
        return np.concatenate(parts)[start - a * BLOCK : end - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode docs(doc_id, text) into shard files under path, in ascending doc_id order, and a manifest of them."""
    from tokenizers import Tokenizer

    bits = bit_width(Tokenizer.from_file(tokenizer).get_vocab_size())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, encode, uri = None, encoder(tokenizer, end_id), f"{path}/shards/{uuid.uuid4().hex}.tok"
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                out, ids = out or ShardWriter(uri, bits), part.column("doc_id")
                out.add(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), *encode([t or "" for t in part.column("text").to_pylist()]))
        if out:
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [uri], "n_docs": [out.close()], "n_tokens": [out.n_tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files under path: its place among all ids, their number and checksum, its shard and place there."""
    shards = spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()  # one row to a file
    base, rows = 0, []
    for s in shards:
        rows.append((s.shard, s.path, base))
        base += s.n_tokens

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                shard, done = Shard(row.path), 0
                while done < shard.n_docs:  # some blocks at a time
                    upto = max(done + 1, int(np.searchsorted(shard.starts, shard.starts[done] + 32 * BLOCK, "right")) - 1)
                    low = int(shard.starts[done])
                    ids = shard.ids(low, int(shard.starts[upto])).astype("<u4")
                    cut = shard.starts[done : upto + 1] - low
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                    doc = pd.array(shard.doc_ids[done:upto], "Int64")
                    doc[shard.nulls[done:upto]] = pd.NA
                    yield pd.DataFrame({"doc_id": doc, "start": row.base + low + cut[:-1], "n_tokens": np.diff(cut), "ids_crc32": crc, "shard": row.shard, "offset": low + cut[:-1]})
                    done = upto

    listed = spark.createDataFrame(rows, "shard long, path string, base long")
    return listed.repartition(max(1, len(rows))).mapInPandas(read, ROWS)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write docs as packed ids in the shared folder and return what the files hold."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or default_tokenizer(), end_id)
    return read_tokens(spark, path)

"""Removal of long passages that an earlier document has, by compaction of a token de Bruijn graph (operator 6).

A window is ``WINDOW`` consecutive words. Writing out every window of a corpus would multiply it, so the graph is
sparse: of the k-mers that start in a window, the one of the least hash is its anchor, chosen by content alone, and
the windows that share an anchor stand side by side. Such a stretch of windows is an edge: its anchor, a 128-bit
BLAKE2b digest of the words it spans, the digest of the edge after it, and its source coordinate (document and place).
Equal windows have equal anchors, so

1. edges whose anchor stands in one document only are dropped;
2. edges of equal digest are one edge, whose source coordinate is the smallest document that has it;
3. an edge and the one after it are joined to a path where neither branches: every occurrence of the first is followed
   by the second, and the second occurs as often. Paths grow by joins of the links with themselves, which double their
   length, so that a path of n edges takes about log n joins. All edges of a path stand in the same documents;
4. a path is removed in all documents but the one of its source coordinate: the digests of the words at both
   coordinates are equal, so that no removal rests on a short hash. Occurrences of a path's first edge alone are read;
5. an anchor with several edges is a branching node: only there can a window of an edge stand in a smaller document
   than the edge does. Windows of those edges, at their sources alone, are digested and compared one by one.

With k-mers as long as a window every window is an edge of its own: the dense graph, as an option (``kmer``).

Nothing is emitted in pairs: a passage in n documents gives n rows. Texts are not shuffled unless there are more
documents with passages than may be broadcast.

Defined cases: a null or short text has no windows; a text of any length is read whole, in running sums; rows that repeat a doc_id are one document, so that they remove
nothing from each other; a row with a null doc_id neither removes nor loses words; an empty table gives no rows;
extra columns stay, and columns with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, own_name, slices, small_side

WINDOW, KMER = 50, 15
SLICE = 1 << 19
ODD1, ODD2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """Hashes of any span of a sequence of numbers, from running sums of a polynomial modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, odd: int):
        n = len(values)
        up, down = self._powers.get(odd, (np.empty(0), np.empty(0)))
        if len(up) < n + 1:
            size = max(n + 1, SLICE)
            inverse = pow(odd, -1, 1 << 64)
            up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)])) for x in (odd, inverse))
            if size <= 2 * SLICE:
                self._powers[odd] = (up, down)
        self.down = down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_places(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each; where words start and end in that; where each text's words begin (one
    place more than texts)."""
    words = [t.encode().split() if t else [] for t in texts]
    raw = b" ".join([b" ".join(w) for w in words if w])
    ends = np.flatnonzero(np.frombuffer(raw + b" ", np.uint8) == 32) if raw else np.empty(0, np.int64)
    return raw, np.concatenate([[0], ends[:-1] + 1])[: len(ends)], ends, np.concatenate([[0], np.cumsum([len(w) for w in words])])


def digests(raw: bytes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """128-bit digests of byte spans, as rows of two numbers."""
    found = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), high.tolist())])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def stretches(texts: list[str | None], kmer: int = KMER) -> dict[str, np.ndarray]:
    """Stretches of windows with one anchor: text number, first window, windows, anchor hash, digest of the words, and
    that of the stretch after it in the text, if last is not set."""
    raw, starts, ends, bounds = word_places(texts)
    room = np.maximum(0, np.diff(bounds) - WINDOW + 1)  # windows of each text
    if not room.sum():
        empty = np.empty(0, np.int64)
        return {c: empty for c in ("text", "at", "n", "h", "d1", "d2", "n1", "n2")} | {"last": np.empty(0, bool)}
    words = Spans(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), ODD1)(starts, ends)
    kmers = Spans(words, ODD2)(np.arange(len(words) - kmer + 1), np.arange(kmer, len(words) + 1))
    text = np.repeat(np.arange(len(texts)), room)
    start = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(bounds[:-1], room)
    anchor = np.empty(len(start), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(kmers, WINDOW - kmer + 1)
    for k in range(0, len(start), 1 << 15):
        part = start[k : k + (1 << 15)]
        anchor[k : k + (1 << 15)] = part + view[part].argmin(1)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    n = np.diff(new, append=len(start))
    low, text = start[new], text[new]
    d = digests(raw, starts[low], ends[low + n + WINDOW - 2])
    after = np.roll(d, -1, 0)
    return {"text": text, "at": low - bounds[text], "n": n, "h": kmers[anchor[new]].view(np.int64), "d1": d[:, 0], "d2": d[:, 1], "n1": after[:, 0], "n2": after[:, 1], "last": np.diff(text, append=-1) != 0}


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key that tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def edges(docs: DataFrame, kmer: int = KMER) -> DataFrame:
    """All stretches of documents with an id: (doc_id, row, at, n, h, d1, d2, n1, n2); n1 and n2 are null at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = stretches(part.column("text").to_pylist(), kmer)
                who, last = pa.array(found.pop("text")), found.pop("last")
                columns = [part.column("doc_id").take(who), part.column("row").take(who), pa.array(found["at"].astype(np.int32)), pa.array(found["n"].astype(np.int32))]
                columns += [*(pa.array(found[c]) for c in ("h", "d1", "d2")), *(pa.array(found[c], mask=last) for c in ("n1", "n2"))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "at", "n", "h", "d1", "d2", "n1", "n2"])

    keyed = _keyed(docs).where("doc_id is not null and text is not null")
    return keyed.mapInArrow(run, "doc_id long, row long, at int, n int, h long, d1 long, d2 long, n1 long, n2 long")


def windows_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Digests of the single windows of stretches(doc_id, row, at, n): (doc_id, row, at, w1, w2)."""
    wanted = materialize(places.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "n")).alias("places")), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw, starts, ends, bounds = word_places(part.column("text").to_pylist())
                ids, at = [], []
                for k, places in enumerate(part.column("places").to_pylist()):
                    for p in places:
                        at.append(np.arange(p["at"], p["at"] + p["n"]) + bounds[k])
                        ids.append(np.full(p["n"], k))
                who, at = np.concatenate(ids), np.concatenate(at)
                d = digests(raw, starts[at], ends[at + WINDOW - 1])
                who = pa.array(who)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(who), part.column("row").take(who), pa.array((at - bounds[who]).astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["doc_id", "row", "at", "w1", "w2"])

    joined = _keyed(docs).join(small_side(wanted, F.size("places")), ["doc_id", "row"]).select("doc_id", "row", "text", "places")
    return joined.mapInArrow(run, "doc_id long, row long, at int, w1 long, w2 long")


def compact(nodes: DataFrame) -> DataFrame:
    """Paths of nodes(d1, d2, n, uses, n1, n2): (d1, d2) of each path's first edge, its windows and edges. n1 and n2
    name the only edge that follows, null where there is none or several."""
    after = nodes.select(F.col("d1").alias("n1"), F.col("d2").alias("n2"), F.col("uses").alias("uses_after"))
    # a link leads from an edge back to the one before it; the first edges of paths have none
    links = nodes.where("n1 is not null").join(after, ["n1", "n2"]).where("uses = uses_after")
    links = materialize(links.select(F.col("n1").alias("d1"), F.col("n2").alias("d2"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("n").cast("long").alias("off")), "links")
    while not links.isEmpty():
        back = links.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("off").alias("more"))
        step = materialize(links.join(back, ["p1", "p2"], "left"), "links")
        links = step.select("d1", "d2", F.coalesce("q1", "p1").alias("p1"), F.coalesce("q2", "p2").alias("p2"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"))
        if step.where("q1 is not null").isEmpty():
            break
    inner = nodes.select("d1", "d2", "n").join(links, ["d1", "d2"], "left")
    return inner.groupBy(F.coalesce("p1", "d1").alias("d1"), F.coalesce("p2", "d2").alias("d2")).agg(F.max(F.col("n") + F.coalesce("off", F.lit(0))).alias("windows"), F.count("*").alias("edges"))


def repeated_paths(docs: DataFrame, kmer: int = KMER) -> DataFrame:
    """Passages to remove: (doc_id, row, start, end) in words, end exclusive, with source_id and, of whole paths,
    source_start and edges. Passages of a document may overlap."""
    all_edges = materialize(edges(docs, kmer), "edges")
    # 1. anchors of more than one document
    anchors = all_edges.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h")
    anchors = materialize(anchors, "anchors")  # both sides of the joins below shuffle, so that Spark can split a hot key
    shared = materialize(all_edges.join(anchors, "h", "left_semi"), "shared-edges")
    # 2. an edge's source, and the only edge after it
    one = (F.count("n1") == F.count("*")) & (F.min("n1") == F.max("n1")) & (F.min("n2") == F.max("n2"))
    nodes = shared.groupBy("d1", "d2").agg(
        F.min("h").alias("h"), F.min("n").alias("n"), F.min(F.struct("doc_id", "at")).alias("source"), F.max("doc_id").alias("high"), F.count("*").alias("uses"),
        F.when(one, F.min("n1")).alias("n1"), F.when(one, F.min("n2")).alias("n2"),
    )
    nodes = materialize(nodes, "nodes")
    # 3. paths of edges that several documents have, and 4. their occurrences outside the source
    repeated = nodes.where("high > source.doc_id")
    paths = materialize(compact(repeated.select("d1", "d2", "n", "uses", "n1", "n2")), "paths")
    heads = repeated.join(paths, ["d1", "d2"]).select("d1", "d2", F.col("source.doc_id").alias("source_id"), F.col("source.at").alias("source_start"), "windows", "edges")
    heads = materialize(heads, "heads")
    whole = shared.select("doc_id", "row", "at", "d1", "d2").join(heads, ["d1", "d2"]).where("doc_id > source_id")
    whole = whole.select("doc_id", "row", F.col("at").alias("start"), (F.col("at") + F.col("windows") + (WINDOW - 1)).cast("int").alias("end"), "source_id", "source_start", "edges")
    whole = materialize(whole, "whole")  # a job of its own, so that Spark can split the occurrences of a hot path
    # 5. windows of edges of branching anchors, where the document is the edge's source
    branching = nodes.groupBy("h").agg(F.min("source.doc_id").alias("low"), F.max("source.doc_id").alias("top")).where("low < top").select("h")
    branching = materialize(branching, "branching")
    inside = nodes.join(branching, "h", "left_semi").select("d1", "d2", F.col("source.doc_id").alias("doc_id"))
    inside = materialize(inside, "branching-edges")
    singles = windows_at(docs, shared.select("doc_id", "row", "at", "n", "d1", "d2").join(inside, ["d1", "d2", "doc_id"], "left_semi").select("doc_id", "row", "at", "n"))
    singles = materialize(singles, "windows")
    first = singles.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    first = materialize(first, "first-windows")
    singles = singles.join(first, ["w1", "w2"]).where("doc_id > low").groupBy("doc_id", "row", "at").agg(F.min("low").alias("source_id"))
    # windows side by side, of one source, are one passage
    order = Window.partitionBy("doc_id", "row").orderBy("at")
    follows = (F.lag("at").over(order) + 1 == F.col("at")) & (F.lag("source_id").over(order) == F.col("source_id"))
    singles = singles.withColumn("run", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order))
    singles = singles.groupBy("doc_id", "row", "run").agg(F.min("at").alias("start"), (F.max("at") + WINDOW).cast("int").alias("end"), F.min("source_id").alias("source_id"))
    return whole.unionByName(singles.drop("run"), allowMissingColumns=True)


def remove_repeats(docs: DataFrame, kmer: int = KMER) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept_text (kept words joined by a space). With ``kmer`` = ``WINDOW``
    every window is an edge: the dense graph, of the same result."""
    if not 1 <= kmer <= WINDOW:
        raise ValueError(f"k-mers have 1 to {WINDOW} words: {kmer}")
    paths = materialize(repeated_paths(docs, kmer), "passages")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256", "kept_text")]
    key, row, held = (own_name(names, x) for x in ("doc", "row", "cuts"))
    by_doc = materialize(paths.groupBy(F.col("doc_id").alias(key), F.col("row").alias(row)).agg(F.collect_set(F.struct("start", "end")).alias(held)), "cuts")
    df = docs.select(*names)
    keys = (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(row))
    df = df.join(small_side(by_doc, F.size(held)), keys, "left").select(*names, held)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields[:-1]], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 * SLICE):
                out = []
                for text, cuts in zip(part.column("text").to_pylist(), part.column(held).to_pylist()):
                    words = text.encode().split() if text else []
                    n = len(words)
                    if cuts:
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, [c["start"] for c in cuts], 1)
                        np.add.at(edge, [c["end"] for c in cuts], -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    kept = b" ".join(words)
                    out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
                new = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new], names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return df.mapInArrow(run, schema)

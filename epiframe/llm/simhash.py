"""SimHash near-duplicates by the generalised pigeonhole principle (operator 8).

Fingerprints of 64 bits link at ``RADIUS`` or fewer differing bits. Bits fall into m partitions, correlated bits into
the same one. If partition thresholds sum to radius - m + 1, two fingerprints that link differ in at most the threshold
in some partition (-1 leaves a partition out). Each fingerprint gets thresholds of its own, by dynamic programming on
the candidates that each partition and threshold would give it, which a bounded sample of fingerprints estimates. It
then probes each partition's index with all values within its threshold, and whole fingerprints are compared.

Equal fingerprints are one before all this. A task reads rows sorted by index key, those of the index first: it holds
the index rows of one key and streams the probes past them; a key that the sample shows to be frequent is dealt out in
blocks of about ``BLOCK`` index rows. Of the links found in a batch it returns a spanning star to each group, so that
a dense group of n fingerprints gives about n rows and not n * n. Components come from large-star and small-star steps
on those rows, each step written to the shared folder.

Defined cases: a null or empty text has no shingles and fingerprint zero, linked like any other; a text of fewer words
than a shingle is one shingle; rows that repeat a doc_id are one document of the smallest id reachable; a null doc_id
is in no component id but still links, and has the smallest id reachable, or null if all are null; a text of any length
gives all its shingles; an empty table gives no rows; extra columns stay in ``with_fingerprint`` and ``with_component``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, own_name, slices, spread_join

RADIUS, SHINGLE, SEED = 3, 3, 42
SAMPLE = 50_000
BLOCK = 4096
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        past = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))  # places after each word
        h = xxhash.xxh64_intdigest
        starts = [0, *[p + 1 for p in past[: len(words) - shingle]]]
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, past[shingle - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with fp, the fingerprint's 64 bits as a signed long."""
    df = docs.drop("fp")
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 24):
                fp = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], names=[*part.schema.names, "fp"])

    return df.mapInArrow(run, schema)


class Plan:
    """Partitions of bits and a sample's value counts: what thresholds a fingerprint gets, and its keys."""

    def __init__(self, sample: np.ndarray, total: int, radius: int = RADIUS):
        self.radius, self.scale = radius, max(1.0, total / max(1, len(sample)))
        # as few partitions as make an index key's rows few: about log2(total) bits to a partition
        self.m = m = max(1, min(radius + 1, 64 // max(1, int(np.log2(max(2, total))) - 2)))
        self.parts = self._partition(sample, m)
        self.masks = [[np.array([sum(1 << b for b in c) for c in itertools.combinations(range(len(p)), t)], np.int64) for t in range(radius + 1)] for p in self.parts]
        self.values, self.counts = [], []
        for i in range(m):
            v, c = np.unique(self.project(sample, i), return_counts=True)
            self.values.append(v)
            self.counts.append(c)

    @staticmethod
    def _partition(sample: np.ndarray, m: int) -> list[list[int]]:
        """Bits in m groups: each starts with the first bit left and takes those most correlated with it."""
        size, left, groups = -(-64 // m), list(range(64)), []
        ones, both = np.zeros(64), np.zeros((64, 64))
        for k in range(0, len(sample), 4096):
            bits = ((sample[k : k + 4096, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            ones += bits.sum(0)
            both += bits.T @ bits
        cov = both - np.outer(ones, ones) / max(1, len(sample))
        var = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.abs(cov / var[:, None] / var[None, :])
        while left:
            head = left.pop(0)
            near = sorted(left, key=lambda b: (-corr[head, b], b))[: size - 1]
            groups.append(sorted([head, *near]))
            left = [b for b in left if b not in near]
        return groups

    def project(self, fps: np.ndarray, i: int) -> np.ndarray:
        """The bits of partition i, side by side."""
        out = np.zeros(len(fps), np.int64)
        for k, b in enumerate(self.parts[i]):
            out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        return out

    def estimate(self, values: np.ndarray, i: int) -> np.ndarray:
        """Rows that have each value of partition i, as the sample shows."""
        v, c = self.values[i], self.counts[i]
        if not len(v):
            return np.zeros(len(values))
        at = np.minimum(np.searchsorted(v, values), len(v) - 1)
        return np.where(v[at] == values, c[at], 0) * self.scale

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """Per fingerprint and partition the threshold; they sum to radius - m + 1 and cost least."""
        n, m, r = len(fps), self.m, self.radius
        cost = np.zeros((m, r + 2, n))  # of thresholds -1 to r: a row to each probe besides the candidates
        for i in range(m):
            value = self.project(fps, i)
            for t in range(r + 1):
                probes = value[:, None] ^ self.masks[i][t][None, :] if len(self.masks[i][t]) <= 64 else None
                near = self.estimate(probes.ravel(), i).reshape(n, -1).sum(1) if probes is not None else np.full(n, len(self.masks[i][t]) * self.scale)
                cost[i, t + 1] = cost[i, t] + near + len(self.masks[i][t])
        # sums of thresholds + 1 are radius + 1 over all partitions
        best, choice = np.full((r + 2, n), np.inf), []
        best[0] = 0
        for i in range(m):
            options = np.stack([np.stack([best[s - t] + cost[i, t] if s >= t else np.full(n, np.inf) for t in range(r + 2)]) for s in range(r + 2)])
            choice.append(options.argmin(1))
            best = options.min(1)
        out, left = np.empty((n, m), np.int64), np.full(n, r + 1)
        for i in reversed(range(m)):
            t = choice[i][left, np.arange(n)]
            out[:, i] = t - 1
            left = left - t
        return out

    def blocks(self, values: np.ndarray, i: int) -> np.ndarray:
        """Blocks into which a key's index rows are dealt."""
        return np.maximum(1, np.ceil(self.estimate(values, i) / BLOCK)).astype(np.int64)


def _rows(plan: Plan, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (key, block, probe, fp): an index row to each partition, and probes within the thresholds."""
    thresholds = plan.thresholds(fps)
    mixed = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    for i in range(plan.m):
        value = plan.project(fps, i)
        key = lambda v, i=i: (v * plan.m + i) if len(plan.parts[i]) <= 48 else v
        yield key(value), (mixed.astype(np.int64) % plan.blocks(value, i)), np.zeros(len(fps), np.int8), fps
        for t in range(plan.radius + 1):
            who = np.flatnonzero(thresholds[:, i] >= t)
            for mask in plan.masks[i][t] if len(who) else ():
                v = value[who] ^ mask
                b = plan.blocks(v, i)
                for k in range(int(b.max()) if len(b) else 0):
                    on = b > k
                    yield key(v[on]), np.full(int(on.sum()), k), np.ones(int(on.sum()), np.int8), fps[who[on]]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in, a star to each of their components out: (fingerprint, smallest fingerprint of its component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star links (a, b) that connect what the links of distinct fingerprints (fp) connect."""
    spark = distinct.sparkSession
    total = distinct.count()
    share = min(1.0, SAMPLE / max(1, total))
    picked = distinct.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).limit(2 * SAMPLE).toArrow()
    plan = spark.sparkContext.broadcast(Plan(np.sort(picked.column("fp").to_numpy().astype(np.int64).view(np.uint64)), total, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fps), 4096):
                rows = list(_rows(plan.value, fps[k : k + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*[(key, block.astype(np.int32), probe, fp.view(np.int64)) for key, block, probe, fp in rows])], names=["key", "block", "probe", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.empty(0, np.uint64)  # index rows of the key that the last batch ended in
        for batch in batches:
            key, block, probe = (batch.column(c).to_numpy() for c in ("key", "block", "probe"))
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if not len(fp):
                continue
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
            n_index = np.add.reduceat((probe == 0).astype(np.int64), starts)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            first = (int(key[0]), int(block[0]))
            if held_key == first:
                held = np.concatenate([held, fp[: n_index[0]]])
            else:
                held = fp[: n_index[0]]
            found += _compare(fp[starts[0] + n_index[0] : ends[0]], held, radius)
            if len(starts) > 1:  # the other groups, whose index rows are all in this batch so far
                n_probe = (ends - starts - n_index)[1:]
                each = np.repeat(n_index[1:], n_probe)
                low = np.repeat(starts[1:], n_probe)
                who = np.concatenate([[0], np.cumsum(n_probe)])
                place = np.repeat((starts + n_index)[1:] - who[:-1], n_probe) + np.arange(who[-1])
                past = np.cumsum(each)
                for part in np.split(np.arange(len(each)), np.flatnonzero(np.diff(past // 2_000_000)) + 1):
                    e = each[part]
                    if e.sum():
                        q = np.repeat(fp[place[part]], e)
                        x = fp[np.repeat(low[part] - (np.cumsum(e) - e), e) + np.arange(e.sum())]
                        near = (np.bitwise_count(q ^ x) <= radius) & (q != x)
                        found.append((q[near], x[near]))
                held = fp[starts[-1] : starts[-1] + n_index[-1]]
            held_key = (int(key[-1]), int(block[-1]))
            if found and sum(len(q) for q, _ in found):
                a, b = _stars(np.concatenate([q for q, _ in found]), np.concatenate([x for _, x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows = distinct.mapInArrow(deal, "key long, block int, probe byte, fp long")
    grouped = rows.repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block", "probe", "fp")
    return grouped.mapInArrow(verify, "a long, b long").distinct()


def _compare(q: np.ndarray, x: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of probes with the index rows of their key, a block of comparisons at a time."""
    out = []
    step = max(1, 2_000_000 // max(1, len(x)))
    for k in range(0, len(q), step):
        part = q[k : k + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ x[None, :]) <= radius)
        on = part[i] != x[j]
        if on.any():
            out.append(_stars(part[i[on]], x[j[on]]))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b): root is the smallest node of the component, by large-star and small-star steps.

    Nodes are ordered as signed longs. Each step is two joins on a node's smallest neighbour, which is found by partial
    sums and written, as three joins read it; the edges of a node with many neighbours join by broadcast, so that they
    are no single task's work. All are stars once every node with a smaller neighbour has no other neighbour.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # large star: every larger neighbour moves to the smallest of the node and its neighbours
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "lowest")
        total, between = low.agg(F.sum("n"), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()
        if not between:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        moved = spread_join(both, low, "u", "n", total)
        # an edge gives an edge at most; those that are now alike become one after the small star
        now = materialize(moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "edges")
        # small star: a node and its smaller neighbours move to the smallest of these
        low = materialize(now.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest")
        moved = spread_join(now, low, "u", "n", low.agg(F.sum("n")).first()[0])
        now = materialize(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct(), "edges")


def with_component(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, fp) with component_id, the smallest doc_id reachable over links."""
    df = materialize(docs.drop("component_id"), "fingerprints")
    distinct = materialize(df.groupBy("fp").agg(F.min("doc_id").alias("_low"), F.count("*").alias("_n")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "_low", "_n", F.coalesce("root", "fp").alias("_root"))
    rooted = materialize(rooted, "rooted")
    lowest = materialize(rooted.groupBy("_root").agg(F.min("_low").alias("component_id"), F.count("*").alias("_members")), "lowest")
    found = materialize(spread_join(rooted, lowest, "_root", "_members", rooted.count()).select("fp", "_n", "component_id"), "found")
    side = found.select("fp", F.col("_n").alias(count := own_name(df.columns, "n")), "component_id")
    return spread_join(df, side, "fp", count, df.count()).select(*df.columns, "component_id")

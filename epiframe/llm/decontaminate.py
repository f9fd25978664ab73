"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 2).

Patterns are windows of benchmark words, one search to each window length. A table of shifts by the hash of the last
words of a window lets the search skip end positions where no pattern can end; where the shift is nought, the bucket
of that suffix hash names the patterns to test, and comparing all words confirms an occurrence. The search moves all
lanes (stretches of the batch's words) at once in numpy, so that a document of any length is as many lanes.

The benchmark goes to the executors in blocks of at most ``BLOCK_WORDS`` words, each a search of its own over the
documents; what one block found travels with the row to the next.

Defined cases: a null text has no words; items without words or with a null item_id match nothing; repeated items
count once, and rows that repeat are marked alike; a text of any length is searched whole; an empty table on either side gives rows without hits, or no rows; extra columns are kept by
``mark_contaminated`` unless they have the names it adds, which it replaces.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Bytes of UTF-8 that belong to words, A-Z lower-cased; the rest become spaces.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WINDOW = 10
BLOCK_WORDS = 2_000_000
LANE = 512
TABLE_BITS = 22
BATCH_WORDS = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class WuManber:
    """Search for patterns of one length m, given as rows of word ids; id 0 stands for a word of no pattern."""

    def __init__(self, patterns: np.ndarray):
        self.m = m = patterns.shape[1]
        self.b = b = 3 if m >= 5 else min(m, 2)
        self.shift = np.full(1 << TABLE_BITS, m - b + 1, np.uint8 if m < 250 else np.int32)
        for end in range(b, m + 1):  # the block of words end-b to end-1 allows a shift of m-end at most
            np.minimum.at(self.shift, _hash([patterns[:, end - b + j] for j in range(b)]), m - end)
        suffix = _hash([patterns[:, m - b + j] for j in range(b)])
        order = np.argsort(suffix, kind="stable")
        self.patterns, self.suffix, self.number = patterns[order], suffix[order], order

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Positions at which a pattern's suffix block ends, found by shifting all lanes together."""
        m, b = self.m, self.b
        first = np.arange(m - 1, len(ids), LANE)
        last, at, found = np.minimum(first + LANE, len(ids)), first, []
        while len(at):
            step = self.shift[_hash([ids[at - b + 1 + j] for j in range(b)])]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < last
            at, last = at[on], last[on]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def search(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the first position and the pattern number, some at a time."""
        at = self.ends(ids)
        if not len(at):
            return
        key = _hash([ids[at - self.b + 1 + j] for j in range(self.b)])
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        size = high - low
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // 1_000_000, prepend=0))
        for part in np.split(np.arange(len(at)), cuts):
            n = size[part]
            if not n.sum():
                continue
            start = np.repeat(at[part] - self.m + 1, n)
            row = np.repeat(low[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            for j in [0, *range(self.m - 1, 0, -1)]:  # a prefix word first, then from the end
                same = ids[start + j] == self.patterns[row, j]
                start, row = start[same], row[same]
            yield start, self.number[row]


class Benchmark:
    """A block of benchmark items ready to search for: words as ids, one search to each window length, windows' items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        grouped: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, words in items:
            row = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words)
            size = min(window, len(row))
            for k in range(len(row) - size + 1):
                grouped[size][row[k : k + size]].add(item)
        self.gap = max(grouped, default=1)
        self.searches = []
        for size, windows in sorted(grouped.items()):
            owners = [sorted(x) for x in windows.values()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in owners])])
            self.searches.append((WuManber(np.array(list(windows), np.int64).reshape(-1, size)), starts, np.array([i for x in owners for i in x], np.int64)))

    def scan(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[set[int]]]:
        """Per text: number of words, positions of words inside occurrences, items found."""
        get, ids, starts, sizes = self.ids.get, [], [], []
        for text in texts:
            words = words_of(text)
            starts.append(len(ids))
            sizes.append(len(words))
            ids += [get(w, 0) for w in words]
            ids += [0] * self.gap  # no window runs into the next text: 0 is in no pattern
        flat, starts = np.array(ids, np.int64), np.array(starts, np.int64)
        edge, items = np.zeros(len(flat) + 1, np.int32), [set() for _ in texts]
        for search, offsets, owners in self.searches:
            for at, pattern in search.search(flat):
                np.add.at(edge, at, 1)
                np.add.at(edge, at + search.m, -1)
                doc = np.searchsorted(starts, at, "right") - 1
                for d, p in np.unique(np.stack([doc, pattern], 1), axis=0):
                    items[d].update(owners[offsets[p] : offsets[p + 1]].tolist())
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        cut = np.searchsorted(hit, starts)
        return np.array(sizes, np.int64), [hit[a:b] - s for a, b, s in zip(cut, [*cut[1:], len(hit)], starts)], items


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items with words, in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if row[0] is not None and (words := words_of(row[1])):
            block.append((row[0], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, hit_words (positions), items, and what is derived from them: n_hit, n_items, items_sha256, contaminated."""
    new = {"n_words": "long", "hit_words": "array<long>", "items": "array<long>", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}
    df = docs.drop(*new).withColumns({c: F.lit(None).cast(t) for c, t in new.items()})
    found = False
    for block in blocks_of(benchmark):
        df, found = _scan(df, block, window), True
    return df if found else _scan(df, [], window)


def _scan(df: DataFrame, block: list, window: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Benchmark(block, window))
    names = df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for batch in batches:
            for part in slices(batch, "text", 6 * BATCH_WORDS):
                n, hits, items = search.scan(part.column("text").to_pylist())
                hits = [h if b is None else np.union1d(b, h).astype(np.int64) for b, h in zip(part.column("hit_words").to_pylist(), hits)]
                items = [sorted(i.union(b or ())) for b, i in zip(part.column("items").to_pylist(), items)]
                new = {"n_words": n, "hit_words": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.int64())), "n_hit": [len(x) for x in hits], "n_items": [len(x) for x in items],
                       "items_sha256": [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items], "contaminated": [len(x) > 0 for x in hits]}
                yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else part.column(c) for c in names], names=names)

    return df.mapInArrow(scan, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]))

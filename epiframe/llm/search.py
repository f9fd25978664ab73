"""Ranked lexical search by windowed bucket scoring (operator 13).

Queries go to the tasks in blocks of at most ``BLOCK_WORDS`` words. A pass over the documents keeps each one's length
and, of its terms, those that the block asks for; numbers of documents and terms, and of documents with a term, are
sums over all documents. Documents are then dealt out by ranges of doc_id. A task takes them in windows of up to
``WINDOW`` in the order of doc_id, and turns a window into postings lists of slots and integer weights. To score a
query it traverses the lists of its terms, adds weights into an array of one number a slot, small enough for a core's
cache, and marks the slots in a bitset; the marked slots alone are harvested into the query's heap of the ``k`` best.
The heaps of all tasks, ``k`` rows a query each, are merged by Spark.

Every number is a 64-bit integer, so that the order of additions doesn't matter.

Defined cases: a null text has no terms; such documents count for nothing and are never found; an item without terms
finds nothing; every row of items is a query and every row of documents a document, so that rows that repeat an id
appear side by side; equal scores go by ascending doc_id, null last; a very long text is one row of term counts, at
most as long as the block's vocabulary; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .decontaminate import words_of

TOP = 10
#: Documents to a window: 32,768 sums of 8 bytes are 256 KB. A window also ends at so many postings.
WINDOW = 1 << 15
WINDOW_POSTINGS = 8_000_000
BLOCK_WORDS = 2_000_000
SLICE_BYTES = 8 << 20
VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item_id long, rank int, doc_id long, score long"


class Block:
    """Queries ready to score: term numbers with how often the query has them."""

    def __init__(self, texts: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.queries = [Counter(self.ids.setdefault(w, len(self.ids)) for w in words) for words in texts]


def blocks_of(items: DataFrame) -> Iterator[tuple[list, Block]]:
    """Ids and queries of the items with terms, in blocks of bounded size, one on the driver at a time."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if words := words_of(row[1]):
            ids.append(row[0])
            texts.append(words)
            size += len(words)
        if size >= BLOCK_WORDS:
            yield ids, Block(texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ids, Block(texts)


def term_vectors(docs: DataFrame, block: Block) -> DataFrame:
    """Each document's number of terms, and of those that the block has the numbers and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(block.ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = shared.value.get, len(shared.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                flat, n = [], np.zeros(part.num_rows, np.int64)
                for row, text in enumerate(part.column("text").to_pylist()):
                    words = words_of(text)
                    n[row] = len(words)
                    flat.append(np.array([get(w, -1) for w in words], np.int64))
                ids, rows = np.concatenate(flat), np.repeat(np.arange(part.num_rows), n)
                known = ids >= 0
                cells, tfs = np.unique(rows[known] * size + ids[known], return_counts=True)
                offsets = pa.array(np.searchsorted(cells, np.arange(part.num_rows + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (cells % size, tfs)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, VECTOR)


def document_frequencies(vectors: DataFrame, size: int) -> list[int]:
    """How many documents have each of the block's terms: a row to a term and task, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(df[has])], names=["term", "df"])

    out = [0] * size
    for term, df in vectors.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df")).collect():  # one row to a term of the block
        out[term] = df
    return out


class Postings:
    """Postings lists of a window: slots and weights by term, and the bits that a term sets in each word of the bitset."""

    def __init__(self, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, idf: np.ndarray, docs: int, words: int):
        self.size = len(n)
        slots = np.repeat(np.arange(self.size), np.diff(offsets))
        order = np.argsort(terms, kind="stable")  # slots ascend within a term
        terms, slots, tf = terms[order], slots[order], tfs[order].astype(np.int64)
        m = 100 - 75 + (75 * n * docs) // words
        self.slots, self.weights = slots, idf[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slots]))
        self.bounds = np.searchsorted(terms, np.arange(len(idf) + 1)).tolist()
        word = slots >> 6
        begins = np.flatnonzero(np.diff(terms, prepend=-1) | np.diff(word, prepend=-1))
        self.words = word[begins]
        self.bits = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), begins) if len(begins) else np.empty(0, np.uint64)
        self.word_bounds = np.searchsorted(begins, self.bounds).tolist()


class Scorer:
    """The sums and the bitset of one task, used for one window and query after the other, and the queries' heaps."""

    def __init__(self, queries: list[Counter], k: int, window: int = WINDOW):
        self.queries, self.k, self.seen = queries, k, 0
        self.sums, self.marks = np.zeros(window, np.int64), np.zeros((window + 63) // 64, np.uint64)
        self.heaps: list[list[tuple]] = [[] for _ in queries]

    def window(self, postings: Postings, doc_ids: list) -> None:
        sums, marks = self.sums, self.marks
        for query, heap in zip(self.queries, self.heaps):
            for term, times in query.items():
                a, b = postings.bounds[term], postings.bounds[term + 1]
                if a < b:
                    sums[postings.slots[a:b]] += postings.weights[a:b] * times  # a document is once in a term's list
                    a, b = postings.word_bounds[term], postings.word_bounds[term + 1]
                    marks[postings.words[a:b]] |= postings.bits[a:b]
            hit = np.flatnonzero(np.unpackbits(marks.view(np.uint8), bitorder="little"))
            if len(hit):
                self.harvest(heap, hit, sums[hit], doc_ids)
                sums[hit] = 0
                marks[:] = 0
        self.seen += postings.size

    def harvest(self, heap: list, hit: np.ndarray, scores: np.ndarray, doc_ids: list) -> None:
        """The window's best into the heap: documents come in the order of ids, so the earlier of equal ones stays."""
        over = scores > (heap[0][0] if len(heap) == self.k else 0)
        hit, scores = hit[over], scores[over]
        if len(hit) > self.k:
            least = np.partition(scores, len(scores) - self.k)[-self.k]
            best = np.flatnonzero(scores >= least)
            best = best[np.argsort(-scores[best], kind="stable")[: self.k]]
            hit, scores = hit[best], scores[best]
        for slot, score in zip(hit.tolist(), scores.tolist()):
            entry = (score, -(self.seen + slot), doc_ids[slot])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)


def windows_of(batches: Iterator[pa.RecordBatch], window: int = WINDOW, most: int = WINDOW_POSTINGS) -> Iterator[pa.Table]:
    """Rows of term vectors in their order, ``window`` at a time, or fewer if they hold many postings."""
    held, rows, postings = [], 0, 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, window - rows)
            held.append(part)
            at, rows = at + part.num_rows, rows + part.num_rows
            postings += len(part.column("terms").flatten())
            if rows == window or postings >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _best(vectors: DataFrame, block: Block, k: int, size: int, most: int) -> DataFrame:
    """(q, doc_id, score): each task's best documents of each query."""
    docs, words = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(vectors, len(block.ids))
    idf = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df], np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((block.queries, idf))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        scorer = Scorer(queries, k, size)
        for window in windows_of(batches, size, most):
            terms, tfs = (window.column(c).combine_chunks() for c in ("terms", "tfs"))
            terms, tfs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (terms, tfs))
            offsets = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
            found = Postings(window.column("n").to_numpy(), offsets, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), weights, docs, words)
            scorer.window(found, window.column("doc_id").to_pylist())
        rows = [(q, doc, s) for q, heap in enumerate(scorer.heaps) for s, _, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int64(), pa.int64()))], names=["q", "doc_id", "score"])

    order = F.col("doc_id").asc_nulls_last()
    dealt = vectors.where(F.size("terms") > 0).repartitionByRange(order).sortWithinPartitions(order)
    return dealt.mapInArrow(score, "q int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, window: int = WINDOW, window_postings: int = WINDOW_POSTINGS) -> DataFrame:
    """The k best documents(doc_id, text) for each of items(item_id, text): item_id, rank from 1, doc_id, score."""
    spark, out = docs.sparkSession, None
    for ids, block in blocks_of(items):
        vectors = materialize(term_vectors(docs, block), "term-vectors")
        names = spark.createDataFrame(list(enumerate(ids)), "q int, item_id long")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        best = _best(vectors, block, k, window, window_postings).withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], FOUND)

"""Phrase collocation mining: distinct pieces with multiplicities, n-grams counted out of core in DuckDB (operator 12).

Texts are cut into pieces at punctuation and line ends, and equal pieces of a language become one with a multiplicity.
Pieces are put together to batches of some million words, whose words are numbered once: a batch is a row, and a file,
of the numbers and of its own table of words, and no level splits texts again.
N-grams are counted level by level, one word to ``LONGEST``. A task sums the n-grams of a batch,
weighted by multiplicity, and deals the sums out by the n-gram's hash; each hash bucket is a task that sums them in
DuckDB, which spills to a scratch folder of the task beyond ``DUCKDB_MEMORY``. A phrase can't occur more often than
its parts, so the next level sums only n-grams both of whose shorter ones may have reached the threshold. A bitmap of
at most 2 ** ``FILTER_BITS`` hash bits tells the tasks which; being by hash, it may let others through but loses none.

Scores need the counts of a candidate's parts. Each cut of a candidate asks for two of them; the requests are shuffled
to the counts by language and part, and parts that very many candidates ask for are spread (``common.spread_join``).

Defined cases: a null text has no pieces, a null language is ``und``; rows that repeat count as often as they stand; a
piece of any length is one row, a text is never cut elsewhere; ties go by the phrase's bytes; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_path, slices, spread_join

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
#: A phrase goes if a longer candidate around it has at least this many of a hundred of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: A-Z lower-cased, and everything that ends a piece as a line feed.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\v\f\r" else b for b in range(256))
SLICE_BYTES = 8 << 20
#: Words and bytes of pieces to a batch; a slice of pieces is never divided.
BATCH_WORDS, BATCH_BYTES = 1_000_000, 32 << 20
FILTER_BITS = 28
#: Bits to a bitmap of Spark's bitmap functions.
BITMAP = 32768
DUCKDB_MEMORY = "256MB"
#: Parts of a language that are ranked on their own before the whole is.
SALTS = 64
COUNTED = "lang string, phrase string, h long, n long"
#: A batch: languages and how many words each has, counted with multiplicity; the words' bytes, ends, languages and
#: hashes; the number of each word of the pieces; the size and multiplicity of each piece. Integers are little-endian.
BATCH = "langs array<string>, totals array<long>, words binary, ends binary, lang_of binary, hashes binary, ids binary, sizes binary, times binary"


def pieces_of(text: str | None) -> list[bytes]:
    """Words of each piece that has any, joined by one space."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)
    # of what bytes.split() takes for white space only space and tab are left within a piece
    return [b" ".join(words) for piece in data.split(b"\n") if (words := piece.split())]


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, times): each distinct piece of a language once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found: dict[str, Counter] = defaultdict(Counter)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    found[lang].update(pieces_of(text))
                for lang, times in found.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(times), pa.string()), pa.array(list(times), pa.binary()).cast(pa.string()), pa.array(list(times.values()), pa.int64())], names=["lang", "piece", "times"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "lang string, piece string, times long").groupBy("lang", "piece").agg(F.sum("times").alias("times"))


class Filter:
    """The hashes that may belong to phrases of the last level; ``bits`` of a hash choose its bit."""

    def __init__(self, maps: dict[int, bytes], bits: int):
        self.bits, self.data = bits, np.zeros(1 << bits >> 3, np.uint8)
        for k, data in maps.items():
            self.data[k * BITMAP // 8 : (k + 1) * BITMAP // 8] = np.frombuffer(data, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_of(level: DataFrame) -> Filter:
    """A filter of a level's phrases with about 16 bits to a phrase, 2 ** FILTER_BITS at most."""
    bits = min(FILTER_BITS, max(15, math.ceil(math.log2(16 * max(1, level.count())))))
    at = F.shiftrightunsigned("h", 64 - bits)
    maps = level.groupBy(F.floor(at / BITMAP).alias("k")).agg(F.bitmap_construct_agg(at % BITMAP).alias("map"))
    return Filter({k: bytes(data) for k, data in maps.collect()}, bits)  # at most 2 ** bits / BITMAP rows of 4 KB


class Pieces:
    """Pieces with their multiplicities, until they are a batch."""

    def __init__(self):
        self.held: dict[str, list[tuple[pa.Array, np.ndarray, np.ndarray]]] = defaultdict(list)
        self.n = self.bytes = 0

    def add(self, lang: str, pieces: pa.Array, times: np.ndarray) -> None:
        """Pieces (bytes) of one language."""
        words = pc.split_pattern(pieces, b" ")
        self.held[lang].append((words.flatten(), pc.list_value_length(words).to_numpy(), times))
        self.n += len(self.held[lang][-1][0])
        self.bytes += pieces.nbytes

    def batch(self) -> pa.RecordBatch:
        """A row of BATCH."""
        langs, totals, tables, lang_of, hashes, ids, sizes, times, first = list(self.held), [], [], [], [], [], [], [], 0
        for k, lang in enumerate(langs):
            words, n, own = (list(x) for x in zip(*self.held.pop(lang)))
            coded = pa.concat_arrays(words).dictionary_encode()
            del words
            table, seed = coded.dictionary, xxhash.xxh64_intdigest(lang.encode())
            tables += table.to_pylist()
            hashes.append(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in tables[first:]), np.uint64, len(table)))
            lang_of.append(np.full(len(table), k, np.int32))
            ids.append(coded.indices.to_numpy() + np.int32(first))
            sizes += n
            times += own
            totals.append(int(sum(int((a.astype(np.int64) * t).sum()) for a, t in zip(n, own))))
            first += len(table)
        ends = np.cumsum([len(w) for w in tables], dtype=np.int64)
        parts = [ends, np.concatenate(lang_of), np.concatenate(hashes), np.concatenate(ids), np.concatenate(sizes).astype(np.int32), np.concatenate(times).astype(np.int64)]
        columns = [pa.array([langs], pa.list_(pa.string())), pa.array([totals], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (b"".join(tables), *(x.tobytes() for x in parts)))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BATCH.split(", ")])


class Words:
    """A batch's words as numbers, with the weight of each and how many words follow in its piece."""

    def __init__(self, row: pa.RecordBatch):
        data = lambda c, kind: np.frombuffer(row.column(c)[0].as_buffer(), kind)
        self.langs, ends = row.column("langs")[0].as_py(), data("ends", "<i8")
        offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
        self.table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, offsets, row.column("words")[0].as_buffer()])
        self.lang_of, self.hashes, self.ids = data("lang_of", "<i4"), data("hashes", "<u8"), data("ids", "<i4").astype(np.int64)
        self.sizes, self.times = data("sizes", "<i4").astype(np.int64), data("times", "<i8")

    def sums(self, size: int, known: Filter | None) -> Iterator[pa.RecordBatch]:
        """Weighted counts of the n-grams of ``size`` words whose shorter ones the filter has."""
        hashes, ids, sizes, words = self.hashes, self.ids, self.sizes, len(self.lang_of)
        times = np.repeat(self.times, sizes)
        if size == 1:
            n = np.zeros(words, np.int64)
            np.add.at(n, ids, times)
            return self.phrases(np.arange(words), np.arange(words), n, 1)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
        at = np.flatnonzero(left >= size)
        if known is not None:
            shorter = np.flatnonzero(left >= size - 1)
            may = np.zeros(len(ids) + 1, bool)
            may[shorter] = known.has(self.mixed(hashes, ids, shorter, size - 1))
            at = at[may[at] & may[at + 1]]
        first, n = self.grouped(ids, at, size, words, times[at])
        return self.phrases(ids, first, n, size)

    def phrases(self, ids: np.ndarray, first: np.ndarray, n: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        """Rows of COUNTED: the n-grams at places ``first`` of ids, and their counts."""
        langs = pa.array(self.langs, pa.string())
        for part in range(0, len(first), 100_000):
            p = first[part : part + 100_000]
            phrase = pc.binary_join_element_wise(*(self.table.take(pa.array(ids[p + j])) for j in range(size)), pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
            lang = langs.take(pa.array(self.lang_of[ids[p]]))
            yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(self.mixed(self.hashes, ids, p, size).view(np.int64)), pa.array(n[part : part + 100_000])], names=["lang", "phrase", "h", "n"])

    @staticmethod
    def grouped(ids: np.ndarray, at: np.ndarray, size: int, words: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct n-gram, and the sum of its weights. N-grams are told apart by their words' numbers
        as digits; a prefix is numbered anew where the next digit would pass 63 bits."""
        code, most = ids[at], max(1, words)
        for j in range(1, size):
            if most * words >= 1 << 63:
                code = np.unique(code, return_inverse=True)[1]
                most = len(at)
            code, most = code * words + ids[at + j], most * words
        order = np.argsort(code)
        code = code[order]
        begins = np.flatnonzero(np.diff(code, prepend=-1))
        return at[order[begins]], np.add.reduceat(times[order], begins) if len(begins) else np.empty(0, np.int64)

    @staticmethod
    def mixed(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """A hash of each n-gram from those of its words."""
        h = hashes[ids[at]].copy()
        for j in range(1, size):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[ids[at + j]]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)


def numbered(distinct: DataFrame) -> DataFrame:
    """Batches of distinct(lang, piece, times); see BATCH."""
    most, most_bytes = BATCH_WORDS, BATCH_BYTES

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Pieces()
        for batch in batches:
            for part in slices(batch, "piece", SLICE_BYTES // 4):
                for lang in part.column("lang").unique():
                    own = part.filter(pc.equal(part.column("lang"), lang))
                    held.add(lang.as_py(), own.column("piece"), own.column("times").to_numpy())
                if held.n >= most or held.bytes >= most_bytes:
                    yield held.batch()
                    held = Pieces()
        if held.n:
            yield held.batch()

    return distinct.select("lang", F.encode("piece", "UTF-8").alias("piece"), "times").mapInArrow(number, BATCH)


def count_level(distinct: DataFrame, size: int, known: Filter | None, least: int) -> DataFrame:
    """(lang, phrase, h, n) of the n-grams of ``size`` words of distinct pieces with at least ``least`` occurrences."""
    return count_batches(numbered(distinct), size, known, least)


def count_batches(rows: DataFrame, size: int, known: Filter | None, least: int) -> DataFrame:
    """(lang, phrase, h, n) of the n-grams of ``size`` words of numbered batches with at least ``least`` occurrences."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from Words(batch.slice(k, 1)).sums(size, shared.value)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("n", pa.int64())])
        # scratch of this task alone, as Spark's own spill files are; nothing reads it once the task has ended
        with tempfile.TemporaryDirectory(prefix="ngrams-") as scratch, duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
            con.register("partial", pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches)))
            yield from con.sql(f"SELECT lang, phrase, min(h) AS h, CAST(sum(n) AS BIGINT) AS n FROM partial GROUP BY lang, phrase HAVING sum(n) >= {int(least)}").to_arrow_reader(100_000)

    return rows.mapInArrow(partial, COUNTED).repartition("h").mapInArrow(bucket, COUNTED)


def phrase_counts(rows: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, h, n, size) of all n-grams of numbered batches up to ``longest`` words with at least ``least`` occurrences."""
    out, known = None, None
    for size in range(1, longest + 1):
        level = materialize(count_batches(rows, size, known, least).withColumn("size", F.lit(size)), f"ngrams-{size}")
        out, known = level if out is None else out.unionByName(level), filter_of(level)
    return out


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, size, a) with l, r and score of their lowest cut."""
    key = lambda phrase: F.concat(F.col("lang"), F.lit("\t"), phrase)
    words = F.split("phrase", " ")
    part = lambda begin, length: F.array_join(F.slice(words, begin, length), " ")
    cuts = counts.where("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = F.array(F.struct(F.lit(True).alias("first"), key(part(F.lit(1), F.col("k"))).alias("key")), F.struct(F.lit(False).alias("first"), key(part(F.col("k") + 1, F.col("size") - F.col("k"))).alias("key")))
    requests = cuts.select("lang", "phrase", "size", F.col("n").alias("a"), "k", F.inline(sides))
    requests = materialize(requests, "part-requests")
    asked = requests.groupBy("key").agg(F.count("*").alias("asks"))
    side = materialize(asked.join(counts.select(key(F.col("phrase")).alias("key"), F.col("n").alias("f")), "key"), "part-counts")
    found = spread_join(requests, side, "key", "asks", requests.count())
    found = found.groupBy("lang", "phrase", "size", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    score = F.expr(f"CAST((CAST({SCALE} AS DECIMAL(8, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + r) AS BIGINT)")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return found.groupBy("lang", "phrase", "size", "a").agg(least).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def without_covered(found: DataFrame, counts: DataFrame) -> DataFrame:
    """found without phrases that a longer candidate holds and covers."""
    words, size = F.split("phrase", " "), F.col("size")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda k: F.array_join(F.slice(words, k, n), " "))))
    inner = counts.where("size > 2").select("lang", F.col("n"), F.explode(F.array_distinct(spans)).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    return found.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < COVERED * F.col("a"))).drop("around")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Each language's best phrases of docs(text, lang): lang, rank, phrase, a, l, r, n, score."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "batches")
    numbered(pieces(docs)).write.option("maxRecordsPerFile", 1).parquet(path)  # so that no reader holds many at once
    rows = spark.read.schema(BATCH).parquet(path)
    counts = phrase_counts(rows, longest, least)
    found = without_covered(scored(counts), counts)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each part of a language first, so that no task ranks all of a language's phrases
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = found.withColumn("_salt", salt).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = rows.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))
    return best.join(F.broadcast(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

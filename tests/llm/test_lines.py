"""Operator 11: brute force over odd texts, hot lines over many ranges, first occurrences, bitmaps."""

from collections import defaultdict

import pytest

from epiframe.llm import lines

SPACE = " \t\n\v\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least, chars=1, keep_first=False):
    """rows: (doc_id, text, ...) -> sorted (doc_id, n_lines, n_dropped, kept text)."""
    found, first = defaultdict(set), {}
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0))
    for r in order:
        for k, line in enumerate((rows[r][1] or "").split("\n")):
            if len(key := key_of(line)) >= chars:
                found[key].add(r)
                first.setdefault(key, (r, k))
    out = []
    for r, (doc, text, *_) in enumerate(rows):
        cut = (text or "").split("\n")
        stay = [x for k, x in enumerate(cut) if len(key_of(x)) < chars or len(found[key_of(x)]) < least or keep_first and first[key_of(x)] == (r, k)]
        out.append((doc, len(cut), len(cut) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def run(df, **options):
    return sorted((tuple(r) for r in lines.drop_lines(df, **options).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


ODD = [
    (1, "A\nb\n\nA "), (2, "\ta\n\x0bB\r\nc"), (3, "a\n\n\n"), (4, None), (5, ""), (6, "É\né\nA"), (None, "a\nlast"), (None, None), (7, "a\x00\na\nß"), (8, "\n"), (9, "x" * 300_000 + "\nA\n" + "long line " * 50_000),
    (10, "b\r\nB\n b"), (11, " a\nÉ"), (12, "only one"), (12, "a\nother text of one id"),
]


@pytest.mark.parametrize("least, chars, keep_first", [(2, 1, False), (3, 1, False), (2, 2, False), (2, 1, True), (1, 1, True), (1, 1, False), (3, 1, True)])
def test_odd_texts(spark, least, chars, keep_first):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    assert run(df, min_docs=least, min_chars=chars, keep_first=keep_first) == brute(ODD, least, chars, keep_first)


def test_repeated_rows_are_documents(spark):
    rows = [(1, "a\nb")] * 9 + [(2, "a\nc")] + [(3, "b\nc")] * 2
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 10)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_hot_lines_over_many_ranges(spark, monkeypatch, ranges, keep_first):
    """A line of a third of all documents fills several ranges; others lie on both sides of an edge."""
    rows = [(k, "\n".join(["Hot"] * (k % 3 == 0) + [f"few {k % 40}", f"ten {k // 10}", f"nine {k // 9}", f"own {k}"] + ["hot"] * (k % 7 == 0))) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spread = lambda e: e.repartitionByRange(ranges, "h1", "h2", "doc_id", "digest")
    plain = lines._streamed

    class Dealt:
        def __init__(self, e):
            self.e = e

        def repartitionByRange(self, *columns):
            return spread(self.e)

    monkeypatch.setattr(lines, "_streamed", lambda e, least: plain(Dealt(e), least))
    assert run(df, keep_first=keep_first) == brute(rows, 10, 1, keep_first)
    found = plain(Dealt(lines.line_entries(df)), 10)
    assert found.where("kind = 'edge'").count() <= 2 * ranges
    assert found.where("kind = 'held'").count() <= 2 * 9 * ranges


def test_bitmaps_joined_by_shuffle_and_broadcast(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in df.collect()], 2)
    assert run(df, min_docs=2) == want
    monkeypatch.setattr(lines, "small_side", lambda df, weight=None: df)
    assert run(df, min_docs=2) == want


def test_bitmap_only_where_a_line_goes(spark):
    rows = [(k, f"same\nown {k}\nmore {k}") for k in range(12)] + [(99, "nothing\nshared")]
    found = {r.doc_id: lines.unpack(r.keep, r.n_lines).tolist() for r in lines.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: [False, True, True] for k in range(12)}


def test_empty_and_clashing_columns(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
    names = ["doc_id", "text", "_id", "_digest", "digest", "keep", "n_lines", "h1", "KEY"]
    df = spark.createDataFrame([(k, "x\ny", 1, 2, "d", "k", 5, 6, "z") for k in range(10)], names)
    out = lines.drop_lines(df)
    assert out.columns == [*(c for c in names if c != "n_lines"), "n_lines", "n_dropped", "kept_text"]
    assert {tuple(r)[2:] for r in out.collect()} == {(1, 2, "d", "k", 6, "z", 2, 2, "")}

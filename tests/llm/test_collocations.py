"""Operator 12: brute force over odd texts, filters, hot parts, counts beyond 64 bits."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from epiframe.llm import collocations as c


def brute(rows, least, top):
    """rows: (text, lang) -> sorted (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + size]) for size in range(1, 5) for i in range(len(words) - size + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    gone = {(g[0], *g[i:j]) for g, a in found.items() for i in range(1, len(g)) for j in range(i + 2, len(g) + 1) if (i, j) != (1, len(g)) if 100 * a >= 80 * f[(g[0], *g[i:j])]}
    best = {}
    for g, a in found.items():
        if g not in gone:
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[(g[0], *g[k:])]), k, f[g[:k]], f[(g[0], *g[k:])]) for k in range(2, len(g)))
            best.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, x in best.items() for rank, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def run(df, least, top=2000):
    return sorted(tuple(r) for r in c.collocations(df, least=least, top=top).collect())


ODD = [
    (None, "en"), ("", None), ("A b\tc. a B c, a b c", None), ("a b c\x0bé é é é é", "und"), ("New York City\nnew  york city!NEW YORK city; york new", "en"), ("x\x00y z x\x00y z" * 3, "en"), (" \t . ;", "en"),
    ("ß É é\r\nß É é ß É", "d e"), ("same same same same same", "en"), ("w" * 100_000 + " " + "w" * 100_000, "en"), ("no break at all " * 20_000, "long"), ("a\x1cb a\x1cb a\x1cb\xa0 c", "fr"),
]


@pytest.mark.parametrize("least, top", [(1, 2000), (2, 2000), (3, 4)])
def test_odd_texts(spark, least, top):
    df = spark.createDataFrame(ODD, "text string, lang string").repartition(3)
    assert run(df, least, top) == brute(ODD, least, top)


@pytest.mark.parametrize("words", [50, 1 << 30])
def test_random_texts(spark, monkeypatch, words):
    """Few words, so that counts tie and phrases cover one another; a third of the rows are one text; sums of small batches."""
    monkeypatch.setattr(c, "BATCH_WORDS", words)
    rng = random.Random(7)
    text = lambda: " ".join(rng.choices(["the", "of", "new", "york", "a", "b", "the,", "b."], [9, 7, 2, 2, 1, 1, 2, 1], k=rng.randrange(30)))
    rows = [(text(), rng.choice(["en", "en", "de", None])) for _ in range(300)] + [("of the new york times, a b", "en")] * 150
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert run(df, 12, 25) == brute(rows, 12, 25)


def test_clash_and_empty(spark):
    assert run(spark.createDataFrame([], "text string, lang string"), 1) == []
    rows = [("a b a b", "x", 1, 2.0, "p", 3, 4, "k")] * 3
    assert run(spark.createDataFrame(rows, "text string, lang string, n int, h double, phrase string, _salt int, rank int, key string"), 2) == brute(rows, 2, 2000)


def test_products_beyond_64_bits(spark):
    a = 6_000_000_000_000
    rows = [("en", "big", 0, 2 * a, 1), ("en", "one", 0, a + 1, 1), ("en", "big one", 0, a, 2)]
    found = c.scored(spark.createDataFrame(rows, "lang string, phrase string, h long, n long, size int")).collect()
    assert [tuple(r) for r in found] == [("en", "big one", 2, a, 2 * a, a + 1, 2_000_000 * a // (3 * a + 1))]


def test_filter_has_all(spark):
    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    found = c.filter_of(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert found.has(h.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 100_000)
    assert 0.01 < found.has(other.view(np.uint64)).mean() < 0.12


def test_buckets_spill(spark, monkeypatch):
    """Counts of more distinct n-grams than DuckDB may hold in memory."""
    monkeypatch.setattr(c, "DUCKDB_MEMORY", "24MB")
    df = spark.range(200_000).selectExpr("'en' AS lang", "concat('word', id, ' of number', id % 50) AS piece", "3L AS times").coalesce(1)
    found = c.count_level(df, 1, None, 5).orderBy("phrase").select("phrase", "n").collect()
    assert [tuple(r) for r in found] == sorted([("of", 600_000), *((f"number{k}", 12_000) for k in range(50))])


def test_levels_read_numbered_batches(spark, monkeypatch):
    """A batch holds its words once, as a table of its own, and no level splits pieces again."""
    monkeypatch.setattr(c, "BATCH_WORDS", 1)
    rows = [("en", "new york new york", 3), ("en", "york", 2), ("d e", "new", 1)]
    found = c.numbered(spark.createDataFrame(rows, "lang string, piece string, times long").coalesce(1))
    assert "piece" not in found.columns
    got = found.collect()
    assert [(r.langs, r.totals, bytes(r.words), np.frombuffer(r.ids, "<i4").tolist(), np.frombuffer(r.sizes, "<i4").tolist()) for r in got] == [(["en", "d e"], [14, 1], b"newyorknew", [0, 1, 0, 1, 1, 2], [4, 1, 1])]
    counts = {(r.lang, r.phrase): r.n for r in c.phrase_counts(found, 2, 1).collect()}
    assert counts == {("en", "new"): 6, ("en", "york"): 8, ("d e", "new"): 1, ("en", "new york"): 6, ("en", "york new"): 3}

"""Operator 6 against every window of every document."""

import hashlib
import random
import re

import numpy as np
import pytest

from epiframe.llm import substrings


def brute(rows, size=50):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    low = {}
    for d, w in split:
        for k in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[k : k + size])
                low[key] = min(d, low.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if d is not None and low[tuple(w[k : k + size])] < d:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int")
    return sorted((tuple(r) for r in substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("seed, words", [(1, 3), (2, 50), (3, 5000)])
def test_random(spark, seed, words, monkeypatch):
    r = random.Random(seed)
    pick = lambda n: [f"é{r.randrange(words)}" for _ in range(n)]
    shared = [pick(n) for n in (49, 50, 51, 80, 200, 400)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randrange(5)):
            s = r.choice(shared)
            a = r.randrange(len(s) // 2)
            w += pick(r.randrange(60)) + (s if r.random() < 0.5 else s[a : a + r.randrange(len(s))])
        if w and r.random() < 0.3:
            w[r.randrange(len(w))] = "edit"
        rows.append((d, r.choice([" ", "\n", "\t "]).join(w)))
    r.shuffle(rows)
    rows += [(70, None), (71, ""), (None, " ".join(shared[4])), (3, rows[0][1]), (3, rows[0][1]), (72, "a " * 400), (73, "a " * 99)]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(substrings, "SLICE", 500)
    monkeypatch.setattr(substrings, "small_side", lambda df, weight=None: df)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("kmer", [substrings.WINDOW, 49, 1])
def test_dense_graph(spark, kmer):
    """Every window an edge, and other lengths of k-mers: the same words go."""
    r = random.Random(kmer)
    shared = [[f"w{r.randrange(900)}" for _ in range(n)] for n in (50, 64, 130)]
    rows = [(d, " ".join([f"w{r.randrange(900)}" for _ in range(r.randrange(40))] + r.choice(shared)[r.randrange(6) :] + [f"w{r.randrange(900)}" for _ in range(r.randrange(9))])) for d in range(40)] + [(50, "x " * 300), (51, "x " * 70), (52, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in substrings.remove_repeats(df, kmer).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute(rows) and any(x[2] for x in got)
    with pytest.raises(ValueError, match="1 to 50"):
        substrings.remove_repeats(df, 51)


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_unequal_words_of_one_short_hash(spark):
    """Words that a polynomial modulo 2^64 can't tell apart, whatever its multiplier: only their digests differ."""
    word, other = "a", "b"
    for _ in range(10):
        word, other = word + other, other + word
    one, two = (substrings.Spans(np.frombuffer(w.encode(), np.uint8).astype(np.uint64) + np.uint64(1), substrings.ODD1)(np.array([0]), np.array([len(w)])) for w in (word, other))
    assert word != other and one == two
    fill = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join([*fill, word, *fill])), (2, " ".join([*fill, other, *fill]))]
    assert [r[2] for r in run(spark, rows)] == [0, 0] and run(spark, rows) == brute(rows)


def test_long_paths_compact(spark):
    """A passage of many edges is one path, and a branch in the middle of it parts it."""
    r = random.Random(5)
    long = [f"x{r.randrange(10**6)}" for _ in range(2000)]
    rows = [(k, " ".join([f"p{k}", *long, f"q{k}"])) for k in range(5)] + [(9, " ".join(long[:1000]))]
    assert run(spark, rows) == brute(rows)
    paths = substrings.repeated_paths(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = [p for p in paths if p.edges and p.doc_id == 4]
    assert max(p.edges for p in whole) > 20 and len(whole) <= 6 and all(p.source_id == 0 for p in whole)


def test_clashing_names(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(60)), "a", "b", "c"), (2, " ".join(f"w{k}" for k in range(60)), "d", "e", "f")]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, _doc string, _CUTS string, _row string")).collect()
    assert sorted((r.doc_id, r.n_removed, r["_doc"], r["_CUTS"], r["_row"]) for r in out) == [(1, 0, "a", "b", "c"), (2, 60, "d", "e", "f")]


def test_empty(spark):
    assert run(spark, []) == []

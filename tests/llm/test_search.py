"""Operator 13: brute force over odd texts, windows, blocks and ties."""

import math
import random
import re
from collections import Counter

import pytest

from epiframe.llm import search as s


def terms(text):
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score)."""
    cut = [(d, Counter(terms(t))) for d, t, *_ in docs]
    total, words = sum(1 for _, c in cut if c), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text, *_ in items:
        scores = []
        for doc, c in cut:
            if c:
                m = 100 - 75 + (75 * sum(c.values()) * total) // words
                score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -x) for rank, (x, _, _, doc) in enumerate(sorted(y for y in scores if y[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def run(docs, items, k=10, **options):
    return sorted((tuple(r) for r in s.search(docs, items, k, **options).collect()), key=str)


DOCS = [
    (5, "the cat sat"), (-3, "The CAT"), (4, None), (6, ""), (7, "... !"), (None, "the cat"), (8, "é É cat_dog cat"), (9, "the " * 50_000 + "rare"), (9, "the cat"), (1 << 62, "cat cat cat the"), (-(1 << 62), "the cat"),
    (10, "a-b a1 1a"), (11, "ünï\x00cat"), (12, "the cat"), (13, "the the the the"),
]
ITEMS = [(1, "the cat"), (2, "cat CAT rare"), (3, None), (4, ""), (5, "nowhere"), (6, "É ünï 1a b"), (None, "sat"), (7, "the cat"), (7, "dog"), (8, "the " * 30)]


@pytest.mark.parametrize("window, postings, block, k", [(1 << 15, 8_000_000, 2_000_000, 10), (3, 8_000_000, 2, 10), (64, 4, 5, 2), (1, 1, 1, 1)])
def test_odd_texts(spark, monkeypatch, window, postings, block, k):
    monkeypatch.setattr(s, "BLOCK_WORDS", block)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    assert run(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), k, window=window, window_postings=postings) == brute(DOCS, ITEMS, k)


@pytest.mark.parametrize("window", [100, 1 << 15])
def test_many_ties(spark, window):
    """A third of the documents are copies, so that equal scores go over the edges of windows and tasks."""
    rng = random.Random(3)
    docs = [(k * 7 - 900, "copy of one text" if k % 3 == 0 else " ".join(rng.choices("abcdefgh", k=rng.randrange(9)))) for k in range(1500)]
    items = [(k, " ".join(rng.choices("abcdefghx", k=rng.randrange(6)))) for k in range(40)] + [(100, "one copy"), (101, "text a")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert run(df, spark.createDataFrame(items, "item_id long, text string"), window=window) == brute(docs, items)


def test_weight_of_a_term_in_all_documents_may_be_nought(spark):
    docs = [(k, "all") for k in range(3000)] + [(5000, "all other")]
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "all"), (2, "other")], "item_id long, text string")) == brute(docs, [(1, "all"), (2, "other")])


def test_empty_and_clashing_columns(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert run(docs, items) == []
    some = spark.createDataFrame([(*r, 1, 2, "x") for r in DOCS], "doc_id long, text string, n int, item_id int, terms string")
    assert run(some, items.limit(0)) == []
    more = spark.createDataFrame([(*r, 3, 4) for r in ITEMS], "item_id long, text string, doc_id int, rank int")
    assert run(some, more) == brute(DOCS, ITEMS)

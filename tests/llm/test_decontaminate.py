"""Operator 2 against every window compared with every position."""

import hashlib
import random
import re

from epiframe.llm import decontaminate

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            v = words(t)
            n = min(10, len(v))
            if i is None or not n:
                continue
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(i)
        s = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(s.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    df = decontaminate.mark_contaminated(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_random_words(spark, monkeypatch):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("a b c É-x D7".split()) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 2, 3, 4, 5, 9, 10, 11, 14, 30]) + 3 * (k > 9))) for k in range(40)] + [(None, "a"), (3, text(12)), (77, None), (78, "!!")]
    docs = [(k, text(r.choice([0, 1, 5, 40, 1500]))) for k in range(60)] + [(1, None), (1, ""), (None, text(30))]
    items = [(i, t) for i, t in items if len(words(t)) == 0 or len(words(t)) > 6]
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    assert run(spark, docs, items) == brute(docs, items)


def test_short_items_and_empty(spark):
    docs = [(1, "one two THREE four"), (2, "two"), (3, None)]
    items = [(10, "Two three"), (9, "four"), (100, "one, two")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert any(r[-1] for r in got)


def test_clashing_names_and_very_long_texts(spark):
    """Columns of the caller's stay, but for those of results; a window at the end of a long text is found."""
    passage = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, "x " * 600_000 + passage, 7, "a", "b"), (2, None, 7, "a", "b")], "doc_id long, text string, n_hit int, item_id string, ids string")
    items = spark.createDataFrame([(5, passage, "z", 1)], "item_id long, text string, n_words string, doc_id int")
    rows = {r.doc_id: r for r in decontaminate.mark_contaminated(docs, items).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].item_id, rows[1].ids) == (600_012, 12, "a", "b") and (rows[2].n_words, rows[2].contaminated) == (0, False)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "one two three four")] * 3, "doc_id long, text string")
    items = spark.createDataFrame([(4, "two three")] * 2 + [(3, "two three")], "item_id long, text string")
    assert {(r.n_hit, r.n_items, tuple(r["items"])) for r in decontaminate.mark_contaminated(docs, items).collect()} == {(2, 2, (3, 4))}

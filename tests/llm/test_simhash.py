"""Operator 8: fingerprints against plain Python, components against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from epiframe.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(rows, radius=3):
    """rows (doc_id, fp); the smallest id reachable per row."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for d, f in rows:
        r = find(f)
        low[r] = min([x for x in (low.get(r), d) if x is not None], default=None)
    return sorted(((d, low[find(f)]) for d, f in rows), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, int(np.uint64(f).view(np.int64))) for d, f in rows], "doc_id long, fp long")
    return sorted((tuple(r) for r in simhash.with_component(df).select("doc_id", "component_id").collect()), key=str)


def test_fingerprints(spark, sf):
    texts = [None, "", " \n", "One", "one TWO", "a b c", "A b c d", "é x y  z\x1cw É", "x " * 4000]
    rows = list(enumerate(texts)) + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = simhash.with_fingerprint(spark.createDataFrame([(d, t, "e") for d, t in rows], "doc_id long, text string, fp string")).collect()
    assert sorted((r.doc_id, int(np.int64(r.fp).view(np.uint64))) for r in got) == sorted((d, brute_fingerprint(t)) for d, t in rows)


@pytest.mark.parametrize("m, block", [(None, 4096), (3, 4096), (2, 4096), (4, 3)])
def test_components(spark, monkeypatch, m, block):
    r = np.random.default_rng(5)
    monkeypatch.setattr(simhash, "BLOCK", block)
    if m:
        monkeypatch.setattr(simhash.Plan, "_partition", staticmethod(lambda sample, _: [list(range(64))[k::m] for k in range(m)]))
        monkeypatch.setattr(simhash.np, "log2", simhash.np.log2)
        bits = {4: 14, 3: 23, 2: 33}[m]
        first = simhash.Plan.__init__
        monkeypatch.setattr(simhash.Plan, "__init__", lambda self, sample, total, radius=3: first(self, sample, 2**bits, radius))
    fps = [int(x) for x in r.integers(0, 2**63, 40, dtype=np.uint64)]
    for _ in range(500):  # chains and dense groups a few bits apart, all sharing many bits
        f = fps[r.integers(len(fps))]
        for b in r.choice(64, r.integers(0, 6), replace=False):
            f ^= 1 << int(b)
        fps.append(f)
    rows = [(int(k), f) for k, f in zip(r.permutation(len(fps)), fps)] + [(3, fps[0]), (None, fps[5]), (None, 2**63 + 12345), (7, fps[1])]
    assert run(spark, rows) == brute_components(rows)


@pytest.mark.parametrize("hot_keys", [1, 8, 1000])
def test_hot_keys(spark, monkeypatch, hot_keys):
    """A fingerprint with a third of all rows and a hub with many near copies, joined by shuffle, in part and by broadcast."""
    from epiframe.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    r = np.random.default_rng(9)
    hub = int(r.integers(0, 2**63, dtype=np.uint64))
    near = [hub ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 64, (60, 2))]
    fps = near + [hub] * 120 + [int(x) for x in r.integers(0, 2**63, 180, dtype=np.uint64)]
    rows = [(int(k), f) for k, f in zip(r.permutation(len(fps)), fps)] + [(None, hub), (4, hub)]
    assert run(spark, rows) == brute_components(rows)


def test_thresholds_sum():
    r = np.random.default_rng(1)
    fps = r.integers(0, 2**63, 300, dtype=np.uint64)
    plan = simhash.Plan(np.sort(fps), 10**6)
    t = plan.thresholds(fps)
    assert (t.sum(1) == 3 - plan.m + 1).all() and t.min() >= -1


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 0), (2, 0), (3, 7), (4, 15)]) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_query(spark, sf):
    from epiframe.llm.queries import op8_simhash

    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op8_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in rows}
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute_components(rows)


def test_stars_are_done(spark, monkeypatch):
    """Edges that are stars, their center the smallest node, are found out by one table of lowest neighbours."""
    written = []
    monkeypatch.setattr(simhash, "materialize", lambda df, name, write=simhash.materialize: written.append(name) or write(df, name))
    edges = [(9, 1), (1, 8), (7, 1), (20, 10)]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(7, 1), (8, 1), (9, 1), (20, 10)]
    assert written == ["edges", "lowest"]


def test_chain_becomes_star(spark):
    got = simhash.components(spark.createDataFrame([(k, k + 1) for k in range(-20, 20)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(k, -20) for k in range(-19, 21)]


def test_plan_memory():
    """The driver correlates bits of the sample a block at a time."""
    import tracemalloc

    sample = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 50_000).astype(np.uint64))
    tracemalloc.start()
    simhash.Plan(sample, 1_000_000)
    assert tracemalloc.get_traced_memory()[1] < 20e6

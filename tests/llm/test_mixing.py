"""Operator 10 against raking in numpy."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.llm import mixing


def goals(have, temper=mixing.TEMPER, keep=mixing.KEEP):
    """Tempered shares of the tokens to keep, within what each value has: by bisection."""
    have = np.array(have, float)
    share = (have / have.sum()) ** temper
    low, high = 0.0, 1e6 * have.sum()
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if np.minimum(have, middle * share).sum() < keep * have.sum() else (low, middle)
    return np.minimum(have, high * share)


def rake(cells, rounds=mixing.ROUNDS):
    """Expected tokens of cells {(source, lang, topic): tokens}."""
    keys = list(cells)
    tokens = np.array([cells[k] for k in keys], float)
    member, goal = [], []
    for d in range(3):
        values = sorted({k[d] for k in keys}, key=str)
        member.append(np.array([values.index(k[d]) for k in keys]))
        goal.append(goals(np.bincount(member[d], tokens)))
    weight = mixing.KEEP * tokens
    for _ in range(rounds):
        for d in range(3):
            total = np.bincount(member[d], weight)
            factor = np.divide(goal[d], total, out=np.zeros_like(total), where=total > 0)
            weight = np.minimum(tokens, weight * factor[member[d]])
    return dict(zip(keys, weight)), [np.abs(np.bincount(m, weight) - g).max() / tokens.sum() for m, g in zip(member, goal)]


def test_raking_equals_numpy(spark):
    rng = np.random.default_rng(2)
    cells = {(None if s == 3 else f"s{s}", l, t): int(rng.pareto(1) * 1000) + (s == 0) * 50_000 for s in range(9) for l in ("en", "de", None) for t in ("note", "long", "article") if rng.random() < 0.8}
    cells[("void", "en", "empty")] = 0
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    want, off = rake(cells)
    got = {(r.source, r.lang, r.topic): r for r in mixing.rake(df).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r.weight == pytest.approx(want[k], rel=1e-6, abs=1e-3) and 0 <= r.weight <= r.tokens
        assert r.probability == pytest.approx(want[k] / cells[k] if cells[k] else 1, rel=1e-6)


def test_margins_of_documents(spark, sf):
    """Sums of sources, languages and topics are at their goals within 1 % of the kept tokens; goals are the targets
    wherever a value has enough tokens, or get what others lack."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rated = mixing.rake(mixing.cells_of(mixing.with_topic(docs)))
    rows = mixing.margins(rated).collect()
    kept = mixing.KEEP * sum(r.tokens for r in rows if r.dimension == "topic")
    for d in mixing.DIMENSIONS:
        assert sum(r.goal for r in rows if r.dimension == d) == pytest.approx(kept, rel=1e-9)
    for r in rows:
        assert r.expected == pytest.approx(r.goal, abs=0.01 * kept), r
        assert r.goal == pytest.approx(r.tokens) or r.goal >= r.target * (1 - 1e-9), r


def test_sampling(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.sampled == (int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32 < r.probability)
    expected, real = defaultdict(float), defaultdict(float)
    for r in rows:
        expected[r.lang] += r.probability * r.n_tokens
        real[r.lang] += r.sampled * r.n_tokens
    assert sum(real.values()) == pytest.approx(sum(expected.values()), rel=0.2)


def test_odd_tables(spark):
    long = "word " * 200_000
    rows = [(1, None, None, None, "x", "y"), (None, "", "en", "a", "x", None), (2, long, "en", "a", None, "y"), (2, long, "en", "a", None, "y"), (3, "one two", "de", "b", "x", "y"), (4, "one | two | three", "de", None, "x", "y")]
    schema = "doc_id long, text string, lang string, source string, _source string, _lang string"
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r.n_tokens, r["_source"], r["_lang"]) for r in got if r.doc_id) == [(1, 0, "x", "y"), (2, 200_000, None, "y"), (2, 200_000, None, "y"), (3, 2, "x", "y"), (4, 5, "x", "y")]
    assert {r.topic for r in got if not r.n_tokens} == {"empty"} and all(r.sampled for r in got if not r.n_tokens)
    assert len({(r.probability, r.sampled) for r in got if r.doc_id == 2}) == 1
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []


def wanted(cells, targets, rounds, keep=mixing.KEEP):
    """Raking in numpy to given weights; dimensions without any have tempered shares."""
    keys = list(cells)
    tokens = np.array([cells[k] for k in keys], float)
    member, goal = [], []
    for d, name in enumerate(mixing.DIMENSIONS):
        values = sorted({k[d] for k in keys}, key=str)
        member.append(np.array([values.index(k[d]) for k in keys]))
        have = np.bincount(member[d], tokens)
        share = np.array([targets[name].get(v, 0.0) for v in values]) if name in targets else (have / have.sum()) ** mixing.TEMPER
        low, high = 0.0, 1e9 * have.sum()
        for _ in range(300):
            middle = (low + high) / 2
            low, high = (middle, high) if np.minimum(have, middle * share).sum() < keep * have.sum() else (low, middle)
        goal.append(np.minimum(have, high * share))
    weight = keep * tokens
    for _ in range(rounds):
        for d in range(3):
            total = np.bincount(member[d], weight)
            weight = np.minimum(tokens, weight * np.divide(goal[d], total, out=np.zeros_like(total), where=total > 0)[member[d]])
    return dict(zip(keys, weight)), dict(zip(mixing.DIMENSIONS, goal))


TARGETS = {"source": {"s0": 1.0, "s1": 5.0, "s2": 2.0, "absent": 9.0}, "lang": {"en": 0.3, "de": 0.7}}


def target_rows(spark, targets):
    return spark.createDataFrame([(d, v, w) for d, x in targets.items() for v, w in x.items()], "dimension string, value string, weight double")


def test_given_targets(spark):
    """Weights far from the corpus's own shares; a value without a weight goes."""
    rng = np.random.default_rng(5)
    cells = {(f"s{s}", lang, t): int(rng.integers(50_000, 90_000)) for s in range(4) for lang in ("en", "de") for t in ("note", "long")}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    for targets in (TARGETS, {"topic": {"note": 1.0, "long": 1.5}}):
        want, goal = wanted(cells, targets, mixing.ROUNDS, 0.2)
        rated = mixing.rake(df, keep=0.2, targets=target_rows(spark, targets))
        got = {(r.source, r.lang, r.topic): r.weight for r in rated.collect()}
        assert got == pytest.approx(want, rel=1e-6, abs=1e-3)
        for r in mixing.margins(rated, keep=0.2, targets=target_rows(spark, targets)).collect():
            given = targets.get(r.dimension)
            assert given is None or given.get(r.value, 0.0) > 0 or r.target == r.goal == r.expected == 0
            assert r.expected == pytest.approx(goal[r.dimension][sorted({k[mixing.DIMENSIONS.index(r.dimension)] for k in cells}).index(r.value)], rel=0.02, abs=1)


def test_bad_targets(spark):
    cells = spark.createDataFrame([("a", "en", "note", 5)], "source string, lang string, topic string, tokens long")
    for bad, match in (({"lang": {"en": -1.0}}, "at least 0"), ({"lang": {"en": None}}, "at least 0"), ({"lang": {"en": float("nan")}}, "at least 0"), ({"color": {"red": 1.0}}, "unknown dimension")):
        with pytest.raises(ValueError, match=match):
            mixing.rake(cells, targets=target_rows(spark, bad))


def test_rounds_until_margins_rest(spark):
    """Margins that pull against one another need more than the least number of rounds."""
    cells = {("a", "x", "t"): 1000, ("a", "y", "t"): 1, ("b", "x", "t"): 1, ("b", "y", "t"): 10, ("c", "y", "t"): 2000}
    targets = {"source": {"a": 1.0, "b": 1.0, "c": 1.0}, "lang": {"x": 3.0, "y": 1.0}}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(df, targets=target_rows(spark, targets), moved=1e-7).collect()}
    long = {n: wanted(cells, targets, n)[0] for n in range(mixing.ROUNDS, mixing.MOST_ROUNDS + 1, mixing.ROUNDS)}
    assert any(got == pytest.approx(long[n], rel=1e-6, abs=1e-3) for n in long)


def test_mix_to_targets_and_topics(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kind", F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string")))
    targets = target_rows(spark, {"topic": {"k0": 1.0, "k1": 2.0, "k2": 2.0}})
    rows = mixing.mix(docs, keep=0.4, targets=targets, topic=F.col("kind")).collect()
    share = lambda k: sum(r.probability * r.n_tokens for r in rows if r.topic == k) / sum(r.probability * r.n_tokens for r in rows)
    assert {r.topic for r in rows} == {"k0", "k1", "k2"} and all(r.kind == r.topic for r in rows)
    assert share("k1") == pytest.approx(0.4, abs=0.04) and share("k0") == pytest.approx(0.2, abs=0.04)


def test_clustered_topics(spark):
    """Texts of three vocabularies fall into three clusters."""
    rng = np.random.default_rng(3)
    words = [[f"{p}{k}" for k in range(30)] for p in ("sea", "law", "code")]
    rows = [(k, " ".join(rng.choice(words[k % 3], 40)), "mine") for k in range(240)] + [(900, None, "mine"), (901, " \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, topic string")
    got = {r.doc_id: r.topic for r in mixing.clustered_topics(df, 3).collect()}
    assert got[900] == got[901] == "empty" and len(got) == 242
    assert len({(k % 3, t) for k, t in got.items() if k < 900}) == 3 == len({t for k, t in got.items() if k < 900})
    assert [r.topic for r in mixing.clustered_topics(df.where("doc_id >= 900"), 3).collect()] == ["empty", "empty"]

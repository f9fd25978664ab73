"""Exact quantiles against numpy, alike for a table and its tenfold copy; next rows over the edges of ranges."""

import numpy as np
import pytest

from epiframe.operators import blend, normalizer


def table(spark, columns):
    rows = [(k, d, float(x)) for (k, d), v in columns.items() for x in v]
    return spark.createDataFrame(rows, "key string, dim int, x double").repartition(5)


@pytest.mark.parametrize("whole", [10_000, 0])
def test_quantiles(spark, monkeypatch, whole):
    """Groups of one row and many, ties at the quantiles, and brackets that hold only what is near them."""
    monkeypatch.setattr(normalizer, "WHOLE", whole or 10_000)
    rng = np.random.default_rng(1)
    columns = {("a", 0): rng.normal(size=30_000), ("a", 1): rng.integers(0, 3, 20_000), ("b", 0): [5.0], ("b", 1): [1.0, 2.0], ("c", 0): rng.pareto(1, 12_345), ("c", 1): np.repeat([0.0, 7.0], [11_000, 1]), ("d", 7): np.full(15_000, 3.5), ("e", 0): np.concatenate([np.full(14_000, -1.0), rng.random(400)])}
    got = {(r.key, r.dim): r for r in normalizer.statistics(table(spark, columns)).collect()}
    assert set(got) == set(columns)
    for k, v in columns.items():
        assert (got[k].q01, got[k].q99) == pytest.approx(tuple(np.quantile(np.asarray(v, float), [0.01, 0.99])), rel=1e-12, abs=1e-12), k
        assert got[k].n == len(v) and got[k].mean == pytest.approx(np.mean(v))


def test_tenfold_copy(spark):
    """The same quantiles up to interpolation, by the same method."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=9_000)
    one, ten = (normalizer.statistics(table(spark, {("a", 0): x})).first() for x in (v, np.tile(v, 10)))
    assert (ten.q01, ten.q99) == pytest.approx(tuple(np.quantile(np.tile(v, 10), [0.01, 0.99])), rel=1e-12)
    assert one.q01 == pytest.approx(ten.q01, abs=0.02)


def test_nulls_empty_and_unknown(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 0, 2.0), ("b", 0, None)], "key string, dim int, x double")
    (r,) = normalizer.statistics(df).collect()
    assert (r.key, r.n, r.q01, r.q99, r["std"]) == ("a", 1, 2.0, 2.0, 0.0)
    assert normalizer.statistics(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="unknown quantiles"):
        normalizer.statistics(df, "auto")


def test_a_broken_bracket_is_an_error(spark):
    rows = table(spark, {("a", 0): range(100)})
    brackets = spark.createDataFrame([("a", 0, 100, 50.0, 60.0)], "key string, dim int, n long, low0 double, high0 double")
    with pytest.raises(Exception, match="outside of its bracket"):
        normalizer.order_statistics(rows, brackets, [0.01]).collect()


@pytest.mark.parametrize("ranges", ["1", "7", "60"])
def test_next_over_ranges(spark, ranges):
    """One key has most of the rows; others begin and end inside ranges; a null key is a key."""
    rows = [(None if k % 10 == 0 else "hot" if k % 10 < 7 else f"k{k % 97}", k, None if k % 13 == 0 else float(k)) for k in range(2000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.n: r.nxt for r in blend.with_next(spark.createDataFrame(rows, "key string, n int, v double"), "key", "n", "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last = {}
    for key, n, v in reversed(rows):
        assert got[n] == last.get(key)
        last[key] = v
    assert blend.with_next(spark.createDataFrame([], "key string, n int, v double"), "key", "n", "v").collect() == []

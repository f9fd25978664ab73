"""Operator 4: hosts, paths and fixed rules against plain Python; mined rules against planted ones."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from epiframe.llm import urls


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


URLS = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/7x?q=1#a", "x://com/en/", "x://notcom/en/", "x://a.com?/en/", "x://a.com#/en/", "x://É.example.net/de/8", "x://example.net/de/7", "x://b.org/es/x://c.com/en/", "x://b.org/es\n/", "http://u@a.com:80/en/"]


def test_fixed_rules(spark, sf):
    rows = list(enumerate(URLS * 2)) + [(r[0] + 1000, r[1]) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    pages = spark.createDataFrame([(k, u, "z") for k, u in rows], "page_id long, url string, host string")
    got = urls.judge_urls(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, fit = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[0])
        assert r.verdict == (fit[1] if fit else "allow")


def test_mined_rules(spark):
    pages = [(k, f"http://{'bets' if k % 4 == 0 else 'shop'}.example.io/{'win' if k % 3 == 0 else 'read'}/{k}") for k in range(1200)] + [(5000, None), (None, "http://bets.example.io/win/1")]
    labels = [(k, 1, int(k % 12 == 0)) for k in range(1200)] + [(None, 1, 1), (7, None, None)]
    df = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in df.collect():
        assert r.verdict == ("block" if r.url and "bets" in r.url and "win" in r.url else "allow")


def test_empty(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_many_redundant_rules(spark):
    """Four sources of ten tokens each have 700 rules of greater support than the last one's."""
    hot = [f"http://h{'abcd'[k % 4]}/" + "/".join(f"{'abcd'[k % 4]}{x}" for x in "pqrstuvwx") for k in range(240)]
    rows = list(enumerate(hot + ["http://cold/only"] * 30 + ["http://fine/read"] * 300))
    labels = [(k, 1, int(k < 270)) for k, _ in rows]
    df = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.url, r.verdict) for r in df.collect()} == {(u, "allow" if "fine" in u else "block") for _, u in rows}


def brute_rules(rows, least, confidence, lift):
    """Minimal token sets of bad pages by counting all sets of up to three tokens."""
    count, bad = Counter(), Counter()
    for tokens, label in rows:
        for n in (1, 2, 3):
            for part in itertools.combinations(sorted(tokens), n):
                count[part] += 1
                bad[part] += label
    base = sum(label for _, label in rows) / len(rows)
    good = [set(p) for p in count if bad[p] >= least and bad[p] / count[p] >= confidence and bad[p] / count[p] / base >= lift]
    return sorted(sorted(p) for p in good if not any(q < p for q in good))


def test_mined_rules_equal_counting(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(1500):
        host, path, query = rng.choice(["shop", "bets", "news", "blog"]), rng.choice(["win", "read", "list"]), rng.choice(["", "?ref=1", "?page=2&ref=x"])
        rows.append((k, f"https://{host}.example.io/{path}/{k}{query}"))
        labels.append((k, 1, int(rng.random() < (0.95 if host == "bets" and path == "win" else 0.9 if "page" in query and host == "blog" else 0.1))))
    pages, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    url = F.col("url")
    items = {r.page_id: r.t for r in pages.select("page_id", urls.tokens_of(url, urls.host_of(url), urls.path_of(url)).alias("t")).collect()}
    counted = [(items[k], t) for k, _, t in labels]
    want = brute_rules(counted, max(urls.MIN_SUPPORT * len(rows), urls.MIN_PAGES), urls.MIN_CONFIDENCE, urls.MIN_LIFT)
    assert len(want) >= 2 and sorted(sorted(r) for r in urls.mine_rules(pages, known)) == want
    for r in urls.judge_urls(pages, known).collect():
        assert r.verdict == ("block" if any(set(w) <= set(items[r.page_id]) for w in want) else "allow")


def test_labels_of_documents_say_nothing_about_urls(spark):
    """On the synthetic tables no token set passes: counting all of them finds none either."""
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("pages", "labels"))
    url = F.col("url")
    rows = pages.join(labels, F.col("page_id") == F.col("doc_id")).select(urls.tokens_of(url, urls.host_of(url), urls.path_of(url)).alias("t"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad")).collect()
    assert brute_rules([(r.t, r.bad) for r in rows], urls.MIN_PAGES, urls.MIN_CONFIDENCE, urls.MIN_LIFT) == [] == urls.mine_rules(pages, labels)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x://com/en/", "a", "b", "c")], "page_id long, url string, _fixed string, _id string, _label string")
    (r,) = urls.judge_urls(df, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert (r["_fixed"], r["_id"], r["_label"], r.rule) == ("a", "b", "c", "com/en/")


def test_minimal_rules(spark):
    rules = [["a"], ["a", "b"], ["b", "c"], ["b", "c", "d"], ["c", "d", "e"], ["a", "x", "y"], ["f", "g", "h"], ["f", "h"]]
    got = urls.minimal(spark.createDataFrame([(r,) for r in rules], "tokens array<string>")).collect()
    assert sorted(r.tokens for r in got) == [["a"], ["b", "c"], ["c", "d", "e"], ["f", "h"]]


def all_rules(rows, least, confidence, lift, most):
    """Minimal token sets of bad pages by counting all sets of up to ``most`` tokens."""
    count, bad = Counter(), Counter()
    for tokens, label in rows:
        for n in range(1, most + 1):
            for part in itertools.combinations(sorted(tokens), n):
                count[part] += 1
                bad[part] += label
    base = sum(label for _, label in rows) / len(rows)
    good = {p for p in count if bad[p] >= least and bad[p] / count[p] >= confidence and bad[p] / count[p] / base >= lift}
    return sorted(sorted(p) for p in good if not any(q in good for n in range(1, len(p)) for q in itertools.combinations(p, n)))


def planted(spark, rng, n=700, parts=7):
    """Pages whose label follows from four path parts together, beside noise."""
    rows, labels = [], []
    for k in range(n):
        some = [p for p in "abcdefg"[:parts] if rng.random() < 0.7]
        rows.append((k, "http://h.io/" + "/".join(some) + f"/{k}"))
        labels.append((k, 1, int(rng.random() < (0.97 if set("abcd") <= set(some) else 0.12))))
    return rows, labels, spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("longest", [urls.LONGEST, 0])
def test_rules_of_every_length_equal_counting(spark, monkeypatch, longest):
    """Rules of four tokens, by FP-growth and level by level."""
    monkeypatch.setattr(urls, "LONGEST", longest)
    for seed in (1, 2):
        rows, labels, pages, known = planted(spark, random.Random(seed))
        url = F.col("url")
        items = {r.page_id: r.t for r in pages.select("page_id", urls.tokens_of(url, urls.host_of(url), urls.path_of(url)).alias("t")).collect()}
        counted = [(items[k], t) for k, _, t in labels]
        want = all_rules(counted, max(urls.MIN_SUPPORT * len(rows), urls.MIN_PAGES), urls.MIN_CONFIDENCE, urls.MIN_LIFT, 9)
        assert any(len(r) == 4 for r in want) and sorted(sorted(r) for r in urls.mine_rules(pages, known)) == want
        for r in urls.judge_urls(pages, known).collect():
            assert r.verdict == ("block" if any(set(w) <= set(items[r.page_id]) for w in want) else "allow")


def test_deep_urls_end_soon(spark):
    """One URL of 25 parts on 50 labelled pages, bad on most or on some; and nested ones, each a part longer."""
    import time

    began = time.perf_counter()
    deep = "http://d.io/" + "/".join(f"p{c}" for c in "abcdefghijklmnopqrstuvwxy")
    for share, want in ((1.0, 27), (0.7, 0)):
        rows = [(k, deep if k < 50 else f"http://fine.org/{'xyz'[k % 3]}") for k in range(400)]
        labels = [(k, 1, int(k < 50 * share)) for k in range(400)]
        found = urls.mine_rules(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert len(found) == want and all(len(r) == 1 for r in found)
    chain = [(k, "http://d.io/" + "/".join(f"p{c}" for c in "abcdefghijklmnopqrstuvwxy"[: 1 + k % 25])) for k in range(1500)]
    labels = [(k, 1, int(k % 25 >= 20)) for k in range(1500)]
    found = urls.mine_rules(spark.createDataFrame(chain, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    # beyond the twentieth part every page is bad; at the twentieth five of six are
    assert sorted(map(tuple, found)) == [(f"path:p{c}",) for c in "tuvwxy"]
    assert time.perf_counter() - began < 90


def test_alternatives_of_a_rule(spark):
    """Tokens on the same labelled pages stand for one another on other pages."""
    rows = [(k, f"http://{'bad' if k % 4 == 0 else 'good'}.io/{'x/y' if k % 3 == 0 else 'z'}/{k}") for k in range(1200)] + [(5001, "http://bad.io/x"), (5002, "http://bad.io/y"), (5003, "http://bad.io/z"), (5004, "http://good.io/x/y")]
    labels = [(k, 1, int(k % 12 == 0)) for k in range(1200)]
    pages, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, known).collect()}
    assert (got[5001], got[5002], got[5003], got[5004]) == ("block", "block", "allow", "allow")
    assert sorted(sorted(r) for r in urls.mine_rules(pages, known)) == [["host:bad", "path:x"], ["host:bad", "path:y"]]


def test_very_long_urls(spark):
    url = "http://a.org/es/" + "part/" * 50_000 + "?" + "&".join(f"k{n}=1" for n in range(2000))
    got = urls.judge_urls(spark.createDataFrame([(1, url), (2, "x" * 300_000), (3, None)], "page_id long, url string"), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert {r.page_id: (r.rule, r.verdict, len(r.path)) for r in got} == {1: ("org/es/", "block", len(url.split("?")[0]) - 12), 2: (None, "allow", 0), 3: (None, "allow", 0)}

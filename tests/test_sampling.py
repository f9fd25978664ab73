"""Masks of long rows: each uniform number once a row or span, results as counted in plain Python."""

import hashlib
import math
import time

from pyspark.sql import functions as F

from epiframe.functions import sampling as S
from epiframe.operators import blend


def uniform(*keys):
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 4294967296.0


def spans(i, length, ratio, mean, alpha, p_free):
    room = length - 1
    rate, w = max(1.0, ratio * room / mean), uniform(i, 0, "n", 3)
    p = total = math.exp(-rate)
    n = 0
    for k in range(1, room + 1):
        n += total <= w
        p *= rate / k
        total += p
    hit = set()
    for k in range(n if uniform(i, 0, "free", 3) >= p_free else 0):
        a = min(room - 1, math.floor((1 - math.pow(1 - uniform(i, k, "start", 3), 1 / alpha)) * room))
        u = max(S.UNIT_EPS, min(1 - S.UNIT_EPS, uniform(i, k, "length", 3)))
        hit |= set(range(a, a + min(room, max(1, math.ceil(math.log(u) / math.log1p(-1 / mean))))))
    return [p < room and p in hit for p in range(length)]


def test_long_masks(spark):
    """Numbers computed anew at each place took minutes here."""
    length, begin = 128, time.monotonic()
    each = lambda k: blend.unit_hash("id", k, seed=1)
    span = lambda k, name: blend.unit_hash("id", k, F.lit(name), seed=3)
    masks = spark.range(100).select("id", S.bernoulli_mask(each, blend.unit_hash("id", seed=2), length, 0.3, True, 0.2).alias("frames"), S.span_mask(span, length, 0.4, 2.0, 1.5, True, 0.1).alias("spans"))
    got = {r.id: (r.frames, r.spans) for r in masks.collect()}
    assert time.monotonic() - begin < 40
    for i in range(100):
        free = uniform(i, 2) < 0.2
        assert got[i] == ([not free and k < length - 1 and uniform(i, k, 1) < 0.3 for k in range(length)], spans(i, length, 0.4, 2.0, 1.5, 0.1))

"""Random choices as column expressions of uniform numbers in [0, 1) that the caller gives.

``rand(seed)`` gives fresh numbers; ``blend.unit_hash`` of a row's key gives the same ones on every run, engine and
partitioning, which is what the registered queries use. Distributions follow from inverse distribution functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards of the stratified time and of the logarithm's argument.
TIME_EPS, UNIT_EPS = 1e-5, 1e-7


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often ``use`` needs it and inside whatever lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def stratified_time(rank: Column, batch_size: int, offset: Column) -> Column:
    """Evenly spaced times of a batch, moved by one offset that the batch shares, below 1."""
    t = rank / F.lit(float(batch_size)) + offset
    return t - F.floor(t / F.lit(1 - TIME_EPS)) * F.lit(1 - TIME_EPS)


def beta_time(u: Column, alpha: float, sigma: float = 0.0) -> Column:
    """(1 - sigma)(1 - z) of z from Beta(alpha, 1)."""
    return F.lit(1 - sigma) * (1 - F.pow(u, F.lit(1 / alpha)))


def beta_time_of(u: Column, alpha: float, beta: float, sigma: float = 0.0) -> Column:
    """(1 - sigma)(1 - z) of z from Beta(alpha, beta), for any positive alpha and beta."""
    if alpha <= 0 or beta <= 0:
        raise ValueError(f"alpha and beta must be positive: {alpha}, {beta}")

    @F.pandas_udf("double")
    def inverse(x: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(x.to_numpy(np.float64), alpha, beta))

    return F.lit(1 - sigma) * (1 - inverse(u))


def beta_share(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """The distribution function of Beta(a, b) by its continued fraction (Lentz's method), on the side where that converges fast."""
    x = np.clip(np.asarray(x, np.float64), 0.0, 1.0)
    turned = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(y), 1 / away(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / away(1 + term * d), away(1 + term / c)
            h = h * d * c
        if np.abs(d * c - 1).max(initial=0) < 1e-15:
            break
    with np.errstate(divide="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(y) + q * np.log1p(-y))
    share = np.where(y <= 0, 0.0, front * h / p)
    return np.where(turned, 1 - share, share)


def beta_quantile(u: np.ndarray, a: float, b: float) -> np.ndarray:
    """Where the distribution function of Beta(a, b) is u, by halving."""
    low, high = np.zeros_like(u), np.ones_like(u)
    for _ in range(60):
        middle = (low + high) / 2
        under = beta_share(middle, a, b) < u
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def geometric(u: Column, mean: float) -> Column:
    """Trials to the first success at a mean of at least 1."""
    if mean < 1:
        raise ValueError(f"mean must be at least 1: {mean}")
    inside = F.greatest(F.lit(UNIT_EPS), F.least(F.lit(1 - UNIT_EPS), u))
    return F.greatest(F.lit(1), F.ceil(F.log(inside) / F.lit(math.log1p(-1 / mean)))).cast("int") if mean > 1 else F.lit(1)


def beta_position(u: Column, length: int, alpha: float, early: bool = True) -> Column:
    """A place from 0 below length, more often near the beginning (or the end) the greater alpha is."""
    z = 1 - F.pow(1 - u, F.lit(1 / alpha)) if early else F.pow(u, F.lit(1 / alpha))
    return F.least(F.lit(length - 1), F.floor(z * length)).cast("int")


def poisson(u: Column, rate: float, most: int) -> Column:
    """A Poisson number, at most ``most``: how many values of the distribution function u has passed."""
    below, p = [], math.exp(-rate)
    total = p
    for k in range(1, most + 1):
        below.append(total)
        p *= rate / k
        total += p
    return bound(u, lambda v: F.size(F.filter(F.array(*(F.lit(x) for x in below)), lambda x: x <= v))) if below else F.lit(0)


def prefix_delay(u: Column, n_valid: Column, strategy: str = "uniform", most: int | None = None) -> Column:
    """Steps of a known prefix, below the valid steps and ``most``: each as likely, or each e times less than the one before."""
    upper = F.greatest(n_valid, F.lit(0)) if most is None else F.greatest(F.least(n_valid, F.lit(most)), F.lit(0))
    if strategy == "uniform":
        return F.floor(u * upper).cast("int")
    if strategy == "exp":
        k = F.floor(-F.log(1 - u * (1 - F.exp(-upper.cast("double")))))
        return F.when(upper > 0, F.least(k, upper - 1)).otherwise(0).cast("int")
    raise ValueError(f"unknown strategy: {strategy}")


def bernoulli_mask(u: Callable[[Column], Column], free: Column, length: int, p: float, keep_last: bool = True, p_no_mask: float = 0.0) -> Column:
    """Array of length: true where u(place) is below p; the last place stays, and all of a row whose ``free`` is below p_no_mask."""
    on = lambda k, masked: masked & ((k < length - 1) | F.lit(not keep_last)) & (u(k) < p)
    return bound(free >= p_no_mask, lambda masked: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: on(k, masked)))


def span_mask(u: Callable[[Column, str], Column], length: int, ratio: float, mean_span: float, alpha: float, keep_last: bool = True, p_no_mask: float = 0.0, early: bool = True) -> Column:
    """Array of length, true in spans: their number is Poisson, their places Beta, their lengths geometric. u(k, name)
    is the uniform number called name of the k-th span."""
    room = length - 1 if keep_last else length
    if room <= 0 or ratio <= 0:
        return F.array_repeat(F.lit(False), length)
    n = poisson(u(F.lit(0), "n"), max(1.0, ratio * room / mean_span), room)
    free = u(F.lit(0), "free") < p_no_mask
    # no spans at all in a row that stays free
    numbers = F.slice(F.sequence(F.lit(0), F.lit(room - 1)), F.lit(1), F.when(free, F.lit(0)).otherwise(n))
    spans = F.transform(numbers, lambda k: F.struct(beta_position(u(k, "start"), room, alpha, early).alias("a"), F.least(F.lit(room), geometric(u(k, "length"), mean_span)).alias("n")))
    inside = lambda k, s: (k >= s["a"]) & (k < s["a"] + s["n"])
    return bound(spans, lambda found: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: (k < room) & F.exists(found, lambda s: inside(k, s))))


def active_views(u: Column, has_chest: Column, drop_head: float, drop_chest: float, train: bool = True) -> Column:
    """Cameras in use: both are kept by what the two probabilities of dropping one leave."""
    if min(drop_head, drop_chest) < 0 or drop_head + drop_chest > 1 + 1e-6:
        raise ValueError("probabilities of dropping a view must be at least 0 and sum to 1 at most")
    both = F.array(F.lit("head"), F.lit("chest"))
    keep = 1 - drop_head - drop_chest
    picked = F.when(u < keep, both).when(u < keep + drop_head, F.array(F.lit("chest"))).otherwise(F.array(F.lit("head"))) if train else both
    return F.when(has_chest, picked).otherwise(F.array(F.lit("head")))


def pick(items: Column, u: Column, train: bool = True) -> Column:
    """One of an array's items: any when training, else the first."""
    return F.get(items, F.floor(u * F.size(items)).cast("int") if train else F.lit(0))


def noisy(noise: Column, target: Column, time: Column, sigma: float = 0.0) -> Column:
    """The point at a time on the line from noise to target, of which sigma stays noise."""
    return (1 - F.lit(1 - sigma) * time) * noise + time * target


def conditioned(step: Column, delay: Column, time: Column, valid: Column) -> dict[str, Column]:
    """Time, loss mask and prefix flag of a step: the known prefix has time 1 and no loss."""
    prefix = step < delay
    return {"time": F.when(prefix, 1.0).otherwise(time), "loss_on": ~prefix & valid, "is_prefix": prefix}

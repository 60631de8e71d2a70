"""Tables of a Chinese restaurant's dishes: all customers of a dish are seated anew at once, in many dishes at a time.

Given the other dishes, the seatings of a dish's ``c`` customers have weights alpha ** t times the product over its ``t`` tables
of (1 - discount)(2 - discount)...(customers - 1 - discount), so ``t`` has the weight alpha ** t * S(c, t) with the generalised
Stirling numbers S.  This distribution is drawn from directly, which is a Gibbs step for all customers together, however many
they are.  Up to EXACT customers S comes from its recursion.  Beyond, c! / (t! discount ** t) times the coefficient of x ** c in
(1 - (1 - x) ** discount) ** t is taken, whose binomial series or saddle point gives S to 0.4 % (tested against the
recursion).
"""

from __future__ import annotations

import functools
import math

import numpy as np

from . import ragged
from .ragged import U64

#: Customers up to which Stirling numbers are in a table.
EXACT = 512
#: Numbers of one matrix of weights.
CELLS = 1 << 19
#: Terms of the series, and by how much they may exceed their sum.
TERMS, CANCELLED = 400, 1e7


def uniform(key: np.ndarray, turn: int) -> np.ndarray:
    """A number in [0, 1) for each key; the same in whatever task it is drawn, so tasks that hold a dish agree on its tables."""
    return (ragged.mix(key + U64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(11)).astype(np.float64) * 2.0**-53


@functools.lru_cache(maxsize=4)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of S(c, t) for c and t up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0
    for c in range(EXACT):
        t = np.arange(1, c + 2)
        stay = np.full(c + 1, -np.inf)
        stay[: c or 0] = out[c, 1 : c + 1] + np.log(c - t[:c] * discount)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


def log_gamma(z: np.ndarray) -> np.ndarray:
    """For z of 1 and more."""
    small = z < 16
    up = np.where(small, z + 16, z)
    out = (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up**3)
    if small.any():
        out[small] -= np.log(z[small][:, None] + np.arange(16)).sum(1)
    return out


@np.errstate(over="ignore", invalid="ignore")
def series(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log_coefficient() by the binomial series, not a number where it doesn't settle."""
    total, size, out = np.zeros(len(c)), np.zeros(len(c)), np.full(len(c), np.nan)
    at, choose, calm = np.arange(len(c)), np.zeros(len(c)), np.zeros(len(c), np.int64)
    for j in range(1, TERMS + 1):
        choose[at] += np.log(np.maximum(t[at] - j + 1, 0.5) / j)
        # Gamma(c - j * discount) / Gamma(c + 1)
        w, less = c[at] + 1, 1 + j * discount
        gammas = (w - less - 0.5) * np.log1p(-less / w) - less * (np.log(w) - 1) + (1 / (w - less) - 1 / w) / 12
        term = np.where(t[at] >= j, np.exp(choose[at] + gammas + math.lgamma(less)), 0.0)
        total[at] += math.sin(math.pi * j * discount) * (-1) ** (j + 1) / math.pi * term
        size[at] += term
        calm[at] = np.where(term <= 1e-9 * np.abs(total[at]), calm[at] + 1, 0)
        ended = calm[at] >= 3
        good = at[ended & (total[at] > 0) & (size[at] <= CANCELLED * np.abs(total[at]))]
        out[good] = np.log(total[good])
        at = at[~ended & (size[at] < 1e100)]
        if not len(at):
            break
    return out


def tilt(ratio: np.ndarray, discount: float, of_one: bool) -> np.ndarray:
    """log(1 - x) where x times the derivative of -(1 - x) ** discount, by 1 - (1 - x) ** discount if ``of_one``, is ``ratio``."""
    low, high = np.full(len(ratio), -700.0), np.full(len(ratio), -1e-15)
    for _ in range(60):
        y = (low + high) / 2
        value = np.log(-np.expm1(y)) + math.log(discount) + (discount - 1) * y - of_one * np.log(-np.expm1(discount * y))
        more = value > np.log(ratio)
        low, high = np.where(more, y, low), np.where(more, high, y)
    return (low + high) / 2


def saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log_coefficient() by the saddle point and the next term of its expansion; t < c."""
    log_y = tilt(c / t, discount, True)
    y = np.exp(log_y)
    q, a = -np.expm1(log_y) / y, -np.expm1(discount * log_y)
    p = (1 - a) / a * q
    # derivatives by log x of b, and cumulants of the power's exponent
    b = 1 + q - discount * q - discount * p
    b1 = (1 - discount) * q * (1 + q) - discount * p * b
    b2 = (1 - discount) * q * (1 + q) * (1 + 2 * q) - discount * p * (b * b + b1)
    k2, k3, k4 = (t * discount * p * k for k in (b, b * b + b1, b**3 + 3 * b * b1 + b2))
    next_ = k4 / k2**2 / 8 - 5 * k3**2 / k2**3 / 24
    return t * np.log(a) - c * np.log(-np.expm1(log_y)) - 0.5 * np.log(2 * math.pi * k2) + np.log1p(np.clip(next_, -0.5, 0.5))


def log_coefficient(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithm of the coefficient of x ** c in (1 - (1 - x) ** discount) ** t, for many customers."""
    out = np.full(len(c), np.nan)
    few = np.flatnonzero(t < 20 + 2 * c**discount)
    out[few] = series(c[few], t[few], discount)
    for k, x in ((0, np.ones(len(c))), (1, (c - 1) * (1 - discount) / 2)):
        some = t == c - k
        out[some] = t[some] * math.log(discount) + np.log(x[some])
    rest = np.flatnonzero(np.isnan(out))
    out[rest] = saddle(c[rest], t[rest], discount)
    return out


def drawn(weight: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A column for each row, by the logarithms of their weights."""
    weight = np.exp(weight - weight.max(1, keepdims=True))
    np.cumsum(weight, axis=1, out=weight)
    return np.minimum((weight <= (u * weight[:, -1])[:, None]).sum(1), weight.shape[1] - 1)


def few(c: int, log_alpha: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``c`` customers each."""
    t = np.arange(1, c + 1)
    known, out = stirling(discount)[c, 1 : c + 1], np.empty(len(u), np.int64)
    for a in range(0, len(u), max(1, CELLS // c)):
        part = slice(a, a + max(1, CELLS // c))
        out[part] = 1 + drawn(log_alpha[part, None] * t + known, u[part])
    return out


def many(c: np.ndarray, log_alpha: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with more customers: weights are computed as far around their mean as they matter."""
    y = tilt(np.exp(np.log(c * discount) - log_alpha), discount, False)
    mean = np.minimum(c, np.maximum(1.0, -np.exp(log_alpha - math.log(discount)) * np.expm1(discount * y)))
    out, at = np.empty(len(c), np.int64), np.arange(len(c))
    while len(at):
        reach = 9 * np.sqrt(mean[at]) + 20
        low, high = np.maximum(1, np.floor(mean[at] - reach)), np.minimum(c[at], np.floor(mean[at] + reach))
        width = 1 << np.ceil(np.log2(high - low + 1)).astype(np.int64)
        again = []
        for w in np.unique(width).tolist():
            same = np.flatnonzero(width == w)
            for part in np.array_split(same, -(-len(same) * w // CELLS)):
                t = low[part, None] + np.arange(w)
                inside = t <= high[part, None]
                weight = np.full(t.shape, -np.inf)
                flat, who = t[inside], np.repeat(at[part], inside.sum(1))
                weight[inside] = log_coefficient(c[who], flat, discount) - log_gamma(flat + 1) + flat * (log_alpha[who] - math.log(discount))
                top, last = weight.max(1), weight[np.arange(len(part)), (high - low)[part].astype(np.int64)]
                whole = ((low[part] == 1) | (weight[:, 0] < top - 25)) & ((high[part] == c[at[part]]) | (last < top - 25))
                out[at[part]] = low[part].astype(np.int64) + drawn(weight, u[at[part]])
                mean[at[part]] = np.where(whole, mean[at[part]], t[np.arange(len(part)), weight.argmax(1)] * 1.05 + 1)
                again.append(at[part][~whole])
        at = np.concatenate(again)
    return out


def tables(c: np.ndarray, alpha: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """The number of tables of each dish when all its customers are seated anew.

    ``c`` are customers, ``alpha`` the weight of a new table (strength + discount * tables of the restaurant, times the
    parent's probability of the dish), ``key`` 64-bit numbers that the draws depend on.
    """
    out = np.minimum(c, 1).astype(np.int64)
    some = np.flatnonzero(c > 1)
    some = some[np.argsort(c[some], kind="stable")]
    u, log_alpha = uniform(key[some].astype(U64), 1), np.log(np.maximum(alpha[some].astype(np.float64), 1e-300))
    size = c[some].astype(np.int64)
    cut = np.searchsorted(size, EXACT, "right")
    bounds = np.flatnonzero(np.diff(size[:cut], prepend=0, append=0)).tolist()
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        out[some[a:z]] = few(int(size[a]), log_alpha[a:z], discount, u[a:z])
    if cut < len(some):
        out[some[cut:]] = many(size[cut:].astype(np.float64), log_alpha[cut:], discount, u[cut:])
    return out


def rate(once: int, twice: int) -> float:
    """A discount from how many dishes have one customer and how many have two."""
    return float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))

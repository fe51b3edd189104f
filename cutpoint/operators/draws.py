"""Exact hypergeometric draws of any size."""

from __future__ import annotations

import math

import numpy as np

#: numpy draws hypergeometric numbers below this.
NUMPY_LIMIT = 1_000_000_000
# fixed values: the width of the table mountain that covers a log-concave distribution of
# whole numbers, by its standard deviation (ratio of uniforms)
SPREAD, MARGIN = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)


def log_steps(a: int, d: int) -> float:
    """``log((a + d)! / a!)`` without the cancellation of two large logarithms."""
    if a < 1 << 20 or a + d < 1 << 20:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1)
    x, y = a + 1.0, a + d + 1.0
    # Stirling's series, each term as a difference
    return d * math.log(x) + (y - 0.5) * math.log1p(d / x) - d + (1 / y - 1 / x) / 12 - (y**-3 - x**-3) / 360


def draw(rng: np.random.Generator, good: int, bad: int, k: int) -> int:
    """How many of ``k`` rows drawn without replacement are good.

    Where numpy does not draw, a point of a plane region (ratio of uniforms) is tried until
    one lies under the distribution: its ratios to the mode come from differences of
    log-factorials, so the numbers are hypergeometric at any size, but for the rounding of
    a double.
    """
    rows = good + bad
    if k >= rows or not bad:
        return min(k, good)
    if not good or k < 1:
        return 0
    if good < NUMPY_LIMIT and bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, k))
    lowest, highest = max(0, k - bad), min(good, k)
    mode = min(max((k + 1) * (good + 1) // (rows + 2), lowest), highest)
    share = good / rows
    middle = k * share + 0.5
    spread = math.sqrt(k * share * (bad / rows) * ((rows - k) / (rows - 1)) + 0.5)
    width = SPREAD * spread + MARGIN
    while True:
        u = 1.0 - rng.random()
        x = math.floor(middle + width * (rng.random() - 0.5) / u)
        if not lowest <= x <= highest:
            continue
        d = x - mode
        fall = log_steps(mode, d) + log_steps(good - mode, -d) + log_steps(k - mode, -d) + log_steps(bad - k + mode, d)
        if 2 * math.log(u) <= -fall:
            return x


def deal(rng: np.random.Generator, cells: np.ndarray, k: int) -> np.ndarray:
    """How many of ``k`` rows drawn without replacement come from each of ``cells`` (rows each).

    The number is split down a binary tree: a half's share of what its parent has is
    hypergeometric. Halves that get none are not split further.
    """
    out = np.zeros(len(cells), np.int64)
    before = np.append(0, np.cumsum(cells))
    work = [(0, len(cells), int(min(k, before[-1])))]
    while work:
        first, stop, want = work.pop()
        if not want:
            continue
        if stop - first == 1:
            out[first] = want
            continue
        middle = (first + stop) // 2
        left, right = int(before[middle] - before[first]), int(before[stop] - before[middle])
        own = draw(rng, left, right, want)
        work += [(middle, stop, want - own), (first, middle, own)]
    return out

"""Exact tail probabilities without scipy: Fisher, hypergeometric, Poisson limits, normal tails."""

from __future__ import annotations

import math


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else -math.inf


def hypergeometric_sf(k: int, population: int, marked: int, drawn: int) -> float:
    """The chance of at least k marked ones among those drawn."""
    low, high = max(k, 0, drawn + marked - population), min(marked, drawn)
    total = _log_choose(population, drawn)
    return min(1.0, math.fsum(math.exp(_log_choose(marked, i) + _log_choose(population - marked, drawn - i) - total) for i in range(low, high + 1)))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """The two-sided p value of a 2 x 2 table."""
    n, row, col = a + b + c + d, a + b, a + c
    chance = lambda x: math.exp(_log_choose(row, x) + _log_choose(n - row, col - x) - _log_choose(n, col))
    seen = chance(a)
    return min(1.0, math.fsum(p for x in range(max(0, row + col - n), min(row, col) + 1) if (p := chance(x)) <= seen * (1 + 1e-7)))


def _poisson_cdf(k: int, mean: float) -> float:
    return math.fsum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k + 1)) if mean > 0 else 1.0


def poisson_interval(k: int, level: float = 0.95) -> tuple[float, float]:
    """Garwood's exact limits of a count's mean, by bisection."""
    tail = (1 - level) / 2

    def solve(f):
        lo, hi = 0.0, k + 10 * math.sqrt(k + 1) + 20
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
        return (lo + hi) / 2

    return (0.0 if k == 0 else solve(lambda m: tail - (1 - _poisson_cdf(k - 1, m)))), solve(lambda m: _poisson_cdf(k, m) - tail)


def two_sided_normal(z: float) -> float:
    """The p value of a normal score."""
    return math.erfc(abs(z) / math.sqrt(2))

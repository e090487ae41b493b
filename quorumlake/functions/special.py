"""Distribution functions for p-values and intervals, in plain Python: they see a few scalars only."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            d = 1 / d
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    cdf = lambda t: 1 - t_two_sided(t, df) / 2
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided p of a Pearson or Spearman coefficient."""
    if n < 3:
        return None
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def kendall_p(concordant_less_discordant: int, n: int, ties_x: list[int], ties_y: list[int]) -> float:
    """Two-sided p of Kendall's tau by the normal approximation with ties."""
    s0 = n * (n - 1) * (2 * n + 5)
    tie = lambda ts: sum(t * (t - 1) * (2 * t + 5) for t in ts)
    two = lambda ts: sum(t * (t - 1) for t in ts)
    three = lambda ts: sum(t * (t - 1) * (t - 2) for t in ts)
    var = (s0 - tie(ties_x) - tie(ties_y)) / 18 + two(ties_x) * two(ties_y) / (2 * n * (n - 1))
    if n > 2:
        var += three(ties_x) * three(ties_y) / (9 * n * (n - 1) * (n - 2))
    return 1.0 if var <= 0 else 2 * (1 - normal_cdf(abs(concordant_less_discordant) / math.sqrt(var)))


def kolmogorov_p(d: float, n: float) -> float:
    """Asymptotic two-sided p of a Kolmogorov-Smirnov distance; ``n`` is the effective size."""
    x = d * math.sqrt(n)
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))

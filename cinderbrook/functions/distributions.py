"""Student's t (central and not), the normal distribution, and tests built on them; plain Python for driver or group use."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_share(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def inverse(function: Callable[[float], float], p: float, low: float, high: float) -> float:
    """x with function(x) = p, for an increasing function, by bisection."""
    while function(low) > p:
        low *= 2
    while function(high) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if function(middle) < p else (low, middle)
    return (low + high) / 2


def t_density(t: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - (df + 1) / 2 * math.log1p(t * t / df)) / math.sqrt(df * math.pi)


@lru_cache(maxsize=10_000)
def t_quantile(p: float, df: float) -> float:
    """By Newton's steps from the normal quantile: it is too small and the distribution concave behind it, so they never overshoot."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    t = inverse(normal_cdf, p, 0.0, 2.0)
    for _ in range(500):
        step = (p - t_cdf(t, df)) / t_density(t, df)
        t += step
        if abs(step) <= 1e-13 * t:
            break
    return t


def noncentral_t_cdf(t: float, df: float, shift: float) -> float:
    """By integrating the normal probability over the scale's chi distribution (Simpson's rule)."""
    spread = 1 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - 12 * spread), 1 + 12 * spread
    log_scale = (df / 2) * math.log(df / 2) + math.log(2) - math.lgamma(df / 2)

    def density(s: float) -> float:
        return normal_cdf(t * s - shift) * math.exp(log_scale + (df - 1) * math.log(s) - df * s * s / 2)

    n = 2000
    step = (high - low) / n
    return step / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * density(low + k * step) for k in range(n + 1))


def paired_t(differences: Sequence[float]) -> dict[str, float]:
    """n, mean, Cohen's d, t and the two-sided p of paired differences."""
    n = len(differences)
    mean = sum(differences) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in differences) / (n - 1))
    t = mean / (sd / math.sqrt(n))
    return {"n": n, "mean": mean, "cohens_d": mean / sd, "t": t, "t_p": 2 * (1 - t_cdf(abs(t), n - 1))}


def wilcoxon_p(differences: Sequence[float]) -> float:
    """Two-sided p of the signed-rank test: normal approximation with tie and continuity corrections; zeros are left out."""
    left = sorted((abs(x), x) for x in differences if x != 0)
    n = len(left)
    if not n:
        return 1.0
    positive = ties = 0.0
    at = 0
    while at < n:
        end = at
        while end < n and left[end][0] == left[at][0]:
            end += 1
        rank = (at + 1 + end) / 2
        positive += rank * sum(x > 0 for _, x in left[at:end])
        ties += (end - at) ** 3 - (end - at)
        at = end
    off = positive - n * (n + 1) / 4
    sigma = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    if sigma == 0:
        return 1.0
    z = (off - math.copysign(0.5, off) * (off != 0)) / sigma
    return min(1.0, 2 * min(normal_cdf(z), 1 - normal_cdf(z)))


def paired_power(effect: float, n: float, alpha: float = 0.05) -> float:
    """Power of the two-sided paired t test."""
    df, shift = n - 1, abs(effect) * math.sqrt(n)
    edge = t_quantile(1 - alpha / 2, df)
    return 1 - noncentral_t_cdf(edge, df, shift) + noncentral_t_cdf(-edge, df, shift)


def pairs_for_power(effect: float, power: float, alpha: float = 0.05) -> int:
    """The fewest pairs that reach the power."""
    return math.ceil(inverse(lambda n: paired_power(effect, n, alpha), power, 2.0, 16.0) - 1e-6)

"""Distribution functions for the driver, in plain Python."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_test(mean_a: float, var_a: float, n_a: int, mean_b: float, var_b: float, n_b: int, equal: bool) -> tuple[float, float]:
    """Statistic and two-sided p of Student's test, or of Welch's if variances aren't equal."""
    if equal:
        df = n_a + n_b - 2
        se = math.sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / df * (1 / n_a + 1 / n_b))
    else:
        a, b = var_a / n_a, var_b / n_b
        se = math.sqrt(a + b)
        df = (a + b) ** 2 / (a * a / (n_a - 1) + b * b / (n_b - 1)) if se else 1.0
    if not se:
        return 0.0, 1.0
    t = (mean_a - mean_b) / se
    return t, t_two_sided(t, df)


def mann_whitney(u: float, n1: int, n2: int, ties: float) -> tuple[float, float]:
    """U and its two-sided p: exact for 8 units or fewer in an arm without ties, else normal with tie and continuity corrections."""
    n = n1 + n2
    if not ties and min(n1, n2) <= 8 and n <= 200:
        small, large = sorted((n1, n2))
        ways = [[0] * (n1 * n2 + 1) for _ in range(small + 1)]
        ways[0][0] = 1
        for k in range(1, n + 1):
            for i in range(min(k, small), 0, -1):
                shift = k - i
                if shift <= large:
                    row, prev = ways[i], ways[i - 1]
                    for v in range(len(row) - 1, shift - 1, -1):
                        row[v] += prev[v - shift]
        counts, low = ways[small], min(u, n1 * n2 - u)
        return u, min(1.0, 2 * sum(counts[: int(low) + 1]) / sum(counts))
    spread = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread if spread else 0.0
    return u, min(1.0, 2 * (1 - _N.cdf(z)))


def kolmogorov_sf(x: float) -> float:
    """P(K > x) of the Kolmogorov distribution."""
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_p(d: float, n1: int, n2: int) -> float:
    """Asymptotic p of the two-sample statistic."""
    return kolmogorov_sf(d * math.sqrt(n1 * n2 / (n1 + n2))) if n1 and n2 else 1.0


#: Polynomial coefficients of Royston's approximation (AS R94), constant term first.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_MEAN_SMALL = (0.544, -0.39978, 0.025054, -0.0006714)
_SD_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
_MEAN_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915)
_SD_LARGE = (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)


def _poly(c, x: float) -> float:
    return sum(v * x**i for i, v in enumerate(c))


def shapiro_p(values: list[float]) -> float:
    """p of the Shapiro-Wilk test; constant samples and fewer than 3 values: 1."""
    x = sorted(values)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0
    m = [_N.inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    total, u = sum(v * v for v in m), 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = m[-1] / math.sqrt(total) + _poly(_C1, u)
        if n > 5:
            next_ = m[-2] / math.sqrt(total) + _poly(_C2, u)
            phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
            a = [-last, -next_, *(v / math.sqrt(phi) for v in m[2:-2]), next_, last]
        else:
            phi = (total - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *(v / math.sqrt(phi) for v in m[1:-1]), last]
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if 1 - w < 1e-15:
        return 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = _poly(_GAMMA, n)
        if y >= gamma:
            return 0.0
        y, mu, sigma = -math.log(gamma - y), _poly(_MEAN_SMALL, n), math.exp(_poly(_SD_SMALL, n))
    else:
        ln = math.log(n)
        mu, sigma = _poly(_MEAN_LARGE, ln), math.exp(_poly(_SD_LARGE, ln))
    return 1 - _N.cdf((y - mu) / sigma)

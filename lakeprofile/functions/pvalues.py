"""Tail probabilities for test statistics.

Each call works on one statistic that Spark has already aggregated.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_TINY = 1e-300


def chi2_tail(x: float, dof: float) -> float:
    """P(chi-square with dof degrees of freedom > x)."""
    if dof <= 0 or x <= 0:
        return 1.0
    a, x = dof / 2.0, x / 2.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, max(0.0, 1.0 - total * math.exp(log_front)))
    # Lentz evaluation of the continued fraction of the upper incomplete gamma.
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, math.exp(log_front) * h)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or _TINY)
    h = d
    for m in range(1, 200_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for num in (even, odd):
            d = 1 / ((1 + num * d) or _TINY)
            c = (1 + num / c) or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, math.exp(log_front) * h / a)


def t_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def correlation_pvalue(r: float | None, n: int) -> float | None:
    """Two-sided p of a Pearson r over n pairs."""
    if r is None or n < 3:
        return None
    rest = 1 - r * r
    if rest <= 0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / rest), n - 2)


def normality_k2(n: int, skew: float, excess_kurtosis: float) -> tuple[float, float]:
    """D'Agostino-Pearson K2 and its p from population skewness and kurtosis."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = (
        3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
        / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    )
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    z_skew = delta * math.asinh(y / math.sqrt(2.0 / (w2 - 1)))

    mean_b2 = 3.0 * (n - 1) / (n + 1)
    var_b2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3.0) * (n + 5))
    x = (excess_kurtosis + 3 - mean_b2) / math.sqrt(var_b2)
    root_b1 = (
        6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9))
        * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    )
    a = 6 + 8 / root_b1 * (2 / root_b1 + math.sqrt(1 + 4 / root_b1**2))
    base = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z_kurt = (1 - 2 / (9 * a) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))
    k2 = z_skew**2 + z_kurt**2
    return k2, math.exp(-k2 / 2)


# Coefficients of Royston's 1995 Shapiro-Wilk approximation (AS R94),
# highest power first.
_FIRST_WEIGHT = [-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0]
_SECOND_WEIGHT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
_SMALL_MEAN = [-6.714e-4, 0.025054, -0.39978, 0.5440]
_SMALL_LOG_SD = [-0.0020322, 0.062767, -0.77857, 1.3822]
_LARGE_MEAN = [0.0038915, -0.083751, -0.31082, -1.5861]
_LARGE_LOG_SD = [0.0030302, -0.082676, -0.4803]
_SMALL_GAMMA = [0.459, -2.273]


# Coefficients of Wichura's 1988 normal quantile (AS 241), above and below the
# fraction, highest power first: for the centre, the tails and the far tails.
NORMAL_CENTRE = (
    [2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987,
     13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665],
    [5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597,
     5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0],
)
NORMAL_TAIL = (
    [0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684,
     3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835],
    [1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008,
     0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0],
)
NORMAL_FAR = (
    [2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124,
     0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103],
    [2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133,
     0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0],
)


def shapiro_end_weights(n: int, norm2: float, m_last: float, m_before: float) -> tuple[float, float, float]:
    """Weights of the largest value and of the one before, and what the others' normal scores are
    divided by. ``norm2`` is the sum of all squared scores."""
    u = 1 / math.sqrt(n)
    last = float(np.polyval(_FIRST_WEIGHT, u)) + m_last / math.sqrt(norm2)
    before = float(np.polyval(_SECOND_WEIGHT, u)) + m_before / math.sqrt(norm2)
    scale = (norm2 - 2 * m_last**2 - 2 * m_before**2) / (1 - 2 * last**2 - 2 * before**2)
    return last, before, math.sqrt(scale)


def shapiro_pvalue(w: float, n: int) -> float | None:
    """p of W for 8 to 5000 values; the approximation holds for no others."""
    if not 8 <= n <= 5000:
        return None
    if w >= 1.0:
        return 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = float(np.polyval(_SMALL_GAMMA, n))
        if y >= gamma:
            return 0.0
        y = -math.log(gamma - y)
        mean, sd = np.polyval(_SMALL_MEAN, n), math.exp(np.polyval(_SMALL_LOG_SD, n))
    else:
        mean = np.polyval(_LARGE_MEAN, math.log(n))
        sd = math.exp(np.polyval(_LARGE_LOG_SD, math.log(n)))
    return 0.5 * math.erfc((y - float(mean)) / sd / math.sqrt(2))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p for 8 to 5000 values."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    centred = x - x.mean()
    total = float(centred @ centred)
    if x[-1] - x[0] < 1e-19 or total == 0:
        return 1.0, 1.0
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    last, before, scale = shapiro_end_weights(n, float(m @ m), m[-1], m[-2])
    weights = m / scale
    weights[[-2, 1]] = before, -before
    weights[[-1, 0]] = last, -last
    w = min(1.0, float(weights @ centred) ** 2 / total)
    return w, shapiro_pvalue(w, n)


def ks_two_sample(d: float, n1: int, n2: int, exact: bool = False) -> float:
    """Two-sided p of a two-sample Kolmogorov-Smirnov distance.

    The limit distribution at an argument with finite-sample terms, at every size; ``exact`` counts
    lattice paths instead, in time that grows with the product of the sizes.
    """
    if exact:
        return _ks_exact(d, n1, n2)
    n = n1 * n2 / (n1 + n2)
    root = math.sqrt(n)
    # Kolmogorov's limit at Vrbik's finite-sample argument.
    lam = d * root + 1 / (6 * root) + (d * root - 1) / (4 * n)
    return _kolmogorov_tail(lam)


def _kolmogorov_tail(lam: float) -> float:
    if lam <= 0:
        return 1.0
    if lam < 1.18:
        c = math.pi**2 / (8 * lam * lam)
        below = sum(math.exp(-c * (2 * j - 1) ** 2) for j in range(1, 20))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / lam * below))
    total = sum((-1) ** (j - 1) * math.exp(-2 * (j * lam) ** 2) for j in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def _ks_exact(d: float, n1: int, n2: int) -> float:
    """Share of the lattice paths from (0, 0) to (n1, n2) that reach distance d.

    Paths staying closer than d to the diagonal are counted one numpy row at a time, only inside
    that band and by their logarithms.
    """
    lcm = n1 // math.gcd(n1, n2) * n2
    a, b = lcm // n1, lcm // n2
    limit = round(d * lcm)
    if limit <= 0:
        return 1.0
    if d * math.sqrt(n1 * n2 / (n1 + n2)) > 6:  # below 1e-30
        return _kolmogorov_tail(d * math.sqrt(n1 * n2 / (n1 + n2)))
    start, row = 0, np.zeros(1)
    for i in range(n1 + 1):
        low = max(0, (i * a - limit) // b + 1)
        high = min(n2, -((-i * a - limit) // b) - 1)
        if high < low:
            return 1.0
        reached = np.full(high - low + 1, -np.inf)
        left, right = max(low, start), min(high, start + len(row) - 1)
        if left <= right:
            reached[left - low : right - low + 1] = row[left - start : right - start + 1]
        start, row = low, np.logaddexp.accumulate(reached)
    if start + len(row) - 1 < n2 or row[-1] == -np.inf:
        return 1.0
    paths = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    return min(1.0, max(0.0, -math.expm1(row[-1] - paths)))

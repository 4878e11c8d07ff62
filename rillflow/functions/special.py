"""Quantile and probability functions without scipy: SQL text for columns, NumPy for summaries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Wichura (1988), algorithm AS 241, coefficients in rising powers.
_CENTRE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3], [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
_NEAR = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4], [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
_FAR = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7], [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def _ratio(parts, x: str) -> str:
    def horner(c):
        text = f"{c[-1]:.17e}"
        for k in reversed(c[:-1]):
            text = f"({text} * {x} + {k:.17e})"
        return text

    return f"{horner(parts[0])} / {horner(parts[1])}"


def norm_ppf_sql(p: str) -> str:
    """Standard normal quantile of an SQL expression strictly inside (0, 1), else NULL; any SQL dialect."""
    q = f"(({p}) - 0.5e0)"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1e0 - ({p}) END))"
    tail = f"(CASE WHEN {r} <= 5 THEN {_ratio(_NEAR, f'({r} - 1.6e0)')} ELSE {_ratio(_FAR, f'({r} - 5e0)')} END)"
    return f"(CASE WHEN NOT (({p}) > 0 AND ({p}) < 1) THEN NULL WHEN abs({q}) <= 0.425e0 THEN {q} * {_ratio(_CENTRE, f'(0.180625e0 - {q} * {q})')} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def norm_ppf(p: str) -> Column:
    """Standard normal quantile of a column named `p` or of an SQL expression."""
    return F.expr(norm_ppf_sql(p))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 0.0
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, dof: float) -> float:
    """Probability of a larger absolute Student t."""
    return beta_cdf(dof / (dof + t * t), dof / 2, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    """Probability of a larger F."""
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def kolmogorov_pvalue(d: float, n: int) -> float:
    """Two-sided p-value of the one-sample Kolmogorov statistic, for any n.

    Twice the one-sided law where both sides can't be exceeded, or are by less than 3e-14 (n d^2 of 4
    and more), an exact matrix power up to MOST_STEPS, else an asymptotic series (Simard and L'Ecuyer 2011).
    """
    if d <= 0:
        return 1.0
    if d >= 0.5 or n * d * d >= 4:
        return float(min(1.0, 2 * _smirnov_upper(d, n)))
    below = _kolmogorov_matrix(d, n) if n * d < MOST_STEPS and n <= 100_000 else _kolmogorov_series(d, n)
    return float(min(1.0, max(0.0, 1 - below)))


#: n d up to which the law is a matrix power: its matrix has twice as many rows, whose factorials a float must hold.
MOST_STEPS = 80


def _smirnov_upper(d: float, n: int) -> float:
    """Probability of a larger one-sided statistic: the exact sum, its asymptotic form from n of 200,000."""
    if d >= 1:
        return 0.0
    if n > 200_000:
        z = (6 * n * d + 1) ** 2 / (18 * n)
        return max(0.0, 1 - (2 * z * z - 4 * z - 1) / (18 * n)) * math.exp(-z)
    j = np.arange(int(n * (1 - d)) + 1)
    rest = 1 - d - j / n
    j, rest = j[rest > 0], rest[rest > 0]
    log = np.fromiter(map(math.lgamma, range(1, n + 2)), float, n + 1)
    return float(np.exp(log[n] - log[j] - log[n - j] + (n - j) * np.log(rest) + (j - 1) * np.log(d + j / n) + math.log(d)).sum())


def _kolmogorov_series(d: float, n: int) -> float:
    """Distribution of the Kolmogorov statistic for a large n: four terms in powers of 1 / sqrt(n) (Pelz and Good 1976)."""
    z, pi2 = math.sqrt(n) * d, math.pi**2
    k = np.arange(1, int(16 * z / math.pi) + 2)
    odd, even = (2 * k - 1.0) ** 2, 1.0 * k**2
    q, whole = np.exp(-odd * pi2 / (8 * z * z)), np.exp(-even * pi2 / (2 * z * z))
    first = q.sum() / z
    second = ((pi2 / 4 * odd - z**2) * q).sum() / (6 * z**4)
    third = ((6 * z**6 + 2 * z**4 + (2 * z**4 - 5 * z**2) * pi2 / 4 * odd + pi2**2 * (1 - 2 * z**2) / 16 * odd**2) * q).sum() / (72 * z**7) - pi2 * (even * whole).sum() / (36 * z**3)
    c = (-30 * z**6 - 90 * z**8, pi2 * (135 * z**4 - 96 * z**6) / 4, pi2**2 * (212 * z**4 - 60 * z**2) / 16, pi2**3 * (5 - 30 * z**2) / 64)
    fourth = (sum(x * odd**i for i, x in enumerate(c)) * q).sum() / (6480 * z**10) + pi2 * ((3 * z**2 - pi2 * even) * even * whole).sum() / (216 * z**6)
    return math.sqrt(2 * math.pi) * float(first + second / n**0.5 + third / n + fourth / n**1.5)


def _kolmogorov_matrix(d: float, n: int) -> float:
    """Distribution of the Kolmogorov statistic, exact (matrix power of Marsaglia, Tsang and Wang)."""
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    H = np.array([[1.0 if i - j + 1 >= 0 else 0.0 for j in range(m)] for i in range(m)])
    for i in range(m):
        H[i, 0] -= h ** (i + 1)
        H[m - 1, i] -= h ** (m - i)
    H[m - 1, 0] += (2 * h - 1) ** m if 2 * h > 1 else 0
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                H[i, j] /= math.factorial(i - j + 1)
    out, power, shift, of_power = np.eye(m), H, 0, 0
    e = n
    while e:
        if e & 1:
            out, shift = out @ power, shift + of_power
        power, of_power = power @ power, 2 * of_power
        for which in (0, 1):
            x = out if which else power
            if x[k - 1, k - 1] > 1e140:
                x *= 1e-140
                if which:
                    shift += 140
                else:
                    of_power += 140
        e >>= 1
    s = out[k - 1, k - 1]
    for i in range(1, n + 1):
        s *= i / n
        if s < 1e-140:
            s, shift = s * 1e140, shift - 140
    return s * 10.0**shift


def _bessel_k(order: float, x: float) -> float:
    """Modified Bessel function of the second kind, from its integral over cosh."""
    t = np.linspace(0, math.acosh(1 + 745 / max(x, 1e-300)) if x < 745 else 1e-3, 4001)
    y = np.exp(-x * np.cosh(t)) * np.cosh(order * t)
    return float(np.trapezoid(y, t))


def cramer_von_mises_pvalue(w: float, n: int) -> float:
    """p-value of the Cramer-von Mises statistic: the limit law and the first correction for a finite n
    of Csorgo and Faraway (1996)."""
    if w <= 1 / (12 * n):
        return 1.0
    if w >= min(n / 3, 8):  # from 8 on it is below 2e-16, and the sums below would need more terms
        return 0.0

    def limit(x):
        total = 0.0
        for k in range(30):
            y = 4 * k + 1
            q = y * y / (16 * x)
            if q > 700:
                break
            term = math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1)) / math.pi**1.5 / math.sqrt(x) * math.sqrt(y) * math.exp(-q) * _bessel_k(0.25, q)
            total += term
        return total

    def correction(x):
        # the published expansion's term of order 1/n, besides the limit's own factor
        root, total = 2 * math.sqrt(x), 0.0

        def second(y):
            q = y * y / 4
            return math.exp(-q) * (y / 2) ** 1.5 * (_bessel_k(0.25, q) + _bessel_k(0.75, q)) / math.sqrt(math.pi) if q < 700 else 0.0

        def third(y):
            q = y * y / 4
            return math.exp(-q) * (y / 2) ** 2.5 * (2 * _bessel_k(0.25, q) + 3 * _bessel_k(0.75, q) - _bessel_k(1.25, q)) / math.sqrt(math.pi) if q < 700 else 0.0

        for k in range(20):
            m, g = 2 * k + 1, math.gamma(k + 0.5)
            near, mid, far = (4 * k + 1) / root, (4 * k + 3) / root, (4 * k + 5) / root
            term = m * g * second(mid) / (9 * x**0.75) + g * third(near) / (72 * x**1.25) + 2 * (m + 2) * math.gamma(k + 1.5) * third(far) / (12 * x**1.25)
            term += 7 * m * g * (second(near) + second(far)) / (144 * x**0.75)
            total -= term / (math.pi * math.gamma(k + 1))
            if near * near / 4 > 700:
                break
        return total

    return float(min(1.0, max(0.0, 1 - limit(w) * (1 + 1 / (12 * n)) - correction(w) / n)))


def anderson_darling_cdf(n: int, z: float) -> float:
    """Distribution of the Anderson-Darling statistic: its limit with the finite-n correction of Marsaglia (2004)."""
    if z <= 0:
        return 0.0
    # Polynomials and bounds of the published approximation, with its correction for a finite n (Marsaglia and Marsaglia 2004).
    if z < 2:
        x = math.exp(-1.2337141 / z) / math.sqrt(z) * (2.00012 + (0.247105 - (0.0649821 - (0.0347962 - (0.0116720 - 0.00168691 * z) * z) * z) * z) * z)
    else:
        x = math.exp(-math.exp(1.0776 - (2.30695 - (0.43424 - (0.082433 - (0.008056 - 0.0003146 * z) * z) * z) * z) * z))
    if x > 0.8:
        return x + (-130.2137 + (745.2337 - (1705.091 - (1950.646 - (1116.360 - 255.7844 * x) * x) * x) * x) * x) / n
    c = 0.01265 + 0.1757 / n
    if x < c:
        t = x / c
        return x + math.sqrt(t) * (1 - t) * (49 * t - 102) * (0.0037 / n**3 + 0.00078 / n**2 + 0.00006 / n)
    t = (x - c) / (0.8 - c)
    t = -0.00022633 + (6.54034 - (14.6538 - (14.458 - (8.259 - 1.91864 * t) * t) * t) * t) * t
    return x + t * (0.04213 / n + 0.01365 / n**2)


def runoff_ratio(aridity: Column, n: float = 2.5) -> Column:
    """Runoff over rainfall of the Turc-Mezentsev water balance, from rainfall over potential evaporation."""
    return 1 - 1 / F.pow(1 + F.pow(aridity, F.lit(n)), F.lit(1 / n))

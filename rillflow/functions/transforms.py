"""Thirteen data transforms as column expressions: forward, backward and Jacobian.

Arguments outside a transform's domain give NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def _real(x: Column) -> Column:
    """NaN (of a power of a negative number) as NULL."""
    return F.nullif(x, F.lit(float("nan")))


@dataclass
class Transform:
    """Base: the identity."""

    def forward(self, x: Column) -> Column:
        return x

    def backward(self, y: Column) -> Column:
        return y

    def jacobian(self, x: Column) -> Column:
        return x * 0 + 1

    def backward_censored(self, y: Column, censor: float = 0.0) -> Column:
        """Back to values of at least `censor`."""
        low = F.coalesce(self.forward(F.lit(float(censor))), F.lit(float("-inf")))
        return F.greatest(self.backward(F.greatest(y, low)), F.lit(float(censor)))


class Identity(Transform):
    pass


@dataclass
class Logit(Transform):
    lower: float = 0.0
    logdelta: float = 0.0

    def _v(self, x):
        return (x - self.lower) / F.exp(F.lit(self.logdelta))

    def forward(self, x):
        v = self._v(x)
        return F.ln(F.when((v > 0) & (v < 1), 1 / (1 - v) - 1))

    def backward(self, y):
        return (1 - 1 / (1 + F.exp(y))) * F.exp(F.lit(self.logdelta)) + self.lower

    def jacobian(self, x):
        v = self._v(x)
        return F.when((v > EPS) & (v < 1 - EPS), F.try_divide(F.lit(1.0), F.exp(F.lit(self.logdelta)) * v * (1 - v)))


@dataclass
class Log(Transform):
    nu: float = EPS
    base: float = 2.718281828459045

    def forward(self, x):
        return F.ln(x + self.nu) / F.ln(F.lit(self.base))

    def backward(self, y):
        return F.exp(y * F.ln(F.lit(self.base))) - self.nu

    def jacobian(self, x):
        return F.when(x + self.nu > EPS, F.try_divide(F.lit(1.0), (x + self.nu) * F.ln(F.lit(self.base))))


@dataclass
class BoxCox2(Transform):
    nu: float = EPS
    lam: float = 1.0

    def forward(self, x):
        u = x + self.nu
        if abs(self.lam) <= EPS:
            return F.ln(u)
        return (_real(F.pow(u, self.lam)) - 1) / self.lam

    def backward(self, y):
        if abs(self.lam) <= EPS:
            return F.exp(y) - self.nu
        return _real(F.pow(self.lam * y + 1, 1 / self.lam)) - self.nu

    def jacobian(self, x):
        return F.when(x + self.nu > 0, F.pow(x + self.nu, self.lam - 1))


class BoxCox1lam(BoxCox2):
    """Box-Cox with `lam` as the parameter and a constant `nu`, which has to be given."""

    def __post_init__(self):
        if self.nu != self.nu:
            raise ValueError("nu is not set")


class BoxCox1nu(BoxCox2):
    """Box-Cox with `nu` as the parameter and a constant `lam`, which has to be given."""

    def __post_init__(self):
        if self.lam != self.lam:
            raise ValueError("lam is not set")


class BoxCox2sym(BoxCox2):
    """Box-Cox on both sides of 0."""

    def forward(self, x):
        return F.signum(x) * (super().forward(F.abs(x)) - super().forward(F.lit(0.0)))

    def backward(self, y):
        return F.signum(y) * super().backward(F.abs(y) + super().forward(F.lit(0.0)))

    def jacobian(self, x):
        return super().jacobian(F.abs(x))


@dataclass
class YeoJohnson(Transform):
    nu: float = 0.0
    scale: float = 1.0
    lam: float = 1.0

    def forward(self, x):
        w = self.nu + self.scale * x
        up = F.ln(w + 1) if abs(self.lam) <= EPS else (F.pow(w + 1, self.lam) - 1) / self.lam
        m = 2 - self.lam
        down = -F.ln(1 - w) if abs(m) <= EPS else -(F.pow(1 - w, m) - 1) / m
        return F.when(w >= EPS, up).otherwise(down)

    def backward(self, y):
        up = F.exp(y) - 1 if abs(self.lam) <= EPS else _real(F.pow(self.lam * y + 1, 1 / self.lam)) - 1
        m = 2 - self.lam
        down = 1 - F.exp(-y) if abs(m) <= EPS else 1 - _real(F.pow(1 - m * y, 1 / m))
        return (F.when(y >= EPS, up).otherwise(down) - self.nu) / self.scale

    def jacobian(self, x):
        w = self.nu + self.scale * x
        return self.scale * F.when(w >= EPS, F.pow(w + 1, self.lam - 1)).otherwise(F.pow(1 - w, 1 - self.lam))


@dataclass
class LogSinh(Transform):
    loga: float = -1.0
    logb: float = 0.0
    xmax: float = 1.0

    def __post_init__(self):
        if self.xmax != self.xmax:
            raise ValueError("xmax is not set")

    def forward(self, x):
        a, b = F.exp(F.lit(self.loga)), F.exp(F.lit(self.logb))
        w = a + b * x / self.xmax
        return F.when(w > 0, (w + F.ln((1 - F.exp(-2 * w)) / 2)) / b)

    def backward(self, y):
        a, b = F.exp(F.lit(self.loga)), F.exp(F.lit(self.logb))
        return self.xmax * (y + (F.ln(1 + F.sqrt(1 + F.exp(-2 * b * y))) - a) / b)

    def jacobian(self, x):
        a, b = F.exp(F.lit(self.loga)), F.exp(F.lit(self.logb))
        w = a + b * x / self.xmax
        return F.when(w > 0, 1 / F.tanh(w) / self.xmax)

    def logprior(self) -> float:
        """Normal log density of logb with standard deviation 0.3, but for a constant."""
        return -0.5 * (self.logb / 0.3) ** 2


@dataclass
class Reciprocal(Transform):
    nu: float = EPS

    def forward(self, x):
        return F.when(x > -self.nu, F.try_divide(F.lit(-1.0), self.nu + x))

    def backward(self, y):
        return F.when(y < -EPS, F.try_divide(F.lit(-1.0), y) - self.nu)

    def jacobian(self, x):
        return F.when(x > -self.nu, F.try_divide(F.lit(1.0), (self.nu + x) * (self.nu + x)))


class Softmax(Transform):
    """Of an array column: positive parts whose sum is below 1."""

    def _sum(self, x):
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def forward(self, x):
        s = self._sum(x)
        wrong = F.exists(x, lambda v: v < 0) | (s > 1 - EPS)
        return F.when(wrong, F.raise_error(F.lit("parts must be >= 0 and sum to less than 1"))).otherwise(F.transform(x, lambda v: F.ln(v / (1 - s))))

    def backward(self, y):
        s = self._sum(F.transform(y, F.exp))
        return F.transform(y, lambda v: F.exp(v) / (1 + s))

    def jacobian(self, x):
        s = self._sum(x)
        product = F.aggregate(x, F.lit(1.0), lambda a, v: a * v)
        return F.try_divide(1 + F.try_divide(s, 1 - s), product)


@dataclass
class Sinh(Transform):
    nu: float = 0.0
    scale: float = 1.0

    def forward(self, x):
        return F.asinh((x - self.nu) * self.scale)

    def backward(self, y):
        return F.sinh(y) / self.scale + self.nu

    def jacobian(self, x):
        u = (x - self.nu) * self.scale
        return self.scale / F.sqrt(1 + u * u)


@dataclass
class Manly(Transform):
    lam: float = 0.1
    xmax: float = 1.0

    def forward(self, x):
        return x / self.xmax if abs(self.lam) <= EPS else (F.exp(self.lam * x / self.xmax) - 1) / self.lam

    def backward(self, y):
        return self.xmax * y if abs(self.lam) <= EPS else self.xmax * F.ln(1 + self.lam * y) / self.lam

    def jacobian(self, x):
        return F.exp(self.lam * x / self.xmax) / self.xmax


TRANSFORMS = {t.__name__: t for t in (Identity, Logit, Log, BoxCox2, BoxCox1lam, BoxCox1nu, BoxCox2sym, YeoJohnson, LogSinh, Reciprocal, Softmax, Sinh, Manly)}


def get_transform(name: str, **values) -> Transform:
    """A transform by name; values that it doesn't know are ignored."""
    if name not in TRANSFORMS:
        raise ValueError(f"no transform {name!r}: expected one of {', '.join(TRANSFORMS)}")
    kind = TRANSFORMS[name]
    known = getattr(kind, "__dataclass_fields__", {})
    return kind(**{k: v for k, v in values.items() if k in known})

"""Regression, autocorrelation, dominance, sampling and autoregressive models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.nulls import clean, ratio
from rillflow.functions.special import f_upper, norm_ppf_sql, t_two_sided


def acf(df: DataFrame, value: str, by: list[str], order: list[str], maxlag: int = 1) -> DataFrame:
    """by, lag, acf, covar for lags 1..maxlag; covar is that of lag 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.select(*by, *order, clean(value).alias("x")).withColumn("m", F.avg("x").over(Window.partitionBy(*by)))
    d = F.col("x") - F.col("m")
    x = x.withColumns({f"c{k}": F.when(F.row_number().over(w) > k, F.coalesce(d * (F.lag("x", k).over(w) - F.col("m")), F.lit(0.0))) for k in range(maxlag + 1)})
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("c")) for k in range(maxlag + 1)])
    each = x.select(*by, F.explode(lags).alias("z")).groupBy(*by, "z.lag").agg(F.avg("z.c").alias("c"))
    zero = each.where("lag = 0").select(*by, F.col("c").alias("covar"))
    return each.where("lag > 0").join(zero, by).select(*by, "lag", ratio(F.col("c"), F.col("covar")).alias("acf"), "covar")


def semicorr(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, rho, rho_plus, rho_minus: correlation of all pairs, and of those with both above or below 0."""
    up, down = (F.col(x) > 0) & (F.col(y) > 0), (F.col(x) < 0) & (F.col(y) < 0)
    return df.groupBy(*by).agg(F.corr(x, y).alias("rho"), F.corr(F.when(up, F.col(x)), F.when(up, F.col(y))).alias("rho_plus"), F.corr(F.when(down, F.col(x)), F.when(down, F.col(y))).alias("rho_minus"))


def semicorr_theory(rho: float) -> float:
    """Semicorrelation of a bivariate normal law with correlation `rho`, by quadrature."""
    z = np.linspace(0, 8, 1601)
    x, y = np.meshgrid(z, z)
    p = np.exp(-(x * x - 2 * rho * x * y + y * y) / (2 * (1 - rho * rho)))
    total = p.sum()
    mx = (p * x).sum() / total
    vx = (p * x * x).sum() / total - mx * mx
    return float(((p * x * y).sum() / total - mx * mx) / vx)


def moments(df: DataFrame, xs: list[str], y: str, by: list[str], intercept: bool = True) -> DataFrame:
    """by and the cross products of predictors and response: one aggregation pass, map-side combined."""
    rows = df.select(*by, *([F.lit(1.0).alias("one")] if intercept else []), *[clean(c).alias(c) for c in xs], clean(y).alias(y)).dropna(subset=[*xs, y])
    names = ["one"] * intercept + xs + [y]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{i + j}") for i, a in enumerate(names) for j, b in enumerate(names[i:])]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *products)


def lstsq(df: DataFrame, xs: list[str], y: str, by: list[str], intercept: bool = True) -> DataFrame:
    """by, term, estimate, stderr, t, p: ordinary least squares from cross products.

    Each group's normal equations are solved in NumPy; they are a few numbers.
    """
    names = ["intercept"] * intercept + xs
    k = len(names)

    def run(pdf):
        import pandas as pd

        rows = []
        for r in pdf.to_dict("records"):
            m = np.zeros((k + 1, k + 1))
            for i in range(k + 1):
                for j in range(i, k + 1):
                    m[i, j] = m[j, i] = r[f"p_{i}_{j}"]
            n, a, b = r["n"], m[:k, :k], m[:k, k]
            if n < k + 1:
                raise ValueError(f"{n} rows don't determine {k} parameters")
            inverse = np.linalg.inv(a)
            theta = inverse @ b
            s2 = max(0.0, m[k, k] - theta @ b) / (n - k)
            for i, name in enumerate(names):
                se = float(np.sqrt(s2 * inverse[i, i]))
                t = theta[i] / se if se > 0 else np.inf
                rows.append({**{c: r[c] for c in by}, "term": name, "estimate": theta[i], "stderr": se, "t": t, "p": t_two_sided(t, n - k)})
        return pd.DataFrame(rows, columns=[*by, "term", "estimate", "stderr", "t", "p"])

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    m = moments(df, xs, y, by, intercept)
    return m.groupBy(*by).applyInPandas(run, f"{kinds}term string, estimate double, stderr double, t double, p double")


def f_test(x: np.ndarray, y: np.ndarray, R: np.ndarray, r: np.ndarray) -> tuple[float, float]:
    """F and p of the restrictions R theta = r on the least-squares parameters of y on x."""
    n, k = x.shape
    inverse = np.linalg.inv(x.T @ x)
    theta = inverse @ x.T @ y
    s2 = ((y - x @ theta) ** 2).sum() / (n - k)
    d = R @ theta - r
    f = float(d @ np.linalg.inv(R @ inverse @ R.T) @ d / len(r) / s2)
    return f, f_upper(f, len(r), n - k)


def leverage(df: DataFrame, xs: list[str], name: str = "leverage") -> DataFrame:
    """`df` with each row's leverage; the inverse of X'X is a few numbers."""
    k = len(xs)
    m = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)]).first()
    inverse = np.linalg.inv(np.array([[m[f"p_{i}_{j}"] for j in range(k)] for i in range(k)], float))
    return df.withColumn(name, sum(F.col(a) * F.col(b) * float(inverse[i, j]) for i, a in enumerate(xs) for j, b in enumerate(xs)))


def dominance(df: DataFrame, key: str, dims: list[str], by: list[str], orientation: int = 1) -> DataFrame:
    """by, key, dominated_by: how many other points of the group are at least as good in every dimension.

    Equal points dominate each other; a point with a missing value neither dominates nor is dominated.
    The comparison is a join within the group on the first dimension's order.
    """
    sign = 1 if orientation >= 0 else -1
    a = df.select(*[F.col(c).alias(f"ga{i}") for i, c in enumerate(by)], F.col(key).alias("ka"), *[(sign * clean(d)).alias(f"a{i}") for i, d in enumerate(dims)])
    b = df.select(*[F.col(c).alias(f"gb{i}") for i, c in enumerate(by)], F.col(key).alias("kb"), *[(sign * clean(d)).alias(f"b{i}") for i, d in enumerate(dims)])
    on = F.col("ka") != F.col("kb")
    for i in range(len(by)):
        on = on & (F.col(f"ga{i}") == F.col(f"gb{i}"))
    for i in range(len(dims)):
        on = on & (F.col(f"a{i}") >= F.col(f"b{i}"))
    n = a.join(b, on).groupBy(*[F.col(f"gb{i}").alias(c) for i, c in enumerate(by)], F.col("kb").alias(key)).agg(F.count("*").alias("n"))
    return df.select(*by, key).join(n, [*by, key], "left").select(*by, key, F.coalesce("n", F.lit(0)).alias("dominated_by"))


def latin_hypercube(spark: SparkSession, n: int, low: list[float], high: list[float], seed: int = 1) -> DataFrame:
    """sample, x0, x1, ...: in each dimension one draw of each of `n` equal slices, in random order."""
    if any(b <= a for a, b in zip(low, high, strict=True)):
        raise ValueError("each upper bound must exceed its lower bound")
    out = spark.range(n).withColumnRenamed("id", "sample")
    for k, (a, b) in enumerate(zip(low, high, strict=True)):
        draws = spark.range(n).withColumn("r", F.rand(seed + k)).withColumn("u", F.rand(seed + 1000 + k))
        placed = draws.select((F.row_number().over(Window.orderBy("r")) - 1).alias("sample"), (F.lit(a) + (b - a) * (F.col("id") + F.col("u")) / n).alias(f"x{k}"))
        out = out.join(placed, "sample")
    return out


def latin_hypercube_normal(spark: SparkSession, n: int, mean: list[float], cov: list[list[float]], seed: int = 1) -> DataFrame:
    """A Latin hypercube of a multivariate normal law."""
    k = len(mean)
    root = np.linalg.cholesky(np.array(cov, float))
    u = latin_hypercube(spark, n, [0.0] * k, [1.0] * k, seed)
    z = u.select("sample", *[F.expr(norm_ppf_sql(f"x{i}")).alias(f"z{i}") for i in range(k)])
    return z.select("sample", *[(sum(F.col(f"z{j}") * float(root[i, j]) for j in range(i + 1)) + float(mean[i])).alias(f"x{i}") for i in range(k)])


def yule_walker(rho: list[float]) -> list[float]:
    """AR parameters from autocorrelations of lags 1, 2, ..."""
    r = np.array([1.0, *rho])
    p = len(rho)
    return np.linalg.solve(np.array([[r[abs(i - j)] for j in range(p)] for i in range(p)]), r[1:]).tolist()


def ar_simulate(df: DataFrame, innovation: str, params: list[float], by: list[str], order: list[str], mean: float = 0.0, initial: float | None = None, name: str = "sim") -> DataFrame:
    """`df` with the AR series of its innovations; a missing innovation counts as 0. A series is one loop."""
    if not 1 <= len(params) <= 10:
        raise ValueError("an AR model has 1 to 10 parameters")

    def run(pdf):
        pdf = pdf.sort_values(order)
        past, out = [(mean if initial is None else initial) - mean] * len(params), []
        for e in pdf[innovation].fillna(0.0):
            now = e + sum(p * v for p, v in zip(params, past, strict=True))
            past = [now, *past[:-1]]
            out.append(now + mean)
        return pdf.assign(**{name: out})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(*by).applyInPandas(run, f"{kinds}, {name} double")


def ar_residual(df: DataFrame, value: str, params: list[float], by: list[str], order: list[str], mean: float | None = None, initial: float | None = None, name: str = "residual") -> DataFrame:
    """`df` with the innovations of its AR series; a missing value is replaced by its estimate (residual 0)."""

    def run(pdf):
        pdf = pdf.sort_values(order)
        m = float(pdf[value].mean()) if mean is None else mean
        past, out = [(m if initial is None else initial) - m] * len(params), []
        for x in pdf[value].to_numpy(float):
            guess = sum(p * v for p, v in zip(params, past, strict=True))
            now = guess if np.isnan(x) else x - m
            past = [now, *past[:-1]]
            out.append(now - guess)
        return pdf.assign(**{name: out})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(*by).applyInPandas(run, f"{kinds}, {name} double")


def kde_grid(df: DataFrame, x: str, y: str, ngrid: int = 50, pad: float = 0.05) -> DataFrame:
    """gx, gy, density: Gaussian kernel density on a padded grid, Scott's bandwidth, full covariance."""
    p = df.select(clean(x).alias("x"), clean(y).alias("y")).dropna()
    s = p.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max), ("v", F.var_samp))], F.covar_samp("x", "y").alias("c")).first()
    scale = s["n"] ** (-1 / 3)
    cov = np.array([[s["vx"], s["c"]], [s["c"], s["vy"]]]) * scale
    inv, det = np.linalg.inv(cov), float(np.linalg.det(cov))

    def axis(lo, hi, i):
        a, b = lo - pad * (hi - lo), hi + pad * (hi - lo)
        return F.lit(a) + (b - a) * i / (ngrid - 1)

    grid = df.sparkSession.range(ngrid * ngrid).select(axis(s["lox"], s["hix"], F.floor(F.col("id") / ngrid)).alias("gx"), axis(s["loy"], s["hiy"], F.col("id") % ngrid).alias("gy"))
    cells = [(r["gx"], r["gy"]) for r in grid.collect()]  # ngrid^2 places
    gx, gy = (np.array([c[k] for c in cells]) for k in (0, 1))

    def run(batches):
        import pandas as pd

        total = np.zeros(len(gx))
        for b in batches:
            for k in range(0, len(b), 256):
                dx, dy = gx[:, None] - b["x"].to_numpy()[None, k : k + 256], gy[:, None] - b["y"].to_numpy()[None, k : k + 256]
                total += np.exp(-0.5 * (inv[0, 0] * dx * dx + 2 * inv[0, 1] * dx * dy + inv[1, 1] * dy * dy)).sum(axis=1)
        yield pd.DataFrame({"gx": gx, "gy": gy, "s": total})

    part = p.mapInPandas(run, "gx double, gy double, s double")
    return part.groupBy("gx", "gy").agg((F.sum("s") / (2 * np.pi * np.sqrt(det) * s["n"])).alias("density"))


def cov_ellipse(df: DataFrame, x: str, y: str, by: list[str], pvalue: float = 0.95) -> DataFrame:
    """by, cx, cy, major, minor, angle: the ellipse that holds `pvalue` of a bivariate normal law."""
    q = -2 * np.log(1 - pvalue)
    m = df.groupBy(*by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("a"), F.var_samp(y).alias("b"), F.covar_samp(x, y).alias("c"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("c") * F.col("c"))
    return m.select(*by, "cx", "cy", (2 * F.sqrt(q * (half + root))).alias("major"), (2 * F.sqrt(q * F.greatest(half - root, F.lit(0.0)))).alias("minor"), F.degrees(F.atan2(half + root - F.col("a"), F.col("c"))).alias("angle"))


def restriction_test(df: DataFrame, xs: list[str], y: str, by: list[str], R: list[list[float]], r: list[float] | None = None, intercept: bool = True) -> DataFrame:
    """by, f, p of the restrictions R theta = r (0 if not given) on the least-squares parameters, from cross products."""
    k = len(xs) + intercept
    rest = np.array(R, float)
    if rest.ndim != 2 or rest.shape[1] != k:
        raise ValueError(f"R must have a column for each of {k} parameters")
    goal = np.zeros(len(rest)) if r is None else np.array(r, float)

    def run(pdf):
        import pandas as pd

        rows = []
        for one in pdf.to_dict("records"):
            m = np.zeros((k + 1, k + 1))
            for i in range(k + 1):
                for j in range(i, k + 1):
                    m[i, j] = m[j, i] = one[f"p_{i}_{j}"]
            inverse = np.linalg.inv(m[:k, :k])
            theta = inverse @ m[:k, k]
            s2, d = (m[k, k] - theta @ m[:k, k]) / (one["n"] - k), rest @ theta - goal
            f = float(d @ np.linalg.inv(rest @ inverse @ rest.T) @ d / len(rest) / s2)
            rows.append({**{c: one[c] for c in by}, "f": f, "p": f_upper(f, len(rest), one["n"] - k)})
        return pd.DataFrame(rows, columns=[*by, "f", "p"])

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    return moments(df, xs, y, by, intercept).groupBy(*by).applyInPandas(run, f"{kinds}f double, p double")

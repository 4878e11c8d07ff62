"""Verification scores of simulated against observed values, and categorical scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.nulls import clean, ratio
from rillflow.operators.quantiles import group_key, quantiles, with_quantiles

EPS = 1e-10


def pairs(df: DataFrame, obs: str, sim: str, by: list[str], trans=None, exclude_null: bool = False) -> DataFrame:
    """by, o, s after the transform; rows with a missing value go only if `exclude_null`."""
    f = trans.forward if trans else (lambda x: x)
    out = df.select(*by, clean(f(clean(obs))).alias("o"), clean(f(clean(sim))).alias("s"))
    return out.where("o is not null and s is not null") if exclude_null else out


def _whole(x: Column) -> Column:
    """NULL if any pair of the group is missing a value."""
    return F.when(F.count_if(F.col("o").isNull() | F.col("s").isNull()) == 0, x)


def bias(df: DataFrame, obs: str, sim: str, by: list[str], kind: str = "standard", **how) -> DataFrame:
    mo, ms = F.avg("o"), F.avg("s")
    if kind == "standard":
        out = F.when(F.abs(mo) >= EPS, ratio(ms - mo, mo))
    elif kind == "normalised":
        out = F.when(F.abs(mo) >= EPS, ratio(ms - mo, ms + mo))
    elif kind == "log":
        out = F.when((mo > EPS) & (ms > EPS), F.ln(ms) - F.ln(mo))
    else:
        raise ValueError(f"unknown bias {kind!r}: expected standard, normalised or log")
    return pairs(df, obs, sim, by, **how).groupBy(*by).agg(_whole(out).alias("bias"))


def nse(df: DataFrame, obs: str, sim: str, by: list[str], **how) -> DataFrame:
    """Nash-Sutcliffe efficiency."""
    e = F.col("s") - F.col("o")
    return pairs(df, obs, sim, by, **how).groupBy(*by).agg(_whole(1 - ratio(F.sum(e * e), F.var_pop("o") * F.count("o"))).alias("nse"))


def kge(df: DataFrame, obs: str, sim: str, by: list[str], **how) -> DataFrame:
    """Kling-Gupta efficiency."""
    mo, so, ss = F.avg("o"), F.stddev_pop("o"), F.stddev_pop("s")
    a, b, c = 1 - ratio(F.avg("s"), mo), 1 - ratio(ss, so), 1 - F.corr("o", "s")
    ok = (F.abs(mo) >= EPS) & (so >= EPS) & (ss >= EPS)
    return pairs(df, obs, sim, by, **how).groupBy(*by).agg(_whole(F.when(ok, 1 - F.sqrt(a * a + b * b + c * c))).alias("kge"))


def _average_rank(column: str, by: list[str]) -> Column:
    ties = F.count("*").over(Window.partitionBy(*by, column))
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (ties - 1) / 2


def median_of(x: Column) -> Column:
    """Median of an array column without its missing members."""
    v = F.array_sort(F.filter(x, lambda e: e.isNotNull() & ~F.isnan(e)))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.expr("0") + F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def mean_of(x: Column) -> Column:
    """Mean of an array column without its missing members."""
    v = F.filter(x, lambda e: e.isNotNull() & ~F.isnan(e))
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, e: a + e) / F.size(v))


def corr(df: DataFrame, obs: str, sim: str, by: list[str], kind: str = "Pearson", ensemble: str | None = None, **how) -> DataFrame:
    """Correlation of observations with simulations, or with an ensemble's mean or median.

    `censored` is computed as Spearman's.
    """
    if kind not in ("Pearson", "Spearman", "censored"):
        raise ValueError(f"unknown correlation {kind!r}")
    if ensemble:
        df = df.withColumn(sim, median_of(F.col(sim)) if ensemble == "median" else mean_of(F.col(sim)))
    p = pairs(df, obs, sim, by, **how)
    if kind != "Pearson":
        p = p.withColumn("ro", _average_rank("o", by)).withColumn("rs", _average_rank("s", by))
    a, b = ("o", "s") if kind == "Pearson" else ("ro", "rs")
    return p.groupBy(*by).agg(_whole(F.corr(a, b)).alias("corr"))


def relative_percentile_error(df: DataFrame, obs: str, sim: str, by: list[str], low: float = 0, high: float = 100, eps: float = 0.0, modified: bool = False, neval: int = 50) -> DataFrame:
    """by, error: mean absolute relative error over `neval` percentiles from `low` to `high`."""
    if not 0 <= low <= high <= 100 or high - low < 1:
        raise ValueError("the percentile range must be within 0 to 100, and at least 1 wide")
    marks = [(low + (high - low) * k / (neval - 1)) / 100 for k in range(neval)]
    p = pairs(df, obs, sim, by, exclude_null=True)
    q = with_quantiles(with_quantiles(p.select(*by).distinct(), p, "o", by, marks, "qo"), p, "s", by, marks, "qs")
    each = q.select(*by, F.explode(F.arrays_zip("qo", "qs")).alias("q")).select(*by, "q.qo", "q.qs")
    d = F.col("qs") - F.col("qo")
    total = F.col("qo") + F.col("qs")
    err = F.when(F.abs(total) > EPS, ratio(d, total)).otherwise(0.0) if modified else ratio(d, F.col("qo") + eps)
    return each.groupBy(*by).agg(F.avg(F.abs(err)).alias("error"))


def absolute_peak_error(df: DataFrame, obs: str, sim: str, by: list[str], order: list[str], erase: int = 300, before: int = 5, after: int = 10, events: int = 500) -> DataFrame:
    """by, event, obs_pos, sim_pos, shift: the largest peaks, each erased before the next is sought.

    The search depends on what was erased before, so a series is one pandas loop.
    """

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(order)
        o, s = (pdf[c].to_numpy(float).copy() for c in (obs, sim))
        o[o < 0], s[s < 0] = np.nan, np.nan
        keys, rows, left = {c: pdf[c].iloc[0] for c in by}, [], int(np.isfinite(o).sum())
        while left > erase and len(rows) < events and np.isfinite(o).any():
            k = int(np.nanargmax(o))
            a, b = max(0, k - before), min(len(o), k + after + 1)
            if np.isfinite(s[a:b]).any():
                m = a + int(np.nanargmax(s[a:b]))
                rows.append({**keys, "event": len(rows), "obs_pos": k, "sim_pos": m, "shift": abs(m - k)})
            o[max(0, k - erase) : k + erase + 1] = np.nan
            left -= 2 * erase + 1
        return pd.DataFrame(rows, columns=[*by, "event", "obs_pos", "sim_pos", "shift"])

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    return df.select(*by, *order, obs, sim).groupBy(*by).applyInPandas(run, f"{kinds}event int, obs_pos int, sim_pos int, shift int")


def confusion(df: DataFrame, obs: str, sim: str, ncat: int) -> DataFrame:
    """obs, sim, n for all pairs of categories 0..ncat-1, also those that don't occur."""
    counts = df.groupBy(F.col(obs).cast("int").alias("obs"), F.col(sim).cast("int").alias("sim")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(ncat * ncat).select((F.col("id") / ncat).cast("int").alias("obs"), (F.col("id") % ncat).cast("int").alias("sim"))
    return spine.join(counts, ["obs", "sim"], "left").select("obs", "sim", F.coalesce("n", F.lit(0)).alias("n"))


def binary_scores(df: DataFrame, obs: str, sim: str, by: list[str] | None = None) -> DataFrame:
    """Scores of a yes/no forecast from its four counts."""
    o, s = F.col(obs) == 1, F.col(sim) == 1
    c = df.where(F.col(obs).isNotNull() & F.col(sim).isNotNull()).groupBy(*(by or [])).agg(F.count_if(o & s).cast("double").alias("tp"), F.count_if(~o & s).cast("double").alias("fp"), F.count_if(o & ~s).cast("double").alias("fn"), F.count_if(~o & ~s).cast("double").alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    h, f = ratio(tp, tp + fn), ratio(fp, fp + tn)
    theta = F.when((h > 0) & (h < 1) & (f > 0) & (f < 1), ratio(tp * tn, fp * fn))
    out = {
        "truepos": tp, "falsepos": fp, "falseneg": fn, "trueneg": tn,
        "bias": ratio(tp + fp, tp + fn), "hitrate": h, "precision": ratio(tp, tp + fp), "falsealarm": f, "accuracy": ratio(tp + tn, n),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "lor": F.ln(theta), "orss": ratio(theta - 1, theta + 1),
        "eds": F.when(tp > 0, ratio(2 * F.ln(ratio(tp + fn, n)), F.ln(ratio(tp, n))) - 1),
    }
    return c.select(*(by or []), *[v.alias(k) for k, v in out.items()])


def box_stats(df: DataFrame, value: str, by: list[str], box: float = 50.0, whiskers: float = 90.0) -> DataFrame:
    """count, mean, min, max, median, and the ends of box and whiskers; up to 3 values give the count only."""
    if whiskers <= box or box < 40:
        raise ValueError("whiskers must cover more than the box, and the box at least 40 %")
    cuts = [(100 - whiskers) / 200, (100 - box) / 200, 0.5, 1 - (100 - box) / 200, 1 - (100 - whiskers) / 200]
    names = ["whisker_low", "box_low", "median", "box_high", "whisker_high"]
    x = F.nullif(F.nullif(clean(value), F.lit(float("inf"))), F.lit(float("-inf")))
    g = df.select(*by, x.alias("x")).groupBy(*by).agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    g = with_quantiles(g, df.select(*by, x.alias("x")), "x", by, cuts)
    many = F.col("count") > 3
    return g.select(*by, "count", *[F.when(many, F.col(c)).alias(c) for c in ("mean", "min", "max")], *[F.when(many, F.col("q")[i]).alias(c) for i, c in enumerate(names)])


def ismisscens(columns: list[str], censor: float = 0.0, eps: float = 1e-10) -> Column:
    """Base-3 code over columns: 0 missing, 1 censored, 2 valid."""
    out = F.lit(0)
    for i, c in enumerate(columns):
        out = out + F.when(clean(c).isNull(), 0).when(clean(c) < censor + eps, 1).otherwise(2) * 3**i
    return out.cast("bigint")


def scatter_bins(df: DataFrame, value: str, ncats: int = 5, cuts: list[float] | None = None) -> DataFrame:
    """cat, n: rows in right-closed bins between quantiles or given cuts; -1 for missing values."""
    x = df.select(clean(value).alias("x"))
    if cuts is None:
        marks = quantiles(x, "x", [], [k / ncats for k in range(ncats + 1)]).select(F.col("q").alias("cuts"))
    else:
        if len(set(cuts)) < len(cuts):
            raise ValueError("cuts must differ")
        marks = df.sparkSession.range(1).select(F.array(*[F.lit(float(c)) for c in cuts]).alias("cuts"))
    y = x.crossJoin(F.broadcast(marks))  # one row
    below = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    last = F.size("cuts") - 2
    cat = F.when(F.col("x").isNull(), -1).otherwise(F.greatest(F.least(below - 1, last), F.lit(0)))
    return y.groupBy(cat.cast("int").alias("cat")).agg(F.count("*").alias("n"))


def pair_counts(df: DataFrame, obs: str, sim: str, by: list[str]) -> DataFrame:
    """by, n, missing: rows, and those that lack a value of the pair."""
    p = pairs(df, obs, sim, by)
    return p.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("o").isNull() | F.col("s").isNull()).alias("missing"))


def independent_scores(df: DataFrame, obs: str, sim: str, by: list[str] | None = None) -> DataFrame:
    """Scores that forecast and observation would have if they were independent, with the same totals."""
    c = binary_scores(df, obs, sim, by)
    tp, fp, fn, tn = (F.col(k) for k in ("truepos", "falsepos", "falseneg", "trueneg"))
    n = tp + fp + fn + tn
    hit, false, miss, rest = (tp + fn) * (tp + fp) / n, (fp + tn) * (tp + fp) / n, (tp + fn) * (fn + tn) / n, (fp + tn) * (fn + tn) / n
    out = {
        "accuracy": ratio(hit + rest, n), "hitrate": ratio(hit, tp + fn), "falsealarm": ratio(false, fp + tn), "precision": ratio(hit, tp + fp),
        "oddsratio": ratio(hit * rest, false * miss), "f1": ratio(2 * hit, 2 * hit + false + miss),
    }
    return c.select(*(by or []), *[v.alias(k) for k, v in out.items()])


def violin_kde(df: DataFrame, value: str, by: list[str], npoints: int = 100) -> DataFrame:
    """by, x, density: a Gaussian kernel density, scaled to 0..1, at regular places and at quantiles.

    Repeated lowest and highest values, which censoring makes, count once. Equal values are one row
    before they meet the places, so the work is distinct values times places. Up to two values, or
    equal ones, give no rows.
    """
    half = npoints // 2
    x = F.nullif(F.nullif(clean(value), F.lit(float("inf"))), F.lit(float("-inf")))
    v = df.select(group_key(by).alias("g"), x.alias("x")).where("x is not null")
    own = v.groupBy("g", "x").agg(F.count("*").alias("n"))
    ends = own.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("all")).where("all > 2 and lo < hi")
    # of values that are nearly the lowest or highest only one counts
    low, high = F.col("x") - F.col("lo") < EPS, F.col("hi") - F.col("x") < EPS
    once = own.join(ends, "g").select("g", F.when(low, F.col("lo")).when(high, F.col("hi")).otherwise(F.col("x")).alias("x"), F.when(low | high, 1).otherwise(F.col("n")).alias("n"))
    once = once.groupBy("g", "x").agg(F.max("n").cast("double").alias("n"))
    w, sx, sxx = F.sum("n"), F.sum(F.col("n") * F.col("x")), F.sum(F.col("n") * F.col("x") * F.col("x"))
    width = once.groupBy("g").agg((F.sqrt((sxx - sx * sx / w) / (w - 1)) * F.pow(w, F.lit(-0.2))).alias("h"))
    q = quantiles(v, "x", ["g"], [i / (half - 1) for i in range(half)]).select(F.col("g.g").alias("g"), "q")
    at = F.concat(F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (half - 1)), "q")
    places = ends.join(width, "g").join(q, "g").select("g", "h", F.posexplode(at).alias("i", "at"))
    z = (F.col("at") - F.col("x")) / F.col("h")
    sums = places.join(once, "g").groupBy("g", "i", "at").agg(F.sum(F.col("n") * F.exp(-z * z / 2)).alias("s"))
    span = sums.groupBy("g").agg(F.min("s").alias("least"), F.max("s").alias("most"))
    density = ratio(F.col("s") - F.col("least"), F.col("most") - F.col("least")).alias("density")
    return sums.join(span, "g").select(*[F.col("g").getField(c).alias(c) for c in by], F.col("at").alias("x"), density)

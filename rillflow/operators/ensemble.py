"""Ensemble forecast verification: CRPS with its decomposition, PIT, calibration tests, D-score."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.nulls import clean, ratio
from rillflow.functions.special import anderson_darling_cdf, cramer_von_mises_pvalue, kolmogorov_pvalue


def valid(df: DataFrame, obs: str, ens: str, by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """by, o, e: rows with an observation and a member; missing members leave the array."""
    e = F.filter(F.transform(ens, lambda x: clean(x)), lambda x: x.isNotNull())
    return df.select(*(by or []), *(keep or []), clean(obs).alias("o"), F.array_sort(e).alias("e")).where("o is not null and size(e) > 0")


def crps_of(o: Column, e: Column) -> Column:
    """CRPS of one forecast from its sorted members: mean distance less half the mean spread."""
    p = F.size(e)
    near = F.aggregate(e, F.lit(0.0), lambda a, x: a + F.abs(x - o)) / p
    spread = F.aggregate(F.transform(e, lambda x, i: x * (2 * (i + 1) - p - 1)), F.lit(0.0), lambda a, x: a + x) / (p * p)
    return near - spread


def crps_mean(df: DataFrame, obs: str, ens: str, by: list[str] | None = None) -> DataFrame:
    return valid(df, obs, ens, by).groupBy(*(by or [])).agg(F.avg(crps_of(F.col("o"), F.col("e"))).alias("crps"))


def crps_table(df: DataFrame, obs: str, ens: str, by: list[str] | None = None) -> DataFrame:
    """by, rank, freq, a, b, g, reliability part, potential part of each of the p + 1 bins (Hersbach 2000)."""
    by = by or []
    x = valid(df, obs, ens, by).withColumn("p", F.size("e"))
    x = x.select(*by, "o", "e", "p", F.explode(F.sequence(F.lit(0), F.col("p"))).alias("j"))
    x = x.withColumn("lo", F.get("e", F.col("j") - 1)).withColumn("hi", F.get("e", F.col("j")))
    zero = F.lit(0.0)
    a = F.when(F.col("j") == 0, 0.0).when(F.col("j") == F.col("p"), F.greatest(zero, F.col("o") - F.col("lo"))).otherwise(F.greatest(zero, F.least("o", "hi") - F.col("lo")))
    b = F.when(F.col("j") == F.col("p"), 0.0).when(F.col("j") == 0, F.greatest(zero, F.col("hi") - F.col("o"))).otherwise(F.greatest(zero, F.col("hi") - F.greatest("o", "lo")))
    out = F.when(F.col("j") == 0, (F.col("o") < F.col("hi")).cast("double")).when(F.col("j") == F.col("p"), (F.col("o") < F.col("lo")).cast("double"))
    t = x.groupBy(*by, F.col("j").alias("rank"), "p").agg(F.avg(a).alias("a"), F.avg(b).alias("b"), F.avg(out).alias("oo"))
    first, last = F.col("rank") == 0, F.col("rank") == F.col("p")
    g = F.when(first, F.coalesce(ratio(F.col("b"), F.col("oo")), zero)).when(last, F.coalesce(ratio(F.col("a"), 1 - F.col("oo")), zero)).otherwise(F.col("a") + F.col("b"))
    t = t.withColumn("g", g).withColumn("freq", F.when(first | last, F.col("oo")).otherwise(F.coalesce(ratio(F.col("b"), F.col("g")), zero)))
    f = F.col("rank") / F.col("p")
    some = F.col("g") > 0
    t = t.withColumn("reliability", F.when(some, F.col("g") * (F.col("freq") - f) * (F.col("freq") - f)).otherwise(0.0))
    t = t.withColumn("potential", F.when(some, F.col("g") * F.col("freq") * (1 - F.col("freq"))).otherwise(0.0))
    return t.withColumn("crps", F.col("a") * f * f + F.col("b") * (1 - f) * (1 - f)).drop("oo", "p")


def uncertainty(df: DataFrame, obs: str, ens: str, by: list[str] | None = None) -> DataFrame:
    """by, uncertainty: half the mean distance of two observations, from one sort."""
    by = by or []
    key = by or [F.lit(0)]
    x = valid(df, obs, ens, by)
    i, n = F.row_number().over(Window.partitionBy(*key).orderBy("o")), F.count("*").over(Window.partitionBy(*key))
    return x.select(*by, ((2 * i - n - 1) * F.col("o") / (n * n)).alias("u")).groupBy(*by).agg(F.sum("u").alias("uncertainty"))


def crps(df: DataFrame, obs: str, ens: str, by: list[str]) -> DataFrame:
    """by, crps, reliability, resolution, uncertainty, potential, skill."""
    t = crps_table(df, obs, ens, by).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("crps", "reliability", "potential")])
    out = t.join(uncertainty(df, obs, ens, by), by)
    return out.select(*by, "crps", "reliability", (F.col("uncertainty") - F.col("potential")).alias("resolution"), "uncertainty", "potential", (1 - ratio(F.col("crps"), F.col("uncertainty"))).alias("skill"))


def pit(df: DataFrame, obs: str, ens: str, keep: list[str], random: bool = False, cst: float = 0.3, censor: float = 0.0, seed: int = 1) -> DataFrame:
    """keep, pit, sudo: the observation's place in its ensemble; sudo marks censored cases."""
    x = valid(df, obs, ens, keep=keep)
    p = F.size("e")
    lower = F.size(F.filter("e", lambda m: m < F.col("o")))
    upto = F.size(F.filter("e", lambda m: m <= F.col("o")))
    if random:
        jitter = F.rand(seed) * 2e-10 - 1e-10
        below = F.size(F.filter("e", lambda m: m < F.col("__o")))
        x = x.withColumn("__o", F.col("o") + jitter)
        value = (below + 0.5 - cst) / (1 - cst + p)
    else:
        value = (lower + upto + F.when(upto > lower, 1).otherwise(0)) / (2.0 * p)
    sudo = (F.col("o") < censor + 1e-10) & F.exists("e", lambda m: m < censor + 1e-10)
    return x.select(*keep, value.alias("pit"), sudo.alias("sudo"))


def uniformity(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, cvm, ad, ks: statistics against the uniform law, by windows; values must be in [0, 1]."""
    w = Window.partitionBy(*by).orderBy(value)
    x = df.select(*by, F.when(F.col(value).between(0, 1), F.col(value)).otherwise(F.raise_error(F.lit("values must be in [0, 1]"))).alias(value))
    x = x.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    v, i, n = F.col(value), F.col("i"), F.col("n")
    x = x.withColumn("cvm", F.pow((2 * i - 1) / (2 * n) - v, 2))
    # the term of the i-th smallest and the i-th largest: ln x weighs 2i - 1, ln(1 - x) what is left
    x = x.withColumn("ad", (2 * i - 1) * F.ln(v) + (2 * (n - i) + 1) * F.ln(1 - v)).withColumn("ks", F.greatest(i / n - v, v - (i - 1) / n))
    return x.groupBy(*by).agg(F.max("n").alias("n"), (1 / (12 * F.max("n")) + F.sum("cvm")).alias("cvm"), (-F.max("n") - F.sum("ad") / F.max("n")).alias("ad"), F.max("ks").alias("ks"))


def uniformity_pvalues(stats: DataFrame) -> DataFrame:
    """`stats` of `uniformity` with cvm_p, ad_p, ks_p; one row for each group."""

    @F.pandas_udf("struct<cvm_p double, ad_p double, ks_p double>")
    def run(n: pd.Series, cvm: pd.Series, ad: pd.Series, ks: pd.Series) -> pd.DataFrame:

        return pd.DataFrame([(cramer_von_mises_pvalue(c, int(k)), 1 - anderson_darling_cdf(int(k), a), kolmogorov_pvalue(d, int(k))) for k, c, a, d in zip(n, cvm, ad, ks, strict=True)], columns=["cvm_p", "ad_p", "ks_p"])

    return stats.withColumn("__p", run("n", "cvm", "ad", "ks")).select(*stats.columns, "__p.*")


def iqr(df: DataFrame, ens: str, ref: str, by: list[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """by, skill, score, clim, ratio of the ensembles' inter-quantile ranges against a reference's."""

    def width(x: Column) -> Column:
        v = F.array_sort(F.filter(F.transform(x, lambda m: clean(m)), lambda m: m.isNotNull()))

        def q(p):
            at = (F.size(v) - 1) * p
            k = F.floor(at).cast("int")
            return F.get(v, k) + (F.coalesce(F.get(v, k + 1), F.get(v, k)) - F.get(v, k)) * (at - k)

        return q(high) - q(low)

    x = df.select(*by, width(F.col(ens)).alias("a"), width(F.col(ref)).alias("c"))
    return x.groupBy(*by).agg((100 * F.avg(ratio(F.col("c") - F.col("a"), F.col("c") + F.col("a")))).alias("skill"), F.avg("a").alias("score"), F.avg("c").alias("clim"), F.avg(ratio(F.col("a"), F.col("c"))).alias("ratio"))


def _counts(rows: list[int], below: list[int], upto: list[int], right: list[int], shape: tuple[int, int], kind) -> np.ndarray:
    """For each member of `rows`, in order, row += for each forecast of `right` its members below plus those below or tied.

    `below` and `upto` say how many of the sorted members of `right` those are; the counts only grow.
    """
    count, out = np.zeros(shape[1], kind), np.zeros(shape, kind)
    one, views, add, b, u = memoryview(count), list(out), np.add, 0, 0
    for i, b_, u_ in zip(rows, below, upto, strict=True):
        for k in right[b : min(u, b_)]:
            one[k] += 1
        for k in right[u:b_]:
            one[k] += 2
        for k in right[max(u, b_) : u_]:
            one[k] += 1
        b, u = b_, u_
        add(views[i], count, views[i])
    return out


def _above(left: list[np.ndarray], right: list[np.ndarray], eps: float) -> tuple[np.ndarray, np.ndarray]:
    """For each forecast of `left` and of `right`: twice the pairs of members of which left's is above, once those
    that tie; and the same as seen from `right`, where rounding may tell otherwise."""
    b, j = np.concatenate(right), np.repeat(np.arange(len(right)), [len(e) for e in right])
    at = np.argsort(b, kind="stable")
    b, j = b[at], j[at].tolist()
    a, i = np.concatenate(left), np.repeat(np.arange(len(left)), [len(e) for e in left])
    at = np.argsort(a, kind="stable")
    a, i = a[at], i[at].tolist()
    most = 2 * max(map(len, left)) * max(map(len, right))
    kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
    own = np.searchsorted(b, a - eps, "left"), np.searchsorted(b, a + eps, "right")
    other = np.searchsorted(b + eps, a, "left"), np.searchsorted(b - eps, a, "right")
    x = _counts(i, own[0].tolist(), own[1].tolist(), j, (len(left), len(right)), kind)
    same = all(np.array_equal(p, q) for p, q in zip(own, other, strict=True))
    return x, x if same else _counts(i, other[0].tolist(), other[1].tolist(), j, x.shape, kind)


#: Blocks of forecasts that another block meets in one task of `ensemble_ranks`.
WIDE = 8


def ensemble_ranks(df: DataFrame, ens: str, by: list[str], key: str, eps: float = 1e-6, block: int = 1000) -> DataFrame:
    """by, key, rank: 1 + the sum over other forecasts of 1, 1/2 or 0, as members rank above, with or below theirs.

    A group's forecasts are dealt to blocks of about `block`, fewer if they have over 128 members each.
    The blocks stand in a circle: each meets itself and those up to half a circle on, WIDE of them in a task.
    A NULL member counts among its forecast's members and is never above or tied; NaN is above all
    numbers. Forecasts without a member or key have no rank.
    """
    members = F.col(ens).cast("array<double>")
    df = df.select(*by, F.col(key).alias("key"), F.filter(members, lambda x: x.isNotNull()).alias("ens"), F.size(members).alias("all")).where("all > 0 and key is not null")
    sizes = df.groupBy(*by).agg(F.ceil(F.greatest(F.count("*"), F.sum("all") / F.lit(128.0)) / F.lit(float(block))).cast("int").alias("blocks"))
    on = F.lit(True)
    for i, c in enumerate(by):
        sizes = sizes.withColumnRenamed(c, f"g{i}")
        on = on & F.col(c).eqNullSafe(F.col(f"g{i}"))
    placed = df.join(sizes, on).withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    # `own` is met by the block `steps` before it, and meets others itself in as many tasks as it takes
    met = F.expr(f"transform(sequence(0, blocks div 2), d -> struct(pmod(own - d, blocks) as x, cast(d div {WIDE} as int) as part, d as steps))")
    met = F.filter(met, lambda m: (2 * m["steps"] < F.col("blocks")) | (2 * m["x"] < F.col("blocks")))
    meets = F.expr(f"transform(filter(sequence(0, blocks div 2), d -> d > 0 and d % {WIDE} = 0), d -> struct(own as x, cast(d div {WIDE} as int) as part, d as steps))")
    pairs = placed.withColumn("at", F.explode(F.concat(met, meets))).select(*by, "key", "ens", "all", "own", "at.x", "at.part")

    def run(pdf):
        m = [np.asarray(e, float) for e in pdf["ens"]]
        size, rank = pdf["all"].to_numpy().astype(np.int64), np.zeros(len(pdf))
        filled = np.array([len(e) for e in m], np.int64)
        mine = (pdf["own"] == pdf["x"]).to_numpy()
        left = np.flatnonzero(mine)
        right = np.arange(len(m)) if pdf["part"].iloc[0] == 0 else np.flatnonzero(~mine)
        if len(left) and len(right):
            theirs = np.flatnonzero(~mine[right])
            above, seen = _above([m[i] for i in left], [m[j] for j in right], eps)
            for i, a, s in zip(left, above, seen, strict=True):
                even = size[i] * size[right]
                rank[i] += ((a > even) + 0.5 * (a == even))[right != i].sum()
                back = (2 * filled[i] * filled[right] - s)[theirs]
                rank[right[theirs]] += (back > even[theirs]) + 0.5 * (back == even[theirs])
        return pdf[[*by, "key"]].assign(part=rank)

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by) + f"key {df.schema['key'].dataType.simpleString()}, "
    parts = pairs.groupBy(*by, "x", "part").applyInPandas(run, f"{kinds}part double")
    return parts.groupBy(*by, F.col("key").alias(key)).agg((1 + F.sum("part")).alias("rank"))


def dscore(df: DataFrame, obs: str, ens: str, by: list[str], key: str, eps: float = 1e-6) -> DataFrame:
    """by, dscore: (correlation of observed and forecast ranks + 1) / 2, of groups of two and more forecasts."""
    r = ensemble_ranks(df, ens, by, key, eps)
    o = df.select(*by, key, F.row_number().over(Window.partitionBy(*by).orderBy(obs, key)).alias("ro"))
    out = o.join(r, [*by, key]).groupBy(*by).agg(((F.corr("ro", "rank") + 1) / 2).alias("dscore"), F.count("*").alias("n"))
    return out.where("n > 1").drop("n")


def alpha(df: DataFrame, obs: str, ens: str, by: list[str], kind: str = "CV", threshold: float = 5.0, random: bool = True, seed: int = 1) -> DataFrame:
    """by, n, stat, pvalue, sudo, many_sudo: the test of uniform PITs and the share of censored cases.

    `kind` is CV (Cramer-von Mises), KS (Kolmogorov-Smirnov) or AD (Anderson-Darling); `many_sudo`
    warns of more than `threshold` per cent of censored cases.
    """
    names = {"CV": "cvm", "KS": "ks", "AD": "ad"}
    if kind not in names:
        raise ValueError(f"unknown test {kind!r}: expected CV, KS or AD")
    p = pit(df, obs, ens, by, random, seed=seed)
    share = p.groupBy(*by).agg((100 * F.avg(F.col("sudo").cast("double"))).alias("sudo"))
    out = uniformity_pvalues(uniformity(p, "pit", by)).join(share, by)
    return out.select(*by, "n", F.col(names[kind]).alias("stat"), F.col(f"{names[kind]}_p").alias("pvalue"), "sudo", (F.col("sudo") > threshold).alias("many_sudo"))

"""Window operators over ordered series: lags, runs, linear stretches, baseflow, ranks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.nulls import clean, ratio
from rillflow.functions.special import norm_ppf
from rillflow.operators.quantiles import group_key, quantiles


def lagged(df: DataFrame, value: str, k: int, by: list[str], order: list[str], name: str = "lagged", missing=None) -> DataFrame:
    """`df` with the value `k` rows before (after, if negative), `missing` beyond the ends."""
    return df.withColumn(name, F.lag(value, k, missing).over(Window.partitionBy(*by).orderBy(*order)))


def true_runs(df: DataFrame, flag: str, by: list[str], order: list[str]) -> DataFrame:
    """by, start, stop of each run of true flags: positions from 0, stop after the last."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.select(*by, *order, F.coalesce(F.col(flag).cast("boolean"), F.lit(False)).alias("f")).withColumn("i", F.row_number().over(w) - 1)
    x = x.where("f").withColumn("g", F.col("i") - F.row_number().over(w))
    return x.groupBy(*by, "g").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).drop("g")


def is_linear(df: DataFrame, value: str, by: list[str], order: list[str], npoints: int = 3, tol: float = 1e-6, thresh: float = 0.0) -> DataFrame:
    """`df` with `linear`: 1 on straight stretches, 2 on constant ones, 0 elsewhere.

    A stretch has `npoints` tested points at least, each above `thresh`, and has ended before the
    series does.
    """
    if npoints < 1 or tol < 1e-10:
        raise ValueError("npoints must be at least 1, tol at least 1e-10")
    w, x = Window.partitionBy(*by).orderBy(*order), clean(value)
    z = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__x", x)
    z = z.withColumn("__c", F.lag("__x", 1).over(w)).withColumn("__p", F.lag("__x", 2).over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    hit = (F.abs(F.col("__c") - (F.col("__p") + F.col("__x")) / 2) < tol) & (F.col("__c") > thresh)
    t = z.where(hit).withColumn("__g", F.col("__i") - F.row_number().over(w))
    kind = F.max_by(F.when(F.abs(F.col("__x") - F.col("__p")) < tol, 2).otherwise(1), "__i")
    runs = t.groupBy(*by, "__g").agg(F.min("__i").alias("s"), F.max("__i").alias("e"), kind.alias("kind"), F.max("__n").alias("n"))
    runs = runs.where((F.col("e") - F.col("s") + 1 >= npoints) & (F.col("e") < F.col("n") - 1))
    marks = runs.select(*by, F.explode(F.sequence(F.col("s") - 2, F.col("e"))).alias("__i"), "kind", "e").groupBy(*by, "__i").agg(F.max_by("kind", "e").alias("kind"))
    out = z.join(marks, [*by, "__i"], "left").withColumn("linear", F.coalesce("kind", F.lit(0)))
    return out.select(*df.columns, "linear")


def eckhardt(df: DataFrame, flow: str, by: list[str], order: list[str], thresh: float = 0.95, tau: float = 20.0, bfi_max: float = 0.8, hourly: bool = False, name: str = "baseflow") -> DataFrame:
    """`df` with the baseflow of Eckhardt's recursive filter.

    An invalid flow repeats the last valid one. Each series is read once, in order, by one task that
    holds a batch and the filter's state.
    """
    if not (0 <= thresh <= 1 and 0 <= bfi_max <= 1) or tau <= 0:
        raise ValueError("thresh and bfi_max must be in [0, 1], tau positive")
    alpha = math.exp(-(1 / 24 if hourly else 1) / tau)
    c1, c2, c3 = (1 - bfi_max) * alpha, (1 - alpha) * bfi_max, 1 - alpha * bfi_max
    a, g = c1 / c3, c2 / c3
    place = len(df.columns)
    z = df.withColumns({f"__k{i}": F.col(c) for i, c in enumerate(by)} | {"__q": clean(flow).cast("double")})

    def run(batches):
        import pyarrow as pa

        key, base, last, seen = None, 0.0, 0.0, False
        for b in batches:
            out = []
            for q, *own in zip(b.column(b.num_columns - 1).to_pylist(), *(b.column(place + i).to_pylist() for i in range(len(by))), strict=True):
                if own != key:
                    key, base, last, seen = own, 0.0, 0.0, False
                if q is not None and q >= 0:
                    last = q
                base = a * base + g * last
                out.append(last if seen and base > thresh * last else base)
                seen = True
            yield pa.RecordBatch.from_arrays([*b.columns[:place], pa.array(out, pa.float64())], names=[*b.schema.names[:place], name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return z.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, f"{kinds}, `{name}` double")


def plotting_positions(df: DataFrame, value: str, by: list[str], cst: float = 0.3, tie: list[str] | None = None) -> DataFrame:
    """by, value, ppos of the non-missing values, ascending: (rank - cst) / (n + 1 - 2 cst)."""
    if not 0 <= cst <= 0.5:
        raise ValueError("cst must be in [0, 0.5]")
    x = df.withColumn(value, clean(value)).where(F.col(value).isNotNull())
    r = F.row_number().over(Window.partitionBy(*by).orderBy(value, *(tie or [])))
    return x.withColumn("ppos", (r - cst) / (F.count("*").over(Window.partitionBy(*by)) + 1 - 2 * cst))


def standard_normal(df: DataFrame, value: str, by: list[str], cst: float = 0.0, method: str = "average") -> DataFrame:
    """`df` with rank (from 0) and z, its normal score; a missing value raises."""
    w, all_ = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    rank = {"average": F.rank().over(w) - 1 + (ties - 1) / 2, "min": F.rank().over(w) - 1, "max": F.rank().over(w) + ties - 2, "dense": F.dense_rank().over(w) - 1, "first": F.row_number().over(w) - 1}
    x = df.withColumn(value, F.when(clean(value).isNull(), F.raise_error(F.lit("missing values have no rank"))).otherwise(F.col(value)))
    z = x.withColumn("rank", rank[method].cast("double")).withColumn("__n", F.count("*").over(all_))
    return z.withColumn("z", norm_ppf(f"(rank + 1 - {cst}e0) / (__n + 1 - 2 * {cst}e0)")).drop("__n")


def fdc_slope(df: DataFrame, value: str, by: list[str], q1: float = 90, q2: float = 100, cst: float = 0.375, trans=None, tie: list[str] | None = None) -> DataFrame:
    """by, slope, q1, q2: slope of the flow duration curve between two percentiles."""
    x = plotting_positions(df, value, by, cst, tie)
    cuts = quantiles(x, value, by, [q1 / 100, q2 / 100])
    y = x.withColumn("g", group_key(by)).join(cuts, "g").where(F.col(value).between(F.col("q")[0], F.col("q")[1]))
    t = trans.forward(F.col(value)) if trans else F.col(value)
    slope = F.when(F.stddev_pop(t) >= 1e-10, ratio(F.covar_pop(t, F.col("ppos")), F.var_pop("ppos")))
    return y.groupBy(*by).agg(slope.alias("slope"), F.first("q").alias("q")).select(*by, "slope", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"))


def qq_points(df: DataFrame, value: str, by: list[str], tie: list[str] | None = None) -> DataFrame:
    """by, value, z of the non-missing values: the normal quantile of each value's plotting position."""
    return plotting_positions(df, value, by, 0.3, tie).withColumn("z", norm_ppf("ppos")).drop("ppos")


def qq_line(df: DataFrame, value: str, by: list[str], censor: float | None = None, tie: list[str] | None = None) -> DataFrame:
    """by, intercept, slope, r of the least-squares line through a normal quantile plot, above `censor` if given."""
    p = qq_points(df, value, by, tie)
    p = p if censor is None else p.where(F.col(value) > censor + 1e-10)
    slope = ratio(F.covar_pop(value, "z"), F.var_pop("z"))
    return p.groupBy(*by).agg((F.avg(value) - slope * F.avg("z")).alias("intercept"), slope.alias("slope"), F.corr(value, "z").alias("r"))

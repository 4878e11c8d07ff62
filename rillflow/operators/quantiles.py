"""Exact quantiles of groups of any size.

A group's values never meet in one buffer. A first pass finds, by an approximate summary, a narrow
interval of values about each quantile; a second counts what lies below it and picks the two
neighbouring values out of the few within, equal values counted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.lineage import written

#: Parts of a group that the summary tells apart; groups of up to SMALL values are one interval.
ACCURACY, SMALL = 10_000, 50_000


def group_key(by: list[str]) -> Column:
    """Group columns as one value, in which nulls are equal."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def quantiles(df: DataFrame, value: str, by: list[str], probabilities: list[float], small: int = SMALL) -> DataFrame:
    """g (see `group_key`), q: array of the linearly interpolated quantiles of the non-null values."""
    v = df.select(group_key(by).alias("g"), F.col(value).cast("double").alias("x")).where("x is not null")
    marks = [max(0.0, p - 2 / ACCURACY) for p in probabilities] + [min(1.0, p + 2 / ACCURACY) for p in probabilities]
    about = v.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", F.array(*[F.lit(m) for m in marks]), ACCURACY).alias("c"))
    few, m = F.col("n") <= small, len(probabilities)
    spans = [F.struct(F.lit(i).alias("i"), F.when(few, F.col("low")).otherwise(F.col("c")[i]).alias("a"), F.when(few, F.col("high")).otherwise(F.col("c")[m + i]).alias("b"), ((F.col("n") - 1) * F.lit(p)).alias("at")) for i, p in enumerate(probabilities)]
    bounds = written(about.select("g", F.array(*spans).alias("spans")), "quantile-bounds")[0]
    rows = v.join(bounds, "g")
    below = rows.groupBy("g").agg(F.array(*[F.count_if(F.col("x") < F.col("spans")[i]["a"]) for i in range(m)]).alias("below"))
    near = rows.select("g", "x", F.explode(F.filter("spans", lambda s: F.col("x").between(s["a"], s["b"]))).alias("s"))
    near = near.groupBy("g", "s.i", "s.at", "x").agg(F.count("*").alias("k")).join(below, "g")
    upto = F.get("below", F.col("i")) + F.sum("k").over(Window.partitionBy("g", "i").orderBy("x"))
    near = near.withColumn("upto", upto)
    first = F.min(F.when(F.col("upto") > F.floor("at"), F.col("x")))
    after = F.min(F.when(F.col("upto") > F.floor("at") + 1, F.col("x")))
    part = F.max(F.col("at") - F.floor("at"))
    each = near.groupBy("g", "i").agg((first + F.when(part > 0, (after - first) * part).otherwise(0.0)).alias("q"))
    return each.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))


def with_quantiles(groups: DataFrame, df: DataFrame, value: str, by: list[str], probabilities: list[float], name: str = "q") -> DataFrame:
    """`groups`, a row for each group, with the array of its quantiles; null for a group without values."""
    q = quantiles(df, value, by, probabilities).withColumnRenamed("q", name)
    return groups.withColumn("g", group_key(by)).join(q, "g", "left").drop("g")

"""Calendar aggregation, homogenisation and conversion between time steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.nulls import clean


def guarded(x: Column, operator: str, maxnan: int = 0, order: Column | None = None, strict: bool = False) -> Column:
    """Aggregate column: sum, mean, max or tail of a group; NULL if more than `maxnan` values are missing.

    Missing values count as 0 in max and tail (so a maximum is at least 0), unless `strict`.
    """
    if operator == "sum":
        out = F.coalesce(F.sum(x), F.lit(0.0))
    elif operator == "mean":
        out = F.coalesce(F.avg(x), F.lit(0.0))
    elif operator == "max":
        out = F.max(x) if strict else F.greatest(F.lit(0.0), F.max(F.coalesce(x, F.lit(0.0))))
    elif operator == "tail":
        out = F.max_by(x, F.when(x.isNotNull(), order)) if strict else F.max_by(F.coalesce(x, F.lit(0.0)), order)
    else:
        raise ValueError(f"unknown operator {operator!r}: expected sum, mean, max or tail")
    return F.when(F.count_if(x.isNull()) <= maxnan, out)


def aggregate(df: DataFrame, index: str, value: str, by: list[str], operator: str = "sum", maxnan: int = 0, order: str | None = None, strict: bool = False) -> DataFrame:
    """One row for each group and label: by, index, value."""
    return df.groupBy(*by, index).agg(guarded(clean(value), operator, maxnan, F.col(order) if order else None, strict).alias(value))


def flathomogen(df: DataFrame, index: str, value: str, by: list[str], maxnan: int = 0, name: str = "flat") -> DataFrame:
    """`df` with each valid value replaced by its group's mean; NULL for a group with too many missing."""
    w, x = Window.partitionBy(*by, index), clean(value)
    return df.withColumn(name, F.when((F.count_if(x.isNull()).over(w) <= maxnan) & x.isNotNull(), F.avg(x).over(w)))


def water_year_end(df: DataFrame, ts: str, value: str, by: list[str], window: int = 3) -> DataFrame:
    """by, month: the month with the lowest circular moving average of monthly means."""
    if window not in (1, 3, 5):
        raise ValueError("window must be 1, 3 or 5")
    means = df.groupBy(*by, F.month(ts).alias("m")).agg(F.avg(clean(value)).alias("v"))
    half = window // 2
    spread = means.withColumn("d", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("month", F.pmod(F.col("m") - 1 + F.col("d"), F.lit(12)) + 1)
    smooth = spread.groupBy(*by, "month").agg(F.avg("v").alias("v"))
    return smooth.groupBy(*by).agg(F.min_by("month", F.struct("v", "month")).alias("month"))


def monthly_to_daily(df: DataFrame, month: str, value: str, by: list[str], minthreshold: float = 0.0) -> DataFrame:
    """by, day, value: a month's total spread evenly; NULL below the threshold (tested on the daily value)."""
    first = F.trunc(month, "month")
    days = df.select(*by, F.explode(F.sequence(first, F.last_day(first))).alias("day"), (clean(value) / F.day(F.last_day(first))).alias(value))
    return days.withColumn(value, F.when(F.col(value) >= minthreshold, F.col(value)))


def monthly_to_daily_cubic(df: DataFrame, month: str, value: str, by: list[str], minthreshold: float = 0.0) -> DataFrame:
    """by, day, value: daily values of a piecewise cubic that keeps every month's total.

    A missing month has the total `minthreshold` - 1. Slopes at month ends follow a sweep through
    the series, so a series is one task.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(month)
        total = pdf[value].fillna(minthreshold - 1).to_numpy(float)
        starts = pd.to_datetime(pdf[month]).dt.to_period("M")
        n = starts.dt.days_in_month.to_numpy()
        u = total / n
        k = len(u)
        middle = (u[:-1] + u[1:]) / 2
        slope = np.concatenate([[u[0]], middle, [u[-1]]])
        start = np.empty(k)
        end = np.empty(k)
        before = u[0]
        for i in range(k):
            start[i] = before
            if i < k - 1:
                after = slope[i + 2]
                end[i] = 0.75 * (u[i] + u[i + 1]) - 0.25 * (before + after)
                before = end[i]
            else:
                end[i] = u[-1]
        rows = []
        keys = {c: pdf[c].iloc[0] for c in by}
        for i in range(k):
            s0, s1 = start[i] * n[i], end[i] * n[i]
            x = np.arange(n[i] + 1) / n[i]
            area = s0 * x + (3 * total[i] - 2 * s0 - s1) * x**2 + (s0 + s1 - 2 * total[i]) * x**3
            days = pd.date_range(starts.iloc[i].start_time, periods=n[i])
            rows.append(pd.DataFrame({**keys, "day": days.date, value: np.diff(area)}))
        return pd.concat(rows)

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, month, value).groupBy(*by).applyInPandas(run, f"{kinds}, day date, {value} double")


def variable_to_regular(df: DataFrame, ts: str, value: str, by: list[str], step: int = 3600, maxgap: int = 432_000, rainfall: bool = False, order: list[str] | None = None) -> DataFrame:
    """by, period, value: means over regular periods of an irregular series, by trapezia between readings.

    Of rainfall, the later reading is spread over its interval. Periods begin at the full hour after
    the first reading. A period is NULL if it is touched by a segment with a missing or negative end
    or a gap over `maxgap` seconds; the last period always is.
    """
    if step not in (1800, 3600) or maxgap < 3600:
        raise ValueError("step must be 1800 or 3600 s, maxgap at least 3600 s")
    w = Window.partitionBy(*by).orderBy(ts, *(order or []))
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    x = df.select(*by, ts, *(order or []), sec.alias("t1"), clean(value).alias("v1"))
    x = x.withColumn("t2", F.lead("t1").over(w)).withColumn("v2", F.lead("v1").over(w))
    spans = x.groupBy(*by).agg((F.floor(F.min("t1") / 3600) * 3600 + 3600).alias("h0"), F.max("t1").alias("last"))
    spans = spans.withColumn("n", F.floor((F.col("last") - F.col("h0")) / step).cast("int")).where("n > 0")
    seg = x.where("t2 is not null").join(spans, by)
    p1, p2 = (F.floor((F.col(t) - F.col("h0")) / step) for t in ("t1", "t2"))
    seg = seg.withColumn("p", F.explode(F.sequence(p1, p2))).withColumn("a", F.col("h0") + F.col("p") * step).withColumn("b", F.col("a") + step)
    seg = seg.where("t1 < b and p between 0 and n - 1")
    s, e = F.greatest("t1", "a"), F.least("t2", "b")
    width = F.col("t2") - F.col("t1")

    def at(t):
        return F.col("v1") + (F.col("v2") - F.col("v1")) * F.try_divide((t - F.col("t1")).cast("double"), width.cast("double"))

    area = F.when(e > s, F.try_divide(F.col("v2") * (e - s), width) * F.lit(float(1 if rainfall else 0)) + (0.0 if rainfall else 1.0) * (at(s) + at(e)) / 2 * (e - s)).otherwise(0.0)
    bad = F.col("v1").isNull() | F.col("v2").isNull() | (F.least("v1", "v2") < -1e-8) | (width > maxgap)
    got = seg.groupBy(*by, "p").agg(F.sum(area).alias("area"), F.max(bad).alias("bad"))
    spine = spans.select(*by, "h0", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - F.lit(1).cast("bigint"))).alias("p"))
    scale = 1.0 if rainfall else float(step)
    out = spine.join(got, [*by, "p"], "left").withColumn(value, F.when(~F.coalesce("bad", F.lit(False)) & (F.col("p") < F.col("n") - 1), F.col("area") / scale))
    return out.select(*by, F.timestamp_seconds(F.col("h0") + F.col("p") * step).cast("timestamp_ntz").alias("period"), value)

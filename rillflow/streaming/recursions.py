"""Streaming forms: tumbling calendar aggregates with a watermark, and recursive filters with state."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, value: str, by: list[str], size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """by, start, sum, mean, n of each window; rows later than `late` are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stream.withWatermark(ts, late).groupBy(*by, w.alias("w")).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return g.select(*by, F.col("w.start").alias("start"), "sum", "mean", "n")


def sessions(df: DataFrame, ts: str, value: str, by: list[str], gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """by, start, stop, sum, n of each run of rows less than `gap` apart, of a stream or a table."""
    x = df.withWatermark(ts, late) if df.isStreaming else df
    g = x.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.sum(value).alias("sum"), F.count(value).alias("n"))
    return g.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "sum", "n")


def running_scores(df: DataFrame, obs: str, sim: str, by: list[str]) -> DataFrame:
    """by, n, bias, nse of all complete pairs so far, for update or complete mode: a few sums a group are the state."""
    p = df.where(F.col(obs).isNotNull() & F.col(sim).isNotNull())
    e = F.col(sim) - F.col(obs)
    return p.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.avg(e), F.avg(obs)).alias("bias"), (1 - F.try_divide(F.sum(e * e), F.var_pop(obs) * F.count(obs))).alias("nse"))


def ar_residual_stream(stream: DataFrame, key: str, ts: str, value: str, params: list[float], mean: float = 0.0) -> DataFrame:
    """key, ts, residual of an AR series; the state of a key is its last values. A missing value is its estimate (residual 0)."""
    if not 1 <= len(params) <= 10:
        raise ValueError("an AR model has 1 to 10 parameters")

    def run(k, frames, state):
        import pandas as pd

        past = list(state.get[0]) if state.exists else [0.0] * len(params)
        pdf = pd.concat(list(frames)).sort_values(ts)
        out = []
        for v in pdf[value]:
            guess = sum(p * x for p, x in zip(params, past, strict=True))
            now = guess if v is None or v != v else v - mean
            past = [float(now), *past[:-1]]
            out.append(now - guess)
        state.update((past,))
        yield pdf[[key, ts]].assign(residual=out)

    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in (key, ts))
    return stream.select(key, ts, value).groupBy(key).applyInPandasWithState(run, f"{kinds}, residual double", "past array<double>", "append", "NoTimeout")


def eckhardt_stream(stream: DataFrame, key: str, ts: str, flow: str, thresh: float = 0.95, tau: float = 20.0, bfi_max: float = 0.8) -> DataFrame:
    """key, ts, baseflow of a stream of flows; the state of a key is its last baseflow and flow.

    Rows of a batch are taken in time order; the filter doesn't go back for late ones.
    """
    alpha = math.exp(-1 / tau)
    a, g = (1 - bfi_max) * alpha / (1 - alpha * bfi_max), (1 - alpha) * bfi_max / (1 - alpha * bfi_max)

    def run(k, frames, state):
        import pandas as pd

        base, last, seen = state.get if state.exists else (0.0, 0.0, False)
        pdf = pd.concat(list(frames)).sort_values(ts)
        out = []
        for v in pdf[flow]:
            last = v if v is not None and v >= 0 else last
            base = a * base + g * last
            out.append(last if seen and base > thresh * last else base)
            seen = True
        state.update((float(base), float(last), bool(seen)))
        yield pdf[[key, ts]].assign(baseflow=out)

    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in (key, ts))
    return stream.select(key, ts, flow).groupBy(key).applyInPandasWithState(run, f"{kinds}, baseflow double", "base double, last double, seen boolean", "append", "NoTimeout")

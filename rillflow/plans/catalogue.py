"""Every registered query, over whole tables, with its SQL where SQL can express it.

A query is an operator applied to a driver table that stands for a hydrological one; results are
rounded to six digits, so that the order of additions doesn't show.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import calendar, transforms
from rillflow.functions.nulls import rounded
from rillflow.functions.special import norm_ppf_sql, runoff_ratio
from rillflow.operators import ensemble, network, raster, resample, scores, sequence, stats
from rillflow.operators.lineage import shared_root
from rillflow.operators.quantiles import with_quantiles
from rillflow.operators.raster import Grid
from rillflow.sources import csvio, gridio, tasks
from rillflow.streaming import recursions

QUERIES: dict = {}
ORACLE_SQL: dict = {}

DIGITS = 6


def query(name: str, sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)
            return out.select(*[(rounded(F.col(c), DIGITS) if k == "double" else F.col(c)).alias(c) for c, k in out.dtypes])

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r(x: str) -> str:
    return f"round({x}, {DIGITS}) + 0.0"


# ---- base tables: daily totals with gaps, readings by type, forecasts, pairs

_ORDERS = "(SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 1000 END AS v FROM orders)"
_EVENTS = "(SELECT event_id, ts, event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events)"
_PAIRS = "(SELECT event_type, event_id, ts, value AS o, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM events)"
_ENS = "(SELECT vec_id, label % 4 AS site, label * 0.1e0 - 0.5e0 AS o, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
BY, AT = ["event_type"], ["ts", "event_id"]


def _orders(t):
    return t("orders").withColumn("v", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice") / 1000).cast("double"))


def _events(t):
    return t("events").select("event_id", "ts", "event_type", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("v"))


def _pairs(t):
    e = t("events").select("event_type", "event_id", "ts", F.col("value").alias("o"))
    return sequence.lagged(e, "o", 1, BY, AT, "s")


def _forecasts(t):
    return t("embeddings").select("vec_id", (F.col("label") % 4).alias("site"), (F.col("label") * F.lit(0.1) - 0.5).alias("o"), F.col("embedding").cast("array<double>").alias("e"))


# ---- calendar aggregation

_AGG = {"sum": "coalesce(sum(v), 0)", "mean": "coalesce(avg(v), 0)", "max": "greatest(0, max(coalesce(v, 0)))", "tail": "arg_max(coalesce(v, 0), (o_orderdate, o_orderkey))"}


def _calendar(op: str, step: str, label: str, name: str):
    sql = f"SELECT o_orderpriority, CAST({label} AS INTEGER) AS idx, CASE WHEN count(*) FILTER (v IS NULL) <= 12 THEN {r(_AGG[op])} END AS v FROM {_ORDERS} GROUP BY ALL"

    @query(name, sql)
    def run(t, spark):
        x = _orders(t).withColumn("idx", calendar.aggindex(F.col("o_orderdate"), step).cast("int")).withColumn("at", F.struct("o_orderdate", "o_orderkey"))
        return resample.aggregate(x, "idx", "v", ["o_orderpriority"], op, 12, "at")


for _op in _AGG:
    _calendar(_op, "MS", "year(o_orderdate) * 100 + month(o_orderdate)", f"agg_{_op}_month")
_calendar("sum", "AS", "year(o_orderdate)", "agg_sum_year")
_calendar("mean", "AS-JUN", "year(o_orderdate + INTERVAL 6 MONTH) - 1", "agg_water_year")
_calendar("max", "D", "year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)", "agg_max_day")


@query("water_year_end", f"""WITH m AS (SELECT o_orderpriority, month(o_orderdate) AS m, avg(v) AS v FROM {_ORDERS} GROUP BY ALL),
    s AS (SELECT o_orderpriority, (m - 1 + d + 12) % 12 + 1 AS month, avg(v) AS v FROM m, (VALUES (-1), (0), (1)) x(d) GROUP BY ALL)
    SELECT o_orderpriority, CAST(arg_min(month, (v, month)) AS INTEGER) AS month FROM s GROUP BY ALL""")  # fmt: skip
def _(t, spark):
    return resample.water_year_end(_orders(t), "o_orderdate", "v", ["o_orderpriority"]).withColumn("month", F.col("month").cast("int"))


@query("flathomogen_day", f"SELECT event_id, CASE WHEN count(*) FILTER (v IS NULL) OVER w <= 5 AND v IS NOT NULL THEN {r('avg(v) OVER w')} END AS flat FROM {_EVENTS} WINDOW w AS (PARTITION BY event_type, CAST(ts AS DATE))")
def _(t, spark):
    x = _events(t).withColumn("day", calendar.aggindex(F.col("ts"), "D"))
    return resample.flathomogen(x, "day", "v", BY, 5).select("event_id", "flat")


@query("goue_by_type", f"WITH f AS (SELECT event_type, value AS o, avg(value) OVER (PARTITION BY event_type, CAST(ts AS DATE)) AS s FROM events) SELECT event_type, {r('1 - sum((s - o) ^ 2) / (var_pop(o) * count(*))')} AS nse FROM f GROUP BY ALL")
def _(t, spark):
    x = t("events").withColumn("day", calendar.aggindex(F.col("ts"), "D"))
    return scores.nse(resample.flathomogen(x, "day", "value", BY), "value", "flat", BY)


@query("monthly_to_daily", f"""WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS m, sum(v) AS v FROM {_ORDERS} GROUP BY ALL),
    d AS (SELECT o_orderpriority, unnest(generate_series(m::TIMESTAMP, last_day(m)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day, v / day(last_day(m)) AS v FROM m)
    SELECT o_orderpriority, CAST(day AS VARCHAR) AS day, CASE WHEN v >= 1 THEN {r('v')} END AS v FROM d""")  # fmt: skip
def _(t, spark):
    m = _orders(t).groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("v").alias("v"))
    return resample.monthly_to_daily(m, "m", "v", ["o_orderpriority"], 1.0).withColumn("day", F.col("day").cast("string"))


@query("monthly_to_daily_cubic", f"""WITH RECURSIVE m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS m, CASE WHEN month(any_value(o_orderdate)) <> 4 THEN sum(v) END AS v FROM {_ORDERS} GROUP BY o_orderpriority, date_trunc('month', o_orderdate)),
    x AS (SELECT p, m, day(last_day(m)) AS n, coalesce(v, -1) AS t, coalesce(v, -1) / day(last_day(m)) AS u, row_number() OVER (PARTITION BY p ORDER BY m) AS i FROM m),
    y AS MATERIALIZED (SELECT *, lead(u) OVER w AS u1, lead(u, 2) OVER w AS u2 FROM x WINDOW w AS (PARTITION BY p ORDER BY i)),
    s(p, i, d) AS (SELECT p, i, u FROM y WHERE i = 1 UNION ALL SELECT s.p, s.i + 1, 0.75 * (u + u1) - 0.25 * (d + coalesce((u1 + u2) / 2, u1)) FROM s JOIN y ON y.p = s.p AND y.i = s.i WHERE u1 IS NOT NULL),
    c AS (SELECT y.*, n * d AS a, n * coalesce(lead(d) OVER (PARTITION BY y.p ORDER BY y.i), u) AS b FROM y JOIN s ON s.p = y.p AND s.i = y.i),
    k AS (SELECT *, unnest(range(n)) AS k FROM c), z AS (SELECT *, k / n AS x0, (k + 1) / n AS x1 FROM k)
    SELECT p AS o_orderpriority, CAST(m + k::INTEGER AS VARCHAR) AS day, {r('a * (x1 - x0) + (3 * t - 2 * a - b) * (x1 ^ 2 - x0 ^ 2) + (a + b - 2 * t) * (x1 ^ 3 - x0 ^ 3)')} AS v FROM z""")  # fmt: skip
def _(t, spark):
    m = _orders(t).groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("v").alias("v"))
    m = m.withColumn("v", F.when(F.month("m") != 4, F.col("v")))  # every April is missing
    return resample.monthly_to_daily_cubic(m, "m", "v", ["o_orderpriority"]).withColumn("day", F.col("day").cast("string"))


def _regular(rain: bool) -> str:
    value = "v2 * (least(t2, b) - greatest(t1, a)) / (t2 - t1)" if rain else "(v1 + (v2 - v1) * (greatest(t1, a) - t1) / (t2 - t1) + v1 + (v2 - v1) * (least(t2, b) - t1) / (t2 - t1)) / 2 * (least(t2, b) - greatest(t1, a))"
    return f"""WITH x AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t1, v AS v1, CAST(floor(epoch(lead(ts) OVER w)) AS BIGINT) AS t2, lead(v) OVER w AS v2 FROM {_EVENTS} WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    s AS (SELECT event_type, min(t1) // 3600 * 3600 + 3600 AS h0, max(t1) AS l FROM x GROUP BY ALL),
    p AS (SELECT event_type, h0, (l - h0) // 3600 AS n, unnest(range((l - h0) // 3600)) AS p FROM s),
    q AS (SELECT *, h0 + p * 3600 AS a, h0 + p * 3600 + 3600 AS b FROM p),
    g AS (SELECT q.event_type, q.p, sum(CASE WHEN least(t2, b) > greatest(t1, a) THEN {value} ELSE 0 END) AS area, bool_or(v1 IS NULL OR v2 IS NULL OR least(v1, v2) < -1e-8 OR t2 - t1 > 86400) AS bad
        FROM q JOIN x ON x.event_type = q.event_type AND t1 < b AND t2 >= a AND t2 IS NOT NULL GROUP BY ALL)
    SELECT q.event_type, CAST(make_timestamp(a * 1000000) AS VARCHAR) AS period, CASE WHEN NOT coalesce(bad, false) AND q.p < n - 1 THEN {r("area / " + ("1.0" if rain else "3600.0"))} END AS v FROM q LEFT JOIN g ON g.event_type = q.event_type AND g.p = q.p"""


@query("var2h_hourly", _regular(False))
def _(t, spark):
    return resample.variable_to_regular(_events(t), "ts", "v", BY, maxgap=86400, order=["event_id"]).withColumn("period", F.col("period").cast("string"))


@query("var2h_rain", _regular(True))
def _(t, spark):
    return resample.variable_to_regular(_events(t), "ts", "v", BY, maxgap=86400, rainfall=True, order=["event_id"]).withColumn("period", F.col("period").cast("string"))


@query("dates", """SELECT o_orderkey, CAST(dayofyear(o_orderdate) - CASE WHEN (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) AND month(o_orderdate) > 2 THEN 1 ELSE 0 END AS INTEGER) AS doy,
    CAST(day(last_day(o_orderdate)) AS INTEGER) AS ndays, CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month, CAST(sign(date_diff('day', o_orderdate, DATE '1998-01-01')) AS INTEGER) AS cmp, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS decoded FROM orders""")  # fmt: skip
def _(t, spark):
    d = F.col("o_orderdate").cast("date")
    code = F.date_format(d, "yyyyMMdd").cast("double")
    return t("orders").select("o_orderkey", calendar.day_of_year(d).cast("int").alias("doy"), calendar.days_in_month(F.year(d), F.month(d)).cast("int").alias("ndays"), calendar.add_month(d).cast("string").alias("next_month"), calendar.compare_dates(d, F.to_date(F.lit("1998-01-01"))).alias("cmp"), calendar.date_of_code(code).cast("string").alias("decoded"))


# ---- sequences

for _k in (1, -2):

    @query(f"lag_{'forward' if _k > 0 else 'backward'}", f"SELECT event_id, {r(f'lag(v, {_k}) OVER (PARTITION BY event_type ORDER BY ts, event_id)')} AS lagged FROM {_EVENTS}")
    def _(t, spark, k=_k):
        return sequence.lagged(_events(t), "v", k, BY, AT).select("event_id", "lagged")


@query("runs_true", """WITH x AS (SELECT event_type, value > 50 AS f, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
    g AS (SELECT event_type, i, i - row_number() OVER (PARTITION BY event_type ORDER BY i) AS g FROM x WHERE f)
    SELECT event_type, min(i)::INTEGER AS start, (max(i) + 1)::INTEGER AS stop FROM g GROUP BY event_type, g""")  # fmt: skip
def _(t, spark):
    return sequence.true_runs(t("events").withColumn("f", F.col("value") > 50), "f", BY, AT).select("event_type", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


_STAIRS = "CASE WHEN event_id % 40 < 12 THEN 5.0e0 WHEN event_id % 40 < 25 THEN 5.0e0 + event_id % 40 ELSE (event_id * 7919 % 101) * 1.0e0 END"


@query("islinear_flags", f"""WITH x AS (SELECT event_id, event_id % 5 AS k, {_STAIRS} AS x FROM events),
    z AS (SELECT *, row_number() OVER w - 1 AS i, lag(x) OVER w AS c, lag(x, 2) OVER w AS p, count(*) OVER (PARTITION BY k) AS n FROM x WINDOW w AS (PARTITION BY k ORDER BY event_id)),
    h AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM z WHERE abs(c - (p + x) / 2) < 1e-6 AND c > 0),
    u AS (SELECT k, g, min(i) AS s, max(i) AS e, arg_max(CASE WHEN abs(x - p) < 1e-6 THEN 2 ELSE 1 END, i) AS kind, max(n) AS n FROM h GROUP BY ALL HAVING count(*) >= 3),
    m AS (SELECT k, unnest(range(s - 2, e + 1)) AS i, kind, e FROM u WHERE e < n - 1),
    o AS (SELECT k, i, arg_max(kind, e) AS kind FROM m GROUP BY ALL)
    SELECT event_id, coalesce(kind, 0)::INTEGER AS linear FROM z LEFT JOIN o ON o.k = z.k AND o.i = z.i""")  # fmt: skip
def _(t, spark):
    x = t("events").select("event_id", (F.col("event_id") % 5).alias("k"), F.expr(_STAIRS).alias("x"))
    return sequence.is_linear(x, "x", ["k"], ["event_id"]).select("event_id", F.col("linear").cast("int").alias("linear"))


def _baseflow_sql() -> str:
    import math

    a0 = math.exp(-1 / 20)
    c3 = 1 - a0 * 0.8
    a, g = 0.2 * a0 / c3, (1 - a0) * 0.8 / c3
    n = math.ceil(math.log(1e-18) / math.log(a))
    total = " + ".join(f"coalesce(lag(q, {k}) OVER w, 0) * {g * a**k!r}" for k in range(n + 1))
    return f"""WITH x AS (SELECT event_id, event_type, ts, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS q FROM {_EVENTS}),
    b AS (SELECT event_id, q, {total} AS b, row_number() OVER w AS i FROM x WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
    SELECT event_id, {r('CASE WHEN i > 1 AND b > 0.95 * q THEN q ELSE b END')} AS baseflow FROM b"""


@query("baseflow_eckhardt", _baseflow_sql())
def _(t, spark):
    return sequence.eckhardt(_events(t), "v", BY, AT).select("event_id", "baseflow")


@query("ppos_rank", f"SELECT event_id, {r('(row_number() OVER (PARTITION BY event_type ORDER BY v, event_id) - 0.3e0) / (count(*) OVER (PARTITION BY event_type) + 0.4e0)')} AS ppos FROM {_EVENTS} WHERE v IS NOT NULL")
def _(t, spark):
    return sequence.plotting_positions(_events(t), "v", BY, 0.3, ["event_id"]).select("event_id", "ppos")


_SCORE = f"""(SELECT event_id, event_type, rank, {norm_ppf_sql('(rank + 1) / (n + 1)')} AS z FROM (SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value) - 1 + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0e0 AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events))"""


@query("normal_scores", f"SELECT event_id, {r('rank')} AS rank, {r('z')} AS z FROM {_SCORE}")
def _(t, spark):
    return sequence.standard_normal(t("events"), "value", BY).select("event_id", "rank", "z")


@query("semicorr", f"WITH x AS (SELECT event_type, z AS a, lag(z) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM {_SCORE}) SELECT event_type, {r('corr(a, b)')} AS rho, {r('corr(a, b) FILTER (a > 0 AND b > 0)')} AS rho_plus, {r('corr(a, b) FILTER (a < 0 AND b < 0)')} AS rho_minus FROM x GROUP BY ALL")
def _(t, spark):
    z = sequence.lagged(sequence.standard_normal(t("events"), "value", BY), "z", 1, BY, ["event_id"], "z1")
    return stats.semicorr(z, "z", "z1", BY)


@query("fdc_slope", f"""WITH x AS (SELECT event_type, v, (row_number() OVER (PARTITION BY event_type ORDER BY v, event_id) - 0.375e0) / (count(*) OVER (PARTITION BY event_type) + 0.25e0) AS p FROM {_EVENTS} WHERE v IS NOT NULL),
    q AS (SELECT event_type, quantile_cont(v, 0.5) AS q1, quantile_cont(v, 0.9) AS q2 FROM x GROUP BY ALL)
    SELECT x.event_type, {r('covar_pop(ln(v + 1e-10), p) / var_pop(p)')} AS slope, {r('any_value(q1)')} AS q1, {r('any_value(q2)')} AS q2 FROM x JOIN q ON q.event_type = x.event_type WHERE v BETWEEN q1 AND q2 GROUP BY ALL""")  # fmt: skip
def _(t, spark):
    return sequence.fdc_slope(_events(t), "v", BY, 50, 90, trans=transforms.Log(), tie=["event_id"])


@query("acf_lags", f"""WITH x AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d, ts, event_id FROM events),
    l AS (SELECT event_type, unnest([0, 1, 2, 3]) AS lag, unnest([d * d, d * lag(d, 1) OVER w, d * lag(d, 2) OVER w, d * lag(d, 3) OVER w]) AS c FROM x WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    m AS (SELECT event_type, lag, avg(c) AS c FROM l GROUP BY ALL)
    SELECT a.event_type, a.lag::INTEGER AS lag, {r('a.c / b.c')} AS acf, round(b.c, 3) + 0.0 AS covar FROM m a JOIN m b ON a.event_type = b.event_type AND b.lag = 0 WHERE a.lag > 0""")  # fmt: skip
def _(t, spark):
    return stats.acf(t("events"), "value", BY, AT, 3).withColumn("covar", F.round("covar", 3))


# ---- scores

_KINDS = {"standard": "(avg(s) - avg(o)) / avg(o)", "normalised": "(avg(s) - avg(o)) / (avg(s) + avg(o))", "log": "ln(avg(s)) - ln(avg(o))"}
_FULL = f"{_PAIRS} WHERE s IS NOT NULL"
for _kind, _sql in _KINDS.items():

    @query(f"bias_{_kind}", f"SELECT event_type, {r(_sql)} AS bias FROM {_FULL} GROUP BY ALL")
    def _(t, spark, kind=_kind):
        return scores.bias(_pairs(t), "o", "s", BY, kind, exclude_null=True)


@query("nse", f"SELECT event_type, {r('1 - sum((s - o) ^ 2) / (var_pop(o) * count(*))')} AS nse FROM {_FULL} GROUP BY ALL")
def _(t, spark):
    return scores.nse(_pairs(t), "o", "s", BY, exclude_null=True)


@query("kge", f"SELECT event_type, {r('1 - sqrt((1 - avg(s) / avg(o)) ^ 2 + (1 - stddev_pop(s) / stddev_pop(o)) ^ 2 + (1 - corr(o, s)) ^ 2)')} AS kge FROM {_FULL} GROUP BY ALL")
def _(t, spark):
    return scores.kge(_pairs(t), "o", "s", BY, exclude_null=True)


@query("corr_pearson", f"SELECT event_type, {r('corr(o, s)')} AS corr FROM {_FULL} GROUP BY ALL")
def _(t, spark):
    return scores.corr(_pairs(t), "o", "s", BY, exclude_null=True)


@query("corr_spearman", f"WITH p AS (SELECT * FROM {_FULL}), k AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY o) + (count(*) OVER (PARTITION BY event_type, o) - 1) / 2.0e0 AS a, rank() OVER (PARTITION BY event_type ORDER BY s) + (count(*) OVER (PARTITION BY event_type, s) - 1) / 2.0e0 AS b FROM p) SELECT event_type, {r('corr(a, b)')} AS corr FROM k GROUP BY ALL")
def _(t, spark):
    return scores.corr(_pairs(t), "o", "s", BY, "Spearman", exclude_null=True)


@query("corr_ensemble_median", f"SELECT site, {r('corr(o, list_median(e))')} AS corr FROM {_ENS} GROUP BY ALL")
def _(t, spark):
    return scores.corr(_forecasts(t), "o", "e", ["site"], ensemble="median")


@query("rel_percentile_error", f"""WITH q AS (SELECT event_type, quantile_cont(o, {[(10 + 80 * k / 49) / 100 for k in range(50)]}) AS a, quantile_cont(s, {[(10 + 80 * k / 49) / 100 for k in range(50)]}) AS b FROM (SELECT event_type, o, s * 1.1e0 + 1 AS s FROM {_FULL}) GROUP BY ALL),
    e AS (SELECT event_type, unnest(a) AS a, unnest(b) AS b FROM q) SELECT event_type, {r('avg(abs((b - a) / a))')} AS error FROM e GROUP BY ALL""")  # fmt: skip
def _(t, spark):
    return scores.relative_percentile_error(_pairs(t).withColumn("s", F.col("s") * 1.1 + 1), "o", "s", BY, 10, 90)


@query("peak_error")
def _(t, spark):
    return scores.absolute_peak_error(_pairs(t).fillna(-1.0, ["s"]), "o", "s", BY, AT)


@query("confusion", "SELECT o.c::INTEGER AS obs, s.c::INTEGER AS sim, count(labels.doc_id) AS n FROM (VALUES (0), (1), (2)) o(c) CROSS JOIN (VALUES (0), (1), (2)) s(c) LEFT JOIN labels ON quality = o.c AND toxic = s.c GROUP BY ALL")
def _(t, spark):
    return scores.confusion(t("labels"), "quality", "toxic", 3)


@query("binary_scores", f"""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS fp, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS fn, count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS tn FROM labels)
    SELECT tp AS truepos, fp AS falsepos, fn AS falseneg, tn AS trueneg, {r('(tp + fp) / (tp + fn)')} AS bias, {r('tp / (tp + fn)')} AS hitrate, {r('tp / (tp + fp)')} AS precision, {r('fp / (fp + tn)')} AS falsealarm, {r('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {r('2 * tp / (2 * tp + fp + fn)')} AS f1,
    {r('(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc, {r('ln(tp * tn / (fp * fn))')} AS lor, {r('(tp * tn / (fp * fn) - 1) / (tp * tn / (fp * fn) + 1)')} AS orss, {r('2 * ln((tp + fn) / (tp + fp + fn + tn)) / ln(tp / (tp + fp + fn + tn)) - 1')} AS eds FROM c""")  # fmt: skip
def _(t, spark):
    return scores.binary_scores(t("labels"), "quality", "toxic")


_Q = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("boxplot_stats_by", f"SELECT l_returnflag, count(*) AS count, {r('avg(x)')} AS mean, {r('min(x)')} AS min, {r('max(x)')} AS max, " + ", ".join(f"{r(f'quantile_cont(x, {q})')} AS {n}" for q, n in zip(_Q, ("whisker_low", "box_low", "median", "box_high", "whisker_high"), strict=True)) + " FROM (SELECT l_returnflag, l_extendedprice::DOUBLE / 1000 AS x FROM lineitem) GROUP BY ALL")
def _(t, spark):
    return scores.box_stats(t("lineitem").withColumn("x", F.col("l_extendedprice").cast("double") / 1000), "x", ["l_returnflag"])


@query("violin_stats", f"SELECT l_returnflag, " + ", ".join(f"{r(f'quantile_cont(x, {q})')} AS q{int(100 * q)}" for q in (0, 0.25, 0.5, 0.75, 1)) + " FROM (SELECT l_returnflag, l_quantity::DOUBLE AS x FROM lineitem) GROUP BY ALL")
def _(t, spark):
    cuts = (0.0, 0.25, 0.5, 0.75, 1.0)
    x = t("lineitem").select("l_returnflag", "l_quantity")
    g = with_quantiles(x.select("l_returnflag").distinct(), x, "l_quantity", ["l_returnflag"], list(cuts))
    return g.select("l_returnflag", *[F.col("q")[i].alias(f"q{int(100 * c)}") for i, c in enumerate(cuts)])


@query("scatter_bins", "WITH q AS (SELECT quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS c FROM events) SELECT CAST(CASE WHEN value IS NULL THEN -1 ELSE greatest(0, least(4, len(list_filter(c, lambda k: k < value)) - 1)) END AS INTEGER) AS cat, count(*) AS n FROM events, q GROUP BY ALL")
def _(t, spark):
    return scores.scatter_bins(t("events"), "value", 5)


@query("ismisscens", f"SELECT event_id, CAST((CASE WHEN v IS NULL THEN 0 WHEN v < 20 + 1e-10 THEN 1 ELSE 2 END) + 3 * (CASE WHEN u < 20 + 1e-10 THEN 1 ELSE 2 END) AS BIGINT) AS code FROM (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN value END AS v, value * 0.5e0 AS u FROM events)")
def _(t, spark):
    x = t("events").withColumn("v", F.when(F.col("event_id") % 17 != 0, F.col("value"))).withColumn("u", F.col("value") * 0.5)
    return x.select("event_id", scores.ismisscens(["v", "u"], 20.0).alias("code"))


# ---- transforms: forward, and back again

_X = "(value / 1000 + 0.01e0)"
_FORWARD = {
    "Identity": ({}, _X), "Logit": ({}, f"ln(1 / (1 - {_X}) - 1)"), "Log": ({"nu": 0.1}, f"ln({_X} + 0.1e0)"),
    "BoxCox2": ({"nu": 0.1, "lam": 0.3}, f"(pow({_X} + 0.1e0, 0.3e0) - 1) / 0.3e0"), "BoxCox1lam": ({"nu": 0.2, "lam": 0.5}, f"(pow({_X} + 0.2e0, 0.5e0) - 1) / 0.5e0"),
    "BoxCox1nu": ({"nu": 0.2, "lam": 0.2}, f"(pow({_X} + 0.2e0, 0.2e0) - 1) / 0.2e0"), "BoxCox2sym": ({"nu": 0.1, "lam": 0.3}, f"(pow({_X} + 0.1e0, 0.3e0) - pow(0.1e0, 0.3e0)) / 0.3e0"),
    "YeoJohnson": ({"nu": -0.2, "lam": 0.7}, f"CASE WHEN {_X} - 0.2e0 >= 1e-10 THEN (pow({_X} + 0.8e0, 0.7e0) - 1) / 0.7e0 ELSE -(pow(1.2e0 - {_X}, 1.3e0) - 1) / 1.3e0 END"),
    "LogSinh": ({}, f"exp(-1e0) + {_X} + ln((1 - exp(-2 * (exp(-1e0) + {_X}))) / 2)"), "Reciprocal": ({"nu": 0.1}, f"-1 / (0.1e0 + {_X})"),
    "Sinh": ({"nu": 0.1, "scale": 2.0}, f"asinh(({_X} - 0.1e0) * 2)"), "Manly": ({"lam": 0.4}, f"(exp(0.4e0 * {_X}) - 1) / 0.4e0"),
}
for _name, (_values, _sql) in _FORWARD.items():

    @query(f"transform_{_name.lower()}", f"SELECT event_id, {r(_sql)} AS y, {r(_X)} AS back FROM events")
    def _(t, spark, name=_name, values=_values):
        f, x = transforms.get_transform(name, **values), F.col("value") / 1000 + 0.01
        return t("events").select("event_id", f.forward(x).alias("y"), f.backward(f.forward(x)).alias("back"))


@query("transform_softmax", f"SELECT event_id, {r('ln(a / (1 - a - b))')} AS y0, {r('ln(b / (1 - a - b))')} AS y1 FROM (SELECT event_id, {_X} * 0.4e0 AS a, {_X} * 0.3e0 AS b FROM events)")
def _(t, spark):
    x = F.col("value") / 1000 + 0.01
    y = transforms.Softmax().forward(F.array(x * 0.4, x * 0.3))
    return t("events").select("event_id", y[0].alias("y0"), y[1].alias("y1"))


# ---- ensembles

@query("crps_mean", f"WITH s AS (SELECT vec_id, site, o, list_sort(e) AS e, len(e) AS p FROM {_ENS}), u AS (SELECT vec_id, site, o, p, unnest(e) AS x, unnest(range(1, p + 1)) AS i FROM s), c AS (SELECT vec_id, site, sum(abs(x - o)) / any_value(p) - sum((2 * i - p - 1) * x) / any_value(p * p) AS c FROM u GROUP BY ALL) SELECT site, {r('avg(c)')} AS crps FROM c GROUP BY ALL")
def _(t, spark):
    return ensemble.crps_mean(_forecasts(t), "o", "e", ["site"])


_BINS = f"""s AS (SELECT site, o, list_sort(e) AS e, len(e) AS p FROM {_ENS}), u AS (SELECT site, o, e, p, unnest(range(p + 1)) AS j FROM s),
    x AS (SELECT site, o, p, j, CASE WHEN j > 0 THEN e[j] END AS lo, CASE WHEN j < p THEN e[j + 1] END AS hi FROM u),
    t AS (SELECT site, j, p, avg(CASE WHEN j = 0 THEN 0 WHEN j = p THEN greatest(0, o - lo) ELSE greatest(0, least(o, hi) - lo) END) AS a, avg(CASE WHEN j = p THEN 0 WHEN j = 0 THEN greatest(0, hi - o) ELSE greatest(0, hi - greatest(o, lo)) END) AS b,
        avg(CASE WHEN j = 0 THEN (o < hi)::INT WHEN j = p THEN (o < lo)::INT END) AS oo FROM x GROUP BY ALL),
    g AS (SELECT *, j / p AS f, CASE WHEN j = 0 THEN coalesce(b / nullif(oo, 0), 0) WHEN j = p THEN coalesce(a / nullif(1 - oo, 0), 0) ELSE a + b END AS g FROM t),
    q AS (SELECT *, CASE WHEN j IN (0, p) THEN oo ELSE coalesce(b / nullif(g, 0), 0) END AS freq FROM g),
    z AS (SELECT *, CASE WHEN g > 0 THEN g * (freq - f) ^ 2 ELSE 0 END AS reliability, CASE WHEN g > 0 THEN g * freq * (1 - freq) ELSE 0 END AS potential, a * f * f + b * (1 - f) ^ 2 AS crps FROM q)"""


@query("crps_table", f"WITH {_BINS} SELECT site, j::INTEGER AS rank, " + ", ".join(f"{r(c)} AS {c}" for c in ("a", "b", "g", "freq", "reliability", "potential", "crps")) + " FROM z")
def _(t, spark):
    return ensemble.crps_table(_forecasts(t), "o", "e", ["site"])


_UNC = f"(SELECT site, sum((2 * i - n - 1) * o / (n * n)) AS uncertainty FROM (SELECT site, o, row_number() OVER (PARTITION BY site ORDER BY o) AS i, count(*) OVER (PARTITION BY site) AS n FROM {_ENS}) GROUP BY ALL)"


@query("crps_uncertainty", f"SELECT site, {r('uncertainty')} AS uncertainty FROM {_UNC}")
def _(t, spark):
    return ensemble.uncertainty(_forecasts(t), "o", "e", ["site"])


@query("crps_decomposition", f"WITH {_BINS}, w AS (SELECT site, sum(crps) AS crps, sum(reliability) AS reliability, sum(potential) AS potential FROM z GROUP BY ALL) SELECT w.site, {r('crps')} AS crps, {r('reliability')} AS reliability, {r('uncertainty - potential')} AS resolution, {r('uncertainty')} AS uncertainty, {r('potential')} AS potential, {r('1 - crps / nullif(uncertainty, 0)')} AS skill FROM w JOIN {_UNC} y ON y.site = w.site")
def _(t, spark):
    return ensemble.crps(_forecasts(t), "o", "e", ["site"])


_PIT = f"(SELECT vec_id, site, (lo + up + CASE WHEN up > lo THEN 1 ELSE 0 END) / (2.0e0 * len(e)) AS pit FROM (SELECT *, len(list_filter(e, lambda x: x < o)) AS lo, len(list_filter(e, lambda x: x <= o)) AS up FROM {_ENS}))"


@query("pit_rank", f"SELECT vec_id, {r('pit')} AS pit FROM {_PIT}")
def _(t, spark):
    return ensemble.pit(_forecasts(t), "o", "e", ["vec_id"]).select("vec_id", "pit")


_UNIF = f"""(SELECT site, any_value(n) AS n, 1 / (12.0e0 * any_value(n)) + sum(c) AS cvm, -any_value(n) - sum(d) / any_value(n) AS ad, max(k) AS ks FROM (SELECT site, n, ((2 * i - 1) / (2.0e0 * n) - x) ^ 2 AS c, (2 * i - 1) * ln(x) + (2 * (n - i) + 1) * ln(1 - x) AS d, greatest(i / n - x, x - (i - 1) / n) AS k
    FROM (SELECT site, x, row_number() OVER (PARTITION BY site ORDER BY x) AS i, count(*) OVER (PARTITION BY site) AS n FROM (SELECT site, least(greatest(pit, 0.001e0), 0.999e0) AS x FROM {_PIT}))) GROUP BY ALL)"""


@query("alpha_statistics", f"SELECT site, n, {r('cvm')} AS cvm, {r('ad')} AS ad, {r('ks')} AS ks FROM {_UNIF}")
def _(t, spark):
    p = ensemble.pit(_forecasts(t), "o", "e", ["site"]).withColumn("pit", F.least(F.greatest("pit", F.lit(0.001)), F.lit(0.999)))
    return ensemble.uniformity(p, "pit", ["site"])


@query("alpha_pvalues")
def _(t, spark):
    p = ensemble.pit(_forecasts(t), "o", "e", ["site"]).withColumn("pit", F.least(F.greatest("pit", F.lit(0.001)), F.lit(0.999)))
    return ensemble.uniformity_pvalues(ensemble.uniformity(p, "pit", ["site"]))


@query("iqr_skill", f"SELECT site, {r('100 * avg((c - a) / (c + a))')} AS skill, {r('avg(a)')} AS score, {r('avg(c)')} AS clim, {r('avg(a / c)')} AS ratio FROM (SELECT site, list_aggregate(e[1:32], 'quantile_cont', 0.75) - list_aggregate(e[1:32], 'quantile_cont', 0.25) AS a, list_aggregate(e, 'quantile_cont', 0.75) - list_aggregate(e, 'quantile_cont', 0.25) AS c FROM {_ENS}) GROUP BY ALL")
def _(t, spark):
    return ensemble.iqr(_forecasts(t).withColumn("a", F.slice("e", 1, 32)), "a", "e", ["site"])


@query("dscore", f"""WITH m AS (SELECT site, vec_id, unnest(e) AS x FROM {_ENS}),
    p AS (SELECT a.site, a.vec_id, b.vec_id AS other, avg(CASE WHEN b.x < a.x - 1e-6 THEN 1e0 WHEN b.x <= a.x + 1e-6 THEN 0.5e0 ELSE 0e0 END) AS above FROM m a JOIN m b ON a.site = b.site AND a.vec_id <> b.vec_id GROUP BY ALL),
    k AS (SELECT site, vec_id, sum(CASE WHEN above > 0.5 + 1e-12 THEN 1e0 WHEN above < 0.5 - 1e-12 THEN 0e0 ELSE 0.5e0 END) AS rank FROM p GROUP BY ALL),
    o AS (SELECT site, vec_id, row_number() OVER (PARTITION BY site ORDER BY o, vec_id) AS ro FROM {_ENS})
    SELECT o.site, {r('(corr(ro, rank) + 1) / 2')} AS dscore FROM o JOIN k ON k.site = o.site AND k.vec_id = o.vec_id GROUP BY ALL""")  # fmt: skip
def _(t, spark):
    return ensemble.dscore(_forecasts(t), "o", "e", ["site"], "vec_id")


# ---- regression, dominance, autoregression, density

_REG = "(SELECT l_returnflag, l_quantity::DOUBLE AS q, l_discount::DOUBLE * 100 AS d, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem)"


@query("ols_simple", f"SELECT l_returnflag, {r('regr_slope(y, q)')} AS slope, {r('regr_intercept(y, q)')} AS intercept FROM {_REG} GROUP BY ALL")
def _(t, spark):
    x = t("lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("q"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    fit = stats.lstsq(x, ["q"], "y", ["l_returnflag"])
    return fit.groupBy("l_returnflag").agg(F.max(F.when(F.col("term") == "q", F.col("estimate"))).alias("slope"), F.max(F.when(F.col("term") == "intercept", F.col("estimate"))).alias("intercept"))


_FIT = f"""WITH m AS (SELECT l_returnflag, count(*) AS n, avg(q) AS mq, avg(d) AS md, avg(y) AS my, var_pop(q) * count(*) AS qq, var_pop(d) * count(*) AS dd, var_pop(y) * count(*) AS yy, covar_pop(q, d) * count(*) AS qd, covar_pop(q, y) * count(*) AS qy, covar_pop(d, y) * count(*) AS dy FROM {_REG} GROUP BY ALL),
    b AS (SELECT *, qq * dd - qd * qd AS det, (dd * qy - qd * dy) / (qq * dd - qd * qd) AS bq, (qq * dy - qd * qy) / (qq * dd - qd * qd) AS bd FROM m),
    f AS (SELECT *, my - bq * mq - bd * md AS b0, (yy - bq * qy - bd * dy) / (n - 3) AS s2 FROM b)"""


def _prices(t):
    return t("lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("q"), (F.col("l_discount").cast("double") * 100).alias("d"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))


@query("ols_multiple", f"""{_FIT}, e AS (SELECT l_returnflag, unnest(['intercept', 'q', 'd']) AS term, unnest([b0, bq, bd]) AS estimate, unnest([sqrt(s2 * (1 / n + (mq * mq * dd - 2 * mq * md * qd + md * md * qq) / det)), sqrt(s2 * dd / det), sqrt(s2 * qq / det)]) AS stderr FROM f)
    SELECT l_returnflag, term, {r('estimate')} AS estimate, {r('stderr')} AS stderr, {r('estimate / stderr')} AS t FROM e""")  # fmt: skip
def _(t, spark):
    return stats.lstsq(_prices(t), ["q", "d"], "y", ["l_returnflag"]).drop("p")


@query("ols_restriction", f"{_FIT} SELECT l_returnflag, {r('(bq * qy + bd * dy) / 2 / s2')} AS f FROM f")
def _(t, spark):
    return stats.restriction_test(_prices(t), ["q", "d"], "y", ["l_returnflag"], [[0, 1, 0], [0, 0, 1]]).drop("p")


@query("leverage", f"WITH x AS (SELECT s_suppkey, 1e0 AS a, s_acctbal::DOUBLE / 1000 AS b FROM supplier), m AS (SELECT sum(a * a) AS n, sum(a * b) AS p, sum(b * b) AS q FROM x) SELECT s_suppkey, {r('(q - 2 * p * b + n * b * b) / (n * q - p * p)')} AS leverage FROM x, m")
def _(t, spark):
    x = t("supplier").select("s_suppkey", F.lit(1.0).alias("a"), (F.col("s_acctbal").cast("double") / 1000).alias("b"))
    return stats.leverage(x, ["a", "b"]).select("s_suppkey", "leverage")


@query("pareto_count", "WITH x AS (SELECT s_nationkey AS k, s_suppkey AS id, s_acctbal AS a, s_suppkey * 7919 % 100 AS b FROM supplier) SELECT y.k, y.id, count(x.id) AS dominated_by FROM x y LEFT JOIN x ON x.k = y.k AND x.id <> y.id AND x.a >= y.a AND x.b >= y.b GROUP BY ALL")
def _(t, spark):
    x = t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("a"), (F.col("s_suppkey") * 7919 % 100).alias("b"))
    return stats.dominance(x, "id", ["a", "b"], ["k"])


_AR2 = "WITH x AS (SELECT event_id, value - avg(value) OVER (PARTITION BY event_type) AS x, row_number() OVER w AS i, event_type, ts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"


@query("ar_residual", f"{_AR2} SELECT event_id, {r('x - 0.5e0 * coalesce(lag(x, 1) OVER w, 0) - 0.2e0 * coalesce(lag(x, 2) OVER w, 0)')} AS residual FROM x WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def _(t, spark):
    return stats.ar_residual(t("events").select("event_id", "event_type", "ts", "value"), "value", [0.5, 0.2], BY, AT).select("event_id", "residual")


@query("ar_sim", f"SELECT event_id, {r('value')} AS sim FROM events")
def _(t, spark):
    x = stats.ar_residual(t("events").select("event_id", "event_type", "ts", "value"), "value", [0.5, 0.2], BY, AT, mean=100.0)
    return stats.ar_simulate(x, "residual", [0.5, 0.2], BY, AT, mean=100.0).select("event_id", "sim")


@query("kde_grid", f"""WITH s AS (SELECT s_acctbal::DOUBLE / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier),
    m AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, var_samp(x) * count(*) ^ (-1 / 3e0) AS a, var_samp(y) * count(*) ^ (-1 / 3e0) AS b, covar_samp(x, y) * count(*) ^ (-1 / 3e0) AS c FROM s),
    g AS (SELECT x0 - 0.05e0 * (x1 - x0) + 1.1e0 * (x1 - x0) * i / 19 AS gx, y0 - 0.05e0 * (y1 - y0) + 1.1e0 * (y1 - y0) * j / 19 AS gy, a, b, c, n, a * b - c * c AS det FROM m, (SELECT unnest(range(20)) AS i), (SELECT unnest(range(20)) AS j))
    SELECT {r('gx')} AS gx, {r('gy')} AS gy, {r('sum(exp(-0.5e0 * (b * (gx - x) ^ 2 - 2 * c * (gx - x) * (gy - y) + a * (gy - y) ^ 2) / det)) / (any_value(n) * 2 * pi() * sqrt(any_value(det)))')} AS density FROM g, s GROUP BY gx, gy""")  # fmt: skip
def _(t, spark):
    return stats.kde_grid(t("supplier").select((F.col("s_acctbal").cast("double") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y")), "x", "y", 20)


@query("cov_ellipse", f"WITH m AS (SELECT event_type, avg(o) AS cx, avg(s) AS cy, var_samp(o) AS a, var_samp(s) AS b, covar_samp(o, s) AS c FROM {_FULL} GROUP BY ALL), h AS (SELECT *, (a + b) / 2 AS h, sqrt(((a - b) / 2) ^ 2 + c * c) AS q FROM m) SELECT event_type, {r('cx')} AS cx, {r('cy')} AS cy, {r('2 * sqrt(-2 * ln(0.05e0) * (h + q))')} AS major, {r('2 * sqrt(-2 * ln(0.05e0) * greatest(h - q, 0))')} AS minor, round(degrees(atan2(h + q - a, c)), 3) + 0.0 AS angle FROM h")
def _(t, spark):
    return stats.cov_ellipse(_pairs(t).where("s is not null"), "o", "s", BY).withColumn("angle", F.round("angle", 3))


# ---- places, grids and flow networks; the direction codes drain east or south, so nothing circles

_LON, _LAT = "(112 + c_custkey * 7919 % 4200 / 100.0e0)", "(-44 + c_custkey * 104729 % 3400 / 100.0e0)"
G = Grid(40, 40, 2.0, 100.0, -50.0)
COARSE = Grid(10, 10, 8.0, 100.0, -50.0)
_N = G.ncols * G.nrows
_CODE = "CASE WHEN cell * 7919 % 97 % 8 < 2 THEN 1 WHEN cell * 7919 % 97 % 8 < 4 THEN 2 WHEN cell * 7919 % 97 % 8 < 7 THEN 4 ELSE 8 END"
_EDGES = f"""(SELECT cell, code, CASE WHEN code = 1 THEN CASE WHEN cell % 40 < 39 THEN cell + 1 ELSE -1 END WHEN cell // 40 = 39 THEN -1 WHEN code = 4 THEN cell + 40 WHEN code = 2 THEN CASE WHEN cell % 40 < 39 THEN cell + 41 ELSE -1 END ELSE CASE WHEN cell % 40 > 0 THEN cell + 39 ELSE -1 END END AS down
    FROM (SELECT cell, {_CODE} AS code FROM (SELECT range AS cell FROM range({_N}))))"""
OUTLET = 1541
_AREA = f"e AS MATERIALIZED {_EDGES}, a(cell, len) AS (SELECT {OUTLET}::BIGINT, 0e0 UNION ALL SELECT e.cell, a.len + CASE WHEN abs(e.cell - e.down) IN (1, 40) THEN 1 ELSE sqrt(2) END FROM a JOIN e ON e.down = a.cell)"


def _cells(spark) -> DataFrame:
    return spark.range(_N).withColumnRenamed("id", "cell").withColumn("value", F.expr(_CODE))


def _edges(spark) -> DataFrame:
    return network.edges(_cells(spark), G)


@query("oz_timezone", f"SELECT c_custkey, CASE WHEN lon < 129 THEN 'Australia/Perth' WHEN lon < 141 THEN CASE WHEN lat < -26 THEN 'Australia/Adelaide' WHEN lon > 138 THEN 'Australia/Brisbane' ELSE 'Australia/Darwin' END WHEN lat < -29 THEN 'Australia/Sydney' ELSE 'Australia/Brisbane' END AS tz FROM (SELECT c_custkey, {_LON} AS lon, {_LAT} AS lat FROM customer)")
def _(t, spark):
    return t("customer").select("c_custkey", calendar.oz_timezone(F.expr(_LON), F.expr(_LAT)).alias("tz"))


@query("coord2cell", f"SELECT c_custkey, CAST(CASE WHEN c BETWEEN 0 AND 39 AND r BETWEEN 0 AND 39 THEN r * 40 + c ELSE -1 END AS BIGINT) AS cell FROM (SELECT c_custkey, CAST(trunc(({_LON} - 100) / 2) AS BIGINT) AS c, 39 - CAST(trunc(({_LAT} + 50) / 2) AS BIGINT) AS r FROM customer)")
def _(t, spark):
    return t("customer").select("c_custkey", G.coord2cell(F.expr(_LON), F.expr(_LAT)).cast("bigint").alias("cell"))


@query("cell2coord", f"SELECT range AS cell, {r('100 + 2 * (range % 40 + 0.5)')} AS x, {r('-50 + 2 * (39 - range // 40 + 0.5)')} AS y, range // 40 AS r, range % 40 AS c FROM range({_N})")
def _(t, spark):
    c = F.col("cell")
    return _cells(spark).select("cell", G.x(c).alias("x"), G.y(c).alias("y"), G.row(c).alias("r"), G.col(c).alias("c"))


@query("neighbours", f"SELECT cell, (i * 3 + j + 4)::INTEGER AS place, CASE WHEN (i <> 0 OR j <> 0) AND cell // 40 + i BETWEEN 0 AND 39 AND cell % 40 + j BETWEEN 0 AND 39 THEN cell + i * 40 + j ELSE -1 END AS other FROM (SELECT range AS cell FROM range({_N})), (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)")
def _(t, spark):
    return _cells(spark).select("cell", F.posexplode(G.neighbours(F.col("cell"))).alias("place", "other"))


POLYGON = [(120.0, -40.0), (150.0, -42.0), (140.0, -25.0), (148.0, -12.0), (118.0, -15.0), (128.0, -30.0)]


def _inside_sql(key: str, source: str) -> str:
    hits = []
    for (ax, ay), (bx, by) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True):
        hits.append(f"(y > {min(ay, by)}e0 AND y <= {max(ay, by)}e0 AND x <= {max(ax, bx)}e0 AND x <= (y - ({ay}e0)) * {(bx - ax) / (by - ay)!r} + {ax}e0)::INTEGER")
    return f"SELECT {key}, CAST(CASE WHEN x BETWEEN 118 AND 150 AND y BETWEEN -42 AND -12 THEN ({' + '.join(hits)}) % 2 ELSE 0 END AS INTEGER) AS inside FROM ({source})"


@query("inside_polygon", _inside_sql("c_custkey", f"SELECT c_custkey, {_LON} AS x, {_LAT} AS y FROM customer"))
def _(t, spark):
    return raster.points_inside(t("customer").select("c_custkey", F.expr(_LON).alias("x"), F.expr(_LAT).alias("y")), "x", "y", POLYGON).select("c_custkey", "inside")


@query("d8_down", f"SELECT cell, down FROM {_EDGES}")
def _(t, spark):
    return _edges(spark)


@query("d8_upstream", f"SELECT down AS cell, string_agg(cell::VARCHAR, ',' ORDER BY cell) AS ups FROM {_EDGES} WHERE down >= 0 GROUP BY ALL")
def _(t, spark):
    return network.upstream(_edges(spark)).select("cell", F.array_join(F.col("ups").cast("array<string>"), ",").alias("ups"))


@query("d8_area", f"WITH RECURSIVE {_AREA} SELECT cell FROM a")
def _(t, spark):
    return network.area(_edges(spark), OUTLET)


@query("d8_paths", f"WITH RECURSIVE {_AREA} SELECT cell AS start, CASE WHEN cell = {OUTLET} THEN (SELECT down FROM e WHERE cell = {OUTLET}) ELSE {OUTLET} END AS stop, {r('len')} AS length FROM a")
def _(t, spark):
    return network.path_lengths(_edges(spark), OUTLET, G)


@query("d8_river", f"WITH RECURSIVE e AS MATERIALIZED {_EDGES}, v(step, cell, dist) AS (SELECT 0, 5::BIGINT, 0e0 UNION ALL SELECT step + 1, e.down, dist + CASE WHEN abs(e.cell - e.down) IN (1, 40) THEN 1 ELSE sqrt(2) END FROM v JOIN e ON e.cell = v.cell WHERE e.down >= 0) SELECT step::INTEGER AS step, cell, {r('dist')} AS dist FROM v")
def _(t, spark):
    return network.river(_edges(spark), 5, G).select("step", "cell", "dist")


_WIDE = 50
_GROWING = f"""(SELECT cell, CASE WHEN code = 1 THEN CASE WHEN cell % {_WIDE} < {_WIDE - 1} THEN cell + 1 ELSE -1 END WHEN cell // {_WIDE} = last THEN -1 WHEN code = 4 THEN cell + {_WIDE} WHEN code = 2 THEN CASE WHEN cell % {_WIDE} < {_WIDE - 1} THEN cell + {_WIDE + 1} ELSE -1 END ELSE CASE WHEN cell % {_WIDE} > 0 THEN cell + {_WIDE - 1} ELSE -1 END END AS down
    FROM (SELECT cell, {_CODE} AS code, max(cell) OVER () // {_WIDE} AS last FROM (SELECT CAST(c_custkey AS BIGINT) AS cell FROM customer)))"""


def _growing(t) -> tuple[DataFrame, DataFrame]:
    """Edges of a grid with a cell for each customer, and a field on it."""
    cells = t("customer").select(F.col("c_custkey").cast("bigint").alias("cell")).withColumn("value", F.expr(_CODE))
    rows = cells.agg(F.max("cell")).first()[0] // _WIDE + 1
    return network.edges(cells, Grid(_WIDE, rows)), cells.select("cell", (F.lit(1.0) + F.col("cell") % 7).alias("value"))


def _accumulated(value: str, within: str = "") -> str:
    return f"WITH RECURSIVE e AS MATERIALIZED {_GROWING}, w(o, cell, n) AS (SELECT cell, cell, 0 FROM e WHERE down >= 0 UNION ALL SELECT w.o, e.down, n + 1 FROM w JOIN e ON e.cell = w.cell WHERE e.down >= 0 {within}) SELECT w.cell, {r(value)} AS value FROM w JOIN e ON e.cell = w.cell WHERE down >= 0 GROUP BY ALL"


@query("d8_accumulate", _accumulated("sum(1e0 + o % 7)"))
def _(t, spark):
    return network.accumulate(*_growing(t), receiver=False)


@query("d8_accumulate_receiver", _accumulated("count(*) * (1e0 + min(w.cell) % 7)"))
def _(t, spark):
    return network.accumulate(*_growing(t))


@query("d8_accumulate_within", _accumulated("count(*) * (1e0 + min(w.cell) % 7)", "AND n < 6"))
def _(t, spark):
    return network.accumulate(*_growing(t), max_accumulated_cells=5)


@query("slope", f"SELECT cell, CASE WHEN down >= 0 THEN {r('(cell * 31 % 53 - down * 31 % 53) / (2 * CASE WHEN abs(cell - down) IN (1, 40) THEN 1 ELSE sqrt(2) END)')} END AS slope FROM {_EDGES}")
def _(t, spark):
    z = _cells(spark).select("cell", (F.col("cell") * 31 % 53).cast("double").alias("value"))
    return raster.slope(_edges(spark), z, G)


@query("grid_intersect", f"WITH RECURSIVE {_AREA} SELECT CAST((cell // 40) // 4 * 10 + (cell % 40) // 4 AS BIGINT) AS cell, {r('count(*) * 0.0625')} AS weight FROM a GROUP BY ALL")
def _(t, spark):
    return raster.intersect(network.area(_edges(spark), OUTLET), G, COARSE)


_POINTS = [(110.0, 20.0), (130.0, -10.0), (150.0, 10.0), (170.0, -40.0)]


@query("voronoi_weights", f"WITH RECURSIVE {_AREA}, d AS (SELECT cell, arg_min(p, ((100 + 2 * (cell % 40 + 0.5) - x) ^ 2 + (-50 + 2 * (39 - cell // 40 + 0.5) - y) ^ 2, p)) AS p FROM a, (VALUES {', '.join(f'({i}, {x}, {y})' for i, (x, y) in enumerate(_POINTS))}) q(p, x, y) GROUP BY cell) SELECT q.p::INTEGER AS point, {r('count(cell) / (SELECT count(*)::DOUBLE FROM a)')} AS weight FROM (VALUES (0), (1), (2), (3)) q(p) LEFT JOIN d ON d.p = q.p GROUP BY ALL")
def _(t, spark):
    return raster.voronoi(network.area(_edges(spark), OUTLET), G, _POINTS)


@query("area_union", f"WITH RECURSIVE {_AREA} SELECT cell FROM a UNION SELECT cell FROM e WHERE cell % 40 = 3")
def _(t, spark):
    return network.union(network.area(_edges(spark), OUTLET), _cells(spark).where("cell % 40 = 3"))


@query("area_minus", f"WITH RECURSIVE {_AREA} SELECT cell FROM a WHERE cell % 3 <> 0")
def _(t, spark):
    return network.difference(network.area(_edges(spark), OUTLET), _cells(spark).where("cell % 3 = 0"))


@query("boundary_order")
def _(t, spark):
    return network.boundary(network.filled(network.area(_edges(spark), OUTLET), G), G)


@query("grid_interpolate", f"""WITH z AS (SELECT range AS cell, (range * range % 17)::DOUBLE AS v FROM range({_N})),
    t AS (SELECT range AS cell, (101 + 2.5e0 * (range % 30 + 0.5e0) - 100) / 2 - 0.5e0 AS fx, 39 - ((-49 + 2.5e0 * (29 - range // 30 + 0.5e0) + 50) / 2 - 0.5e0) AS fy FROM range(900)),
    k AS (SELECT *, least(floor(fy), 38)::BIGINT AS i, least(floor(fx), 38)::BIGINT AS j FROM t WHERE fx BETWEEN 0 AND 39 AND fy BETWEEN 0 AND 39)
    SELECT k.cell, {r('(1 - fy + i) * ((1 - fx + j) * a.v + (fx - j) * b.v) + (fy - i) * ((1 - fx + j) * c.v + (fx - j) * d.v)')} AS value
    FROM k JOIN z a ON a.cell = i * 40 + j JOIN z b ON b.cell = a.cell + 1 JOIN z c ON c.cell = a.cell + 40 JOIN z d ON d.cell = a.cell + 41""")  # fmt: skip
def _(t, spark):
    z = _cells(spark).select("cell", (F.col("cell") * F.col("cell") % 17).cast("double").alias("value"))
    return raster.interpolate(z, G, Grid(30, 30, 2.5, 101.0, -49.0))


@query("grid_smooth", f"""WITH x AS (SELECT range // 40 AS r, range % 40 AS c, CASE WHEN range % 11 <> 0 THEN (range % 40)::DOUBLE END AS v FROM range({_N})),
    p AS (SELECT *, max(v) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM x),
    f AS (SELECT r, c, coalesce(v, max(m) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS v FROM p),
    w AS (SELECT k, exp(-0.5e0 * (k / 2e0) ^ 2) / sum(exp(-0.5e0 * (k / 2e0) ^ 2)) OVER () AS w FROM (SELECT unnest(range(-8, 9)) AS k)),
    h AS (SELECT a.r, a.c, sum(w * b.v) AS v FROM f a CROSS JOIN w JOIN f b ON b.r = a.r AND b.c = greatest(0, least(39, a.c + k)) GROUP BY ALL),
    g AS (SELECT a.r, a.c, sum(w * b.v) AS v FROM h a CROSS JOIN w JOIN h b ON b.c = a.c AND b.r = greatest(0, least(39, a.r + k)) GROUP BY ALL)
    SELECT r * 40 + c AS cell, {r('v')} AS value FROM g""")  # fmt: skip
def _(t, spark):
    z = _cells(spark).select("cell", F.when(F.col("cell") % 11 != 0, (F.col("cell") % 40).cast("double")).alias("value"))
    return raster.smooth(z, G, 2.0, 20)


# ---- more of sets of cells, quantile plots, densities, sessions and files

@query("area_intersect", f"WITH RECURSIVE {_AREA} SELECT cell FROM a WHERE cell % 3 = 0")
def _(t, spark):
    return network.intersection(network.area(_edges(spark), OUTLET), _cells(spark).where("cell % 3 = 0"))


@query("area_isin", f"WITH RECURSIVE {_AREA} SELECT c_custkey, a.cell IS NOT NULL AS inside FROM customer LEFT JOIN a ON a.cell = c_custkey % {_N}")
def _(t, spark):
    places = t("customer").select("c_custkey", (F.col("c_custkey") % _N).cast("bigint").alias("cell"))
    return network.contains(network.area(_edges(spark), OUTLET), places).select("c_custkey", "inside")


_CENTRES = f"SELECT range AS cell, 100 + 2e0 * (range % 40 + 0.5e0) AS x, -50 + 2e0 * (39 - range // 40 + 0.5e0) AS y FROM range({_N})"


@query("cells_inside", f"SELECT cell FROM ({_inside_sql('cell', _CENTRES)}) WHERE inside = 1")
def _(t, spark):
    return raster.cells_inside(spark, G, POLYGON)


_QQ = f"(SELECT event_type, v, {norm_ppf_sql('p')} AS z FROM (SELECT event_type, v, (row_number() OVER (PARTITION BY event_type ORDER BY v, event_id) - 0.3e0) / (count(*) OVER (PARTITION BY event_type) + 0.4e0) AS p FROM {_EVENTS} WHERE v IS NOT NULL))"


@query("qq_line", f"SELECT event_type, {r('regr_intercept(v, z)')} AS intercept, {r('regr_slope(v, z)')} AS slope, {r('corr(v, z)')} AS r FROM {_QQ} GROUP BY ALL")
def _(t, spark):
    return sequence.qq_line(_events(t), "v", BY, tie=["event_id"])


@query("qq_line_censored", f"SELECT event_type, {r('regr_intercept(v, z)')} AS intercept, {r('regr_slope(v, z)')} AS slope, {r('corr(v, z)')} AS r FROM {_QQ} WHERE v > 20 + 1e-10 GROUP BY ALL")
def _(t, spark):
    return sequence.qq_line(_events(t), "v", BY, 20.0, ["event_id"])


@query("violin_kde", f"""WITH x AS (SELECT s_nationkey % 3 AS k, greatest(s_acctbal::DOUBLE / 1000, 1e0) AS x FROM supplier),
    m AS (SELECT k, min(x) AS lo, max(x) AS hi, quantile_cont(x, {[i / 9 for i in range(10)]}) AS q FROM x GROUP BY ALL HAVING count(*) > 2 AND min(x) < max(x)),
    s AS (SELECT x.k, x.x FROM x JOIN m ON m.k = x.k WHERE x > lo AND x < hi UNION ALL SELECT k, unnest([lo, hi]) FROM m),
    w AS (SELECT k, stddev_samp(x) * count(*) ^ (-0.2e0) AS h FROM s GROUP BY ALL),
    p AS (SELECT m.k, h, unnest(range(20)) AS i, unnest(list_concat(list_transform(range(10), lambda i: lo + (hi - lo) * i / 9), q)) AS g FROM m JOIN w ON w.k = m.k),
    d AS (SELECT p.k, i, g, sum(exp(-0.5e0 * ((g - x) / h) ^ 2)) AS d FROM p JOIN s ON s.k = p.k GROUP BY ALL)
    SELECT k, {r('g')} AS x, {r('(d - min(d) OVER (PARTITION BY k)) / (max(d) OVER (PARTITION BY k) - min(d) OVER (PARTITION BY k))')} AS density FROM d""")  # fmt: skip
def _(t, spark):
    x = t("supplier").select((F.col("s_nationkey") % 3).alias("k"), F.greatest(F.col("s_acctbal").cast("double") / 1000, F.lit(1.0)).alias("x"))
    return scores.violin_kde(x, "x", ["k"], 20)


@query("pair_counts", f"SELECT event_type, count(*) AS n, count(*) FILTER (o IS NULL OR s IS NULL) AS missing FROM {_PAIRS} GROUP BY ALL")
def _(t, spark):
    return scores.pair_counts(_pairs(t), "o", "s", BY)


@query("independent_scores", f"""WITH c AS (SELECT count(*) FILTER (quality = 1)::DOUBLE AS po, count(*) FILTER (toxic = 1)::DOUBLE AS ps, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
    h AS (SELECT *, po * ps / n AS tp, (n - po) * ps / n AS fp, po * (n - ps) / n AS fn, (n - po) * (n - ps) / n AS tn FROM c)
    SELECT {r('(tp + tn) / n')} AS accuracy, {r('tp / po')} AS hitrate, {r('fp / (n - po)')} AS falsealarm, {r('tp / ps')} AS precision, {r('tp * tn / (fp * fn)')} AS oddsratio, {r('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM h""")  # fmt: skip
def _(t, spark):
    return scores.independent_scores(t("labels"), "quality", "toxic")


@query("runoff_ratio", f"SELECT event_id, {r('1 - 1 / (1 + (value / 50 + 0.01e0) ^ 2.5) ^ 0.4')} AS ratio FROM events")
def _(t, spark):
    return t("events").select("event_id", runoff_ratio(F.col("value") / 50 + 0.01).alias("ratio"))


@query("sessions", f"""WITH x AS (SELECT event_type, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
    SELECT event_type, CAST(min(ts) AS VARCHAR) AS start, {r('sum(value)')} AS sum, count(value) AS n FROM s GROUP BY event_type, k""")  # fmt: skip
def _(t, spark):
    return recursions.sessions(t("events"), "ts", "value", BY, "10 minutes").select("event_type", F.col("start").cast("timestamp_ntz").cast("string").alias("start"), "sum", "n")


@query("running_scores", f"SELECT event_type, count(*) AS n, {r('avg(s - o) / avg(o)')} AS bias, {r('1 - sum((s - o) ^ 2) / (var_pop(o) * count(*))')} AS nse FROM {_FULL} GROUP BY ALL")
def _(t, spark):
    return recursions.running_scores(_pairs(t), "o", "s", BY)


def _file(spark, name: str) -> str:
    """A new path below the shared folder, for writers on the driver: such a folder must be mounted there."""
    root = shared_root(spark)
    if not re.match(r"file:|/", root):
        raise ValueError(f"{root} is no mounted folder")
    folder = f"{re.sub('^file:/+', '/', root)}/rillflow/files-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return f"{folder}/{name}"


@query("csv_zip_round_trip", "SELECT n_nationkey::INTEGER AS n_nationkey, n_name, round(n_regionkey / 8e0, 5) AS part FROM nation")
def _(t, spark):
    path = _file(spark, "nation.csv")
    csvio.write_csv(t("nation").select("n_nationkey", "n_name", (F.col("n_regionkey") / 8).alias("part")), path, {"purpose": "round trip"}, __file__)
    return csvio.read_csv(spark, path[:-4] + ".zip", "n_nationkey int, n_name string, part double")[0]


@query("band_zip_round_trip", "SELECT range AS cell, CASE WHEN c_custkey IS NULL THEN -9e0 ELSE c_custkey / 2e0 END AS value FROM range(100) LEFT JOIN customer ON c_custkey = range")
def _(t, spark):
    path, grid = _file(spark, "g.bil"), Grid(10, 10, 2.0, 1.0, 1.0, nodata=-9.0)
    gridio.write_band(t("customer").where("c_custkey < 100").select(F.col("c_custkey").alias("cell"), (F.col("c_custkey") / 2).alias("value")), grid, path)
    with zipfile.ZipFile(path + ".zip", "w") as z:
        for end in (".hdr", ".bil"):
            z.write(path[:-4] + end, "g" + end)
    return gridio.read_zip(spark, path + ".zip", "g.hdr")[0]


# ---- tasks

@query("option_product", "SELECT row_number() OVER (ORDER BY r_name, k) - 1 AS taskid, r_name AS region, k::BIGINT AS k FROM region, (VALUES (1), (2), (3)) v(k)")
def _(t, spark):
    names = [x["r_name"] for x in t("region").select("r_name").orderBy("r_name").collect()]  # five regions
    return tasks.option_product(spark, region=names, k=[1, 2, 3])


@query("site_batches", "SELECT n_nationkey, (ntile(4) OVER (ORDER BY n_nationkey) - 1)::INTEGER AS batch FROM nation")
def _(t, spark):
    return tasks.batches(t("nation"), "n_nationkey", 4).select("n_nationkey", F.col("batch").cast("int").alias("batch"))

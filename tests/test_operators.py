"""Golden values and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import special, transforms
from rillflow.operators import ensemble, network, raster, resample, scores, stats
from rillflow.operators.raster import Grid
from rillflow.sources import csvio, gridio, tasks
from rillflow.sources.vector import Vector

FLOW = [0, 4, 4, 4, 0, 0, 0, 4, 4, 8, 0, 0, 0, 2, 4, 8, 0, 0, 0, 0, 2, 0, 0, 0, 0, 0, 0, 4, 0, 0, 0, 0, 0, 0, 0, 0]
G = Grid(6, 6)


@pytest.fixture(scope="module")
def edge(spark):
    return network.edges(spark.createDataFrame(list(enumerate(FLOW)), "cell long, value int"), G)


def test_downstream(edge):
    got = {r["cell"]: r["down"] for r in edge.collect() if r["down"] >= 0}
    assert got == {1: 7, 2: 8, 3: 9, 7: 13, 8: 14, 9: 14, 13: 20, 14: 20, 15: 20, 20: 27, 27: 33}


@pytest.mark.parametrize("outlet, inlets, want", [(27, [], {1, 2, 3, 7, 8, 9, 13, 14, 15, 20, 27}), (12, [], set()), (14, [], {2, 3, 8, 9, 14}), (27, [14], {1, 7, 13, 15, 20, 27}), (27, [14, 13], {15, 20, 27})])
def test_area(edge, outlet, inlets, want):
    assert {r["cell"] for r in network.area(edge, outlet, inlets).collect()} == want


def test_river_and_paths(edge):
    river = network.river(edge, 1, G).orderBy("step").collect()
    assert [r["cell"] for r in river] == [1, 7, 13, 20, 27, 33]
    assert [r["dx"] for r in river] == [0, 0, 0, -1, -1, 0] and [r["dy"] for r in river] == [0, -1, -1, -1, -1, -1]
    length = {r["start"]: r["length"] for r in network.path_lengths(edge, 27, G).collect()}
    s = math.sqrt(2)
    assert length == pytest.approx({20: s, 27: 0, 13: 2 * s, 14: 1 + s, 15: 2 * s, 7: 1 + 2 * s, 8: 2 + s, 9: 1 + 2 * s, 1: 2 + 2 * s, 2: 3 + s, 3: 2 + 2 * s})


def test_boundary_accumulation_intersect_voronoi(spark, edge):
    cells = network.area(edge, 27)
    assert [r["cell"] for r in network.boundary(cells, G).orderBy("seq").collect()] == [1, 2, 3, 9, 15, 20, 13, 7, 1]
    ones = spark.range(36).select(F.col("id").alias("cell"), F.lit(1.0).alias("value"))
    acc = {r["cell"]: r["value"] for r in network.accumulate(edge, ones).collect()}
    assert (acc[20], acc[27], acc[14], acc[1]) == (10, 11, 5, 1)
    got = {r["cell"]: r["weight"] for r in raster.intersect(cells, G, Grid(3, 3, 2.0, 1.0, 1.0)).collect()}
    assert got == {6: 0.25, 7: 0.25, 3: 1, 4: 0.5, 0: 0.5, 1: 0.25}
    v = [r["weight"] for r in raster.voronoi(cells, G, [(0, 0), (0, 5), (5, 0), (5, 5)]).orderBy("point").collect()]
    assert v == pytest.approx([1 / 11, 6 / 11, 1 / 11, 3 / 11])


def test_slope(spark, edge):
    z = spark.range(36).select(F.col("id").alias("cell"), (5 - F.floor(F.col("id") / 6)).cast("double").alias("value"))
    got = {r["cell"]: r["slope"] for r in raster.slope(edge.where("down >= 0"), z, G).collect()}
    assert got[1] == pytest.approx(1) and got[13] == pytest.approx(1 / math.sqrt(2))


def test_holes_are_filled(spark):
    ring = spark.createDataFrame([(c,) for c in (7, 8, 9, 13, 15, 19, 20, 21)], "cell long")
    assert {r["cell"] for r in network.filled(ring, G).collect()} == {7, 8, 9, 13, 14, 15, 19, 20, 21}


@pytest.mark.parametrize("name", [n for n in transforms.TRANSFORMS if n != "Softmax"])
def test_transform_round_trip_and_jacobian(spark, name):
    f = transforms.get_transform(name, nu=0.1, lam=0.4, unknown=1)
    x = spark.createDataFrame([(0.05 + 0.9 * k / 20,) for k in range(20)], "x double")
    d = 1e-6
    got = x.select("x", f.backward(f.forward(F.col("x"))).alias("back"), f.jacobian(F.col("x")).alias("j"), ((f.forward(F.col("x") + d) - f.forward(F.col("x") - d)) / (2 * d)).alias("num")).collect()
    for r in got:
        assert r["back"] == pytest.approx(r["x"], abs=1e-8) and r["j"] == pytest.approx(r["num"], rel=1e-4)
    with pytest.raises(ValueError):
        transforms.get_transform("none")


def test_quantile_and_probabilities(spark):
    z = spark.createDataFrame([(0.975,), (0.5,), (1e-9,), (0.0,)], "p double").select(special.norm_ppf("p").alias("z")).collect()
    assert [z[0][0], z[1][0], z[2][0]] == pytest.approx([1.959963984540054, 0, -5.997807015007686]) and z[3][0] is None
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.kolmogorov_pvalue(0.274, 10) == pytest.approx(1 - 0.6284796154565043, abs=1e-6)
    assert special.anderson_darling_cdf(10**6, 2.492) == pytest.approx(0.95, abs=1e-3)
    assert special.cramer_von_mises_pvalue(0.461, 10**6) == pytest.approx(0.05, abs=1e-3)
    assert stats.semicorr_theory(0.55) == pytest.approx(0.311, abs=0.01)


def test_ranks_of_weigel_and_mason(spark):
    df = spark.createDataFrame([("a", 0, [22.0, 23.0, 26.0, 27.0, 32.0]), ("a", 1, [28.0, 31.0, 33.0, 34.0, 36.0]), ("a", 2, [24.0, 25.0, 26.0, 27.0, 28.0])], "g string, k int, e array<double>")
    assert [r["rank"] for r in ensemble.ensemble_ranks(df, "e", ["g"], "k").orderBy("k").collect()] == [1, 3, 2]


def test_tornado_forecasts(spark):
    rows = [(0, 0, 2680), (0, 1, 72), (1, 0, 23), (1, 1, 28)]
    df = spark.createDataFrame([(o, s) for o, s, n in rows for _ in range(n)], "o int, s int")
    r = scores.binary_scores(df, "o", "s").first()
    assert [r["bias"], r["hitrate"], r["accuracy"], r["precision"], r["lor"]] == pytest.approx([1.96, 0.549, 0.966, 0.28, math.log(45.314)], abs=1e-3)


def test_regression_of_heights(spark):
    h = [1.47, 1.50, 1.52, 1.55, 1.57, 1.60, 1.63, 1.65, 1.68, 1.70, 1.73, 1.75, 1.78, 1.80, 1.83]
    w = [52.21, 53.12, 54.48, 55.84, 57.20, 58.57, 59.93, 61.29, 63.11, 64.47, 66.28, 68.10, 69.92, 72.19, 74.46]
    df = spark.createDataFrame([("x", a, a * a, b) for a, b in zip(h, w, strict=True)], "g string, h double, h2 double, w double")
    fit = {r["term"]: r for r in stats.lstsq(df, ["h", "h2"], "w", ["g"]).collect()}
    assert [fit[k]["estimate"] for k in ("intercept", "h", "h2")] == pytest.approx([128.8128, -143.1620, 61.9603], abs=1e-3)
    assert [fit[k]["stderr"] for k in ("intercept", "h", "h2")] == pytest.approx([16.3083, 19.8332, 6.0084], abs=1e-3)


def test_cubic_keeps_monthly_totals(spark):
    df = spark.sql("SELECT 'a' AS g, add_months(DATE'2000-01-01', cast(id AS int)) AS m, 10.0D + 5 * sin(id) AS v FROM range(24)")
    daily = resample.monthly_to_daily_cubic(df, "m", "v", ["g"])
    back = daily.groupBy(F.trunc("day", "month").alias("m")).agg(F.sum("v").alias("s")).join(df, "m").collect()
    assert len(back) == 24 and all(r["s"] == pytest.approx(r["v"]) for r in back)


def test_csv_and_band_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "a int, `b` double")
    csvio.write_csv(df, str(tmp_path / "x.csv"), {"purpose": "test"}, __file__)
    got, comments = csvio.read_csv(spark, str(tmp_path / "x.zip"), "a int, b double")
    assert sorted(map(tuple, got.collect())) == [(1, 2.5), (2, 3.5)] and comments["purpose"] == "test"
    csvio.write_csv(df, str(tmp_path / "y.csv"), "note", __file__, compress=False)
    got, _ = csvio.read_csv(spark, csvio.find_file(str(tmp_path / "y.gz")), "a int, b double")
    assert got.count() == 2
    cells = spark.range(36).select(F.col("id").alias("cell"), (F.col("id") * 1.5).alias("value"))
    gridio.write_band(cells, G, str(tmp_path / "g.bil"))
    head = gridio.parse_header((tmp_path / "g.hdr").read_text())
    assert head.same_geometry(G) and gridio.read_band(spark, str(tmp_path / "g.bil"), head).exceptAll(cells).isEmpty()


def test_tasks_and_vector(spark):
    t = tasks.option_product(spark, v1=["a", "b"], v2=[1, 2, 3])
    assert [tuple(r) for r in t.orderBy("taskid").limit(2).collect()] == [(0, "a", 1), (1, "a", 2)]
    assert [len(tasks.get_batch(26, 5, i)) for i in range(5)] == [6, 5, 5, 5, 5]
    v = Vector(["a"], [1.0], [0.0], [2.0])
    v["a"] = 5
    assert v["a"] == 2 and v.hit


def test_lhs_has_one_draw_in_each_slice(spark):
    x = np.sort([r["x0"] for r in stats.latin_hypercube(spark, 50, [0.0, 1.0], [1.0, 2.0]).collect()])
    assert (np.floor(x * 50) == np.arange(50)).all()


def test_streaming_baseflow_equals_batch(spark, tmp_path):
    from rillflow.operators import sequence
    from rillflow.streaming import recursions

    df = spark.sql("SELECT 'a' AS k, timestamp_seconds(id * 3600) AS ts, 5.0D + 4 * sin(id) AS q FROM range(40)")
    df.write.parquet(str(tmp_path / "in"))
    out = recursions.eckhardt_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts", "q")
    s = out.writeStream.format("memory").queryName("base").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    s.processAllAvailable()
    s.stop()
    want = {r["ts"]: r["baseflow"] for r in sequence.eckhardt(df, "q", ["k"], ["ts"]).collect()}
    got = {r["ts"]: r["baseflow"] for r in spark.table("base").collect()}
    assert got == pytest.approx(want)


def test_published_probabilities_of_thirty_values():
    """Statistics and p-values of an independent implementation, n = 30."""
    golden = [(0.09512549, 0.6124847, 0.54319535, 0.70179255), (0.12183129, 0.49047093, 0.64451175, 0.60556343), (0.14730099, 0.3996688, 0.84116088, 0.45123213), (0.56671332, 0.02637722, 3.86919947, 0.01026198), (0.12787233, 0.46688876, 0.81852694, 0.46677797)]
    for w, pw, a, pa_ in golden:
        assert special.cramer_von_mises_pvalue(w, 30) == pytest.approx(pw, abs=1e-6)
        assert 1 - special.anderson_darling_cdf(30, a) == pytest.approx(pa_, abs=1e-6)


def test_pvalues_of_far_and_large_samples(spark):
    stats_ = spark.createDataFrame([(600, 120.0, 700.0, 0.42), (3077, 1000.0, 5000.0, 0.45), (30_000, 5000.0, 1e5, 0.3), (30_000, 0.05, 0.3, 0.004)], "n int, cvm double, ad double, ks double")
    got = ensemble.uniformity_pvalues(stats_).orderBy("n", "ks").collect()
    assert [(round(r["cvm_p"], 6), round(r["ad_p"], 4), round(r["ks_p"], 6)) for r in (got[0], got[1], got[3])] == [(0, 0, 0)] * 3
    assert got[2]["ks_p"] == pytest.approx(0.7215, abs=1e-3) and got[2]["cvm_p"] > 0.8
    # the limit law's five per cent point, with the first correction for a finite n
    for n in (2_000, 50_000, 10**7):
        assert special.kolmogorov_pvalue(1.3580986 / n**0.5 - 1 / (6 * n), n) == pytest.approx(0.05, abs=2e-5)
    # the ways of evaluation agree where they meet
    for n, d in ((1_700, (3.99 / 1_700) ** 0.5 - 1e-9), (3_000, (2 / 3_000) ** 0.5), (20_000, (0.2 / 20_000) ** 0.5)):
        exact = special._kolmogorov_matrix(d, n)
        assert special._kolmogorov_series(d, n) == pytest.approx(exact, abs=5e-9)
        assert special.kolmogorov_pvalue(d, n) == pytest.approx(1 - exact, abs=5e-9)
    assert 2 * special._smirnov_upper(0.1, 400) == pytest.approx(1 - special._kolmogorov_matrix(0.1, 400), abs=1e-12)


def test_accumulation_of_a_large_grid(spark):
    """A million cells that drain south, 1000 steps long."""
    g = Grid(1000, 1000)
    cells = spark.range(1_000_000).select(F.col("id").alias("cell"), F.lit(4).alias("value"))
    edge, ones = network.edges(cells, g), cells.select("cell", F.lit(1.0).alias("value"))
    got = network.accumulate(edge, ones).where("cell % 1000 = 7").select("cell", "value").collect()
    assert len(got) == 999 and all(r["value"] == r["cell"] // 1000 + 1 for r in got)


def test_a_circle_is_refused(spark):
    edge = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0)], "cell long, down long")
    ones = edge.select("cell", F.lit(1.0).alias("value"))
    with pytest.raises(ValueError, match="circle"):
        network.accumulate(edge, ones)
    assert {r["cell"] for r in network.area(edge, 1).collect()} == {0, 1, 2, 3}


def test_cubic_of_a_missing_month(spark):
    df = spark.sql("SELECT 'a' AS g, add_months(DATE'2000-01-01', cast(id AS int)) AS m, CASE WHEN id <> 3 THEN 10.0D + id END AS v FROM range(12)")
    got = {str(r["m"])[:7]: r["s"] for r in resample.monthly_to_daily_cubic(df, "m", "v", ["g"]).groupBy(F.trunc("day", "month").alias("m")).agg(F.sum("v").alias("s")).collect()}
    assert len(got) == 12 and got["2000-04"] == pytest.approx(-1) and got["2000-12"] == pytest.approx(21)


def test_csv_keeps_rows_like_its_names(spark, tmp_path):
    import zipfile

    text = "# purpose : x\na,b\n1,2\na,b\n# no head\n3,4\n"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.csv", text)
    got, comments = csvio.read_csv(spark, str(tmp_path / "x.zip"))
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [("1", "2"), ("3", "4"), ("a", "b")] and comments == {"purpose": "x"}


def test_ranks_in_blocks_equal_those_of_one(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, rng.normal(i % 7, 2, 20).round(1).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, k int, e array<double>")
    want = []
    for i, (_, k, a) in enumerate(rows):
        rank = 1.0
        for j, (_, _, b) in enumerate(rows):
            if i != j:
                above = sum(1 if y < x - 1e-6 else 0.5 if y <= x + 1e-6 else 0 for x in a for y in b) / 400
                rank += 1 if above > 0.5 + 1e-12 else 0 if above < 0.5 - 1e-12 else 0.5
        want.append(rank)
    for block in (1000, 7):
        assert [r["rank"] for r in ensemble.ensemble_ranks(df, "e", ["g"], "k", block=block).orderBy("k").collect()] == want


def test_ranks_of_odd_members_equal_pairs_one_by_one(spark):
    """Members a tolerance apart, missing, NaN and infinite, in blocks enough for two tasks of each; groups of one."""
    rng = np.random.default_rng(3)
    odd = [None, float("nan"), float("inf")]
    rows = [("a", i, i % 5, [odd[rng.integers(3)] if rng.random() < 0.05 else float(rng.integers(0, 12)) / 1e6 for _ in range(rng.integers(1, 9))]) for i in range(60)]
    rows += [("a", 60, 1, []), ("a", 61, 2, None), ("b", 62, 3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "g string, k int, o int, e array<double>")
    big = lambda x: (x != x, x)  # noqa: E731  NaN above all numbers
    one = lambda x, y: 0 if x is None or y is None else 1 if big(y) < big(x - 1e-6) else 0.5 if y == y and y <= x + 1e-6 or x != x else 0
    want = {}
    for _, k, _, a in rows[:60]:
        above = [sum(one(x, y) for x in a for y in b) / (len(a) * len(b)) for _, j, _, b in rows[:60] if j != k]
        want[k] = 1 + sum(1 if u > 0.5 + 1e-12 else 0 if u < 0.5 - 1e-12 else 0.5 for u in above)
    for block in (1000, 2, 3):
        got = ensemble.ensemble_ranks(df, "e", ["g"], "k", block=block).where("g = 'a'").collect()
        assert {r["k"]: r["rank"] for r in got} == want
    assert [r["g"] for r in ensemble.dscore(df, "o", "e", ["g"], "k").collect()] == ["a"]


def test_alpha_warns_of_censored_cases(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(max(0, rng.normal())), [float(max(0, x)) for x in rng.normal(size=50)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, o double, e array<double>")
    r = ensemble.alpha(df, "o", "e", ["g"], "KS").first()
    assert r["many_sudo"] and 30 < r["sudo"] < 70 and 0 <= r["pvalue"] <= 1
    with pytest.raises(ValueError):
        ensemble.alpha(df, "o", "e", ["g"], "XX")


def test_restrictions_of_a_single_parameter_are_t_squared(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    df = spark.createDataFrame([("g", float(a), float(b), float(1 + 2 * a + rng.normal())) for a, b in x], "g string, a double, b double, y double")
    t = {r["term"]: r for r in stats.lstsq(df, ["a", "b"], "y", ["g"]).collect()}
    f = stats.restriction_test(df, ["a", "b"], "y", ["g"], [[0, 0, 1]]).first()
    assert f["f"] == pytest.approx(t["b"]["t"] ** 2) and f["p"] == pytest.approx(t["b"]["p"])


def _stream(spark, df, tmp_path, make, mode="append"):
    df.write.parquet(str(tmp_path / "in"))
    name = f"out_{mode}_{df.columns[-1]}"
    s = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    s.processAllAvailable()
    s.stop()
    return spark.table(name)


def test_streaming_residuals_and_scores_equal_batch(spark, tmp_path):
    from rillflow.streaming import recursions

    df = spark.sql("SELECT 'a' AS k, timestamp_seconds(id * 3600) AS ts, CASE WHEN id <> 7 THEN 5.0D + 4 * sin(id) END AS q FROM range(40)")
    got = {r["ts"]: r["residual"] for r in _stream(spark, df, tmp_path / "a", lambda x: recursions.ar_residual_stream(x, "k", "ts", "q", [0.5, 0.2], 5.0)).collect()}
    want = {r["ts"]: r["residual"] for r in stats.ar_residual(df, "q", [0.5, 0.2], ["k"], ["ts"], mean=5.0).collect()}
    assert got == pytest.approx(want)
    pair = df.select("k", F.col("q").alias("o"), (F.col("q") * 1.1).alias("s"))
    one = _stream(spark, pair, tmp_path / "b", lambda x: recursions.running_scores(x, "o", "s", ["k"]), "complete").first()
    assert one["n"] == 39 and one["bias"] == pytest.approx(0.1)


def test_streaming_windows_and_sessions(spark, tmp_path):
    """Sums by the hour, and a session that a gap of an hour ends; the last ones wait for the watermark."""
    from rillflow.streaming import recursions

    df = spark.sql("SELECT 'a' AS k, timestamp_seconds(id * 600 + CASE WHEN id > 11 THEN 7200 ELSE 0 END) AS ts, 1.0D AS v FROM range(60)")
    hours = _stream(spark, df, tmp_path / "a", lambda x: recursions.windowed(x, "ts", "v", ["k"]), "update").collect()
    assert sum(r["sum"] for r in hours) == 60 and max(r["n"] for r in hours) == 6
    table = recursions.sessions(df, "ts", "v", ["k"]).orderBy("start").collect()
    assert [r["n"] for r in table] == [12, 48]


def test_quantiles_of_large_and_tied_groups(spark):
    """The narrow intervals of large groups against NumPy, with ties, a null group and a group without values."""
    from rillflow.operators.quantiles import with_quantiles

    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=30_000), "b": rng.integers(0, 4, 30_000).astype(float), None: rng.exponential(size=50)}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("none", None)], "k string, v double")
    probs = [0.0, 0.013, 0.25, 0.5, 0.999, 1.0]
    for small in (50_000, 100):
        from rillflow.operators import quantiles as own

        got = {r["g"]["k"]: r["q"] for r in own.quantiles(df, "v", ["k"], probs, small).collect()}
        assert set(got) == {"a", "b", None}
        for k, x in data.items():
            assert got[k] == pytest.approx(np.quantile(x, probs).tolist(), abs=1e-12)
    assert with_quantiles(df.select("k").distinct(), df, "v", ["k"], probs).where("q is null").first()["k"] == "none"


def test_polygon_of_thousands_of_edges(spark):
    n = 4000
    ring = [(10 * math.cos(2 * math.pi * k / n), 10 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rng = np.random.default_rng(5)
    p = rng.uniform(-11, 11, (400, 2))
    got = raster.points_inside(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "i int, x double, y double"), "x", "y", ring).orderBy("i").collect()
    assert [r["inside"] for r in got] == [int(math.hypot(a, b) < 10) for a, b in p]


def test_peaks_are_sought_one_after_the_other(spark):
    """Against a plain search: the largest value left, the largest simulation near it, then the surroundings go."""
    rng = np.random.default_rng(6)
    o, s = rng.gamma(0.5, 4, 400), rng.gamma(0.5, 4, 400)
    df = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(o, s, strict=True))], "g string, i int, o double, s double")
    got = [(r["obs_pos"], r["sim_pos"], r["shift"]) for r in scores.absolute_peak_error(df, "o", "s", ["g"], ["i"], erase=20, before=3, after=4).orderBy("event").collect()]
    free, want = {i: v for i, v in enumerate(o)}, []
    left = len(free)
    while left > 20 and free:
        k = max(free, key=free.get)
        m = max(range(max(0, k - 3), min(400, k + 5)), key=s.__getitem__)
        want.append((k, m, abs(m - k)))
        free = {i: v for i, v in free.items() if abs(i - k) > 20}
        left -= 41
    assert got == want and len(got) > 5

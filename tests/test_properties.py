"""Identities, solver optimality, golden files, round trips."""

from datetime import date, datetime

import duckdb
import numpy as np
import pytest
from compare import differs
from pyspark.sql import functions as F

from zephyrine import errors
from zephyrine import queries as Q
from zephyrine.functions import features as X
from zephyrine.models import LinearModel, PythonModel, load_model, model_hash, save_model, train_model
from zephyrine.operators import events, joins, lags, metrics, prepare, scm, solvers
from zephyrine.plans import decompose, normalise, orchestrate
from zephyrine.queries import MODEL, daily
from zephyrine.schema import quantile_name, require_no_duplicates, require_no_missing, safe_name
from zephyrine.sources import persistence, report, stations, trajectory

TDUMP = """1
GDAS 20 10 1 0 0
1 BACKWARD OMEGA
20 10 1 0 51.52 -0.13 100.0
5 PRESSURE RAINFALL MIXDEPTH RELHUMID AIR_TEMP
1 1 20 10 1 0 0 0 0.0 51.520 -0.130 100.0 995.0 0.0 800.0 70.0 285.0
1 1 20 9 30 23 0 0 -1.0 51.300 -1.200 300.0 980.0 0.5 600.0 75.0 283.0
1 1 20 9 30 22 0 0 -2.0 51.000 -2.500 500.0 970.0 1.0 500.0 80.0 281.0
1 1 broken
"""


def test_names():
    cases = {"my-covariate": "my_covariate", "123var": "v_123var", "  ": "var", "hello!world": "hello_world", "multiple___underscores": "multiple_underscores", "date": "date"}
    assert {k: safe_name(k) for k in cases} == cases
    assert (quantile_name(0.05), quantile_name(1)) == ("q050", "q1000")
    with pytest.raises(errors.DataError):
        quantile_name(1.5)


def test_checks(spark):
    d = spark.createDataFrame([(1, 1.0), (1, float("nan"))], "a int, b double")
    with pytest.raises(errors.DataError):
        require_no_missing(d, "b")
    with pytest.raises(errors.DataError):
        require_no_duplicates(d, "a")
    with pytest.raises(errors.DataError):
        prepare.process_date(spark.createDataFrame([("hello",)], "x string"))


def test_simplex_solver_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.normal(size=(30, 6)), rng.normal(size=30)
        w = solvers.simplex_ls(y, x)
        g = x.T @ (x @ w - y)
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0
        assert (g @ w - g.min()) < 1e-5 * max(1, abs(g).max())  # no vertex is better
        assert abs(solvers.affine_ls(y, x).sum() - 1) < 1e-6


def test_ridge_loo_matches_refits():
    rng = np.random.default_rng(2)
    f, y = rng.normal(size=(12, 5)), rng.normal(size=(12, 2))
    f = (f - f.mean(axis=0)) / f.std(axis=0)
    lam = np.array([0.3])
    y0, coef, _ = solvers.ridge_loo(f, y, lam)
    direct = np.linalg.solve(f.T @ f + 12 * 0.3 * np.eye(5), f.T @ (y - y.mean(axis=0)))
    assert np.allclose(coef, direct) and np.allclose(y0, y.mean(axis=0))


def test_estimators_recover_a_mix(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(20):
        d = {"D1": np.sin(i) + 10, "D2": np.cos(i) + 5, "D3": rng.uniform() + 2}
        d["T"] = 0.6 * d["D1"] + 0.4 * d["D2"] + 0.05 * rng.normal()
        rows += [(date(2026, 1, i + 1), u, float(v)) for u, v in d.items()]
    p = spark.createDataFrame(rows, "date date, unit string, outcome double")
    t = scm.tasks_table(spark, [("T", "T", "2026-01-15", ["D1", "D2", "D3"])])
    for m in ("robust", "abadie"):
        w = {r.donor: r.weight for r in scm.weights(scm.run_tasks(p, t, m)).collect()}
        assert abs(w["D1"] - 0.6) < 0.08 and abs(w["D2"] - 0.4) < 0.08
    w = [r.weight for r in scm.weights(scm.run_tasks(p, t, "scm")).collect()]
    assert abs(sum(w) - 1) < 1e-6 and min(w) >= 0
    bad = scm.run_tasks(p, scm.tasks_table(spark, [("x", "none", "2026-01-15", ["D1"])]), "scm").collect()
    assert [r.kind for r in bad] == ["error"]
    with pytest.raises(errors.ConfigError):
        scm.run_tasks(p, t, "nope")


def test_decompositions_telescope(spark, sf):
    d = daily(spark, sf)
    e = decompose.decompose_emission(d, MODEL, n_samples=10)
    gap = F.abs(F.col("emi_total") - F.col("emi_base") - F.col("emi_noise") - F.col("date_unix") - F.col("weekday"))
    assert e.agg(F.max(gap)).first()[0] < 1e-9
    m = decompose.decompose_meteorology(d, MODEL, n_samples=10)
    gap = F.abs(F.col("observed") - F.col("emi_total") - F.col("met_base") - F.col("discount") - F.col("quantity") - F.col("met_noise"))
    assert m.agg(F.max(gap)).first()[0] < 1e-9


def test_auto_stop_with_a_mock(spark):
    d = spark.createDataFrame([(datetime(2026, 1, 1, i), 0.5 * i) for i in range(24)], "date timestamp, value double")
    mock = lambda n, s: d.select("date", F.col("value").alias("observed"), (F.col("value") + 1.23).alias("normalised"))
    r = normalise.normalise_auto(d, None, normaliser=mock)
    assert r.best_n == 400 and r.converged
    assert r.result.agg(F.max(F.abs(F.col("normalised") - F.col("observed") - 1.23))).first()[0] < 1e-9


def test_split_blocks_are_contiguous(spark):
    d = spark.range(365).select(F.timestamp_seconds(F.col("id") * 86400 + 1767225600).alias("date"))
    for method in ("month_ts", "season_ts"):
        starts = set()
        for seed in range(4):
            x = prepare.split_sets(d, method, 0.6, seed).orderBy("date").collect()
            runs = sum(a["set"] != b["set"] and b["set"] == "testing" for a, b in zip(x, x[1:], strict=False))
            assert runs <= 13
            starts.add(tuple(r["set"] for r in x))
        assert len(starts) > 1
    n = prepare.split_sets(d, "random", 0.8).where("set = 'training'").count()
    assert n == 292


def test_lag_truth(spark):
    rng = np.random.default_rng(4)
    ws, x = [], 0.0
    for t in range(600):
        x = 0.6 * x + rng.normal()
        ws.append(x + 2 * np.sin(2 * np.pi * t / 24))
    rows = [(datetime.fromtimestamp(1767225600 + 3600 * t), float(ws[t]), float(0.8 * ws[t - 6] + 0.3 * rng.normal()) if t >= 6 else None) for t in range(600)]
    d = spark.createDataFrame(rows, "date timestamp, ws double, pm double")
    r = lags.analyze_lag(d, "pm", "ws", 12)
    assert r.peak_lag == 6 and abs(r.acf.where("lag = 0").first().acf - 1) < 1e-12 and "peak lag: 6" in r.summary()


def test_p_values():
    assert abs(metrics.correlation_p(0.5, 20) - 0.02475) < 1e-4
    assert metrics.p_stars(0.04) == "*" and metrics.p_stars(None) is None


def test_anomalies_rank_spikes_first(spark):
    rows = [(datetime.fromtimestamp(1767225600 + 3600 * t), float(np.sin(2 * np.pi * t / 24) + (9.0 if t == 100 else 0))) for t in range(240)]
    d = spark.createDataFrame(rows, "date timestamp, value double")
    for kw in ({"method": "iqr"}, {"method": "stl_residual"}, {"method": "isolation", "trees": 30}):
        top = events.anomaly_scores(d, "value", **kw).orderBy(F.desc("score")).first()
        after = (top.date - rows[100][0]).total_seconds() / 3600
        assert 0 <= after <= (12 if kw["method"] == "isolation" else 0), kw  # lags of the spike stand out too
    assert events.detect_cutoff(d, "value") == rows[100][0]


def test_trajectory_golden(spark, tmp_path):
    (tmp_path / "tdump_a").write_text(TDUMP)
    x = trajectory.build_trajectory_features(spark, f"{tmp_path}/tdump_*", {"southwest": (-6.0, 50.0, -2.0, 51.2)}).collect()
    assert len(x) == 1
    r = x[0]
    assert r.date == datetime(2020, 10, 1) and abs(r.traj_blh_mean - 633.333) < 0.01 and r.traj_rainfall_sum == 1.5
    assert r.traj_height_min == 100 and r.traj_rh_mean == 75 and abs(r.traj_pressure_mean - 981.667) < 0.01 and r.traj_temp_mean == 283
    assert r.traj_dist_km > 100 and 200 < r.traj_inflow_deg < 290 and r.traj_pathlen_km >= r.traj_dist_km and abs(r.traj_resid_southwest - 1 / 3) < 1e-9


def test_gdas_names():
    assert [trajectory.gdas1_filenames(date(2020, 5, d), date(2020, 5, d))[0][-1] for d in (1, 7, 8, 28, 29, 31)] == list("112455")
    assert trajectory.gdas1_filenames(date(2020, 5, 1), date(2020, 4, 30)) == ["gdas1.apr20.w5", "gdas1.may20.w1"]
    assert trajectory.met_files_for(["gdas1.apr20.w5", "gdas1.may20.w1"], datetime(2020, 5, 2), datetime(2020, 5, 3)) == ["gdas1.may20.w1"]
    assert trajectory.control_text(datetime(2020, 5, 1), 51.5, -0.1, 100, -72, [("/m", "f")], "/o", "t").splitlines()[0] == "20 05 01 00"


def test_sites_and_codes():
    assert stations.coerce_sites({"a": (1, 2)}) == [("a", 1.0, 2.0)] == stations.coerce_sites([{"site": "a", "lat": 1, "lon": 2}])
    with pytest.raises(errors.DataError):
        stations.coerce_sites([{"site": "a"}])
    assert stations.resolve_code("no2", stations.EEA_POLLUTANTS) == 8 == stations.resolve_code(8, {})
    with pytest.raises(errors.ConfigError):
        stations.resolve_code("nope", stations.EEA_POLLUTANTS)


def test_json_answers(spark):
    a = spark.createDataFrame([('{"site":"s","station_id":"1","pollutant":"NO2","unit":"u","lat":1,"lon":2,"values":[{"timestamp":0,"value":3.5}]}',)], "body string")
    assert stations.parse_series(a).first().value == 3.5
    o = spark.createDataFrame([('{"site":"s","latitude":1,"longitude":2,"hourly":{"time":["2020-01-01T00:00"],"temperature_2m":[1.0]}}',)], "body string")
    r = stations.parse_openmeteo(o, ["temperature_2m"]).first()
    assert abs(r.t2m - 274.15) < 1e-9 and r.date == datetime(2020, 1, 1)


def test_models_round_trip(spark, tmp_path):
    d = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("value"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"))
    m = train_model(d, "value", ["x", "kind"])
    assert abs(m.slopes["x"] - 2) < 1e-9 and abs(m.intercept - 1) < 1e-6
    save_model(m, str(tmp_path))
    assert model_hash(load_model(str(tmp_path))) == model_hash(m)
    assert PythonModel(type("P", (), {"predict": lambda self, x: x[:, 0] * 2})(), ["x"]).transform(d).where("prediction <> 2 * x").count() == 0
    assert LinearModel(1.0, {"x": 2.0}).transform(d).where("prediction <> value").count() == 0


def test_cache_and_runs(spark, sf, tmp_path):
    c = persistence.Cache(spark, f"file://{tmp_path}")
    d = daily(spark, sf).select("date", "value")
    assert c.load("none") is None and c.save("k", d).count() == c.load("k").count()
    assert persistence.data_hash(d) == persistence.data_hash(d.orderBy(F.desc("date"))) != persistence.data_hash(d.limit(5))
    run = persistence.make_run(d, "single", {"a": 1}, df=d, model=MODEL)
    persistence.save_run(run, f"{tmp_path}/run")
    back = persistence.load_run(spark, f"{tmp_path}/run")
    assert back.result.count() == d.count() and back.metadata["config_hash"] == run.metadata["config_hash"]
    assert "<table>" in report.generate_html(run) and report.to_markdown(run).startswith("# Run")


def test_ensemble_and_workflows(spark, sf):
    d = daily(spark, sf)
    u = orchestrate.run_workflow(d, "unc", orchestrate.UncConfig("value", ["quantity", "discount"], n_samples=5, n_models=2))
    assert {"date", "observed", "mean", "weighted", "lower_bound"} <= set(u["result"].columns) and abs(u["mod_stats"].where("set = 'testing'").agg(F.sum("weight")).first()[0] - 1) < 1e-9
    with pytest.raises(errors.ConfigError):
        orchestrate.run_workflow(d, "nope", None)


def test_asof_ties_and_missing_groups(spark):
    ts = lambda h: datetime(2020, 1, 1, h)
    a = spark.createDataFrame([("x", ts(2)), ("x", ts(9)), ("y", ts(1))], "s string, date timestamp")
    b = spark.createDataFrame([("x", ts(1), 1), ("x", ts(3), 3), ("x", ts(8), 8)], "s string, date timestamp, v int")
    assert sorted((r.s, r.date.hour, r.v or 0) for r in joins.asof_nearest(a, b, "date", "s").collect()) == [("x", 2, 1), ("x", 9, 8), ("y", 1, 0)]


def test_streaming_sessions(spark, tmp_path):
    from zephyrine.streaming import live

    rows = [(datetime(2020, 1, 1, h), 5.0 if h in (1, 2, 9) else 0.0) for h in range(12)] + [(datetime(2020, 2, 1), 0.0), (datetime(2020, 3, 1), 9.0)]
    spark.createDataFrame(rows, "date timestamp, score double").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("date timestamp, score double").parquet(f"{tmp_path}/in")
    q = live.event_sessions(s, "score", 1.0, "2 hours").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


def test_wind_and_geometry(spark):
    r = spark.range(1).select(X.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("d"), X.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"), X.in_polygon(F.lit(0.5), F.lit(0.5), [(0, 0), (1, 0), (1, 1), (0, 1)]).alias("p")).first()
    assert abs(r.d - 10007.54) < 0.01 and abs(r.b - 90) < 1e-9 and r.p


def test_regions_with_parts_and_holes(spark, tmp_path):
    import json

    from zephyrine.sources import trajectory

    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shapes = {"one": ("Polygon", [square(0, 1)]), "hole": ("Polygon", [square(0, 9), square(4, 6)]), "parts": ("MultiPolygon", [[square(0, 1)], [square(5, 9), square(6, 7)]])}
    (tmp_path / "r.json").write_text(json.dumps({"features": [{"properties": {"name": n}, "geometry": {"type": k, "coordinates": c}} for n, (k, c) in shapes.items()]}))
    regions = trajectory.load_regions(spark, str(tmp_path / "r.json"))
    inside = lambda n, x: spark.range(1).select(X.in_region(F.lit(x), F.lit(x + 0.01), regions[n]).alias("p")).first().p
    assert [inside("one", 0.5), inside("one", 2.0)] == [True, False]
    assert [inside("hole", 1.0), inside("hole", 5.0)] == [True, False]
    assert [inside("parts", x) for x in (0.5, 3.0, 5.5, 6.5, 8.0)] == [True, False, True, False, True]


def test_fetch_of_weekly_archives(tmp_path):
    from datetime import date

    from zephyrine.errors import DataError
    from zephyrine.sources import trajectory

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "gdas1.jan20.w1").write_bytes(b"x" * 10)
    base, out = f"file://{tmp_path}/src", str(tmp_path / "out")
    assert trajectory.fetch_gdas1(date(2020, 1, 1), date(2020, 1, 3), out, base) == [f"{out}/gdas1.jan20.w1"]
    (tmp_path / "src" / "gdas1.jan20.w1").unlink()
    assert trajectory.fetch_gdas1(date(2020, 1, 1), date(2020, 1, 9), out, base, "warn") == [f"{out}/gdas1.jan20.w1"]  # kept; the second week is left out
    with pytest.raises(DataError):
        trajectory.fetch_gdas1(date(2020, 1, 9), date(2020, 1, 9), out, base)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["gdas1.jan20.w1"]


def test_covariates_before_the_cutoff_enter_the_fit(spark):
    import numpy as np

    from zephyrine.operators import panel, scm
    from zephyrine.operators.solvers import fit_scm

    rng = np.random.default_rng(3)
    days = [datetime(2020, 1, 1 + i).date() for i in range(20)]
    y = rng.normal(size=(5, 20)).cumsum(axis=1)
    rows = [(d, f"u{k}", float(y[k, i]), float(k * k)) for k in range(5) for i, d in enumerate(days)]
    src = spark.createDataFrame(rows, "date date, unit string, outcome double, height double")
    cov = panel.pre_period_means(src, "unit", ["height"], "2020-01-15")
    fits = scm.run_tasks(src.select("date", "unit", "outcome"), scm.tasks_table(spark, [("t", "u0", "2020-01-15", ["u1", "u2", "u3", "u4"])]), pre_covariates=cov)
    got = {r.donor: r.weight for r in scm.weights(fits).collect()}
    want = fit_scm(y[0], y[1:].T, np.arange(20) < 14, covariates=np.array([[0.0], [1.0], [4.0], [9.0], [16.0]]))["weights"]
    plain = fit_scm(y[0], y[1:].T, np.arange(20) < 14)["weights"]
    assert np.allclose([got[f"u{k}"] for k in range(1, 5)], want) and not np.allclose(want, plain)


def test_panel_meets_tasks_by_equality(spark):
    from zephyrine.operators import panel, scm

    p = spark.createDataFrame([("2020-01-01", "a", 1.0), ("2020-01-01", "b", 2.0)], "date string, unit string, outcome double").withColumn("date", F.to_date("date"))
    tasks = scm.tasks_table(spark, [("t", "a", "2020-01-02", ["b"])])
    for df in (panel.did_effects(p, tasks), scm.run_tasks(p, tasks)):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_absent_donors_do_not_count():
    w = np.array([0.25, 0.75])
    x = np.array([[1.0, 2.0], [np.nan, 4.0], [3.0, np.nan], [np.nan, np.nan]])
    assert np.allclose(solvers.blend(x, w), [1.75, 4.0, 3.0, np.nan], equal_nan=True)
    rng = np.random.default_rng(1)
    donors = rng.normal(10, 1, (30, 3))
    y = donors @ np.array([0.5, 0.5, 0.0])
    donors[25, 0] = np.nan
    got = solvers.fit_abadie(y, donors, np.arange(30) < 20)["synthetic"]
    assert abs(got[25] - donors[25, 1]) < 0.1 and np.allclose(got[26:], y[26:], atol=1e-3)


def half_hours(spark, path):
    """Events at and just past the half of six hours, one after the last slot."""
    rows = [(1, 7, "2024-01-01 03:00:00.4"), (2, 7, "2024-01-01 03:00:00"), (3, 7, "2024-01-01 09:00:00"), (4, 7, "2024-01-01 08:59:59.999999"), (5, 7, "2024-01-01 06:10:00"), (6, 7, "2024-01-01 12:00:00.5"), (7, 7, "2024-01-01 00:00:00"), (8, 8, "2024-01-02 03:00:00.000001"), (9, 8, None)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "if(event_id % 2 = 0, 'error', 'click') as event_type", "event_id / 4 as value", "'{}' as props")
    e.coalesce(1).write.parquet(f"{path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    return c


def test_rounded_time_keeps_fractions(spark, tmp_path):
    times = spark.createDataFrame([("2024-01-01 03:00:00",), ("2024-01-01 03:00:00.000001",), ("2024-01-01 09:00:00",), ("2024-01-01 08:59:59.999999",), ("1969-12-31 21:00:00",), ("1969-12-31 20:59:59.9",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = [r[0] for r in times.select(F.date_format(joins.rounded_time(F.col("t"), 21600), "dd HH:mm:ss.SSSSSS")).collect()]
    assert got == [f"{x}:00:00.000000" if x else None for x in ("01 00", "01 06", "01 12", "01 06", "01 00", "31 18", None)]
    c = half_hours(spark, tmp_path)
    assert differs(Q.queries()["rounded_time_join"](spark, str(tmp_path)), c, Q.oracle_sql()["rounded_time_join"]) is None


def test_rounded_time_meet_keeps_fractions(spark, tmp_path):
    c = half_hours(spark, tmp_path)
    assert differs(Q.queries()["rounded_time_meet"](spark, str(tmp_path)), c, Q.oracle_sql()["rounded_time_meet"]) is None


def test_rounded_time_join_joins(spark, tmp_path):
    c = half_hours(spark, tmp_path)
    x = Q.queries()["rounded_time_join"](spark, str(tmp_path))
    assert differs(x, c, Q.oracle_sql()["rounded_time_join"]) is None
    # Six hours of user 7 that begin at 00, 06 and 12; the slot of event 8 lies after its user's only six hours.
    assert sorted((r.event_id, r.slot[8:], r.n, r.value) for r in x.collect()) == [(1, "01 06", 3, 1.0), (2, "01 00", 3, 0.833333), (3, "01 12", 1, 1.5), (4, "01 06", 3, 1.0), (5, "01 06", 3, 1.0), (6, "01 12", 1, 1.5), (7, "01 00", 3, 0.833333)]


def most_rows(df):
    """The most rows that a node of the run plan made."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        m = p.metrics().get("numOutputRows")
        kids = p.children()
        return max([m.get().value() if m.isDefined() else 0, *(walk(kids.apply(i)) for i in range(kids.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_equal_places_meet_once(spark):
    at = lambda i: ((i % 3 / 100.0).alias("lat"), (i % 2 / 100.0).alias("lon"))
    i = F.col("id")
    left = spark.range(2000).select(i, F.lit("unknown").alias("name"), *at(i))
    right = spark.range(1000, 3000).select(i.alias("code"), F.concat(F.lit("n"), i).alias("name"), *at(i))
    x = joins.match_or_nearest(left, right, "name")
    assert most_rows(x) <= 2000
    first = {(c % 3, c % 2): c for c in range(1005, 999, -1)}
    assert {r.id: r.code for r in x.collect()} == {n: first[n % 3, n % 2] for n in range(2000)}


def test_nearest_place_in_dense_cells(spark):
    rng = np.random.default_rng(3)
    # Many spots in few cells, on a fine grid (so with ties), some just below zero; a cluster far from its probes.
    s = np.unique(np.vstack([rng.integers(-300, 300, (3000, 2)) / 1e4, rng.integers(0, 40, (400, 2)) / 1e5 + [0.215, 0.2]]), axis=0)
    p = np.unique(np.vstack([rng.integers(-400, 400, (300, 2)) / 1e4, rng.integers(0, 40, (200, 2)) / 1e5 + 0.2, [[5.0, 5.0]]]), axis=0)
    code = rng.permutation(len(s))
    d = np.sqrt(((p[:, None] - s[None]) ** 2).sum(2))
    pick = [min((round(d[i, j], 9), int(code[j])) for j in np.flatnonzero(d[i] < 0.02))[1] if (d[i] < 0.02).any() else None for i in range(len(p))]
    spots = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(s, code, strict=True)], "x double, y double, c long")
    probes = spark.createDataFrame([(float(a), float(b)) for a, b in p], "la double, lo double")
    for fill in (5, 64, 10**6):
        got = {(r.la, r.lo): r.c for r in joins.nearest_place(probes, spots, 0.02, fill).collect()}
        assert got == {(a, b): c for (a, b), c in zip(p.tolist(), pick, strict=True) if c is not None}
    assert most_rows(joins.nearest_place(probes, spots, 0.02, 5)) < 60 * len(p) < (d < 0.02).sum()


def test_match_or_nearest_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, " Foo ", None, None), (2, "x", 1.03, 0.0), (3, "x", float("nan"), 0.0), (4, "x", float("inf"), 0.0), (5, None, 7.0, 7.0), (6, "x", 9.0, 9.0), (2, "x", 1.03, 0.0)], "id long, name string, lat double, lon double").withColumn("la", F.lit(-1))
    right = spark.createDataFrame([("f2", "foo", 5.0, 5.0), ("f1", "FOO", 6.0, 6.0), ("a", "p", 1.02, 0.0), ("b", "q", 1.04, 0.0), ("c", "r", 7.0, 7.01), ("d", "s", float("nan"), 0.0), ("e", "t", None, 0.0)], "code string, name string, lat double, lon double")
    x = joins.match_or_nearest(left, right, "name")
    assert x.columns == ["id", "name", "lat", "lon", "la", "code"] and x.where("la <> -1").isEmpty()
    assert sorted((r.id, r.code or "") for r in x.collect()) == [(1, "f1"), (2, "a"), (2, "a"), (3, ""), (4, ""), (5, "c"), (6, "")]

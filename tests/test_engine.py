"""Closed forms, brute force and properties on small made series."""

import json
import math

import numpy as np
import pytest
from orrery.functions import timefn, values
from orrery.operators import cluster, cycles, events, health, hybrid, joins, linear, monitor, networks, quality, stats, zones
from orrery.plans import cli, engine
from orrery.sources import archive, registry, telemetry
from orrery.streaming import monitor as stream
from pyspark.sql import functions as F

START = 1704067200.0


@pytest.fixture(scope="module")
def sine(spark):
    rng = np.random.default_rng(1)
    t = np.arange(0, 4 * 86400, 600.0)
    v = 2 + 3 * np.sin(2 * math.pi * t / 86400) + rng.normal(0, 0.01, len(t))
    return spark.createDataFrame([("s", START + float(a), float(b)) for a, b in zip(t, v)], telemetry.SCHEMA).cache()


def series(spark, values_, step=60.0, name="a"):
    return spark.createDataFrame([(name, START + i * step, float(v)) for i, v in enumerate(values_)], telemetry.SCHEMA)


def test_fourier_fit_recovers_the_sine(spark, sine):
    basis = values.fourier((F.col("time") - START) / 3600, 2, 86400.0)
    p = linear.gram_fit(sine, ["mnemonic"], basis).first().params
    assert p[0] == pytest.approx(2, abs=0.01) and p[1] == pytest.approx(3, abs=0.01) and p[2] == pytest.approx(0, abs=0.01)


def test_phase_is_periodic(spark, sine):
    a = sine.select(cycles.phase(F.col("time"), START, 86400.0).alias("p")).collect()
    b = sine.select(cycles.phase(F.col("time") + 5 * 86400, START, 86400.0).alias("p")).collect()
    assert all(abs(x.p - y.p) < 1e-6 for x, y in zip(a, b))


def test_wide_fit_equals_lstsq(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5))
    x[:, 4] = x[:, 0] + x[:, 1]
    y = 1 + x @ np.array([2, -3, 0.5, 0, 0]) + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([("k", [1.0, *map(float, r)], float(v)) for r, v in zip(x, y)], "k string, x array<double>, value double")
    p = np.array(linear.gram_fit(df, ["k"], F.col("x")).first().params)
    a = np.column_stack([np.ones(200), x])
    assert np.allclose(a @ p, a @ np.linalg.lstsq(a, y, rcond=None)[0], atol=1e-6)


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(50, 5))
    y = 5 + 2 * x[:, 0] + 0.1 * rng.normal(size=50)
    df = spark.createDataFrame([("k", [float(v) for v in r], float(v)) for r, v in zip(x, y)], "k string, x array<double>, value double")
    p = linear.gram_fit(df, ["k"], F.col("x"), ridge=0.1, intercept=True).first().params
    z = (x - x.mean(0)) / x.std(0)
    c = np.linalg.solve(z.T @ z + 0.1 * np.eye(5), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(p[1:], c, atol=1e-8) and p[0] == pytest.approx(y.mean() - x.mean(0) @ c)


def test_robust_line_is_stationary(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, 200)
    y = 1 + 2 * x + rng.normal(0, 0.1, 200)
    y[:10] += 100
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "mnemonic string, x double, value double")
    p = linear.robust_line(df, ["mnemonic"], "x").first()
    r = p.p0 + p.p1 * x - y
    g = r / np.sqrt(1 + r * r)
    assert abs(g.sum()) < 1e-3 and abs((g * x).sum()) < 1e-2 and p.p1 == pytest.approx(2, abs=0.05)


def test_zones_by_hand(spark):
    z = zones.from_flag(series(spark, [0, 1, 1, 0, 0, 1, 1]), before=10, after=5).orderBy("start").collect()
    assert [(r.start - START, r.end - START) for r in z] == [(50, 185), (290, 365)]


def test_coalesce_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    spans = [(float(a), float(a + b)) for a, b in zip(rng.integers(0, 1000, 80), rng.integers(1, 30, 80))]
    got = sorted((r.start, r.end) for r in zones.coalesce_overlaps(spark.createDataFrame([("z", *s) for s in spans], "zone_id string, start double, end double")).collect())
    want: list[list[float]] = []
    for s, e in sorted(spans):
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert got == [tuple(x) for x in want]


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    p = spark.createDataFrame([("a", float(t)) for t in rng.uniform(0, 5e5, 200)], "mnemonic string, time double")
    z = spark.createDataFrame([(float(s), float(s + 40000)) for s in rng.uniform(0, 5e5, 15)], "start double, end double")
    got = joins.range_join(p, z, bucket=10000.0).count()
    spans = [(r.start, r.end) for r in z.collect()]
    assert got == sum(s <= r.time < e for r in p.collect() for s, e in spans)


def test_flat_series_gives_no_outlier(spark):
    flat = series(spark, [5.0] * 20).withColumn("trend", F.lit(5.0)).withColumn("sigma", F.lit(0.0))
    assert monitor.outliers(flat, 3.0).count() == 0
    c = stats.coefficients(stats.segment_stats(series(spark, [5.0] * 20).withColumn("cycle", F.lit(0)), ["mnemonic", "cycle"])).first()
    assert (c.offset, c.scale) == (5.0, 0.0)


def test_event_value_is_the_trapezoid(spark):
    o = spark.createDataFrame([("a", "default", START + t, d) for t, d in ((0.0, 1.0), (10.0, -3.0), (20.0, 1.0), (500.0, 2.0))], "mnemonic string, state string, time double, diff double")
    got = events.from_outliers(o, 60.0).orderBy("event_start").collect()
    assert [(e.event_value, e.event_end - e.event_start) for e in got] == [(40.0, 20.0), (0.0, 0.0)]


def test_coalesced_events(spark):
    e = spark.createDataFrame([("a", "d", 0.0, 10.0, 5.0), ("a", "d", 12.0, 20.0, 7.0), ("a", "d", 22.0, 25.0, 0.1), ("a", "d", 500.0, 510.0, 0.2), ("a", "d", 900.0, 910.0, 3.0)], "name string, event_state string, event_start double, event_end double, event_value double")
    got = events.coalesced(e, 5.0, 1.0).orderBy("event_start").collect()
    assert [(r.event_start, r.event_end, r.event_value) for r in got] == [(0.0, 20.0, 12.0), (900.0, 910.0, 3.0)]


def test_duplicates_nan_and_inf(spark):
    rows = spark.createDataFrame([("a", 2.0, 1.0), ("a", 1.0, float("nan")), ("a", 2.0, 1.0), ("a", 3.0, float("inf")), ("a", 0.0, 4.0), ("a", 5.0, None)], telemetry.SCHEMA)
    assert [(r.time, r.value) for r in quality.sort_unique(quality.finite(rows)).orderBy("time").collect()] == [(0.0, 4.0), (2.0, 1.0)]


def test_downsampling_keeps_ends_and_spikes():
    t = np.arange(1000.0)
    v = np.zeros(1000)
    v[500] = 100
    at = quality.largest_triangles(t, v, 50)
    assert len(at) == 50 and at[0] == 0 and at[-1] == 999 and 500 in at and (np.diff(at) > 0).all()


def test_time_formats(spark):
    s = spark.createDataFrame([("2024/060/12:30:15.250",), ("2024",), ("2024/002",), ("2024-1",)], "s string")
    got = [r.t for r in s.select(timefn.parse_long(F.col("s")).alias("t")).collect()]
    assert got == [1709209815.25, 1704067200.0, 1704153600.0, None]
    back = s.limit(1).select(timefn.format_long(timefn.parse_long(F.col("s"))).alias("b")).first().b
    assert back == "2024/060/12:30:15.250"


def test_network_fits_a_sine(spark, sine):
    t = quality.downsample(sine, 200).withColumns({"phase": cycles.phase(F.col("time"), START, 86400.0, scale=86400.0) * 2 - 1, "value": (F.col("value") - 2) / 4})
    fit = networks.fit_network(t, ["mnemonic"], inputs=["phase"], seeds=3, rounds=300, alpha=1e-4).first()
    out = networks.forward(np.array(fit.params), networks.shapes(1, [6, 4]), np.array([[r.phase] for r in t.collect()]))
    assert np.sqrt(np.mean((out - [r.value for r in t.collect()]) ** 2)) < 0.1


def test_network_gradient():
    rng = np.random.default_rng(7)
    sizes = networks.shapes(2, [3, 2])
    x, y = rng.normal(size=(10, 2)), rng.normal(size=10)
    w = networks.start_weights(sizes, 1)
    _, g = networks.loss(w, sizes, x, y, 0.1)
    for i in (0, 5, len(w) - 1):
        d = np.zeros_like(w)
        d[i] = 1e-6
        assert g[i] == pytest.approx((networks.loss(w + d, sizes, x, y, 0.1)[0] - networks.loss(w - d, sizes, x, y, 0.1)[0]) / 2e-6, abs=1e-6)


def test_liquid_network_learns():
    x = np.sin(np.linspace(0, 6, 60))
    net = networks.LiquidNetwork(6)
    before = np.mean((net.run(x)[0] - (0.5 + 0.3 * x)) ** 2)
    assert net.train(x, 0.5 + 0.3 * x, 60, rate=0.5) < before


def test_no_zone_split_is_the_plain_model(spark, sine):
    none = spark.createDataFrame([], "state string, start double, end double")
    m = hybrid.fit(hybrid.split(sine, none)).first()
    assert m.state == "default" and m.mu == pytest.approx(linear.constant_fit(sine, ["mnemonic"]).first().mu)


def test_two_state_model(spark, sine):
    z = spark.createDataFrame([("hot", START, START + 7200.0)], "state string, start double, end double")
    m = {r.state: r.n for r in hybrid.fit(hybrid.split(sine, z)).collect()}
    assert m["hot"] == 12 and m["default"] == sine.count() - 12
    before = spark.createDataFrame([("s", "hot", 1.0, 0.5), ("s", "hot", 2.0, 0.25)], "mnemonic string, state string, ref_time double, sigma double")
    got = {r.state: r for r in hybrid.matched(hybrid.fit(hybrid.split(sine, z)), before).collect()}
    assert got["hot"].tpc == pytest.approx(got["hot"].sigma / 0.25) and got["default"].tpc == 0


def test_dbscan_equals_brute_force(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(8)
    v = {i: {f"f{j}": float(x) for j, x in enumerate(rng.integers(0, 3, 4)) if x} for i in range(40)}
    leaf = spark.createDataFrame([(i, f, x) for i, m in v.items() for f, x in m.items()], "event_id long, feature string, value double")
    got = {r.event_id: r.cluster for r in cluster.dbscan(spark.createDataFrame([(i,) for i in v], "event_id long"), cluster.similarity(leaf), 0.95, 2).collect()}

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(a[k] * b.get(k, 0) for k in a) / n if n else 0.0

    near = {i: {j for j in v if j != i and cos(v[i], v[j]) >= 0.95} for i in v}
    core = {i for i in v if len(near[i]) >= 2}
    label = {i: i for i in core}
    for _ in v:
        for i in core:
            label[i] = min([label[i], *(label[j] for j in near[i] & core)])
    want = {i: label[i] if i in core else label[min(near[i] & core)] if near[i] & core else -1 for i in v}
    assert got == want


def test_second_day_tpc(spark, tmp_path):
    rng = np.random.default_rng(9)
    noise = rng.normal(0, 1, 1440)
    rows = [("a", START + 60.0 * i, 10 + float(n)) for i, n in enumerate(noise)] + [("a", START + 86400 + 60.0 * i, 10 + 2 * float(n)) for i, n in enumerate(noise)]
    df = spark.createDataFrame(rows, telemetry.SCHEMA)

    class Source:
        def get_data(self, channels, s, e):
            return df.where(F.col("mnemonic").isin(channels) & F.col("time").between(s, e))

    run = engine.Engine(spark, Source(), str(tmp_path))
    run.train(["a"], START, START + 2 * 86400, warning=100.0)
    tpc = [r.tpc for r in run.archive.read("status").orderBy("time").collect()]
    assert tpc[0] == 0 and tpc[1] == pytest.approx(2, rel=0.02)
    assert run.plot_frame("a", START + 86400, START + 2 * 86400, 100).count() > 50
    assert run.archive.models(START, START + 2 * 86400).first().ref_time == START + 86400


def test_plugin_model(spark, sine):
    engine.register(engine.BasisModel("daily", values.fourier((F.col("time") - START) / 3600, 1, 86400.0)))
    out = engine.train(sine, engine.Session(START, START + 4 * 86400), "daily")
    assert out.models.first().sigma < 0.05 and out.models.first().params[1] == pytest.approx(3, abs=0.02)


def test_status_codes(spark):
    rows = spark.createDataFrame([(0.5, 0.0, False), (2.5, 0.0, False), (3.5, 0.0, True), (0.0, 5.0, False), (0.0, 5.0, True)], "t double, o double, n boolean")
    assert [r.c for r in rows.select(health.status_code(F.col("t"), F.col("o"), F.col("n")).alias("c")).collect()] == [1, 2, 3, 3, 1]


def test_registry_json(spark, tmp_path):
    (tmp_path / "P.json").write_text(json.dumps({"name": "P", "satid": "1", "mnemonics": [{"name": "x", "frequency": "4", "warning_limit": 3, "depends": "y|z", "attributes": ["minstd|0.1", "flag"]}]}))
    r = registry.load_json(spark, str(tmp_path))
    row = r.first()
    assert (row.frequency, row.warning_limit, row.attribute) == (4.0, 3.0, {"minstd": "0.1", "flag": ""})
    assert [(c.place, c.channel) for c in registry.channels(r).orderBy("place").collect()] == [(0, "x"), (1, "y"), (2, "z")]


def test_archive_replaces_by_key(spark, tmp_path):
    a = archive.Archive(spark, str(tmp_path))
    assert a.read("models").count() == 0
    row = spark.createDataFrame([("m", "default", 1.0, 0.5)], "mnemonic string, state string, ref_time double, sigma double")
    a.append("models", row, 1.0)
    a.append("models", row.withColumn("sigma", F.lit(0.7)), 2.0)
    assert a.models(0, 10).first().sigma == 0.7


def test_stream_finds_the_same_outliers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.0), ("a", 100.0), ("b", 1.0)], "mnemonic string, value double").withColumn("ts", F.timestamp_seconds(F.lit(START)))
    rows.write.parquet(str(tmp_path / "in"))
    models = spark.createDataFrame([("a", 0.0, 1.0)], "mnemonic string, trend double, sigma double")
    s = stream.judged(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), models)
    stream.start(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.mnemonic, r.value, r.diff) for r in got] == [("a", 100.0, -97.0)]


def test_command_line():
    args = cli.parser().parse_args(["train", "a", "-s", "2024/001", "-e", "2024/003/12:00"])
    assert (args.start, args.end) == (START, START + 2.5 * 86400)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["train", "a"])


def test_scan_reads_two_columns_and_filters(spark):
    from tables import DATA

    plan = telemetry.EventTableSource(spark, DATA).get_data(["click"], START, START + 86400)._jdf.queryExecution().toString()
    physical = plan.rpartition("Physical Plan")[2]
    assert "props" not in physical and "EqualTo(event_type,click)" in physical


def test_unequal_windows_of_training(spark):
    b = spark.createDataFrame([("a", START + i * 86400) for i in range(8)], "mnemonic string, time double")
    w = [(r.window, (r.start - START) / 86400, (r.end - START) / 86400) for r in cycles.training_windows(b, 2, 86400.0).orderBy("window").collect()]
    assert w == [(0, 0, 4), (1, 2, 6), (2, 4, 8)]


def test_networks_use_every_sample(spark):
    from orrery import queries

    d = "/root/testdata/sf0.01"
    whole = {r.mnemonic: r["count"] for r in queries.tel(spark, d).groupBy("mnemonic").count().collect()}
    assert max(whole.values()) > 240
    assert {r.mnemonic: r["count"] for r in queries._phased(spark, d).groupBy("mnemonic").count().collect()} == whole
    assert {r.mnemonic: r.n for r in queries.QUERIES["f27_network_fit"](spark, d).collect()} == whole


def _two_days(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name in ("a", "b"):
        for d in (0, 1):
            noise = rng.normal(0, 1 + 3 * d, 1440)
            noise[[100, 101, 700, 701]] = 60.0
            rows += [(name, START + 86400 * d + 60.0 * i, 10 + float(n)) for i, n in enumerate(noise)]
    df = spark.createDataFrame(rows, telemetry.SCHEMA)

    class Source:
        def get_data(self, channels, s, e):
            return df.where(F.col("mnemonic").isin(channels) & F.col("time").between(s, e))

    return Source()


def test_two_day_run_writes_all_tables_and_runs_again(spark, tmp_path):
    run = engine.Engine(spark, _two_days(spark), str(tmp_path))
    tables = run.train(["a", "b"], START, START + 2 * 86400, clip=1e9, ratio=1.0)

    def seen():
        keys = {"events": ["timetag", "id"], "models": ["mnemonic", "state", "ref_time"], "status": ["mnemonic", "state", "time"], "outliers": ["mnemonic", "time"], "cycle_stats": ["mnemonic", "time"]}
        return {t: sorted(tuple(r) for r in archive.latest(run.archive.read(t), keys[t]).drop("written_at", "np", "pattern_times").collect()) for t in tables}

    first = seen()
    assert {(r[0], r[2]) for r in first["status"]} == {(c, START + 86400.0 * d) for c in "ab" for d in (0, 1)}
    assert all(r[4] == 0 for r in first["status"] if r[2] == START) and all(2 < r[4] < 6 for r in first["status"] if r[2] > START)
    assert {r[1] for r in first["events"]} == {"a", "b", "a#tpc", "b#tpc"}
    run.train(["a", "b"], START, START + 2 * 86400, clip=1e9, ratio=1.0)
    assert seen() == first


def test_manual_results_wait_for_save(spark, tmp_path):
    run = engine.Engine(spark, _two_days(spark), str(tmp_path))
    run.train(["a", "b"], START, START + 86400, manual=True, clip=1e9)
    assert run.archive.read("models").count() == 0
    got = run.save(["a"])
    assert got["models"] == 1 and [r.mnemonic for r in run.archive.read("models").collect()] == ["a"]
    assert cli.plotted(run, "outlier", "a", START, START + 86400).count() == got["outliers"] == 4


def test_long_term_is_one_session(spark, tmp_path):
    run = engine.Engine(spark, _two_days(spark), str(tmp_path))
    run.train(["a"], START, START + 2 * 86400, long_term=True)
    assert [(r.ref_time, r.period) for r in run.archive.read("models").collect()] == [(START, 2 * 86400.0)]


def test_earlier_model_flags_or_is_stale(spark):
    rows = spark.createDataFrame([("a", START + 60.0 * i, 100.0 if i in (5, 6) else float(i % 2)) for i in range(1440)], telemetry.SCHEMA)
    session = engine.Session(START, START + 86400, clip=1e9, ratio=0.01)
    good = spark.createDataFrame([("a", 0.5, 1.0)], "mnemonic string, mu double, sigma double")
    assert engine.train(rows, session, earlier=good).models.first().mu == pytest.approx(0.5, abs=1e-3)
    stale = good.withColumn("mu", F.lit(-50.0))
    first = engine.train(rows, session, earlier=stale).outliers
    assert first.count() == 2


def test_discrete_and_counter_models(spark):
    rows = spark.createDataFrame([("a", START + 60.0 * i, 2.0 if i % 10 == 0 else 1.0) for i in range(1440)], telemetry.SCHEMA)
    assert engine.train(rows, engine.Session(START, START + 86400), "discrete").models.first().sigma == pytest.approx(1.5)
    count = spark.createDataFrame([("c", START + 80.0 * i, float((i * 8 + i % 3) % 5000)) for i in range(1000)], telemetry.SCHEMA)
    out = engine.train(count, engine.Session(START, START + 86400, warning=1e9), "lmtrend").models.first()
    assert out.mu == pytest.approx(1.0, rel=0.01)


def test_hybrid_of_unlike_models(spark):
    rows = spark.createDataFrame([("a", START + 60.0 * i, (3.0 + 2 * i / 1440 if 400 <= i < 800 else 1.0) + 0.001 * (i % 2)) for i in range(1440)], telemetry.SCHEMA)
    states = spark.createDataFrame([("high", START + 60.0 * 400, START + 60.0 * 800)], "state string, start double, end double")
    line = engine.BasisModel("line", values.powers((F.col("time") - START) / 86400, 2))
    out = engine.train(rows, engine.Session(START, START + 86400, clip=1e9, warning=1e9), engine.HybridModel(states, {"high": line})).models
    got = {r.state: (r.params, r.sigma) for r in out.collect()}
    assert got["default"][0] == pytest.approx([1.0005], abs=1e-4) and got["high"][0] == pytest.approx([3.0005, 2.0], abs=1e-3)
    assert max(s for _, s in got.values()) < 1e-3


def test_gap_gate_leaves_out_a_channel(spark):
    whole = [("a", START + 60.0 * i, float(i % 7)) for i in range(1440)]
    holed = [("b", START + 60.0 * i, float(i % 7)) for i in range(1440) if not 200 <= i < 1200]
    rows = spark.createDataFrame(whole + holed, telemetry.SCHEMA)
    assert {r.mnemonic for r in engine.train(rows, engine.Session(START, START + 86400, gap=0.5)).models.collect()} == {"a"}
    assert {r.mnemonic for r in engine.train(rows, engine.Session(START, START + 86400)).models.collect()} == {"a", "b"}


def _against_sql(spark, tmp_path, name, rows):
    """The rows of an engine query and of its SQL, on an events table of these rows (event_id, ts, mnemonic, value)."""
    import duckdb
    from orrery import queries
    from tables import same

    db = duckdb.connect()
    db.sql("create table events (event_id bigint, ts timestamp, event_type varchar, value double)")
    db.executemany("insert into events values (?, ?, ?, ?)", rows)
    db.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    db.sql("set threads = 1")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), db.sql(queries.SQL[name])
    return same(got.columns, [tuple(r) for r in got.collect()]), same(want.columns, want.fetchall())


def test_calendar_at_the_edges_of_hours_and_far_years(spark, tmp_path):
    times = ["2024-01-31 22:59:59.999499", "2024-01-31 22:59:59.9995", "2024-02-29 23:59:59.9998", "1969-12-31 23:59:59.999999", "1969-12-31 22:59:59.9985", "2401-01-01 03:59:59.999999", "9999-12-31 23:59:59.9999", "12345-06-01 10:00:00", None]
    got, want = _against_sql(spark, tmp_path, "d11_calendar", [(i, t, "a", 1.0) for i, t in enumerate(times)])
    assert got == want


def test_sharpest_time_where_samples_share_a_time(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", m, v) for m, xs in {"a": [(0, 1.0), (5, 2.0), (5, 2.0), (9, 1.0)], "b": [(0, 1.0), (5, 9.0), (9, 1.0), (12, 1.0)], "c": [(0, 1.0), (3, 7.0), (5, 2.0), (5, 3.0), (9, 1.0)], "d": [(4, 1.0)] * 3}.items() for i, (s, v) in enumerate(xs)]
    got, want = _against_sql(spark, tmp_path, "d30_sharpest_time", rows)
    assert got == want and len(got) == 4


def test_extreme_time_of_equal_values_is_the_first(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "a", [3.0, 0.0, 5.0, 0.0, 5.0][i % 5]) for i in range(60)]
    got, want = _against_sql(spark, tmp_path, "d29_extreme_time", rows)
    assert got == want and f"{START + 120:.6f}|{START + 60:.6f}" in got[0]


def test_liquid_network_in_stretches_equals_single_steps():
    """Of 1300 steps, also where the state is not forgotten; and 60,000 steps in seconds."""
    import time

    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, 1300)
    y = 0.5 + 0.3 * np.sin(6 * x)
    for tau, scale in ((1.0, 1.0), (1e6, 0.1)):
        net = networks.LiquidNetwork(5, tau=tau)
        net.w *= scale
        h = np.zeros(5)
        hs, as_ = [h], []
        for v in x:
            as_.append(np.tanh(net.w @ np.append(v, h) + net.b))
            h = h + net.dt * (as_[-1] - h / net.tau)
            hs.append(h)
        out, got_h, got_a = net.run(x)
        assert np.allclose(got_h, hs, rtol=1e-9, atol=1e-11) and np.allclose(got_a, as_, rtol=1e-9, atol=1e-11)
        e = (out - y) * out * (1 - out) / len(y)
        back, gw, gb = np.zeros(5), np.zeros_like(net.w), np.zeros(5)
        for t in range(len(x) - 1, -1, -1):
            back = back + e[t] * net.v
            d = back * net.dt * (1 - as_[t] ** 2)
            gw, gb = gw + np.outer(d, np.append(x[t], hs[t])), gb + d
            back = back * (1 - net.dt / net.tau) + net.w[:, 1:].T @ d
        w, b = net.w.copy(), net.b.copy()
        net.train(x, y, 1, rate=1.0)
        assert np.allclose(w - net.w, gw, rtol=1e-6, atol=1e-10) and np.allclose(b - net.b, gb, rtol=1e-6, atol=1e-10)
    long = rng.uniform(0, 1, 60_000)
    begin = time.perf_counter()
    networks.LiquidNetwork(10).train(long, long, 3)
    assert time.perf_counter() - begin < 3


def test_similarity_shuffles_no_pairs_and_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"f{j}", float(x)) for i in range(40) for j, x in enumerate(rng.integers(-2, 3, 9)) if x]
    plain = spark.createDataFrame(rows, "event_id long, feature string, value double")
    # aggregates by pair are what took the disk
    assert "a#" not in "".join(x for x in cluster.similarity(plain)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x)
    rows += [(100, f"f{j}", 1.0) for j in range(80)] + [(101, "f1", None), (101, "f2", 2.0), (102, "f3", 1.0), (102, "f3", 2.0), (103, None, 2.0), (103, "f4", 1.0), (104, None, 1.0), (104, "f4", 3.0), (105, "f5", 0.0)]
    leaf = spark.createDataFrame(rows, "event_id long, feature string, value double")
    norm, want = {}, {}
    for i, _, v in rows:
        norm[i] = norm.get(i, 0.0) + (v or 0.0) ** 2
    for i, f, v in rows:
        for j, g, u in rows:
            if i < j and f == g and f is not None:
                want[i, j] = want.get((i, j), 0.0) + (v or 0.0) * (u or 0.0)
    want = {(i, j): d / math.sqrt(norm[i] * norm[j]) if norm[i] * norm[j] else 0.0 for (i, j), d in want.items()}
    for narrow in (64, 3):
        got = [((r.a, r.b), r.similarity or 0.0) for r in cluster.similarity(leaf, narrow).collect()]
        assert len(got) == len(want) and dict(got) == pytest.approx(want)

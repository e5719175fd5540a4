"""Codecs, the sparsifier in batch and on a stream, files, configuration, bands, detection, metadata and the cache."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftline.operators import anomaly, bands, explore, rollup, sparse
from driftline.operators.cache import RangeCache
from driftline.operators.resample import resample
from driftline.operators.timerange import TimeRange
from driftline.plans.config import Config, adler_shard
from driftline.sources import codec, files, generators
from driftline.streaming import pipeline


def machine(points, rule):
    state, out = sparse.State(), []
    for e, v in points:
        out += sparse.step(state, e, v, rule)
    return out


def test_relative_delta():
    rule = sparse.Rule("delta", min_delta=1e-4, gap=10**6, forced=10**6)
    got = machine([(10, 10000.0), (20, 10200.0), (30, 10201.0), (40, 10401.0)], rule)
    assert [d for *_, d in got] == ["first", "changed", "dropped", "changed"]


def test_percentile_and_forced_and_late():
    rule = sparse.Rule("percentile", min_delta=1e-4, gap=10**6, forced=10**6)
    got = machine([(e, 1000.0 - 100 * e) for e in range(10)] + [(11, 2.0), (12, 4.0), (13, 100.0)], rule)
    assert [d for *_, d in got[-3:]] == ["changed"] * 3
    got = machine([(0, 1.0), (10, 1.0), (20, 1.0), (31, 1.0), (5, 1.0)], sparse.Rule(gap=100, forced=20))
    assert [d for *_, d in got] == ["first", "dropped", "dropped", "forced", "late"]


def test_gap_markers(spark):
    epochs = [10, 20, 40, 50, 80, 90]
    got = machine([(e, 1.0) for e in epochs], sparse.Rule(gap=10))
    assert [e for e, _, m, _ in got if m] == [30, 60]
    df = spark.createDataFrame([("a", e, 1.0) for e in epochs], "k string, epoch long, value double")
    assert sorted(r["epoch"] for r in sparse.gap_markers(df, ["k"], 10).collect()) == [30, 60]
    assert [r["epoch"] for r in sparse.tombstones(df, ["k"], 10).collect()] == [100]


def test_rate(spark):
    df = spark.createDataFrame([("a", 10, 10.0), ("a", 20, 11.0), ("a", 40, 20.0)], "k string, epoch long, value double")
    assert [(r["value"], r["marker"]) for r in sparse.rate(df, ["k"]).orderBy("epoch").collect()] == [(None, "missing"), (0.1, None), (0.45, None)]


def test_lossless_round_trip(spark):
    rng = random.Random(1)
    points = [(f"s{k}", 60 * i, float(rng.randrange(3))) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(points, "series_id string, epoch long, value double")
    thin = sparse.kept(sparse.decide(df, [sparse.Rule("lossless", gap=600)]))
    assert thin.count() < len(points)
    grid = TimeRange(0, 12000, 60)
    back = {(r["series_id"], r["epoch"]): r["value"] for r in resample(thin, grid, ["series_id"], gap=60).collect()}
    assert back == {(s, e): v for s, e, v in points}


def test_stream_equals_batch(spark, tmp_path):
    points = [(f"s{k}", 60 * i, float((i // (k + 2)) % 4)) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(points, "series_id string, epoch long, value double")
    for part in range(3):
        df.where((F.col("epoch") >= part * 1200) & (F.col("epoch") < (part + 1) * 1200)).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    rule = sparse.Rule("delta", min_delta=0.1, gap=600, forced=900)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = pipeline.sparsify(source, rule).writeStream.format("memory").queryName("thin").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, spark.table("thin").collect())) == sorted(map(key, sparse.decide(df, [rule]).collect()))


def test_stream_rollup(spark, tmp_path):
    df = spark.createDataFrame([("a", e, float(e)) for e in range(0, 7200, 600)], "k string, epoch long, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = pipeline.rollup(source, ["k"], 3600, "1 second").writeStream.format("memory").queryName("rolled").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["epoch"], r["mean"], r["n"]) for r in spark.table("rolled").collect()] == [(3600, 1500.0, 6)]


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "line string")


def test_codecs(spark):
    got = codec.parse_auto(lines(spark, "m,Cluster=c1,Node=n=1 cpu=5,mem=7i 1500000000000", "clusters.A.n1.up 20 1556", "two parts", "m a=true 1000000000", "m,x=1 v=1 0"), now=99).collect()
    assert sorted((r["datasource"], r["field"], r["epoch"], r["value"]) for r in got) == [("flat", "up", 1556, 20.0), ("m", "cpu", 1500, 5.0), ("m", "mem", 1500, 7.0), ("m", "v", 99, 1.0)]
    tagged = next(r for r in got if r["field"] == "cpu")
    assert tagged["tags"] == {"measurement": "m", "Cluster": "c1", "Node": "n=1"}
    flat = next(r for r in got if r["field"] == "up")
    assert flat["tags"] == {"tkn0": "clusters", "tkn1": "A", "tkn2": "n1", "tkns": "4"}
    assert codec.rejected(lines(spark, "two parts", "a b 5")).count() == 1


def test_bundle(spark, tmp_path):
    rows = ['{"name":"N.S.x","timestamp":60000000000,"field":"value","value":10,"tags":[]}', '{"name":"N.S.y","timestamp":60000000000,"field":"value","value":1,"tags":[{"key":"a","value":"b"}]}',
            '{"name":"nodot","timestamp":1,"field":"value","value":1,"tags":[]}', '{"name":"N.z","timestamp":1,"field":"other","value":1,"tags":[]}', '{"name":"N.denied","timestamp":1,"field":"value","value":1,"tags":[]}']
    (tmp_path / "b.json").write_text("\n".join(rows))
    bundle = codec.read_bundle(spark, str(tmp_path / "b.json"))
    got = codec.bundle_points(bundle, "c1", 1000, deny="denied").collect()
    assert [(r["field"], r["epoch"], r["tags"]["tkn1"], r["tags"]["tkns"], r["version"]) for r in got] == [("x", 60, "c1", "5", 1000)]
    assert codec.bundle_counts(bundle).first().asDict() == {"n_flat": 4, "n_tagged": 1, "n_skipped": 3}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("d1", 5, 1.0), ("d1", 90000, 2.0), ("d2", 7, 3.0)], "datasource string, epoch long, value double")
    manifest = files.write_bundle(df, str(tmp_path / "b"))
    assert manifest["total_points_processed"] == 3 and manifest["datasource_map"]["d1"]["points_written"] == 2
    assert files.read_manifest(spark, str(tmp_path / "b")) == manifest
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_bundle(df, str(tmp_path / "b"))
    files.append_points(df, str(tmp_path / "p"))
    assert files.read_points(spark, str(tmp_path / "p"), 0, 86400).count() == 2
    files.regranulate(spark, str(tmp_path / "p"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).select("day").distinct().count() == 1


CONFIG = """
grid: 60
segment: DAY
datasources: {"": other, process.: proc, process.cpu: cpu}
rules: [{pattern: count, algorithm: lossless}, {pattern: cpu, algorithm: delta, min_delta: 0.1}]
transforms: [{include: count, exclude: skip, suffix: .rate}]
rollups: [3600]
cross_cluster: ["*.cpu"]
shards: 4
"""


def test_config(spark):
    c = Config.load(CONFIG)
    names = lines(spark, "process.cpu", "process.x.count", "skip.count")
    x = F.col("line")
    got = names.select(c.datasource(x), c.algorithm(x), c.transformed(x), c.is_cross_cluster(x), c.grid_epoch(F.lit(61))).collect()
    assert [tuple(r) for r in got] == [("cpu", "delta", None, True, 120), ("proc", "lossless", ".rate", False, 120), ("other", "lossless", None, False, 120)]
    assert c.forced_write == 43200
    assert names.select(adler_shard(x, F.lit(4)).alias("s")).where("s < 0 or s > 3").count() == 0
    for bad in ("segment: EON", "grid: 0", "rules: [{algorithm: nosuch}]", "unknown: 1", "{grid: 60, rollups: [90]}"):
        with pytest.raises(ValueError):
            Config.load(bad)


def test_bands(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(20, 1) if i % 2 else rng.gauss(60, 1)) for i in range(4000)] + [("a", rng.uniform(0, 100)) for _ in range(40)]
    df = spark.createDataFrame(rows, "k string, value double")
    found = bands.bands(df, "k", max_width=0.1).collect()
    for mode in (20, 60):
        assert any(b["low"] <= mode <= b["high"] for b in found)
    outliers = bands.thin_by_bands(df, "k", bands.bands(df, "k", max_width=0.1)).where("outlier").count()
    assert outliers < 0.1 * len(rows)


def test_anomalies(spark):
    rng = random.Random(0)
    rows = [("a", i, 5.0 if 95 <= i <= 98 else rng.gauss(0, 0.3)) for i in range(100)] + [("flat", i, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "series_id string, epoch long, value double")
    got = anomaly.detect(df, ["series_id"], 1).collect()
    assert [(r["series_id"], r["start"], r["end"]) for r in got] == [("a", 95, 98)]
    got = anomaly.detect(df, ["series_id"], 1, "static", threshold=4, comparator="gt").collect()
    assert [(r["start"], r["end"], r["points"]) for r in got] == [(95, 98, 4)]
    with pytest.raises(ValueError):
        anomaly.detect(df, ["series_id"], 1, "os.system")


def test_explore(spark):
    points = spark.createDataFrame([({"measurement": "cpu", "node": "n1", "dc": "x"}, "f"), ({"measurement": "mem", "node": "n2", "dc": "y"}, "g")], "tags map<string,string>, field string")
    assert [r[0] for r in explore.show(points, "SHOW MEASUREMENTS WITH MEASUREMENT =~ /c/ LIMIT 5").collect()] == ["cpu"]
    assert [r[0] for r in explore.show(points, 'SHOW TAG VALUES FROM "mem" WITH KEY = "node"').collect()] == ["n2"]
    assert explore.show(points, "SHOW TAG VALUES FROM mem WITH KEY = node AND dc = 'x'").count() == 0
    names = spark.createDataFrame([("a.b.c",), ("a.d",), ("a.b.e",)], "name string")
    assert [tuple(r) for r in explore.find_children(names, "a.*").collect()] == [("b", False), ("d", True)]
    with pytest.raises(ValueError):
        explore.show(points, "SHOW NOTHING")


def test_cache(spark):
    calls = []

    def evaluate(r):
        calls.append((r.start, r.end))
        return spark.createDataFrame([(e, float(e)) for e in r.epochs()], "epoch long, value double")

    cache = RangeCache(2)
    assert cache.compute("q", TimeRange(0, 30, 10), evaluate).count() == 3
    assert cache.compute("q", TimeRange(10, 50, 10), evaluate).count() == 4
    assert cache.compute("q", TimeRange(0, 50, 10), evaluate).count() == 5
    assert calls == [(0, 30), (30, 50)] and [(r.start, r.end) for r, _ in cache.entries["q"]] == [(0, 30), (30, 50)]
    for k in "xyz":
        cache.set(k, TimeRange(0, 10, 10), evaluate(TimeRange(0, 10, 10)))
    assert list(cache.entries) == ["y", "z"]


def test_generators(spark):
    df = generators.predictable(spark, 0, 3600)
    assert df.where("field = 'steady'").count() == 60 * 6 and df.where("field = 'regular' and value != epoch").count() == 0
    assert generators.random_walk(spark, 2, 50, 0).where("value < 0 or value > 100").count() == 0


def test_cache_releases_and_prunes(spark):
    def evaluate(r):
        return spark.createDataFrame([(e, float(e)) for e in r.epochs()], "epoch long, value double")

    cache = RangeCache(most=1, points=4)
    cache.compute("q", TimeRange(0, 30, 10), evaluate)
    cache.compute("q", TimeRange(0, 60, 10), evaluate)
    assert [(r.start, r.end) for r, _ in cache.entries["q"]] == [(20, 30), (30, 60)]
    old = [df for _, df in cache.entries["q"]]
    assert sorted(r["epoch"] for r in cache.get("q", TimeRange(0, 60, 10))[0].collect()) == [20, 30, 40, 50]
    cache.compute("other", TimeRange(0, 10, 10), evaluate)
    assert list(cache.entries) == ["other"] and not any(df.is_cached for df in old)
    cache.clear()
    assert not cache.entries


def test_whitelist_kinds_and_schema(spark):
    tags = [{"Cluster": "a", "Node": "n"}, {"tkn1": "a", "tkn2": "m"}, {"Cluster": "b"}]
    points = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "id int, tags map<string,string>")
    assert {r["id"] for r in codec.whitelisted(points, "a").collect()} == {0, 1}
    assert {r["id"] for r in codec.whitelisted(points, "a", "m").collect()} == {1}
    names = ["x.m1_rate", "x.p99", "m.total", "m.discount", "clusters.c.admin.value", "a.b.count"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(codec.metric_kind(F.col("n")), codec.histogram_category(F.col("n")), codec.component(F.col("n"))).collect()]
    assert got == [("meter", None, "x.m1_rate"), ("histogram", "p99", "x.p99"), ("histogram", "total", "m.total"), ("gauge", None, "m.discount"), ("gauge", None, "c.admin"), ("counter", None, "b.count")]
    kinds = {r["name"]: r["kind"] for r in explore.information_schema({"t": spark.createDataFrame([("a", 1, 2.0)], "tag string, epoch long, v double")}).collect()}
    assert kinds == {"tag": "dimension", "epoch": "time", "v": "metric"}


def test_adler(spark):
    keys = ["", "a", "cluster-17", "é€", "x" * 5000, None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r[0] for r in df.select(adler_shard(F.col("k"), F.lit(1000))).collect()]
    assert got == [None if k is None else zlib.adler32(k.encode()) % 1000 for k in keys]


def test_rates_run_from_the_last_written_point(spark):
    points = spark.createDataFrame([("s", e, v) for e, v in ((10, 10.0), (20, 11.0), (30, 12.0), (40, 20.0))], "series_id string, epoch long, value double")
    rule = sparse.Rule("delta", min_delta=0.1, gap=10**6, forced=10**6, transform=True)
    got = [(r["epoch"], r["value"], r["marker"], r["decision"]) for r in sparse.decide(points, [rule]).orderBy("epoch").collect()]
    assert got == [(10, None, "missing", "first"), (20, 0.1, None, "changed"), (30, 0.1, None, "dropped"), (40, 0.45, None, "changed")]


def test_grouped_baselines(spark):
    rows = [(f"c.{g}.{i}", e, float(v)) for g, vs in (("a", (1, 3)), ("b", (10, 30))) for i, v in enumerate(vs) for e in (0, 1)]
    df = spark.createDataFrame(rows, "series_id string, epoch long, value double")
    got = {r["series_id"]: r["score"] for r in anomaly.gaussian(df, ["series_id"], tokens=[1]).collect()}
    assert all(abs(x - (1 - math.exp(-0.5) / math.sqrt(2 * math.pi))) < 1e-12 for x in got.values())
    assert all(r["score"] is None for r in anomaly.gaussian(df, ["series_id"]).collect())


def test_step_rollups_are_those_of_the_batch(spark):
    rng = random.Random(8)
    epochs = sorted(rng.sample(range(3600, 36000), 40))
    points = [(e, float(rng.randrange(100))) for e in epochs]
    state, told = pipeline.Steps(), {}
    for e, v in points:
        for end, mean, total, top, last, marker in state.step(e, v, False, 3600, 10**9):
            told[end] = (mean, total, top, last, marker)
    assert state.step(36000, None, True, 3600, 10**9) [-1][0] == 39600
    df = spark.createDataFrame([("s", e, v) for e, v in points], "series_id string, epoch long, value double")
    for how, i in (("mean", 0), ("sum", 1), ("max", 2), ("last", 3)):
        want = {r["epoch"]: r["value"] for r in rollup.rollup(df, ["series_id"], TimeRange(0, 36000, 3600), how).collect()}
        for end, values in told.items():
            assert values[i] == pytest.approx(want[end]) if want[end] is not None else values[i] is None, (how, end)


def test_step_rollup_markers():
    state = pipeline.Steps()
    assert state.step(0, 10.0, False, 60, 30) == []
    assert state.step(130, 5.0, False, 60, 30) == [(60, 10.0, 300.0, 10.0, 10.0, None), (120, None, None, None, None, "missing")]
    assert state.step(150, None, True, 60, 30) == [(180, 5.0, 100.0, 5.0, 5.0, None), (240, None, None, None, None, "tombstone")]


def test_outliers_are_told_and_bands_once(spark):
    rng = random.Random(5)
    values = [rng.choice([10, 90]) + rng.uniform(-1, 1) for _ in range(400)] + [50.0, 10.2, 10.4, 300.0, 90.3]
    rule = sparse.Rule("outlier", window=400, gap=10**6, forced=10**6)
    out = machine(list(enumerate(values)), rule)
    tail = [(v, d) for _, v, _, d in out[-5:]]
    assert tail[0] == (50.0, "changed") and tail[3] == (300.0, "changed")
    assert tail[1][1] == "changed" and abs(tail[1][0] - 10) < 1.5 and tail[2] == (tail[1][0], "dropped")


def test_band_statistics(spark):
    points = spark.createDataFrame([("a", 0, 1.0), ("a", 5, 1.2), ("a", 15, 9.0)], "k string, epoch long, value double")
    found = spark.createDataFrame([("a", 0.5, 1.5, 0.9)], "k string, low double, high double, probability double")
    got = {(r["epoch"], r["low"]): (r["points"], r["mean"]) for r in bands.band_statistics(points, "k", found, 10).collect()}
    assert got == {(0, 0.5): (2, pytest.approx(1.1)), (10, None): (1, 9.0)}


def test_consumer_modes(spark):
    df = spark.createDataFrame([("s", e, 5.0) for e in range(0, 8000, 60)] + [("s", 20000, 5.0)], "series_id string, epoch long, value double")
    rules = [sparse.Rule("lossless", gap=600, forced=10**6)]
    raw = pipeline.consume(df, rules, "realtime")["raw"]
    assert sorted((r["epoch"], r["marker"]) for r in raw.collect()) == [(0, None), (8580, "missing"), (20000, None)]
    assert [r["epoch"] for r in pipeline.consume(df, rules, "recovery")["raw"].collect()] == [8580]
    assert set(pipeline.consume(df, rules, "realtime")) == {"raw"}
    with pytest.raises(ValueError):
        pipeline.consume(df, rules, "nothing")


def test_rollup_steps_on_a_stream(spark, tmp_path):
    rows = [("s", e, float(e % 7), None) for e in range(0, 14400, 600)] + [("s", 14400, None, "tombstone")]
    schema = "series_id string, epoch long, value double, marker string"
    for i, part in enumerate((rows[:10], rows[10:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*")
    out = pipeline.consume(stream, [], "rollup", (3600,), 10**6)["rollup_3600"]
    query = out.writeStream.format("memory").queryName("steps").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["epoch"]: (r["mean"], r["sum"], r["max"], r["last"], r["marker"]) for r in spark.table("steps").collect()}
    want = {}
    for end in range(3600, 14401, 3600):
        v = [float(e % 7) for e in range(end - 3600, end, 600)]
        want[end] = (pytest.approx(sum(v) / 6), sum(v) * 600, max(v), v[-1], None)
    assert got == want | {18000: (None, None, None, None, "tombstone")}


def test_bundles_generators_and_copies(spark):
    assert generators.catch_all(spark, 2, 5, 0).count() == 10 and generators.multi_cluster(spark, 2, 3, 4, 0).select("name").distinct().count() == 6
    near = generators.outliers(spark, 1, 5000, 0).selectExpr("avg(cast(abs(value - 10) <= 1 or abs(value - 90) <= 1 or abs(value - 200) <= 1 as double)) AS share").first()["share"]
    assert 0.97 < near < 1 and generators.live(spark).isStreaming
    rows = spark.createDataFrame([("a.b.c", e * 10**9, "value", float(e), []) for e in (0, 30, 60, 200)] + [("x", 0, "value", 1.0, [])], codec.BUNDLE)
    dense = codec.dense_bundle(rows, "c1", 7, TimeRange(0, 300, 60))
    assert sorted((r["epoch"], r["value"], r["version"]) for r in dense.collect()) == [(0, 15.0, 7), (60, 60.0, 7), (180, 200.0, 7)]
    config = Config(datasources={"": "ts"}, cross_cluster=("*.load",), shards=3)
    names = spark.createDataFrame([("clusters.a.n.load",), ("clusters.b.n.cpu",)], "name string")
    got = sorted((r["name"], r["datasource"]) for r in config.with_cross_cluster(names).collect())
    shard = lambda k: zlib.adler32(k.encode()) % 3
    assert got == sorted([("clusters.a.n.load", f"ts_{shard('a')}"), ("clusters.a.n.load", f"ts_ccluster_{shard('load')}"), ("clusters.b.n.cpu", f"ts_{shard('b')}")])
    known = spark.createDataFrame([("a",), (None,)], "k string")
    points = spark.createDataFrame([("a", 1), ("b", 5), ("b", 2), (None, 3)], "k string, epoch long")
    assert [tuple(r) for r in sparse.new_keys(points, known, ["k"]).collect()] == [("b", 2)]

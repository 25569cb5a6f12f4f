"""Stream against table: equal in complete mode; in append mode, minus what is still open."""

import json
import time

import pytest
from pyspark.sql import functions as F

from netlens.functions import net
from netlens.streaming import live
from netlens.streaming.baseline import baseline_anomalies
from tests.conftest import one


@pytest.fixture
def feed(spark, tmp_path):
    """Three files of live packets, as a stream and as a table."""
    folder = tmp_path / "in"
    folder.mkdir()
    base = 1704067200
    for part in range(3):
        lines = [
            {"src_ip": f"10.0.0.{i % 3}", "dst_ip": "10.0.1.1", "protocol": "TCP" if i % 4 else "UDP", "size": 100 + i,
             "dst_port": 1 + i % 60, "timestamp": base + part * 40 + i * 0.25}
            for i in range(120)
        ]
        (folder / f"{part}.json").write_text("\n".join(map(json.dumps, lines)))
    table = (
        spark.read.schema(live.LIVE_PACKETS).json(str(folder)).withColumn("feed", F.lit("live"))
        .withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))).drop("timestamp")
    )
    return live.read_live(spark, str(folder), files_per_batch=1), table


def bag(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def run(spark, df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option(
        "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name), q


@pytest.mark.parametrize("name", ["window_metrics", "talkers", "source_activity", "connection_table", "second_metrics"])
def test_complete_mode_equals_table(spark, feed, tmp_path, name):
    stream, table = feed
    step = live.live_metrics if name == "second_metrics" else (lambda df: df)
    got, _ = run(spark, getattr(live, name)(stream), "complete", f"c_{name}", tmp_path)
    assert bag(step(got)) == bag(step(getattr(live, name)(table)))


def test_sketch_equals_exact_count(feed):
    _, table = feed
    got = live.active_connections(live.second_metrics(table))
    assert bag(got) == bag(live.active_connections_exact(table))


@pytest.mark.parametrize("name", ["window_metrics", "idle_sessions", "expiring_connections"])
def test_append_mode_emits_closed_groups(spark, feed, tmp_path, name):
    stream, table = feed
    got, _ = run(spark, getattr(live, name)(stream), "append", f"a_{name}", tmp_path)
    whole = getattr(live, name)(table)
    assert set(bag(got)) <= set(bag(whole))
    if name == "window_metrics":
        last = table.agg(F.max(net.us("ts"))).first()[0] - 10_000_000
        assert bag(got) == bag(whole.where(F.col("end_us") <= last))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    folder = tmp_path / "late"
    folder.mkdir()
    row = {"src_ip": "a", "dst_ip": "b", "protocol": "TCP", "size": 1, "dst_port": 1}
    df = live.window_metrics(live.read_live(spark, str(folder), files_per_batch=1), 5, 5)
    sink = {"checkpointLocation": str(tmp_path / "late_cp")}
    late = live.LateRows()
    spark.streams.addListener(late)
    for n, at in enumerate((1000, 2000, 1001)):
        (folder / f"{n}.json").write_text(json.dumps(row | {"timestamp": at}))
        q = df.writeStream.outputMode("append").format("noop").options(**sink).trigger(availableNow=True).start()
        q.awaitTermination(120)
    deadline = time.time() + 30
    while late.total(q) < 1 and time.time() < deadline:  # listeners run behind the query
        time.sleep(0.2)
    spark.streams.removeListener(late)
    assert late.total(q) == 1


def test_current_state_of_repeating_sinks(spark):
    rows = [("a", 1, 0), ("b", 5, 0), ("a", 2, 1), ("a", 3, 2)]
    table = spark.createDataFrame(rows, "pair string, packets long, batch_id long")
    assert sorted(map(tuple, live.current(table, ["pair"]).collect())) == [("a", 3), ("b", 5)]
    assert [tuple(r) for r in live.current(table).collect()] == [("a", 3)]
    assert live.current(table.limit(0)).count() == live.current(table.limit(0), ["pair"]).count() == 0


def test_metrics_and_alerts_sink(spark, feed, tmp_path):
    stream, table = feed
    out = str(tmp_path / "out")
    limits = live.Thresholds().updated(high_pps=3.9)
    q = live.run_metrics(stream, out, lambda: limits, checkpoint=str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(180)
    last = table.agg(F.max(net.us("ts"))).first()[0] - 10_000_000
    whole = live.live_metrics(live.second_metrics(table)).where(F.col("end_us") <= last)
    assert bag(whole.drop("connections")) == bag(live.window_metrics(table).where(F.col("end_us") <= last))
    metrics = live.read_table(spark, f"{out}/metrics", whole)
    assert bag(metrics.drop("batch_id")) == bag(whole)
    history = live.metrics_history(metrics, 5).collect()
    assert len(history) == 5 and history[0]["end_us"] == whole.agg(F.max("end_us")).first()[0]
    alerts = spark.read.parquet(f"{out}/alerts")
    assert alerts.where("type = 'high_pps'").count() == live.threshold_alerts(whole, limits).count() > 0
    want = baseline_anomalies(whole).count()
    assert alerts.where("category = 'anomaly'").count() == want


def test_table_sink_ranks_each_batch(spark, feed, tmp_path):
    stream, table = feed
    out = str(tmp_path / "top")
    q = live.run_table(live.talkers(stream), out, lambda b: live.top_talkers(b, 1), checkpoint=str(tmp_path / "tcp"), availableNow=True)
    q.awaitTermination(180)
    got = spark.read.parquet(out)
    assert got.where("rank = 1").count() == got.count() == got.select("end_us").distinct().count() > 0


@pytest.mark.parametrize("block", [11, 100_000])
def test_baseline(spark, block):
    rows = [("f", i * 1_000_000, 10.0, 5, ["TCP"]) for i in range(30)]
    rows[5] = ("f", 5_000_000, 500.0, 50, ["TCP"])
    rows[25] = ("f", 25_000_000, 31.0, 11, ["TCP", "GRE"])
    df = spark.createDataFrame(rows, "feed string, end_us long, packets_per_second double, connections long, protocols array<string>")
    got = sorted((r["end_us"], r["type"], r["protocol"]) for r in baseline_anomalies(df, block).collect())
    assert got == [(25_000_000, "connection_surge", None), (25_000_000, "new_protocol", "GRE"), (25_000_000, "traffic_spike", None)]


def test_alert_rules(spark):
    m = spark.createDataFrame([("f", 1, 10_001.0, 1.0), ("f", 2, 1.0, 100_000_001.0), ("f", 3, 10_000.0, 1e8)],
                              "feed string, end_us long, packets_per_second double, bits_per_second double")
    assert sorted(r["type"] for r in live.threshold_alerts(m).collect()) == ["high_bps", "high_pps"]
    a = spark.createDataFrame([("f", 1, "x", 1001, 51), ("f", 1, "y", 1000, 50)], "feed string, end_us long, src_ip string, packets long, ports int")
    assert sorted(r["severity"] for r in live.security_alerts(a).collect()) == ["critical", "high"]
    assert one(live.top_talkers(spark.createDataFrame([("f", 1, "x", 1, 5), ("f", 1, "y", 1, 6)], "feed string, end_us long, src_ip string, packets long, bytes long"), 1))["src_ip"] == "y"


@pytest.mark.parametrize("bad", [{"nope": 1}, {"high_pps": 0}, {"high_pps": "x"}, {"ddos_threshold": -1}, {"high_bps": True}])
def test_threshold_updates(bad):
    assert live.Thresholds().updated(high_pps=5).high_pps == 5
    with pytest.raises(ValueError):
        live.Thresholds().updated(**bad)


def test_windows_over_blocks_equal_a_look_at_every_window(spark, packets):
    times = [0.2, 0.4, 1.5, 58.9, 59.0, 60.1, 61.0, 119.5, 120.0, 300.0, 361.7, 900.0]
    rows = [{"at": at, "src_ip": f"10.0.0.{i % 4}", "capture_id": c, "protocol": ("TCP", "UDP", "tcp")[i % 3]} for i, at in enumerate(times * 2) for c in ("a", "b")]
    feed = live.from_packets(packets(*rows)).withColumn("size", F.when(F.col("src_ip") != "10.0.0.1", F.col("size")))
    ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.col("s") + k.cast("long") * 1_000_000))
    pairs = feed.withColumn("s", (F.floor(F.unix_micros("ts") / 1e6).cast("long") + 1) * 1_000_000).select("feed", ends.alias("end_us"), "src_ip", "dst_ip").distinct()
    want = bag(pairs.groupBy("feed", "end_us").agg(F.count("*").alias("active_connections")))
    seconds = live.second_metrics(feed)
    assert bag(live.active_connections_exact(feed)) == want and bag(live.active_connections(seconds)) == want
    narrow = live.window_metrics(feed)
    assert bag(live.live_metrics(seconds).select(narrow.columns)) == bag(narrow)


def test_a_second_goes_to_two_blocks_not_to_sixty_windows(spark, packets):
    feed = live.from_packets(packets(*[{"at": float(i)} for i in range(300)]))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    seconds = live.second_metrics(feed)
    blocks = live._blocks(seconds, live.ACTIVE)
    assert blocks.select(F.sum(F.size("items"))).first()[0] == 2 * seconds.count()
    assert "hll_union_agg" not in plan(live.live_metrics(seconds)) + plan(live.active_connections(seconds))
    assert "sequence" not in plan(feed) and live.active_connections_exact(feed).count() == 359

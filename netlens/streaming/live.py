"""Live packet feed: source, windowed aggregates, alerts and sinks.

The aggregates are plain DataFrame functions, so the same code runs on a stream and on a
table; on a stream they need event time under a watermark (``with_event_time``).
"""

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from netlens.functions import net
from netlens.operators.ordered import scan, time_chunk
from netlens.operators.stage import checkpointed
from netlens.schema import LIVE_PACKETS
from netlens.streaming.baseline import HISTORY, baseline_anomalies

WIDTH, SLIDE, ACTIVE = 5, 1, 60
LATENESS = "10 seconds"
MAX_HISTORY = 1000
_DAY_US = 86_400_000_000
SHOWN_PROTOCOLS = ("TCP", "UDP", "ICMP")


@dataclass(frozen=True)
class Thresholds:
    """Alert limits. The defaults."""

    high_pps: float = 10_000
    high_bps: float = 100_000_000
    high_latency: float = 0.5
    high_packet_loss: float = 0.05
    suspicious_port_scan: int = 50
    ddos_threshold: int = 1000

    def updated(self, **changes) -> "Thresholds":
        known = {f.name for f in fields(self)}
        for name, value in changes.items():
            if name not in known:
                raise ValueError(f"unknown threshold {name}")
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0:
                raise ValueError(f"threshold {name} has to be a positive number")
        return replace(self, **changes)


def read_live(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """The live feed from files of live packets (JSON or Parquet), with event time."""
    raw = (
        spark.readStream.schema(LIVE_PACKETS)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return with_event_time(raw.withColumn("feed", F.lit("live")))


def with_event_time(live: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Event time from epoch seconds, and the watermark that bounds state."""
    ts = F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))
    return live.withColumn("ts", ts).drop("timestamp").withWatermark("ts", lateness)


def from_packets(packets: DataFrame) -> DataFrame:
    """Live-feed columns of a packets table; a capture is a feed."""
    return packets.select(
        F.col("capture_id").alias("feed"),
        "ts",
        "src_ip",
        "dst_ip",
        "protocol",
        F.col("packet_size").alias("size"),
        "dst_port",
    )


def _window(width: int = WIDTH, slide: int = SLIDE):
    return F.window("ts", f"{width} seconds", f"{slide} seconds").alias("w")


def window_metrics(live: DataFrame, width: int = WIDTH, slide: int = SLIDE) -> DataFrame:
    """Packets, bytes and packets by protocol of each sliding window of a feed."""
    proto = F.upper("protocol")
    per = live.groupBy("feed", _window(width, slide)).agg(
        F.count("*").alias("packets"),
        F.sum("size").alias("bytes"),
        *[F.count_if(proto == p).alias(f"{p.lower()}_packets") for p in SHOWN_PROTOCOLS],
        F.count_if(~proto.isin(*SHOWN_PROTOCOLS)).alias("other_packets"),
        F.collect_set(proto).alias("protocols"),
    )
    return per.select(
        "feed",
        net.us("w.end").alias("end_us"),
        "packets",
        "bytes",
        *[f"{p.lower()}_packets" for p in SHOWN_PROTOCOLS],
        "other_packets",
        F.array_sort("protocols").alias("protocols"),
        (F.col("packets") / width).alias("packets_per_second"),
        (F.col("bytes") / width).alias("bytes_per_second"),
        (F.col("bytes") * 8 / width).alias("bits_per_second"),
    )


def talkers(live: DataFrame, width: int = WIDTH, slide: int = SLIDE) -> DataFrame:
    """Packets and bytes per window and source."""
    return (
        live.groupBy("feed", _window(width, slide), "src_ip")
        .agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"))
        .select("feed", net.us("w.end").alias("end_us"), "src_ip", "packets", "bytes")
    )


def top_talkers(per_source: DataFrame, n: int = 10) -> DataFrame:
    """The n largest sources by bytes per window (on a table, or inside foreachBatch)."""
    w = Window.partitionBy("feed", "end_us").orderBy(F.desc("bytes"), "src_ip")
    return per_source.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def second_metrics(live: DataFrame) -> DataFrame:
    """One row per feed and second: counts, protocols, and a distinct-count sketch of the
    source–destination pairs. All sliding metrics follow from these rows."""
    proto = F.upper("protocol")
    pair = F.concat_ws("\u0000", "src_ip", "dst_ip")
    return (
        live.groupBy("feed", F.window("ts", "1 second").alias("w"))
        .agg(
            F.count("*").alias("packets"),
            F.sum("size").alias("bytes"),
            *[F.count_if(proto == p).alias(f"{p.lower()}_packets") for p in SHOWN_PROTOCOLS],
            F.count_if(~proto.isin(*SHOWN_PROTOCOLS)).alias("other_packets"),
            F.collect_set(proto).alias("protocols"),
            F.hll_sketch_agg(pair, 14).alias("sketch"),
        )
        .withColumn("second_us", net.us("w.end"))
        .drop("w")
    )


def _blocks(seconds: DataFrame, width: int, *columns: str) -> DataFrame:
    """(feed, block, items): the second rows of every block of ``width`` seconds and of the block
    before it, in order. They hold all windows of that width that end in the block, so a row goes
    to two groups and not to ``width`` windows."""
    block = F.floor(F.col("second_us") / (width * 1_000_000)).cast("long")
    placed = seconds.select("feed", F.explode(F.array(block, block + 1)).alias("block"), F.struct("second_us", "sketch", *columns).alias("item"))
    grouped = placed.groupBy("feed", "block").agg(F.collect_list("item").alias("items"))
    return grouped.withColumn("items", F.array_sort("items", lambda x, y: (x["second_us"] - y["second_us"]).cast("int")))


def _united(items) -> Column:
    """The union of the sketches up to each of the items."""

    def add(done, item):
        union = F.coalesce(F.hll_union(F.get(done, F.size(done) - 1)["sketch"], item["sketch"]), item["sketch"])
        return F.concat(done, F.array(F.struct(item["second_us"].alias("second_us"), union.alias("sketch"))))

    return F.aggregate(items, F.array().cast("array<struct<second_us:bigint,sketch:binary>>"), add)


def _windows(seconds: DataFrame, width: int, *columns: str) -> DataFrame:
    """(feed, end_us, connections, items) of every window of ``width`` seconds that holds a second:
    the estimate of its pairs, and the items of its block.

    A window is the end of one block and the beginning of the next, so the unions that run
    backwards over the former and forwards over the latter give all windows of a block."""
    start = F.col("block") * (width * 1_000_000)
    halves = _blocks(seconds, width, *columns).withColumns(
        {
            "former": _united(F.reverse(F.filter("items", lambda x: x["second_us"] < start))),
            "latter": _united(F.filter("items", lambda x: x["second_us"] >= start)),
        }
    )
    ends = halves.withColumn("end_us", F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: start + k.cast("long") * 1_000_000)))
    end = F.col("end_us")
    former = F.filter("former", lambda x: x["second_us"] > end - width * 1_000_000)
    latter = F.filter("latter", lambda x: x["second_us"] <= end)
    parts = ends.withColumns({c: F.get(f, F.size(f) - 1)["sketch"] for c, f in (("former", former), ("latter", latter))})
    union = F.coalesce(F.hll_union("former", "latter"), "former", "latter")
    return parts.select("feed", "end_us", F.hll_sketch_estimate(union).alias("connections"), "items").where("connections IS NOT NULL")


def active_connections(seconds: DataFrame, width: int = ACTIVE) -> DataFrame:
    """Pairs seen in the last ``width`` seconds at every second, from the sketches."""
    return _windows(seconds, width).select("feed", "end_us", F.col("connections").alias("active_connections"))


def live_metrics(seconds: DataFrame, width: int = WIDTH, active: int = ACTIVE) -> DataFrame:
    """Sliding-window metrics with the active pairs of the last minute, from second rows.

    The narrower window takes the youngest ``width`` seconds of the ``active`` ones, so one
    grouping serves both.
    """
    counts = ["packets", "bytes", *[f"{p.lower()}_packets" for p in SHOWN_PROTOCOLS], "other_packets"]
    end, reach = F.col("end_us"), min(width, active) * 1_000_000
    young = F.filter("items", lambda x: (x["second_us"] <= end) & (x["second_us"] > end - reach))
    windows = _windows(seconds, active, *counts, "protocols").withColumn("items", young)

    def known(column: str):
        return F.array_compact(F.transform("items", lambda x: x[column]))

    def total(column: str):
        return F.aggregate(known(column), F.lit(None).cast("long"), lambda done, x: F.coalesce(done, F.lit(0).cast("long")) + x)

    return (
        windows.select(
            "feed",
            "end_us",
            *[total(c).alias(c) for c in counts],
            F.array_sort(F.array_distinct(F.flatten(known("protocols")))).alias("protocols"),
            "connections",
        )
        .where(F.col("packets").isNotNull())
        .withColumns(
            {
                "packets_per_second": F.col("packets") / width,
                "bytes_per_second": F.col("bytes") / width,
                "bits_per_second": F.col("bytes") * 8 / width,
            }
        )
    )


def active_connections_exact(live: DataFrame, width: int = ACTIVE) -> DataFrame:
    """The same, counted exactly; pairs are reduced to one row per second first.

    A pair's second makes it active until ``width`` seconds later, from itself or from where its
    second before ends. So it adds one at one time and takes one off at another, and the sums of
    these, added up along time, are the counts. Packets without a time have a count of their own."""
    span = width * 1_000_000
    second = (F.floor(net.us("ts") / 1_000_000).cast("long") + 1) * 1_000_000
    pairs = live.select("feed", second.alias("second_us"), "src_ip", "dst_ip").distinct()
    before = F.lag("second_us").over(Window.partitionBy("feed", "src_ip", "dst_ip").orderBy("second_us"))
    now = F.col("second_us")
    closed = F.struct((now + span).alias("at_us"), F.lit(-1).cast("long").alias("change"))
    steps = pairs.select("feed", now, before.alias("before_us"))
    opened = F.struct(F.greatest(now, F.col("before_us") + span).alias("at_us"), F.lit(1).cast("long").alias("change"))
    steps = steps.select("feed", F.inline(F.when(now.isNull(), F.array(opened)).otherwise(F.array(opened, closed))))
    steps = checkpointed(steps.groupBy("feed", "at_us").agg(F.sum("change").alias("change")))
    timed = steps.where("at_us IS NOT NULL")
    counted = scan(timed, ["feed"], [F.col("at_us")], time_chunk(F.col("at_us"), _DAY_US), sums={"active": F.col("change")})
    bounded = scan(counted, ["feed"], [-F.col("at_us")], time_chunk(-F.col("at_us"), _DAY_US), last={"next_us": F.col("at_us")}).where("active > 0")
    ends = F.explode(F.sequence(F.col("at_us"), F.col("next_us") - 1_000_000, F.lit(1_000_000).cast("long")))
    timeless = steps.where("at_us IS NULL").select("feed", F.col("at_us").alias("end_us"), F.col("change").alias("active_connections"))
    return bounded.select("feed", ends.alias("end_us"), F.col("active").alias("active_connections")).unionByName(timeless)


def connection_table(live: DataFrame) -> DataFrame:
    """First seen, last seen, packets and bytes per pair (update mode; state grows with pairs)."""
    return live.groupBy("feed", "src_ip", "dst_ip").agg(
        F.min(net.us("ts")).alias("first_seen_us"),
        F.max(net.us("ts")).alias("last_seen_us"),
        F.count("*").alias("packets"),
        F.sum("size").alias("bytes"),
    )


def expiring_connections(live: DataFrame, ttl: str = "300 seconds") -> DataFrame:
    """The same with bounded state: a pair silent for ``ttl`` is emitted and dropped."""
    s = F.session_window("ts", ttl).alias("s")
    return (
        live.groupBy("feed", "src_ip", "dst_ip", s)
        .agg(
            F.max(net.us("ts")).alias("last_seen_us"),
            F.count("*").alias("packets"),
            F.sum("size").alias("bytes"),
        )
        .select(
            "feed", "src_ip", "dst_ip", net.us("s.start").alias("first_seen_us"),
            "last_seen_us", "packets", "bytes",
        )
    )


def threshold_alerts(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Windows over the packet or bit rate limit; a window can exceed both."""

    def alert(column: str, limit: float, type_: str, title: str):
        return F.when(
            F.col(column) > limit,
            F.struct(
                F.lit(type_).alias("type"),
                F.lit("high").alias("severity"),
                F.lit("performance").alias("category"),
                F.lit(title).alias("title"),
                F.col(column).alias("value"),
            ),
        )

    hits = F.array_compact(
        F.array(
            alert("packets_per_second", t.high_pps, "high_pps", "High Packet Rate Detected"),
            alert("bits_per_second", t.high_bps, "high_bps", "High Bandwidth Utilization"),
        )
    )
    return metrics.select("feed", "end_us", F.explode(hits).alias("a")).select("feed", "end_us", "a.*")


def source_activity(live: DataFrame, width: int = WIDTH, slide: int = SLIDE) -> DataFrame:
    """Packets and distinct destination ports per window and source (65,536 ports at most)."""
    return (
        live.where(F.col("src_ip").isNotNull() & (F.col("dst_port") != 0))
        .groupBy("feed", _window(width, slide), "src_ip")
        .agg(F.count("*").alias("packets"), F.size(F.collect_set("dst_port")).alias("ports"))
        .select("feed", net.us("w.end").alias("end_us"), "src_ip", "packets", "ports")
    )


def security_alerts(activity: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Port scans and floods among the source activity rows."""

    def alert(column: str, limit: int, type_: str, severity: str, title: str):
        return F.when(
            F.col(column) > limit,
            F.struct(
                F.lit(type_).alias("type"),
                F.lit(severity).alias("severity"),
                F.lit("security").alias("category"),
                F.lit(title).alias("title"),
                F.col(column).cast("double").alias("value"),
            ),
        )

    hits = F.array_compact(
        F.array(
            alert("ports", t.suspicious_port_scan, "port_scan", "high", "Potential Port Scan Detected"),
            alert("packets", t.ddos_threshold, "ddos", "critical", "Potential DDoS Attack"),
        )
    )
    return activity.select("feed", "end_us", "src_ip", F.explode(hits).alias("a")).select(
        "feed", "end_us", "src_ip", "a.*"
    )


def idle_sessions(live: DataFrame, gap: str = "300 seconds") -> DataFrame:
    """Sessions of a source–destination pair that end after an idle gap (append mode)."""
    return (
        live.groupBy("feed", "src_ip", "dst_ip", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"))
        .select(
            "feed", "src_ip", "dst_ip", net.us("s.start").alias("start_us"),
            net.us("s.end").alias("end_us"), "packets", "bytes",
        )
    )


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks dropped, over the whole life of each query: add it to the
    session before the query starts (``spark.streams.addListener``)."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, query: StreamingQuery) -> int:
        return self.dropped.get(str(query.id), 0)


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return root


def _write_batch(df: DataFrame, table: str, batch_id: int) -> None:
    """One folder per micro-batch: a replayed batch overwrites its own rows."""
    df.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def read_table(spark: SparkSession, table: str, like: DataFrame) -> DataFrame:
    """A sink table read back with the schema of ``like``; empty before the first batch."""
    schema = T.StructType([*like.schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(table)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def current(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The present state of a sink table: after update mode the newest row of each key, after
    complete mode (no keys) the rows of the newest batch."""
    if keys is None:
        newest = table.agg(F.max("batch_id").alias("batch_id"))
        return table.join(F.broadcast(newest), "batch_id", "left_semi").drop("batch_id")
    rest = [c for c in table.columns if c not in keys and c != "batch_id"]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_newest"))
    return newest.select(*keys, "_newest.*")


def metrics_history(table: DataFrame, limit: int = 100) -> DataFrame:
    """The newest metric rows, 1,000 at most."""
    return table.orderBy(F.desc("end_us"), "feed").limit(min(limit, MAX_HISTORY))


def run_metrics(
    live: DataFrame,
    out: str,
    thresholds: Callable[[], Thresholds] = Thresholds,
    checkpoint: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Keep ``out/seconds``, ``out/metrics`` and ``out/alerts`` up to date from one feed.

    The stream only aggregates to one row per feed and second (append mode: a second comes
    once, when the watermark has passed it). Sliding windows, the last minute's active
    pairs, limits and the rolling baseline are worked out per batch from those few rows. A
    batch reads earlier batches back from the sinks, never its own, so a replay gives the
    same. Limits are read per batch and may change while the query runs.
    """
    spark = live.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            newest = batch.agg(F.max("second_us")).first()[0]
            if newest is None:
                return
            _write_batch(batch, f"{out}/seconds", batch_id)
            stored = read_table(spark, f"{out}/seconds", batch).where(F.col("batch_id") < batch_id)
            bounds = batch.groupBy("feed").agg(
                F.min("second_us").alias("first_us"), F.max("second_us").alias("to_us")
            )
            before = stored.groupBy("feed").agg(F.max("second_us").alias("from_us"))
            span = bounds.join(before, "feed", "left").withColumn(
                "from_us", F.coalesce("from_us", F.col("first_us") - 1)
            )
            # Windows that end after the previous batch also hold seconds from before it.
            reach = span.select("feed", (F.col("from_us") - ACTIVE * 1_000_000).alias("reach_us"))
            recent = (
                stored.drop("batch_id")
                .join(reach, "feed")
                .where(F.col("second_us") > F.col("reach_us"))
                .drop("reach_us")
            )
            metrics = (
                live_metrics(batch.unionByName(recent))
                .join(span.select("feed", "from_us", "to_us"), "feed")
                .where((F.col("end_us") > F.col("from_us")) & (F.col("end_us") <= F.col("to_us")))
                .drop("from_us", "to_us")
                .persist()
            )
            try:
                _write_batch(metrics, f"{out}/metrics", batch_id)
                newest_first = Window.partitionBy("feed").orderBy(F.desc("end_us"))
                earlier = (
                    read_table(spark, f"{out}/metrics", metrics)
                    .where(F.col("batch_id") < batch_id)
                    .withColumn("n", F.row_number().over(newest_first))
                    .where(F.col("n") <= HISTORY)
                    .drop("n", "batch_id")
                )
                marked = earlier.withColumn("new", F.lit(False)).unionByName(
                    metrics.withColumn("new", F.lit(True))
                )
                found = baseline_anomalies(marked).where("new")
                alerts = threshold_alerts(metrics, thresholds()).unionByName(
                    found.select(
                        "feed", "end_us", "type", "severity", F.lit("anomaly").alias("category"),
                        F.lit("Anomaly Detected").alias("title"), "value",
                    )
                )
                _write_batch(alerts, f"{out}/alerts", batch_id)
            finally:
                metrics.unpersist()
        finally:
            batch.unpersist()

    return (
        second_metrics(live)
        .writeStream.outputMode("append")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint or f"{checkpoint_root(spark)}/live_metrics")
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def run_table(
    aggregate: DataFrame,
    table: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    checkpoint: str | None = None,
    mode: str = "append",
    **trigger,
) -> StreamingQuery:
    """Any of the aggregates to a table, through a per-batch step (ranking, alerts). In update and
    complete mode a batch repeats what it changes: read the table through ``current``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch(transform(batch), table, batch_id)

    name = table.rstrip("/").rsplit("/", 1)[-1]
    return (
        aggregate.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option(
            "checkpointLocation", checkpoint or f"{checkpoint_root(aggregate.sparkSession)}/{name}"
        )
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )

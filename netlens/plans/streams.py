"""The packets played as a live feed: each query runs a stream to its end."""

from pyspark.sql import functions as F

from netlens.plans import protocols
from netlens.plans.live import _R1, _R3
from netlens.plans.registry import query
from netlens.plans.shape import rounded
from netlens.sources import derived
from netlens.streaming import live, pairing, replay

#: Time of the row that ends a feed, and limits within which nothing of it times out before.
_LONG_US = 20 * 365 * 86_400_000_000


def _end():
    return F.lit("2100-01-01 00:00:00").cast("timestamp")


def _one_feed(sql: str) -> str:
    """The SQL of the live aggregates with all captures as one feed."""
    return sql.replace("capture_id AS feed", "'live' AS feed").replace("capture_id\n AS feed", "'live' AS feed")


@query("j1_http_transactions_stream", protocols._HTTP + "SELECT * FROM tx")
def j1_stream(spark, sf):
    end = {"ts": _end(), "http_method": F.lit("END")}
    paired = replay.replayed(derived.packets(spark, sf), end, lambda s: pairing.http_transactions(s, timeout_us=_LONG_US))
    return paired.where("capture_id IS NOT NULL")


@query("j2_dns_transactions_stream", protocols._DNS + "SELECT * FROM tx")
def j2_stream(spark, sf):
    end = {"ts": _end(), "dns_query": F.lit("end")}
    paired = replay.replayed(derived.packets(spark, sf), end, lambda s: pairing.dns_transactions(s, timeout_us=_LONG_US))
    return paired.where("capture_id IS NOT NULL")


# Unanswered queries leave after 20 ms; answers take 35 ms at least, so none is in time.
@query(
    "j2_dns_timeouts_stream",
    """SELECT capture_id, src_ip AS client_ip, frame_number AS query_frame, dns_query AS domain, 'TIMEOUT' AS outcome
FROM (SELECT *, lead(us) OVER (PARTITION BY capture_id, least(src_ip, dst_ip), greatest(src_ip, dst_ip), CASE WHEN dns_qr = 0 THEN src_port ELSE dst_port END
        ORDER BY us, frame_number) AS next FROM packets WHERE dns_qr IS NOT NULL)
WHERE dns_qr = 0 AND (next IS NULL OR next - us > 20000)""",
)
def j2_timeouts(spark, sf):
    end = {"ts": _end(), "dns_query": F.lit("end")}
    paired = replay.replayed(derived.packets(spark, sf), end, lambda s: pairing.dns_transactions(s, timeout_us=20_000))
    return paired.where("capture_id IS NOT NULL AND outcome = 'TIMEOUT'").select("capture_id", "client_ip", "query_frame", "domain", "outcome")


@query(
    "r4_connections_stream",
    """SELECT capture_id AS feed, src_ip, dst_ip, min(us) AS first_seen_us, max(us) AS last_seen_us, count(*) AS packets,
  sum(packet_size)::BIGINT AS bytes FROM packets GROUP BY 1, 2, 3""",
)
def r4_stream(spark, sf):
    feed = live.from_packets(derived.packets(spark, sf))
    table = replay.replayed(feed, {"ts": _end()}, lambda s: pairing.connections(s.withWatermark("ts", live.LATENESS), _LONG_US), "update")
    return table.where("closed AND feed IS NOT NULL").drop("closed")


def _delivered(spark, sf) -> str:
    """The packets as live packets in JSON files."""
    place = replay.folder(spark)
    rows = derived.packets(spark, sf).select("src_ip", "dst_ip", "protocol", F.col("packet_size").alias("size"), "dst_port", (F.unix_micros("ts") / 1e6).alias("timestamp"))
    replay.deliver(rows, {"timestamp": F.unix_micros(_end()) / 1e6}, f"{place}/in", "json")
    return place


@query(
    "s9_live_windows_stream",
    _one_feed(_R1)
    + """SELECT feed, end_us, packets, bytes, tcp_packets, udp_packets, icmp_packets, other_packets,
  array_to_string(protocols, ',') AS protocols FROM m""",
)
def s9(spark, sf):
    place = _delivered(spark, sf)
    metrics = live.window_metrics(live.read_live(spark, f"{place}/in")).drop("packets_per_second", "bytes_per_second", "bits_per_second")
    live.run_table(metrics, f"{place}/out", checkpoint=f"{place}/state", availableNow=True).awaitTermination()
    return live.read_table(spark, f"{place}/out", metrics).drop("batch_id").withColumn("protocols", F.concat_ws(",", "protocols"))


@query(
    "s10_live_sinks_stream",
    _one_feed(_R1 + _R3)
    + """SELECT feed, end_us, packets, bytes, array_to_string(protocols, ',') AS protocols, round(packets / 5, 6) AS packets_per_second,
  active_connections AS connections FROM m JOIN ac USING (feed, end_us)
WHERE end_us <= (SELECT (max(us) // 1000000 + 1) * 1000000 FROM packets)""",
)
def s10(spark, sf):
    place = _delivered(spark, sf)
    feed = live.read_live(spark, f"{place}/in")
    live.run_metrics(feed, f"{place}/out", checkpoint=f"{place}/state", availableNow=True).awaitTermination()
    like = live.live_metrics(live.second_metrics(live.from_packets(derived.packets(spark, sf))))
    metrics = live.read_table(spark, f"{place}/out/metrics", like)
    return rounded(metrics.select("feed", "end_us", "packets", "bytes", F.concat_ws(",", "protocols").alias("protocols"), "packets_per_second", "connections"))

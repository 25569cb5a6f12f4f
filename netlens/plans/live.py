"""The live aggregates run on a table: what the stream gives in complete mode."""

from pyspark.sql import functions as F

from netlens.plans.registry import query
from netlens.plans.shape import rounded
from netlens.sources import derived
from netlens.streaming import live
from netlens.streaming.baseline import baseline_anomalies

_SLIDE = ", sl AS (SELECT p.*, (us // 1000000 + k) * 1000000 AS end_us FROM packets p, generate_series(1, 5) g(k))\n"
_R1 = (
    _SLIDE
    + """, m AS (SELECT capture_id AS feed, end_us, count(*) AS packets, sum(packet_size)::BIGINT AS bytes,
   count(*) FILTER (protocol = 'TCP') AS tcp_packets, count(*) FILTER (protocol = 'UDP') AS udp_packets,
   count(*) FILTER (protocol = 'ICMP') AS icmp_packets, count(*) FILTER (protocol NOT IN ('TCP', 'UDP', 'ICMP')) AS other_packets,
   list_sort(list(DISTINCT protocol)) AS protocols FROM sl GROUP BY 1, 2)
"""
)


def _feed(spark, sf):
    return live.from_packets(derived.packets(spark, sf))


@query(
    "r1_window_metrics",
    _R1
    + """SELECT feed, end_us, packets, bytes, tcp_packets, udp_packets, icmp_packets, other_packets,
  array_to_string(protocols, ',') AS protocols, round(packets / 5, 6) AS packets_per_second,
  round(bytes / 5, 6) AS bytes_per_second, round(bytes * 8 / 5, 6) AS bits_per_second FROM m""",
)
def r1(spark, sf):
    return rounded(
        live.window_metrics(_feed(spark, sf)).withColumn("protocols", F.concat_ws(",", "protocols"))
    )


@query(
    "r2_window_top_talkers",
    _SLIDE
    + """SELECT feed, end_us, src_ip, packets, bytes, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY feed, end_us
   ORDER BY bytes DESC, src_ip) AS rank FROM (SELECT capture_id AS feed, end_us, src_ip, count(*) AS packets,
   sum(packet_size)::BIGINT AS bytes FROM sl GROUP BY 1, 2, 3)) WHERE rank <= 10""",
)
def r2(spark, sf):
    return live.top_talkers(live.talkers(_feed(spark, sf)))


_R3 = """, ac AS (SELECT feed, end_us, count(*) AS active_connections FROM (SELECT DISTINCT capture_id AS feed,
   (us // 1000000 + k) * 1000000 AS end_us, src_ip, dst_ip FROM packets, generate_series(1, 60) g(k)) GROUP BY 1, 2)
"""


@query("r3_active_connections", _R3 + "SELECT * FROM ac")
def r3(spark, sf):
    return live.active_connections_exact(_feed(spark, sf))


# A sketch of few pairs is exact, so the exact SQL applies here.
@query("r3_active_connections_sketch", _R3 + "SELECT * FROM ac")
def r3_sketch(spark, sf):
    return live.active_connections(live.second_metrics(_feed(spark, sf)))


@query(
    "r1_r3_live_metrics",
    _R1
    + _R3
    + """SELECT feed, end_us, packets, bytes, tcp_packets, udp_packets, icmp_packets, other_packets,
  array_to_string(protocols, ',') AS protocols, round(packets / 5, 6) AS packets_per_second,
  round(bytes / 5, 6) AS bytes_per_second, round(bytes * 8 / 5, 6) AS bits_per_second, active_connections AS connections
FROM m JOIN ac USING (feed, end_us)""",
)
def r1_r3(spark, sf):
    m = live.live_metrics(live.second_metrics(_feed(spark, sf)))
    return rounded(m.withColumn("protocols", F.concat_ws(",", "protocols")))


@query(
    "r4_connection_table",
    """SELECT capture_id AS feed, src_ip, dst_ip, min(us) AS first_seen_us, max(us) AS last_seen_us, count(*) AS packets,
  sum(packet_size)::BIGINT AS bytes FROM packets GROUP BY 1, 2, 3""",
)
def r4(spark, sf):
    return live.connection_table(_feed(spark, sf))


@query(
    "r5_threshold_alerts",
    _R1
    + """SELECT feed, end_us, 'high_pps' AS type, 'high' AS severity, 'performance' AS category, 'High Packet Rate Detected' AS title,
  round(packets / 5, 6) AS value FROM m WHERE packets / 5 > 1
UNION ALL SELECT feed, end_us, 'high_bps', 'high', 'performance', 'High Bandwidth Utilization', round(bytes * 8 / 5, 6)
  FROM m WHERE bytes * 8 / 5 > 3000""",
)
def r5(spark, sf):
    limits = live.Thresholds().updated(high_pps=1, high_bps=3000)
    return rounded(live.threshold_alerts(live.window_metrics(_feed(spark, sf)), limits))


@query(
    "r6_security_alerts",
    _SLIDE
    + """, a AS (SELECT capture_id AS feed, end_us, src_ip, count(*) AS packets, count(DISTINCT dst_port) AS ports FROM sl
   WHERE dst_port <> 0 GROUP BY 1, 2, 3)
SELECT feed, end_us, src_ip, 'port_scan' AS type, 'high' AS severity, 'security' AS category, 'Potential Port Scan Detected' AS title,
  ports::DOUBLE AS value FROM a WHERE ports > 1
UNION ALL SELECT feed, end_us, src_ip, 'ddos', 'critical', 'security', 'Potential DDoS Attack', packets::DOUBLE FROM a WHERE packets > 3""",
)
def r6(spark, sf):
    limits = live.Thresholds().updated(suspicious_port_scan=1, ddos_threshold=3)
    return live.security_alerts(live.source_activity(_feed(spark, sf)), limits)


@query(
    "w10_r7_baseline_anomalies",
    _R1
    + _R3
    + """, j AS (SELECT m.*, packets / 5 AS pps, active_connections AS c FROM m JOIN ac USING (feed, end_us)),
b AS (SELECT *, count(*) OVER w AS h, avg(pps) OVER w AS ap, avg(c) OVER w AS acn, flatten(list(protocols) OVER w) AS seen FROM j
   WINDOW w AS (PARTITION BY feed ORDER BY end_us ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
k AS (SELECT * FROM b WHERE h >= 10)
SELECT feed, end_us, 'traffic_spike' AS type, 'high' AS severity, round(pps, 6) AS value, NULL::VARCHAR AS protocol FROM k WHERE pps > ap * 3
UNION ALL SELECT feed, end_us, 'connection_surge', 'medium', c::DOUBLE, NULL FROM k WHERE c > acn * 2
UNION ALL SELECT feed, end_us, 'new_protocol', 'medium', 1, p FROM (SELECT feed, end_us, seen, unnest(protocols) AS p FROM k)
  WHERE NOT list_contains(seen, p)""",
)
def w10(spark, sf):
    return rounded(baseline_anomalies(live.live_metrics(live.second_metrics(_feed(spark, sf)))))

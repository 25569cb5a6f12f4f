from pyspark.sql import functions as F

from netlens.functions import measures, net
from netlens.functions.net import CONVERSATION
from netlens.operators import flows, tcp
from netlens.plans.registry import query
from netlens.plans.shape import rounded
from netlens.sources import derived

_CONV = "capture_id, lo_ip, lo_port, hi_ip, hi_port"


@query(
    "a7_conversations",
    f"""SELECT {_CONV}, count(*) AS packets, sum(packet_size)::BIGINT AS bytes,
  arg_max(CASE WHEN protocol IN ('TCP', 'UDP') THEN protocol ELSE 'IP' END, frame_number) AS protocol
FROM conv_packets GROUP BY {_CONV}""",
)
def a7(spark, sf):
    return flows.conversations(derived.packets(spark, sf))


@query(
    "t1_top_conversations",
    f""", c AS (SELECT {_CONV}, count(*) AS packets, sum(packet_size)::BIGINT AS bytes,
  arg_max(CASE WHEN protocol IN ('TCP', 'UDP') THEN protocol ELSE 'IP' END, frame_number) AS protocol
  FROM conv_packets GROUP BY {_CONV})
SELECT {_CONV}, packets, bytes, protocol, rank::INT AS rank, total_conversations FROM (SELECT *,
  row_number() OVER (PARTITION BY capture_id ORDER BY packets DESC, lo_ip, lo_port, hi_ip, hi_port) AS rank,
  count(*) OVER (PARTITION BY capture_id) AS total_conversations FROM c) WHERE rank <= 20""",
)
def t1(spark, sf):
    return flows.top_conversations(derived.packets(spark, sf))


_A8 = f""", f AS (SELECT {_CONV},
   arg_min(src_ip, frame_number) AS f_src, arg_min(dst_ip, frame_number) AS f_dst,
   arg_min(coalesce(src_port, -1), frame_number) AS f_sp, arg_min(coalesce(dst_port, -1), frame_number) AS f_dp,
   arg_min(protocol, frame_number) AS protocol, arg_min(us, frame_number) AS start_us,
   arg_max(us, frame_number) AS end_us, count(*) AS packets, sum(packet_size)::BIGINT AS bytes
   FROM conv_packets GROUP BY {_CONV}),
s AS (SELECT {_CONV}, protocol, start_us, end_us, packets, bytes,
   CASE WHEN lo_port <> 0 AND f_sp < f_dp THEN f_dst ELSE f_src END AS client_ip,
   nullif(CASE WHEN lo_port <> 0 AND f_sp < f_dp THEN f_dp ELSE f_sp END, -1) AS client_port,
   CASE WHEN lo_port <> 0 AND f_sp < f_dp THEN f_src ELSE f_dst END AS server_ip,
   nullif(CASE WHEN lo_port <> 0 AND f_sp < f_dp THEN f_sp ELSE f_dp END, -1) AS server_port FROM f),
d AS (SELECT s.*, q.client_packets, q.client_bytes, s.packets - q.client_packets AS server_packets,
   s.bytes - q.client_bytes AS server_bytes FROM s JOIN (
     SELECT {", ".join("p." + c for c in _CONV.split(", "))},
       count(*) FILTER (p.src_ip = s.client_ip) AS client_packets,
       coalesce(sum(packet_size) FILTER (p.src_ip = s.client_ip), 0)::BIGINT AS client_bytes
     FROM conv_packets p JOIN s USING ({_CONV})
     GROUP BY {", ".join("p." + c for c in _CONV.split(", "))}) q USING ({_CONV}))
"""


@query(
    "a8_conversation_flows",
    _A8
    + """SELECT *, round((end_us - start_us) / 1e6, 6) AS duration_s,
  round(CASE WHEN end_us > start_us THEN bytes * 1e6 / (end_us - start_us) ELSE 0 END, 6) AS bytes_per_second,
  round(CASE WHEN end_us > start_us THEN packets * 1e6 / (end_us - start_us) ELSE 0 END, 6) AS packets_per_second,
  round(CASE WHEN bytes > 0 THEN client_bytes / bytes ELSE 0.5 END, 6) AS asymmetry,
  packets >= 4 AND client_packets > 0 AND server_packets > 0 AS interactive FROM d""",
)
def a8(spark, sf):
    return rounded(flows.conversation_flows(derived.packets(spark, sf)))


_W4 = f""", head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_CONV} ORDER BY frame_number) AS n
   FROM conv_packets WHERE protocol = 'TCP') WHERE n <= 10),
run AS (SELECT *, max((tcp_flags & 18 = 2)::INT) OVER w AS syn_seen, max((tcp_flags & 18 = 18)::INT) OVER w AS sa_seen
   FROM head WINDOW w AS (PARTITION BY {_CONV} ORDER BY frame_number ROWS UNBOUNDED PRECEDING)),
hs AS (SELECT {_CONV}, max(n) >= 3 AND bool_or(tcp_flags & 18 = 16 AND syn_seen = 1 AND sa_seen = 1) AS handshake_complete
   FROM run GROUP BY {_CONV})
"""


@query("w4_handshakes", _W4 + f"SELECT {_CONV}, handshake_complete FROM hs")
def w4(spark, sf):
    return flows.handshakes(derived.packets(spark, sf))


_A9 = (
    _W4
    + f""", st AS (SELECT {_CONV}, count(*) AS packets, sum(packet_size)::BIGINT AS bytes, min(us) AS start_us,
  max(us) AS end_us, count(*) FILTER (tcp_flags & 2 <> 0) AS syn_packets,
  count(*) FILTER (tcp_flags & 1 <> 0) AS fin_packets, count(*) FILTER (tcp_flags & 4 <> 0) AS rst_packets,
  arg_min(src_port, frame_number) AS sp, arg_min(dst_port, frame_number) AS dp,
  arg_min(src_ip, frame_number) AS si, arg_min(dst_ip, frame_number) AS di
  FROM conv_packets WHERE protocol = 'TCP' GROUP BY {_CONV})
"""
)


@query(
    "a9_tcp_streams",
    _A9
    + f"""SELECT {_CONV}, packets, bytes, start_us, end_us, handshake_complete,
  CASE WHEN sp < dp THEN si ELSE di END AS low_port_ip, least(sp, dp) AS low_port,
  CASE WHEN sp < dp THEN di ELSE si END AS high_port_ip, greatest(sp, dp) AS high_port
FROM st JOIN hs USING ({_CONV})""",
)
def a9(spark, sf):
    return flows.tcp_streams(derived.packets(spark, sf)).select(
        *CONVERSATION,
        "packets",
        "bytes",
        "start_us",
        "end_us",
        "handshake_complete",
        "low_port_ip",
        "low_port",
        "high_port_ip",
        "high_port",
    )


@query(
    "a10_udp_flows",
    f"""SELECT {_CONV}, count(*) AS packets, sum(packet_size)::BIGINT AS bytes, min(us) AS start_us, max(us) AS end_us,
  arg_min(src_ip, frame_number) AS src_ip, arg_min(src_port, frame_number) AS src_port,
  arg_min(dst_ip, frame_number) AS dst_ip, arg_min(dst_port, frame_number) AS dst_port
FROM conv_packets WHERE protocol = 'UDP' GROUP BY {_CONV}""",
)
def a10(spark, sf):
    return flows.udp_flows(derived.packets(spark, sf))


@query(
    "a11_stream_metrics",
    _A9
    + f"""SELECT {_CONV}, packets, bytes, syn_packets, fin_packets, rst_packets, handshake_complete,
  round((end_us - start_us) / 1e6, 6) AS duration_s, round(bytes / packets, 6) AS avg_packet_size,
  round(CASE WHEN end_us > start_us THEN packets * 1e6 / (end_us - start_us) ELSE 0 END, 6) AS packets_per_second,
  round(CASE WHEN end_us > start_us THEN bytes * 1e6 / (end_us - start_us) ELSE 0 END, 6) AS bytes_per_second
FROM st JOIN hs USING ({_CONV})""",
)
def a11(spark, sf):
    return rounded(
        flows.tcp_streams(derived.packets(spark, sf)).select(
            *CONVERSATION,
            "packets",
            "bytes",
            "syn_packets",
            "fin_packets",
            "rst_packets",
            "handshake_complete",
            "duration_s",
            "avg_packet_size",
            "packets_per_second",
            "bytes_per_second",
        )
    )


_RETRANS = f""", rt AS (SELECT {_CONV}, sum(n - 1)::BIGINT AS retransmissions, sum(n) AS total FROM (
   SELECT {_CONV}, src_ip, src_port, tcp_seq, count(*) AS n FROM conv_packets WHERE protocol = 'TCP'
   GROUP BY ALL) GROUP BY {_CONV})
"""


@query(
    "a25_flow_statistics",
    _A8
    + _RETRANS
    + f"""SELECT capture_id, count(*) AS flows, count(*) FILTER (protocol = 'TCP') AS tcp_flows,
  count(*) FILTER (protocol = 'UDP') AS udp_flows, count(*) FILTER (protocol = 'ICMP') AS icmp_flows,
  round(sum(end_us - start_us)::BIGINT / count(*) / 1e6, 6) AS avg_duration_s,
  round(min(end_us - start_us) / 1e6, 6) AS min_duration_s, round(max(end_us - start_us) / 1e6, 6) AS max_duration_s,
  round(avg(CASE WHEN end_us > start_us THEN bytes * 1e6 / (end_us - start_us) ELSE 0 END), 6) AS mean_throughput,
  count(*) FILTER (retransmissions > 0) AS flows_with_retransmissions
FROM d LEFT JOIN rt USING ({_CONV}) GROUP BY 1""",
)
def a25(spark, sf):
    p = derived.packets(spark, sf)
    return rounded(flows.flow_summary(flows.conversation_flows(p), tcp.retransmissions(p)))


@query(
    "a25_flow_ports",
    _A8 + "SELECT capture_id, protocol, server_port, count(*) AS flows FROM d GROUP BY ALL",
)
def a25_ports(spark, sf):
    return flows.flow_port_distribution(flows.conversation_flows(derived.packets(spark, sf)))


@query(
    "a8_flow_quality",
    _A8
    + _RETRANS
    + f""", hm AS (SELECT *, lag(http_method) OVER w AS pm, lag(us) OVER w AS pu FROM conv_packets
   WHERE http_method IS NOT NULL OR http_status <> 0 WINDOW w AS (PARTITION BY {_CONV} ORDER BY frame_number)),
ht AS (SELECT {_CONV}, round(sum(us - pu)::BIGINT / count(*) / 1e6, 6) AS avg_response_time FROM hm
   WHERE http_method IS NULL AND pm IS NOT NULL GROUP BY {_CONV})
SELECT {_CONV}, client_ip, server_ip, packets, bytes, avg_response_time,
  round(retransmissions / total::BIGINT, 6) AS retransmission_rate
FROM d LEFT JOIN ht USING ({_CONV}) LEFT JOIN rt USING ({_CONV})""",
)
def a8_quality(spark, sf):
    p = derived.packets(spark, sf)
    return rounded(
        flows.with_quality(flows.conversation_flows(p), p).select(
            *CONVERSATION, "client_ip", "server_ip", "packets", "bytes", "avg_response_time",
            "retransmission_rate",
        )
    )


_W1 = """, g AS (SELECT *, us - lag(us) OVER (PARTITION BY capture_id, lo_ip, lo_port, hi_ip, hi_port
   ORDER BY us, frame_number) AS gap FROM conv_packets)
"""


@query(
    "w1_packet_gaps",
    _W1
    + f"""SELECT {_CONV}, count(gap) AS gaps, sum(gap)::BIGINT AS gap_sum_us,
  round(stddev_pop(gap / 1e6) + 1.3e-7, 6) AS gap_stddev_pop,
  round(stddev_samp(gap / 1e6) + 1.3e-7, 6) AS gap_stddev_samp
FROM g GROUP BY {_CONV}""",
)
def w1(spark, sf):
    g = flows.gap_statistics(derived.packets(spark, sf))
    return rounded(
        g.select(
            *CONVERSATION,
            "gaps",
            "gap_sum_us",
            # Two gaps differ by whole microseconds, so their deviation is often exactly
            # half of one; the offset keeps the rounding of both sides off that tie.
            (F.sqrt("gap_var_pop") + 1.3e-7).alias("gap_stddev_pop"),
            (F.sqrt("gap_var_samp") + 1.3e-7).alias("gap_stddev_samp"),
        )
    )


@query(
    "r8_idle_sessions",
    _W1
    + f""", n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 300000000 THEN 1 ELSE 0 END) OVER (
   PARTITION BY {_CONV} ORDER BY us, frame_number ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT {_CONV}, min(us) AS start_us, max(us) + 300000000 AS end_us, count(*) AS packets,
  sum(packet_size)::BIGINT AS bytes FROM n GROUP BY {_CONV}, s""",
)
def r8(spark, sf):
    return flows.idle_sessions(derived.packets(spark, sf))


@query(
    "w2_rtt_samples",
    f""", g AS (SELECT *, us - lag(us) OVER (PARTITION BY {_CONV} ORDER BY frame_number) AS gap
   FROM conv_packets WHERE protocol = 'TCP'),
s AS (SELECT *, CASE WHEN tcp_flags & 16 <> 0 AND gap BETWEEN 1000 AND 1000000 THEN gap END AS x FROM g)
SELECT {_CONV}, count(x) AS rtt_samples, round(sum(x)::BIGINT / count(x) / 1e6, 6) AS avg_rtt,
  round(min(x) / 1e6, 6) AS min_rtt, round(max(x) / 1e6, 6) AS max_rtt,
  round(var_samp(x / 1e6), 6) AS rtt_variance FROM s GROUP BY {_CONV}""",
)
def w2(spark, sf):
    return rounded(tcp.rtt_samples(derived.packets(spark, sf)))


_W3 = f""", hr AS (SELECT {_CONV}, CASE WHEN min(frame_number) FILTER (tcp_flags & 18 = 2)
      < min(frame_number) FILTER (tcp_flags & 18 = 18)
   THEN arg_min(us, frame_number) FILTER (tcp_flags & 18 = 18) - arg_min(us, frame_number) FILTER (tcp_flags & 18 = 2)
   END AS handshake_us FROM conv_packets WHERE protocol = 'TCP' GROUP BY {_CONV})
"""


@query("w3_handshake_rtt", _W3 + "SELECT * FROM hr")
def w3(spark, sf):
    return tcp.handshake_rtt(derived.packets(spark, sf))


@query(
    "w5_retransmissions",
    _RETRANS
    + f"SELECT {_CONV}, retransmissions, round(retransmissions / total::BIGINT, 6) AS retransmission_rate FROM rt",
)
def w5(spark, sf):
    return rounded(tcp.retransmissions(derived.packets(spark, sf)))


@query(
    "w5_retransmitted_packets",
    """SELECT capture_id, frame_number, src_ip, dst_ip, tcp_seq FROM (SELECT *, row_number() OVER (
   PARTITION BY capture_id, src_ip, src_port, dst_ip, dst_port, tcp_seq ORDER BY frame_number) AS n
   FROM packets WHERE protocol = 'TCP') WHERE n > 1""",
)
def w5_packets(spark, sf):
    return tcp.retransmitted_packets(derived.packets(spark, sf)).select(
        "capture_id", "frame_number", "src_ip", "dst_ip", "tcp_seq"
    )


@query(
    "w6_out_of_order",
    f""", o AS (SELECT *, tcp_seq < lag(tcp_seq) OVER (PARTITION BY capture_id, src_ip, src_port, dst_ip, dst_port
   ORDER BY frame_number) AS late FROM conv_packets WHERE protocol = 'TCP')
SELECT {_CONV}, count(*) FILTER (late) AS out_of_order_packets FROM o GROUP BY {_CONV}""",
)
def w6(spark, sf):
    return tcp.out_of_order(derived.packets(spark, sf))


@query(
    "w8_syn_spacing",
    """, h AS (SELECT * FROM (SELECT capture_id, us, frame_number, row_number() OVER (PARTITION BY capture_id
   ORDER BY frame_number) AS n FROM packets WHERE protocol = 'TCP' AND tcp_flags & 18 = 2) WHERE n <= 10),
g AS (SELECT capture_id, us - lag(us) OVER (PARTITION BY capture_id ORDER BY frame_number) AS gap FROM h)
SELECT capture_id, coalesce(round((sum(gap) FILTER (gap > 0))::BIGINT / count(*) FILTER (gap > 0) / 1e6, 6), 0) AS avg_syn_gap_s,
  coalesce(round(max(gap) FILTER (gap > 0) / 1e6, 6), 0) AS max_syn_gap_s FROM g GROUP BY 1""",
)
def w8(spark, sf):
    return rounded(tcp.syn_spacing(derived.packets(spark, sf)))


@query(
    "x1_keys",
    """SELECT frame_number, capture_id,
  CASE WHEN sp <> 0 THEN src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port
       ELSE src_ip || '->' || dst_ip END AS flow_key,
  CASE WHEN lo_port <> 0 THEN lo_ip || ':' || lo_port || '<->' || hi_ip || ':' || hi_port
       ELSE lo_ip || '<->' || hi_ip END AS conversation_key FROM conv_packets""",
)
def x1(spark, sf):
    return net.with_endpoints(derived.packets(spark, sf)).select(
        "frame_number",
        "capture_id",
        net.flow_key().alias("flow_key"),
        net.conversation_key().alias("conversation_key"),
    )


@query(
    "x3_epoch_millis",
    """SELECT frame_number, capture_id, coalesce(us // 1000, 0) AS ts_ms,
  0::BIGINT AS missing_ms FROM packets""",
)
def x3(spark, sf):
    def millis(ts):
        return F.coalesce(F.unix_millis(ts), F.lit(0).cast("long"))

    return derived.packets(spark, sf).select(
        "frame_number",
        "capture_id",
        millis(F.col("ts")).alias("ts_ms"),
        millis(F.lit(None).cast("timestamp")).alias("missing_ms"),
    )


_X4 = "capture_id, lo_ip, lo_port, hi_ip, hi_port, packets, bytes, client_packets, server_packets, client_bytes"


@query(
    "x4_rates",
    _A8
    + f"""SELECT {_CONV}, round((end_us - start_us) / 1e6, 6) AS duration_s,
  round(CASE WHEN end_us > start_us THEN bytes * 1e6 / (end_us - start_us) ELSE 0 END, 6) AS throughput,
  round(CASE WHEN end_us > start_us THEN packets * 1e6 / (end_us - start_us) ELSE 0 END, 6) AS packet_rate FROM d""",
)
def x4(spark, sf):
    f = flows.conversation_flows(derived.packets(spark, sf))
    return rounded(
        f.select(
            *CONVERSATION,
            "duration_s",
            F.col("bytes_per_second").alias("throughput"),
            F.col("packets_per_second").alias("packet_rate"),
        )
    )


@query(
    "x5_x6_asymmetry_interactive",
    _A8
    + f"""SELECT {_CONV}, round(CASE WHEN bytes > 0 THEN client_bytes / bytes ELSE 0.5 END, 6) AS asymmetry,
  packets >= 4 AND client_packets > 0 AND server_packets > 0 AS interactive FROM d""",
)
def x5(spark, sf):
    f = flows.conversation_flows(derived.packets(spark, sf))
    return rounded(
        f.select(
            *CONVERSATION,
            measures.asymmetry("client_bytes", "bytes").alias("asymmetry"),
            measures.interactive("packets", "client_packets", "server_packets").alias("interactive"),
        )
    )


@query(
    "x20_hour_weekday",
    f"""SELECT {_CONV}, hour(arg_min(ts, frame_number))::INT AS hour_of_day,
  (isodow(arg_min(ts, frame_number)) - 1)::INT AS weekday FROM conv_packets GROUP BY {_CONV}""",
)
def x20(spark, sf):
    first = (
        net.with_endpoints(derived.packets(spark, sf))
        .groupBy(*CONVERSATION)
        .agg(F.min_by("ts", "frame_number").alias("ts"))
    )
    return first.select(
        *CONVERSATION, F.hour("ts").alias("hour_of_day"), F.weekday("ts").alias("weekday")
    )

from pyspark.sql import functions as F

from netlens.functions import net
from netlens.functions.measures import human_duration, human_size
from netlens.operators import traffic
from netlens.plans.registry import query
from netlens.plans.shape import rounded
from netlens.sources import derived


@query(
    "s2_protocol_names",
    """SELECT capture_id, ip_proto, CASE ip_proto WHEN 1 THEN 'ICMP' WHEN 2 THEN 'IGMP'
  WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 41 THEN 'IPv6' WHEN 47 THEN 'GRE'
  WHEN 50 THEN 'ESP' WHEN 51 THEN 'AH' ELSE 'OTHER' END AS name, count(*) AS packets
FROM (SELECT capture_id, ip_proto FROM packets
      UNION ALL SELECT capture_id, frame_number % 60 FROM packets) GROUP BY ALL""",
)
def s2(spark, sf):
    p = derived.packets(spark, sf)
    numbers = p.select("capture_id", "ip_proto").unionByName(
        p.select("capture_id", (F.col("frame_number") % 60).cast("int").alias("ip_proto"))
    )
    return (
        numbers.groupBy("capture_id", F.col("ip_proto").cast("long").alias("ip_proto"))
        .agg(F.count("*").alias("packets"))
        .withColumn("name", net.protocol_name("ip_proto"))
    )


_FLAG_LIST = "[%s]" % ", ".join(
    f"CASE WHEN f & {bit} <> 0 THEN '{name}' END" for name, bit in net.TCP_FLAGS.items()
)


@query(
    "s3_flag_text",
    f""", raw AS (SELECT CASE frame_number % 3 WHEN 0 THEN '0x' || lower(hex(tcp_flags))
    WHEN 1 THEN tcp_flags::VARCHAR ELSE 'SYN?' || (tcp_flags % 2) END AS flag_text
  FROM packets WHERE tcp_flags IS NOT NULL),
num AS (SELECT flag_text, CASE WHEN flag_text LIKE '0x%' THEN flag_text::INT
    WHEN regexp_full_match(flag_text, '[0-9]+') THEN flag_text::INT END AS f FROM raw)
SELECT flag_text, CASE WHEN f IS NULL THEN flag_text
   ELSE array_to_string(list_filter({_FLAG_LIST}, lambda x: x IS NOT NULL), ',') END AS flags,
  count(*) AS packets FROM num GROUP BY ALL""",
)
def s3(spark, sf):
    f = F.col("tcp_flags")
    text = (
        F.when(F.col("frame_number") % 3 == 0, F.concat(F.lit("0x"), F.lower(F.hex(f))))
        .when(F.col("frame_number") % 3 == 1, f.cast("string"))
        .otherwise(F.concat(F.lit("SYN?"), (f % 2).cast("string")))
    )
    return (
        derived.packets(spark, sf)
        .where(f.isNotNull())
        .groupBy(text.alias("flag_text"))
        .agg(F.count("*").alias("packets"))
        .withColumn("flags", net.flag_text("flag_text"))
    )


@query(
    "s4_packet_scan",
    """SELECT capture_id, CAST(ts AS DATE)::VARCHAR AS dt, count(*) AS packets,
  sum(packet_size)::BIGINT AS bytes, sum(frame_number)::BIGINT AS frames,
  sum(tcp_seq)::BIGINT AS seqs, count(payload) AS payloads FROM packets GROUP BY 1, 2""",
)
def s4(spark, sf):
    p = derived.packets(spark, sf)
    return p.groupBy("capture_id", F.to_date("ts").cast("string").alias("dt")).agg(
        F.count("*").alias("packets"),
        F.sum("packet_size").alias("bytes"),
        F.sum("frame_number").alias("frames"),
        F.sum("tcp_seq").alias("seqs"),
        F.count("payload").alias("payloads"),
    )


@query(
    "a1_capture_totals",
    """, t AS (SELECT capture_id, count(*) AS packets, sum(packet_size)::BIGINT AS bytes,
  min(us) AS start_us, max(us) AS end_us FROM packets GROUP BY 1)
SELECT *, round((end_us - start_us) / 1e6, 6) AS duration_s,
  round(bytes / packets, 6) AS avg_packet_size,
  round(CASE WHEN end_us > start_us THEN packets * 1e6 / (end_us - start_us) ELSE 0 END, 6) AS packets_per_second,
  round(CASE WHEN end_us > start_us THEN bytes * 1e6 / (end_us - start_us) ELSE 0 END, 6) AS bytes_per_second,
  round(CASE WHEN end_us > start_us THEN bytes * 8 * 1e6 / (end_us - start_us) ELSE 0 END / 1048576, 6)
    AS throughput_mbps FROM t""",
)
def a1(spark, sf):
    return rounded(traffic.capture_totals(derived.packets(spark, sf)))


@query(
    "a2_protocol_labels",
    """SELECT capture_id, label, count(*) AS packets FROM (
  SELECT capture_id, protocol AS label FROM packets WHERE protocol IN ('TCP','UDP','ICMP','ARP')
  UNION ALL SELECT capture_id, 'DNS' FROM packets
    WHERE dns_query IS NOT NULL OR dns_response IS NOT NULL
  UNION ALL SELECT capture_id, 'HTTP' FROM packets WHERE protocol = 'TCP'
    AND (contains(payload, 'HTTP') OR contains(payload, 'GET') OR contains(payload, 'POST')))
GROUP BY ALL""",
)
def a2(spark, sf):
    return traffic.label_distribution(derived.packets(spark, sf))


@query(
    "a3_protocol_distribution",
    """, c AS (SELECT capture_id, upper(protocol) AS protocol, count(*) AS packets,
   sum(packet_size)::BIGINT AS bytes FROM packets GROUP BY 1, 2)
SELECT *, round(packets * 100.0 / (sum(packets) OVER (PARTITION BY capture_id))::DOUBLE, 6) AS percentage FROM c""",
)
def a3(spark, sf):
    return rounded(traffic.protocol_distribution(derived.packets(spark, sf)))


@query(
    "a4_protocol_counters",
    """SELECT capture_id, count(*) FILTER (protocol = 'TCP') AS tcp_packets,
  count(*) FILTER (protocol = 'UDP') AS udp_packets,
  count(*) FILTER (protocol = 'ICMP') AS icmp_packets,
  count(*) FILTER (http_method IS NOT NULL OR http_status <> 0) AS http_sessions,
  count(*) FILTER (tls_version IS NOT NULL OR src_port IN (443, 8443) OR dst_port IN (443, 8443)) AS https_sessions,
  count(*) FILTER (dns_query IS NOT NULL OR dns_response IS NOT NULL) AS dns_queries,
  count(*) FILTER (protocol = 'UDP' AND (src_port IN (67, 68) OR dst_port IN (67, 68))) AS dhcp_packets,
  count(*) FILTER (protocol = 'ARP') AS arp_packets
FROM packets GROUP BY 1""",
)
def a4(spark, sf):
    return traffic.protocol_counters(derived.packets(spark, sf))


@query(
    "a5_top_talkers",
    """, h AS (SELECT capture_id, ip, count(*) AS packets, sum(packet_size)::BIGINT AS bytes FROM (
   SELECT capture_id, src_ip AS ip, packet_size FROM packets
   UNION ALL SELECT capture_id, dst_ip, packet_size FROM packets) GROUP BY 1, 2)
SELECT capture_id, ip, packets, bytes, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY capture_id
  ORDER BY packets DESC, ip) AS rank FROM h) WHERE rank <= 10""",
)
def a5(spark, sf):
    return traffic.top_talkers(derived.packets(spark, sf))


@query(
    "a6_host_bytes",
    """SELECT capture_id, ip, sum(sent)::BIGINT AS bytes_sent, sum(received)::BIGINT AS bytes_received,
  (sum(sent) + sum(received))::BIGINT AS total_bytes FROM (
  SELECT capture_id, src_ip AS ip, packet_size AS sent, 0 AS received FROM packets
  UNION ALL SELECT capture_id, dst_ip, 0, packet_size FROM packets) GROUP BY 1, 2""",
)
def a6(spark, sf):
    h = traffic.host_totals(derived.packets(spark, sf))
    return h.select(
        "capture_id",
        "ip",
        "bytes_sent",
        "bytes_received",
        (F.col("bytes_sent") + F.col("bytes_received")).alias("total_bytes"),
    )


@query(
    "a13_flag_histogram",
    f"""SELECT capture_id, f AS tcp_flags, count(*) AS packets,
  array_to_string(list_filter({_FLAG_LIST}, lambda x: x IS NOT NULL), ',') AS flags
FROM (SELECT capture_id, tcp_flags AS f FROM packets WHERE tcp_flags IS NOT NULL) GROUP BY ALL""",
)
def a13(spark, sf):
    return traffic.flag_histogram(derived.packets(spark, sf))


@query(
    "a16_distinct_endpoints",
    """SELECT capture_id, count(DISTINCT ip) AS unique_ips, count(DISTINCT port) AS unique_ports FROM (
  SELECT capture_id, src_ip AS ip, src_port AS port FROM packets
  UNION ALL SELECT capture_id, dst_ip, dst_port FROM packets) GROUP BY 1""",
)
def a16(spark, sf):
    return traffic.distinct_endpoints(derived.packets(spark, sf))


@query("a16_distinct_endpoints_approximate")
def a16_approx(spark, sf):
    return traffic.distinct_endpoints(derived.packets(spark, sf), approximate=True)


@query(
    "a17_size_distribution",
    """SELECT capture_id, min(packet_size) AS min_size, max(packet_size) AS max_size,
  round(avg(packet_size), 6) AS avg_size, sum(packet_size)::BIGINT AS total_bytes FROM packets GROUP BY 1""",
)
def a17(spark, sf):
    return rounded(traffic.size_distribution(derived.packets(spark, sf)))


@query(
    "a18_payload_statistics",
    """SELECT capture_id, count(*) AS payloads, sum(strlen(payload))::BIGINT AS payload_bytes,
  min(strlen(payload))::INT AS min_payload, max(strlen(payload))::INT AS max_payload,
  count(*) FILTER (contains(payload, 'HTTP')) AS http_payloads
FROM packets WHERE strlen(payload) > 0 GROUP BY 1""",
)
def a18(spark, sf):
    return traffic.payload_statistics(derived.packets(spark, sf))


@query(
    "a18_payload_sizes",
    """SELECT capture_id, strlen(payload)::INT AS payload_size, count(*) AS payloads
FROM packets WHERE strlen(payload) > 0 GROUP BY 1, 2""",
)
def a18_sizes(spark, sf):
    return traffic.payload_size_histogram(derived.packets(spark, sf))


@query(
    "a19_performance_triage",
    """, b AS (SELECT capture_id, sum(packet_size)::BIGINT AS bandwidth_usage,
   count(DISTINCT CASE WHEN protocol = 'TCP' THEN (src_ip, src_port, dst_ip, dst_port) END) AS connection_rate
   FROM packets GROUP BY 1),
d AS (SELECT capture_id, count(*) AS duplicate_acks FROM (SELECT capture_id, tcp_ack FROM packets
   WHERE protocol = 'TCP' AND tcp_flags & 16 <> 0 GROUP BY 1, 2 HAVING count(*) > 3) GROUP BY 1)
SELECT capture_id, bandwidth_usage, connection_rate, coalesce(duplicate_acks, 0) AS duplicate_acks
FROM b LEFT JOIN d USING (capture_id)""",
)
def a19(spark, sf):
    return traffic.performance_triage(derived.packets(spark, sf))


@query(
    "a26_merged_chunks",
    """, ch AS (SELECT capture_id, us // 86400000000 AS chunk, count(*) AS packets, sum(packet_size)::BIGINT AS bytes,
   min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us,
   count(*) FILTER (tcp_flags & 4 <> 0) / count(*) AS reset_rate FROM packets GROUP BY 1, 2)
SELECT capture_id, count(*) AS chunks, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes,
  min(start_us) AS start_us, max(end_us) AS end_us,
  round(CASE WHEN sum(duration_us) > 0 THEN sum(reset_rate * duration_us) / sum(duration_us)::DOUBLE ELSE 0 END, 6) AS reset_share,
  round(max(reset_rate), 6) AS max_reset_rate,
  round((max(end_us) - min(start_us)) / 1e6, 6) AS duration_s,
  round(sum(bytes)::BIGINT / sum(packets)::BIGINT, 6) AS avg_packet_size,
  round(sum(packets)::BIGINT * 1e6 / (max(end_us) - min(start_us)), 6) AS packets_per_second,
  round(sum(bytes)::BIGINT * 1e6 / (max(end_us) - min(start_us)), 6) AS bytes_per_second
FROM ch GROUP BY 1""",
)
def a26(spark, sf):
    chunks = traffic.chunk_statistics(derived.packets(spark, sf))
    return rounded(
        traffic.merge_chunks(chunks, {"reset_rate": "reset_share"}, maxima=["reset_rate"])
    )


@query(
    "a29_traffic_series",
    """SELECT capture_id, us // 60000000 * 60000000 AS bucket_us, count(*) AS packets,
  sum(packet_size)::BIGINT AS bytes, round(count(*) / 60, 6) AS packets_per_second,
  round(sum(packet_size)::BIGINT / 60, 6) AS bytes_per_second FROM packets GROUP BY 1, 2""",
)
def a29(spark, sf):
    return rounded(traffic.series(derived.packets(spark, sf)))


_PORT_ROWS = ", ".join(f"('{a}', {p})" for a, ps in traffic.SERVICE_PORTS.items() for p in ps)


@query(
    "j8_applications",
    f""", svc(application, port) AS (VALUES {_PORT_ROWS})
SELECT capture_id, application, count(*) AS packets FROM (
  SELECT DISTINCT p.capture_id, p.frame_number, svc.application FROM packets p
  JOIN svc ON svc.port = p.src_port OR svc.port = p.dst_port) GROUP BY 1, 2""",
)
def j8(spark, sf):
    return traffic.applications(derived.packets(spark, sf))


@query(
    "u3_detected_protocols",
    f""", svc(application, port) AS (VALUES {_PORT_ROWS})
SELECT capture_id, lower(protocol) AS protocol FROM packets
UNION SELECT capture_id, application FROM packets JOIN svc ON svc.port = src_port
UNION SELECT capture_id, application FROM packets JOIN svc ON svc.port = dst_port
UNION SELECT capture_id, 'http' FROM packets WHERE http_method IS NOT NULL OR http_status <> 0
UNION SELECT capture_id, 'dns' FROM packets WHERE dns_query IS NOT NULL OR dns_response IS NOT NULL""",
)
def u3(spark, sf):
    return traffic.detected_protocols(derived.packets(spark, sf))


@query(
    "x18_human_text",
    """, n AS (SELECT report_id, CASE report_id % 5 WHEN 0 THEN file_size % 1024 WHEN 1 THEN file_size
    WHEN 2 THEN file_size * 64 WHEN 3 THEN file_size * 32768 ELSE file_size * 33554432 END AS b,
    processing_time * 1000 * CASE report_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 90 END AS ms FROM reports)
SELECT report_id, b AS bytes, ms,
  CASE WHEN b < 1024 THEN b || '.0 B'
    WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE)
    WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE)
    WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE)
    ELSE printf('%.1f TB', b / 1099511627776.0::DOUBLE) END AS size_text,
  CASE WHEN ms < 60000 THEN (ms // 1000) || '.' || (ms % 1000 // 100) || ' seconds'
    WHEN ms < 3600000 THEN ((ms + 3000) // 60000) || '.' || ((ms + 3000) % 60000 // 6000) || ' minutes'
    ELSE ((ms + 180000) // 3600000) || '.' || ((ms + 180000) % 3600000 // 360000) || ' hours' END AS duration_text
FROM n""",
    base="reports",
)
def x18(spark, sf):
    i, s = F.col("report_id"), F.col("file_size")
    b = (
        F.when(i % 5 == 0, s % 1024)
        .when(i % 5 == 1, s)
        .when(i % 5 == 2, s * 64)
        .when(i % 5 == 3, s * 32768)
        .otherwise(s * 33554432)
    )
    ms = F.col("processing_time") * 1000 * F.when(i % 3 == 0, 1).when(i % 3 == 1, 7).otherwise(90)
    return (
        derived.reports(spark, sf)
        .select("report_id", b.alias("bytes"), ms.alias("ms"))
        .withColumn("size_text", human_size("bytes"))
        .withColumn("duration_text", F.when(F.col("ms").isNotNull(), human_duration("ms")))
    )

from pyspark.sql import functions as F

from netlens.functions import measures
from netlens.functions.net import CONVERSATION
from netlens.operators import dns, http, tcp, udp
from netlens.plans.registry import query
from netlens.plans.shape import rounded
from netlens.sources import derived

_CONV = "capture_id, lo_ip, lo_port, hi_ip, hi_port"


def _tcp_sql(grain: str) -> str:
    g = grain
    on = f"USING ({g})"
    return f""", t AS (SELECT * FROM conv_packets WHERE protocol = 'TCP'),
c AS (SELECT {g}, coalesce(arg_min(src_ip, frame_number) FILTER (tcp_flags & 18 = 2), arg_min(src_ip, frame_number)) AS client_ip
   FROM t GROUP BY {g}),
ps AS (SELECT {g}, any_value(client_ip) AS client_ip, count(*) AS packets, sum(packet_size)::BIGINT AS bytes,
   arg_max(us, frame_number) - arg_min(us, frame_number) AS duration_us,
   count(*) FILTER (tcp_flags & 18 = 2) AS syn_packets, count(*) FILTER (tcp_flags & 18 = 18) AS syn_ack_packets,
   count(*) FILTER (tcp_flags & 18 = 16) AS ack_packets, count(*) FILTER (tcp_flags & 1 <> 0) AS fin_packets,
   count(*) FILTER (tcp_flags & 4 <> 0) AS rst_packets,
   coalesce(arg_min(tcp_window, frame_number) FILTER (tcp_window > 0), 0) AS initial_window,
   coalesce(min(tcp_window) FILTER (tcp_window > 0), 0) AS min_window,
   coalesce(max(tcp_window) FILTER (tcp_window > 0), 0) AS max_window,
   count(*) FILTER (tcp_window = 0) AS zero_window_packets,
   count(*) FILTER (src_ip = client_ip) AS client_packets,
   coalesce(sum(packet_size) FILTER (src_ip = client_ip), 0)::BIGINT AS client_bytes FROM t JOIN c {on} GROUP BY {g}),
hr AS (SELECT {g}, CASE WHEN min(frame_number) FILTER (tcp_flags & 18 = 2) < min(frame_number) FILTER (tcp_flags & 18 = 18)
   THEN arg_min(us, frame_number) FILTER (tcp_flags & 18 = 18) - arg_min(us, frame_number) FILTER (tcp_flags & 18 = 2) END AS handshake_us
   FROM t GROUP BY {g}),
gp AS (SELECT *, us - lag(us) OVER (PARTITION BY {g} ORDER BY frame_number) AS gap FROM t),
rs AS (SELECT {g}, count(x) AS rtt_samples, sum(x)::BIGINT / count(x) / 1e6 AS avg_rtt, var_samp(x / 1e6) AS rtt_variance
   FROM (SELECT *, CASE WHEN tcp_flags & 16 <> 0 AND gap BETWEEN 1000 AND 1000000 THEN gap END AS x FROM gp) GROUP BY {g}),
rt AS (SELECT {g}, sum(n - 1)::BIGINT AS retransmissions, (sum(n - 1) / sum(n)::DOUBLE) AS retransmission_rate FROM (
   SELECT {_CONV}, src_ip, src_port, tcp_seq, count(*) AS n FROM t GROUP BY ALL) GROUP BY {g}),
oo AS (SELECT {g}, count(*) FILTER (late) AS out_of_order_packets FROM (SELECT *, tcp_seq < lag(tcp_seq) OVER (
   PARTITION BY capture_id, src_ip, src_port, dst_ip, dst_port ORDER BY frame_number) AS late FROM t) GROUP BY {g}),
j AS (SELECT * FROM ps JOIN hr {on} JOIN rs {on} JOIN rt {on} JOIN oo {on}),
q AS (SELECT *, 100 - CASE WHEN retransmission_rate > 0.05 THEN 30 WHEN retransmission_rate > 0.01 THEN 15 ELSE 0 END
   - CASE WHEN avg_rtt > 0.5 THEN 25 WHEN avg_rtt > 0.1 THEN 10 ELSE 0 END
   - least(20, out_of_order_packets * 2) - least(15, zero_window_packets * 3) AS quality_score FROM j)
"""


_TCP_OUT = [
    "client_ip", "packets", "bytes", "client_packets", "client_bytes", "syn_packets", "syn_ack_packets",
    "ack_packets", "fin_packets", "rst_packets", "initial_window", "min_window", "max_window",
    "zero_window_packets", "handshake_us", "rtt_samples", "retransmissions", "out_of_order_packets",
]
_TCP_SELECT = (
    ", ".join(_TCP_OUT)
    + """, packets - client_packets AS server_packets, bytes - client_bytes AS server_bytes,
  (CASE WHEN max_window > 65535 THEN max_window // 65536 + 1 ELSE 0 END)::BIGINT AS window_scaling,
  round(avg_rtt, 6) AS avg_rtt, round(rtt_variance, 6) AS rtt_variance,
  round(retransmission_rate, 6) AS retransmission_rate,
  round(CASE WHEN duration_us > 0 THEN bytes * 8 * 1e6 / duration_us ELSE 0 END, 6) AS throughput_bps,
  round(CASE WHEN duration_us > 0 THEN client_bytes * 8 * 1e6 / duration_us ELSE 0 END, 6) AS client_throughput_bps,
  CASE WHEN syn_packets > 0 AND syn_ack_packets > 0 AND ack_packets > 0 THEN 'established'
    WHEN syn_packets > 0 AND syn_ack_packets = 0 THEN 'syn_sent' WHEN rst_packets > 0 THEN 'reset'
    WHEN fin_packets > 0 THEN 'closed' ELSE 'unknown' END AS state,
  quality_score::BIGINT AS quality_score,
  CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 75 THEN 'good'
    WHEN quality_score >= 60 THEN 'fair' ELSE 'poor' END AS quality,
  retransmission_rate > 0.02 OR zero_window_packets > 0 OR out_of_order_packets > packets * 0.01 AS congested FROM q"""
)
_TCP_COLUMNS = [
    *_TCP_OUT, "server_packets", "server_bytes", "window_scaling", "avg_rtt", "rtt_variance",
    "retransmission_rate", "throughput_bps", "client_throughput_bps", "state", "quality_score", "quality",
    "congested",
]


@query("a12_tcp_analysis", _tcp_sql(_CONV) + f"SELECT {_CONV}, {_TCP_SELECT}")
def a12(spark, sf):
    return rounded(tcp.analysis(derived.packets(spark, sf)).select(*CONVERSATION, *_TCP_COLUMNS))


@query("a12_tcp_analysis_by_capture", _tcp_sql("capture_id") + f"SELECT capture_id, {_TCP_SELECT}")
def a12_capture(spark, sf):
    return rounded(
        tcp.analysis(derived.packets(spark, sf), tcp.CAPTURE).select("capture_id", *_TCP_COLUMNS)
    )


@query(
    "x7_x8_tcp_state_quality",
    _tcp_sql(_CONV)
    + """, r AS (SELECT CASE WHEN syn_packets > 0 AND syn_ack_packets > 0 AND ack_packets > 0 THEN 'established'
    WHEN syn_packets > 0 AND syn_ack_packets = 0 THEN 'syn_sent' WHEN rst_packets > 0 THEN 'reset'
    WHEN fin_packets > 0 THEN 'closed' ELSE 'unknown' END AS state,
  CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 75 THEN 'good'
    WHEN quality_score >= 60 THEN 'fair' ELSE 'poor' END AS quality, capture_id,
  retransmission_rate > 0.02 OR zero_window_packets > 0 OR out_of_order_packets > packets * 0.01 AS congested FROM q)
SELECT capture_id, state, quality, congested, count(*) AS conversations FROM r GROUP BY ALL""",
)
def x7(spark, sf):
    return (
        tcp.analysis(derived.packets(spark, sf))
        .groupBy("capture_id", "state", "quality", "congested")
        .agg(F.count("*").alias("conversations"))
    )


@query(
    "a14_tcp_triage",
    """, r AS (SELECT capture_id, sum(n - 1)::BIGINT AS retransmissions, sum(n)::BIGINT AS total FROM (SELECT capture_id, src_ip,
   src_port, dst_ip, dst_port, tcp_seq, count(*) AS n FROM packets WHERE protocol = 'TCP' GROUP BY ALL) GROUP BY 1),
c AS (SELECT capture_id, count(*) FILTER (tcp_flags & 2 <> 0) AS tcp_connections, count(*) FILTER (tcp_flags & 4 <> 0) AS resets,
   count(*) FILTER (tcp_window = 0) AS zero_windows FROM packets WHERE protocol = 'TCP' GROUP BY 1)
SELECT capture_id, tcp_connections, resets, zero_windows, retransmissions,
   round(retransmissions / total, 6) AS retransmission_rate FROM c JOIN r USING (capture_id)""",
)
def a14(spark, sf):
    return rounded(tcp.triage(derived.packets(spark, sf)))


# ---------------------------------------------------------------- UDP


@query(
    "a22_udp_flow_statistics",
    """, g AS (SELECT capture_id, count(*) AS packets, sum(packet_size)::BIGINT AS bytes,
   arg_max(us, frame_number) - arg_min(us, frame_number) AS d,
   count(DISTINCT src_ip) > 1 OR count(DISTINCT dst_ip) > 1 AS bi, count(*) FILTER (dst_port < 1024) AS low,
   round(avg(packet_size), 6) AS avg_packet_size, min(packet_size) AS min_packet_size, max(packet_size) AS max_packet_size,
   round(avg(coalesce(udp_length, packet_size - 28)), 6) AS avg_payload_size,
   count(*) FILTER (packet_size > 1400) AS large_packets FROM packets WHERE protocol = 'UDP' GROUP BY 1),
h AS (SELECT *, CASE WHEN bi THEN low ELSE 0 END AS requests, CASE WHEN bi THEN packets - low ELSE 0 END AS responses,
   CASE WHEN bi THEN 0 ELSE packets END AS unidirectional FROM g)
SELECT capture_id, packets, bytes, round(d / 1e6, 6) AS duration_s, requests, responses, unidirectional, avg_packet_size,
  min_packet_size, max_packet_size, avg_payload_size, large_packets, large_packets > 0 AS potential_fragmentation,
  round(CASE WHEN d > 0 THEN bytes * 8 * 1e6 / d ELSE 0 END, 6) AS throughput_bps,
  round(CASE WHEN requests > 0 THEN greatest(0, (requests - responses) / requests) ELSE 0 END, 6) AS loss_rate FROM h""",
)
def a22(spark, sf):
    return rounded(udp.flow_statistics(derived.packets(spark, sf)))


@query(
    "w1_udp_response_gaps",
    """, g AS (SELECT *, us - lag(us) OVER w AS gap, lag(src_port) OVER w AS psp, lag(dst_port) OVER w AS pdp
   FROM conv_packets WHERE protocol = 'UDP'
   WINDOW w AS (PARTITION BY capture_id, lo_ip, lo_port, hi_ip, hi_port ORDER BY us, frame_number)),
r AS (SELECT *, CASE WHEN (pdp < 1024 AND src_port < 1024) OR (psp > 1024 AND dst_port > 1024) THEN gap END AS x FROM g)
SELECT capture_id, count(gap) AS gaps, round(sum(gap)::BIGINT / count(gap) / 1e6, 6) AS avg_inter_packet_gap,
  count(x) AS responses_timed, round(sum(x)::BIGINT / count(x) / 1e6, 6) AS avg_response_time,
  round(min(x) / 1e6, 6) AS min_response_time, round(max(x) / 1e6, 6) AS max_response_time,
  round(stddev_samp(x / 1e6), 6) AS response_time_stddev FROM r GROUP BY 1""",
)
def w1_udp(spark, sf):
    return rounded(udp.response_gaps(derived.packets(spark, sf)))


@query(
    "w7_udp_bursts",
    """, g AS (SELECT capture_id, us - lag(us) OVER (PARTITION BY capture_id ORDER BY frame_number) AS gap
   FROM packets WHERE protocol = 'UDP' AND packet_size > 100)
SELECT capture_id, count(*) AS large_packets, coalesce(bool_or(gap < 100000), false) AS burst_detected FROM g GROUP BY 1""",
)
def w7(spark, sf):
    return udp.bursts(derived.packets(spark, sf), udp.CAPTURE, large=100)


@query(
    "j6_udp_near_duplicates",
    """, u AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_number) AS n FROM packets WHERE protocol = 'UDP'),
m AS (SELECT capture_id, count(*) AS packets, count(*) FILTER (EXISTS (SELECT 1 FROM u b WHERE b.capture_id = a.capture_id
   AND b.src_ip = a.src_ip AND b.dst_ip = a.dst_ip AND b.packet_size = a.packet_size
   AND b.n BETWEEN a.n + 1 AND a.n + 9 AND abs(b.us - a.us) < 10000)) AS duplicates FROM u a GROUP BY 1)
SELECT capture_id, packets, duplicates, round(duplicates / packets, 6) AS duplicate_rate FROM m""",
)
def j6(spark, sf):
    return rounded(udp.near_duplicates(derived.packets(spark, sf)))


# ---------------------------------------------------------------- HTTP

_HTTP = """, h AS (SELECT *, http_method IS NOT NULL AS req,
   CASE WHEN http_method IS NOT NULL THEN src_ip ELSE dst_ip END AS client_ip,
   CASE WHEN http_method IS NOT NULL THEN src_port ELSE dst_port END AS client_port,
   CASE WHEN http_method IS NOT NULL THEN dst_ip ELSE src_ip END AS server_ip,
   CASE WHEN http_method IS NOT NULL THEN dst_port ELSE src_port END AS server_port
   FROM packets WHERE http_method IS NOT NULL OR http_status <> 0),
l AS (SELECT *, lag(req) OVER w AS preq, lag(frame_number) OVER w AS pframe, lag(us) OVER w AS pus,
   lag(packet_size) OVER w AS psize, lag(http_method) OVER w AS pmethod, lag(http_host) OVER w AS phost,
   lag(http_uri) OVER w AS puri FROM h
   WINDOW w AS (PARTITION BY capture_id, client_ip, client_port, server_ip, server_port ORDER BY frame_number)),
tx AS (SELECT capture_id, client_ip, client_port, server_ip, server_port, pframe AS request_frame,
   frame_number AS response_frame, pmethod AS method, phost AS host, puri AS uri, http_status AS status,
   psize AS request_size, packet_size AS response_size, us - pus AS response_us FROM l WHERE NOT req AND preq)
"""


@query("j1_http_transactions", _HTTP + "SELECT * FROM tx")
def j1(spark, sf):
    return http.transactions(derived.packets(spark, sf))


@query(
    "j4_http_ordinal_sessions",
    _HTTP
    + """, a AS (SELECT capture_id, frame_number AS request_frame, http_method, http_uri,
   row_number() OVER (PARTITION BY capture_id ORDER BY frame_number) AS session FROM h WHERE req),
b AS (SELECT capture_id, frame_number AS response_frame, http_status,
   row_number() OVER (PARTITION BY capture_id ORDER BY frame_number) AS session FROM h WHERE NOT req)
SELECT capture_id, session, request_frame, http_method, http_uri, response_frame, http_status
FROM a LEFT JOIN b USING (capture_id, session)""",
)
def j4(spark, sf):
    return http.ordinal_sessions(derived.packets(spark, sf))


@query(
    "a20_http_summary",
    _HTTP
    + """, s AS (SELECT capture_id, count(*) FILTER (req) AS requests, count(*) FILTER (NOT req) AS responses,
   coalesce(sum(packet_size) FILTER (req), 0)::BIGINT AS request_bytes,
   coalesce(sum(packet_size) FILTER (NOT req), 0)::BIGINT AS response_bytes,
   count(*) FILTER (NOT req AND http_status BETWEEN 200 AND 299) AS success_count,
   count(*) FILTER (NOT req AND http_status >= 400) AS error_count FROM h GROUP BY 1)
SELECT *, request_bytes + response_bytes AS total_bytes, round(request_bytes / requests, 6) AS avg_request_size,
  round(response_bytes / responses, 6) AS avg_response_size, round(error_count / responses, 6) AS error_rate FROM s""",
)
def a20(spark, sf):
    return rounded(http.summary(derived.packets(spark, sf)))


@query("a20_http_methods", _HTTP + "SELECT capture_id, http_method, count(*) AS requests FROM h WHERE req GROUP BY ALL")
def a20_methods(spark, sf):
    return http.method_counts(derived.packets(spark, sf))


@query(
    "a20_http_status_codes",
    _HTTP + "SELECT capture_id, http_status, count(*) AS responses FROM h WHERE NOT req GROUP BY ALL",
)
def a20_status(spark, sf):
    return http.status_counts(derived.packets(spark, sf))


def _top_sql(kind):
    return (
        _HTTP
        + f""", c AS (SELECT capture_id, {kind}, count(*) AS transactions FROM tx GROUP BY 1, 2)
SELECT capture_id, {kind}, transactions, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY capture_id
  ORDER BY transactions DESC, {kind}) AS rank FROM c) WHERE rank <= 10"""
    )


@query("a20_top_urls", _top_sql("uri"))
def a20_urls(spark, sf):
    return http.top_targets(derived.packets(spark, sf), "uri")


@query("a20_top_hosts", _top_sql("host"))
def a20_hosts(spark, sf):
    return http.top_targets(derived.packets(spark, sf), "host")


def _times_sql(table):
    return f""", o AS (SELECT capture_id, response_us AS v, row_number() OVER (PARTITION BY capture_id ORDER BY response_us) AS n,
   count(*) OVER (PARTITION BY capture_id) AS total FROM {table} WHERE response_us > 0)
SELECT capture_id, count(*) AS timed, round(sum(v)::BIGINT / count(*) / 1e6, 6) AS avg_response_time,
  round(min(v) / 1e6, 6) AS min_response_time, round(max(v) / 1e6, 6) AS max_response_time,
  round(max(v) FILTER (n = floor(total * 0.95::DOUBLE) + 1) / 1e6, 6) AS p95,
  round(max(v) FILTER (n = floor(total * 0.99::DOUBLE) + 1) / 1e6, 6) AS p99 FROM o GROUP BY 1"""


@query("w9_http_response_times", _HTTP + _times_sql("tx"))
def w9(spark, sf):
    return rounded(http.response_times(derived.packets(spark, sf)))


@query(
    "x11_http_first_lines",
    """, p AS (SELECT capture_id, frame_number, string_split(string_split(payload, chr(13) || chr(10))[1], ' ') AS parts,
   payload LIKE 'HTTP/%' AS resp FROM packets
   WHERE payload LIKE 'HTTP/%' OR regexp_matches(payload, '^(GET|POST|PUT|DELETE|HEAD|OPTIONS) '))
SELECT capture_id, frame_number, CASE WHEN resp THEN 'response' ELSE 'request' END AS kind,
  CASE WHEN NOT resp THEN parts[1] END AS method, CASE WHEN NOT resp THEN parts[2] END AS uri,
  CASE WHEN resp THEN parts[1] ELSE parts[3] END AS version, CASE WHEN resp THEN parts[2] END AS status_code,
  CASE WHEN resp THEN array_to_string(parts[3:], ' ') END AS status_message FROM p WHERE len(parts) >= 3""",
)
def x11(spark, sf):
    return http.parsed_messages(derived.packets(spark, sf))


# ---------------------------------------------------------------- DNS

_DNS = """, h AS (SELECT *, coalesce(dns_query <> '', false) AS qry,
   CASE WHEN dns_query <> '' THEN src_ip ELSE dst_ip END AS client_ip,
   CASE WHEN dns_query <> '' THEN src_port ELSE dst_port END AS client_port,
   CASE WHEN dns_query <> '' THEN dst_ip ELSE src_ip END AS server_ip,
   CASE WHEN dns_query <> '' THEN dst_port ELSE src_port END AS server_port
   FROM packets WHERE dns_query <> '' OR dns_response <> ''),
l AS (SELECT *, lag(qry) OVER w AS pq, lag(frame_number) OVER w AS pframe, lag(us) OVER w AS pus,
   lag(dns_query) OVER w AS pdom, lag(dns_type) OVER w AS ptype, lead(qry) OVER w IS NULL AS is_last FROM h
   WINDOW w AS (PARTITION BY capture_id, client_ip, client_port, server_ip, server_port ORDER BY frame_number)),
tx AS (SELECT capture_id, client_ip, client_port, server_ip, server_port, pframe AS query_frame, pus AS query_us,
   pdom AS domain, ptype AS query_type, dns_response AS answer, dns_rcode AS rcode, 'NOERROR' AS outcome,
   us - pus AS response_us FROM l WHERE NOT qry AND pq
 UNION ALL SELECT capture_id, client_ip, client_port, server_ip, server_port, frame_number, us, dns_query, dns_type,
   NULL, NULL, 'TIMEOUT', NULL FROM l WHERE qry AND is_last)
"""


@query("j2_dns_transactions", _DNS + "SELECT * FROM tx")
def j2(spark, sf):
    return dns.transactions(derived.packets(spark, sf))


_J3 = """, a AS (SELECT q.capture_id, q.frame_number, q.dns_id, q.us, min((r.us, r.dns_rcode)) AS best
   FROM packets q LEFT JOIN packets r ON r.capture_id = q.capture_id AND r.dns_id = q.dns_id AND r.dns_qr = 1 AND r.us > q.us
   WHERE q.dns_qr = 0 GROUP BY 1, 2, 3, 4),
m AS (SELECT a.capture_id, a.frame_number, a.dns_id, x.response_us, x.rcode, x.response_us IS NULL OR x.rcode <> 0 AS failed
   FROM a LEFT JOIN (SELECT q.capture_id, q.frame_number, r.us - q.us AS response_us, r.dns_rcode AS rcode,
      row_number() OVER (PARTITION BY q.capture_id, q.frame_number ORDER BY r.us, r.dns_rcode) AS n
      FROM packets q JOIN packets r ON r.capture_id = q.capture_id AND r.dns_id = q.dns_id AND r.dns_qr = 1 AND r.us > q.us
      WHERE q.dns_qr = 0) x ON x.capture_id = a.capture_id AND x.frame_number = a.frame_number AND x.n = 1)
"""


@query("j3_dns_matched_by_id", _J3 + "SELECT * FROM m")
def j3(spark, sf):
    return dns.matched_by_id(derived.packets(spark, sf))


@query(
    "j3_dns_performance",
    _J3
    + """SELECT capture_id, count(*) AS queries, count(*) FILTER (response_us IS NULL) AS timeouts,
  count(*) FILTER (failed) AS failures, round(sum(response_us)::BIGINT / count(response_us) / 1e6, 6) AS avg_response_time,
  round(max(response_us) / 1e6, 6) AS max_response_time, round(count(*) FILTER (failed) / count(*), 6) AS failure_rate
FROM m GROUP BY 1""",
)
def j3_performance(spark, sf):
    return rounded(dns.performance(derived.packets(spark, sf)))


@query(
    "a15_dns_triage",
    """, i AS (SELECT capture_id, dns_id, count(*) FILTER (dns_qr = 0) AS q, count(*) FILTER (dns_qr = 1) AS r,
   count(*) FILTER (dns_qr = 1 AND dns_rcode = 3) AS nx FROM packets WHERE dns_qr IS NOT NULL GROUP BY 1, 2)
SELECT capture_id, sum(q)::BIGINT AS dns_queries, sum(r)::BIGINT AS dns_responses, sum(nx)::BIGINT AS nxdomain,
  sum(greatest(q - r, 0))::BIGINT AS unanswered FROM i GROUP BY 1""",
)
def a15(spark, sf):
    return dns.triage(derived.packets(spark, sf))


@query(
    "a21_dns_summary",
    _DNS
    + """, s AS (SELECT capture_id, count(*) FILTER (qry) AS queries, count(*) FILTER (NOT qry) AS responses FROM h GROUP BY 1),
d AS (SELECT capture_id, count(*) FILTER (outcome = 'NOERROR') AS answered, count(*) FILTER (outcome = 'TIMEOUT') AS timeouts,
   count(*) FILTER (rcode = 3) AS nxdomain, count(*) FILTER (rcode = 2) AS servfail, count(DISTINCT domain) AS unique_domains,
   max(query_us) - min(query_us) AS span FROM tx GROUP BY 1)
SELECT capture_id, queries, responses, answered, timeouts, nxdomain, servfail, unique_domains,
  round(answered / queries, 6) AS success_rate, round(CASE WHEN span > 0 THEN queries * 1e6 / span ELSE 0 END, 6) AS queries_per_second
FROM s JOIN d USING (capture_id)""",
)
def a21(spark, sf):
    return rounded(dns.summary(derived.packets(spark, sf)))


@query(
    "a21_dns_types",
    _DNS + "SELECT capture_id, dns_type AS query_type, count(*) AS queries FROM h WHERE qry GROUP BY ALL",
)
def a21_types(spark, sf):
    return dns.type_counts(derived.packets(spark, sf))


@query(
    "a21_top_domains",
    _DNS
    + """, c AS (SELECT capture_id, domain, count(*) AS queries FROM tx GROUP BY 1, 2)
SELECT capture_id, domain, queries, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY capture_id
  ORDER BY queries DESC, domain) AS rank FROM c) WHERE rank <= 10""",
)
def a21_domains(spark, sf):
    return dns.top_domains(derived.packets(spark, sf))


@query(
    "a21_dns_servers",
    _DNS
    + """SELECT capture_id, server_ip, count(*) AS queries,
  round((sum(response_us) FILTER (response_us > 0))::BIGINT / count(*) FILTER (response_us > 0) / 1e6, 6) AS avg_response_time
FROM tx GROUP BY 1, 2""",
)
def a21_servers(spark, sf):
    return rounded(dns.servers(derived.packets(spark, sf)))


@query("w9_dns_response_times", _DNS + _times_sql("tx"))
def w9_dns(spark, sf):
    return rounded(dns.response_times(derived.packets(spark, sf)))


@query(
    "a23_dns_deep_summary",
    """SELECT capture_id, count(*) AS queries, count(DISTINCT dns_query) AS unique_domains FROM packets
WHERE dns_qr = 0 GROUP BY 1""",
)
def a23(spark, sf):
    return dns.deep_summary(derived.packets(spark, sf))


@query(
    "a23_dns_type_numbers",
    """SELECT capture_id, CASE dns_type WHEN 'A' THEN 1 WHEN 'AAAA' THEN 28 END AS qtype, count(*) AS queries
FROM packets WHERE dns_qr = 0 AND dns_query IS NOT NULL GROUP BY ALL""",
)
def a23_types(spark, sf):
    return dns.deep_type_counts(derived.packets(spark, sf))

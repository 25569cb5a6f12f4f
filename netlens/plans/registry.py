"""Registry of named queries and the DuckDB SQL each one is checked against."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netlens.sources.derived import TEMPLATE_COLUMNS, TEMPLATE_ROWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PACKETS = f"""
tpl({TEMPLATE_COLUMNS}) AS (VALUES {TEMPLATE_ROWS}),
ev AS (
  SELECT e.event_id AS eid, e.user_id AS uid, epoch_us(e.ts) AS base_us, t.*,
    CASE WHEN e.user_id % 10 = 0 THEN '93.184.' || (e.user_id % 200) || '.34'
         ELSE '10.0.' || (e.user_id % 7) || '.' || (e.user_id % 250 + 1) END AS cip,
    CASE WHEN t.proto = 'UDP' THEN '8.8.8.8'
         ELSE '192.168.1.' || (e.event_id % 20 + 1) END AS sip,
    CASE WHEN t.proto <> 'ICMP' THEN 20000 + e.event_id % 40000 END AS cport,
    CASE WHEN t.srv_port = -1 THEN 1 + e.event_id % 1000 ELSE t.srv_port END AS sport,
    CASE e.event_id % 7 WHEN 0 THEN '/../../../etc/passwd'
         WHEN 1 THEN '/q?s=1 union select 2' WHEN 2 THEN '/c?t=<script>x</script>'
         ELSE '/item/' || (e.event_id % 50) END AS uri
  FROM events e JOIN tpl t USING (event_type)),
packets AS (
  SELECT 'cap' || (eid % 4) AS capture_id,
    (eid * 10 + step)::BIGINT AS frame_number,
    (base_us + off_ms * 1000)::BIGINT AS us,
    make_timestamp((base_us + off_ms * 1000)::BIGINT) AS ts,
    size::BIGINT AS packet_size,
    CASE WHEN dir = 'c' THEN cip ELSE sip END AS src_ip,
    CASE WHEN dir = 'c' THEN sip ELSE cip END AS dst_ip,
    proto AS protocol,
    CASE proto WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 1 END AS ip_proto,
    (CASE WHEN dir = 'c' THEN cport ELSE sport END)::INT AS src_port,
    (CASE WHEN dir = 'c' THEN sport ELSE cport END)::INT AS dst_port,
    flags AS tcp_flags,
    CASE WHEN proto = 'TCP' THEN
      (CASE WHEN dir = 'c' THEN 1000 ELSE 5000 END + eid % 500 + seq_rel)::BIGINT END AS tcp_seq,
    CASE WHEN flags >= 16 THEN (CASE WHEN dir = 'c' THEN 5001 ELSE 1001 END + eid % 500)::BIGINT
         WHEN proto = 'TCP' THEN 0::BIGINT END AS tcp_ack,
    win AS tcp_window,
    CASE WHEN proto = 'UDP' THEN size - 34 END AS udp_length,
    t_method AS http_method,
    CASE WHEN t_method IS NOT NULL THEN 'site' || (eid % 30) || '.example.com' END AS http_host,
    CASE WHEN t_method IS NOT NULL THEN uri END AS http_uri,
    t_status AS http_status,
    CASE WHEN proto = 'UDP' THEN
      ((eid * 7 + CASE WHEN step >= 3 THEN 1 ELSE 0 END) % 65536)::INT END AS dns_id,
    CASE dns_kind WHEN 'q' THEN 0 WHEN 'r' THEN 1 END AS dns_qr,
    CASE WHEN dns_kind = 'q' THEN CASE eid % 6
         WHEN 0 THEN 'bcdfghjklmnp' || eid || '.net'
         WHEN 1 THEN 'a1b2c3d4e5f6a1b2c3d4e5f6a1b2c3d4.tk'
         WHEN 2 THEN repeat('data', 14) || '.example.com'
         WHEN 3 THEN '10-0-0-' || (eid % 255) || '.pool.example.org'
         ELSE 'www' || (eid % 40) || '.example.com' END END AS dns_query,
    CASE WHEN dns_kind = 'r' THEN '93.184.216.34' END AS dns_response,
    CASE WHEN dns_kind = 'q' THEN CASE WHEN eid % 3 = 0 THEN 'AAAA' ELSE 'A' END END AS dns_type,
    CASE WHEN dns_kind = 'r' THEN CASE WHEN eid % 5 = 0 THEN 3 ELSE 0 END END AS dns_rcode,
    CASE WHEN event_type = 'purchase' AND step = 4
         THEN CASE WHEN eid % 4 = 0 THEN 769 ELSE 771 END END AS tls_version,
    NULL::INT AS tls_cipher,
    CASE WHEN t_method IS NOT NULL THEN t_method || ' ' || uri || ' HTTP/1.1'
         WHEN t_status IS NOT NULL THEN 'HTTP/1.1 ' || t_status || ' OK'
         WHEN event_type = 'click' AND step = 5 THEN CASE eid % 6
           WHEN 0 THEN 'user=a&password=hunter2'
           WHEN 1 THEN 'data:base64,' || repeat('QUJD', 30)
           WHEN 2 THEN 'x; DROP TABLE users'
           ELSE 'a=' || eid END END AS payload
  FROM ev),
conv_packets AS (
  SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS lo_ip,
            CASE WHEN fwd THEN sp ELSE dp END AS lo_port,
            CASE WHEN fwd THEN dst_ip ELSE src_ip END AS hi_ip,
            CASE WHEN fwd THEN dp ELSE sp END AS hi_port
  FROM (SELECT *, (src_ip, sp) <= (dst_ip, dp) AS fwd
        FROM (SELECT *,
                CASE WHEN coalesce(src_port, 0) <> 0 AND coalesce(dst_port, 0) <> 0
                     THEN src_port ELSE 0 END AS sp,
                CASE WHEN coalesce(src_port, 0) <> 0 AND coalesce(dst_port, 0) <> 0
                     THEN dst_port ELSE 0 END AS dp
              FROM packets) q0) q1)
"""

_REPORTS = """
reports AS (
  SELECT o_orderkey AS report_id,
    'job' || CASE WHEN o_orderkey % 20 < 4 THEN o_orderkey - o_orderkey % 4
                  ELSE o_orderkey END AS job_id,
    'cap_' || o_orderkey || '.pcap' AS original_filename,
    'h' || o_custkey AS file_hash,
    floor(o_totalprice)::BIGINT AS file_size,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing'
      ELSE CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed'
           ELSE 'cancelled' END END AS status,
    o_orderdate::TIMESTAMP AS created_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 300 END AS processing_time,
    o_orderkey % 5000 AS total_packets
  FROM orders),
jobs AS (
  SELECT report_id, job_id,
    CASE status WHEN 'completed' THEN 'success' WHEN 'processing' THEN 'started'
         ELSE 'failure' END AS status,
    CASE status WHEN 'completed' THEN 100 WHEN 'processing' THEN 50 ELSE 0 END AS progress,
    created_at AS started_at,
    created_at + to_seconds(processing_time) AS completed_at
  FROM reports WHERE report_id % 10 <> 0)
"""

_PAYLOADS = """
payloads AS (
  SELECT 'doc/' || doc_id AS path, text AS content FROM documents
  UNION ALL SELECT 'page/' || page_id, html FROM pages)
"""

_PRELUDES = {"packets": _PACKETS, "reports": _REPORTS, "payloads": _PAYLOADS}


def query(name: str, sql: str | None = None, base: str = "packets"):
    """Register a query. ``sql`` follows the CTEs of ``base``; it may open with ``, x AS (…)``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = f"WITH {_PRELUDES[base].strip()}\n{sql.strip()}"
        return fn

    return add

from netlens.operators import detect, flows, graph
from netlens.plans.detection import _D7, _D8
from netlens.plans.flows import _A8
from netlens.plans.registry import query
from netlens.sources import derived

_TIES = "src_ip, src_port NULLS FIRST, dst_ip, dst_port NULLS FIRST"
_CLASS = """CASE WHEN regexp_matches({c}, '[.]255$') THEN 'broadcast' WHEN starts_with({c}, '10.') OR starts_with({c}, '192.168.')
  THEN 'internal' ELSE 'external' END"""
_GRAPH = (
    _A8
    + f""", c AS (SELECT capture_id, client_ip AS src_ip, client_port AS src_port, server_ip AS dst_ip, server_port AS dst_port,
   protocol, packets, bytes FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY packets DESC, {_TIES}) AS rank FROM c),
top AS (SELECT * FROM ranked WHERE rank <= 100),
vol AS (SELECT capture_id, ip, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes FROM (
   SELECT capture_id, src_ip AS ip, packets, bytes FROM top UNION ALL SELECT capture_id, dst_ip, packets, bytes FROM top) GROUP BY 1, 2),
links AS (SELECT capture_id, ip, sum(o) AS outgoing, sum(i) AS incoming, count(DISTINCT peer) AS peers FROM (
   SELECT capture_id, src_ip AS ip, dst_ip AS peer, 1 AS o, 0 AS i FROM c
   UNION ALL SELECT capture_id, dst_ip, src_ip, 0, 1 FROM c WHERE src_ip <> dst_ip) GROUP BY 1, 2),
nodes AS (SELECT capture_id, ip, 'node_' || replace(ip, '.', '_') AS node_id, packets, bytes, {_CLASS.format(c="ip")} AS ip_class,
   CASE WHEN incoming > outgoing * 2 THEN 'server' WHEN outgoing > incoming * 2 THEN 'client' WHEN peers > 10 THEN 'gateway'
   ELSE 'peer' END AS role FROM vol JOIN links USING (capture_id, ip)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY packets DESC, ip) AS rank FROM nodes) WHERE rank <= 50)
"""
)


def _input(spark, sf):
    return graph.directed(flows.conversation_flows(derived.packets(spark, sf)))


@query("g1_nodes", _GRAPH + "SELECT * FROM nodes")
def g1(spark, sf):
    return graph.nodes(_input(spark, sf))


def _edges_sql(n):
    return (
        _GRAPH
        + f"""SELECT t.capture_id, src_ip, src_port, dst_ip, dst_port, protocol, t.packets, t.bytes,
  protocol || CASE WHEN t.packets > 10000 THEN ' ' || (t.packets // 1000) || 'k' WHEN t.packets > 50 THEN ' ' || t.packets ELSE '' END
  || CASE WHEN dst_port IN (80, 443, 22, 25, 53, 21, 23) THEN ' :' || dst_port ELSE '' END AS label, t.packets > 1000 AS high_traffic
FROM top t WHERE t.packets >= {n}
  AND EXISTS (SELECT 1 FROM kept k WHERE k.capture_id = t.capture_id AND k.ip = t.src_ip)
  AND EXISTS (SELECT 1 FROM kept k WHERE k.capture_id = t.capture_id AND k.ip = t.dst_ip)"""
    )


@query("g2_edges", _edges_sql(5))
def g2(spark, sf):
    return graph.edges(_input(spark, sf), min_packets=5)


@query(
    "j7_edges_between_kept_nodes",
    _GRAPH
    + """SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM kept k WHERE k.capture_id = c.capture_id AND k.ip = c.src_ip)
  AND EXISTS (SELECT 1 FROM kept k WHERE k.capture_id = c.capture_id AND k.ip = c.dst_ip)""",
)
def j7(spark, sf):
    convs = _input(spark, sf)
    return graph.between_kept(convs, graph.kept_nodes(convs))


@query(
    "g3_flow_steps",
    _GRAPH
    + """SELECT capture_id, rank::INT AS step, src_ip, src_port, dst_ip, dst_port, packets,
  CASE WHEN packets > 100 THEN protocol || ' (' || packets || ' pkts)' ELSE protocol END AS label, packets > 50 AS has_response
FROM ranked WHERE rank <= 20""",
)
def g3(spark, sf):
    return graph.flow_steps(_input(spark, sf))


_ALERTS = """, al AS (SELECT capture_id, 'TCP_RESET' AS type, 'medium' AS severity, src_ip AS ip FROM packets WHERE tcp_flags & 4 <> 0
 UNION ALL SELECT capture_id, 'TCP_RESET', 'medium', dst_ip FROM packets WHERE tcp_flags & 4 <> 0
 UNION ALL SELECT capture_id, 'WEB_ATTACK', 'critical', src_ip FROM packets WHERE protocol = 'TCP' AND (contains(payload, '../../../')
   OR contains(payload, 'DROP TABLE') OR contains(payload, 'SELECT * FROM') OR contains(payload, '<script>'))
 UNION ALL SELECT capture_id, 'WEB_ATTACK', 'critical', dst_ip FROM packets WHERE protocol = 'TCP' AND (contains(payload, '../../../')
   OR contains(payload, 'DROP TABLE') OR contains(payload, 'SELECT * FROM') OR contains(payload, '<script>'))
 UNION ALL SELECT capture_id, 'weak_tls_version', 'medium', src_ip FROM packets WHERE tls_version < 771
 UNION ALL SELECT capture_id, 'weak_tls_version', 'medium', dst_ip FROM packets WHERE tls_version < 771)
"""


@query(
    "g4_incident_hosts",
    _ALERTS
    + """SELECT capture_id, ip, count(*) AS alerts, count(DISTINCT type) AS kinds,
  CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high'
    WHEN 2 THEN 'medium' ELSE 'low' END AS max_severity,
  CASE count(DISTINCT type) WHEN 1 THEN min(type) WHEN 2 THEN min(type) || ', ' || max(type)
    ELSE count(DISTINCT type) || ' threat types' END AS label FROM al GROUP BY 1, 2""",
)
def g4(spark, sf):
    from pyspark.sql import functions as F

    rules = [*detect.tcp_flags(deep=True)[:1], *detect.web_attacks(), *detect.weak_tls()]
    alerts = detect.packet_findings(derived.packets(spark, sf), rules).withColumn(
        "description", F.concat_ws(" ", "type", F.lit("from"), "src_ip", F.lit("to"), "dst_ip")
    )
    return graph.incident_hosts(alerts)


@query(
    "g5_issue_rows",
    f"""SELECT capture_id, (row_number() OVER (PARTITION BY capture_id ORDER BY type, severity, description))::INT AS issue, type, severity,
  CASE WHEN length(description) > 50 THEN substr(description, 1, 47) || '...' ELSE description END AS short_text,
  CASE severity WHEN 'high' THEN 'highSeverity' WHEN 'medium' THEN 'mediumSeverity' ELSE 'lowSeverity' END AS severity_class
FROM (SELECT capture_id, type, severity, description || ' in ' || capture_id || ', see the measured value' AS description
  FROM ({_D7} UNION ALL {_D8}))""",
)
def g5(spark, sf):
    from pyspark.sql import functions as F

    p = derived.packets(spark, sf)
    issues = detect.load_issues(p).unionByName(detect.performance_issues(p))
    return graph.issue_rows(
        issues.withColumn(
            "description",
            F.concat("description", F.lit(" in "), "capture_id", F.lit(", see the measured value")),
        )
    )

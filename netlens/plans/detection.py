from pyspark.sql import functions as F

from netlens.functions import measures, net, text
from netlens.operators import anomaly, detect, findings
from netlens.plans.registry import query
from netlens.plans.shape import rounded
from netlens.sources import derived


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _row(detector, type_, severity, desc, cond, evidence="NULL", value="NULL") -> str:
    return (
        f"SELECT capture_id, {_q(detector)} AS detector, {_q(type_)} AS type, {_q(severity)} AS severity, "
        f"src_ip, dst_ip, frame_number, {_q(desc)} AS description, ({evidence})::VARCHAR AS evidence, "
        f"({value})::DOUBLE AS value, NULL::DOUBLE AS confidence FROM packets WHERE {cond}"
    )


def _agg(detector, type_, severity, desc, source, src="NULL", dst="NULL", evidence="NULL", value="NULL", conf="NULL"):
    return (
        f"SELECT capture_id, {_q(detector)} AS detector, {_q(type_)} AS type, {severity} AS severity, "
        f"{src}::VARCHAR AS src_ip, {dst}::VARCHAR AS dst_ip, NULL::BIGINT AS frame_number, {_q(desc)} AS description, "
        f"({evidence})::VARCHAR AS evidence, ({value})::DOUBLE AS value, {conf}::DOUBLE AS confidence FROM ({source})"
    )


def _union(*parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _like(col, words):
    return "(" + " OR ".join(f"contains({col}, {_q(w)})" for w in words) + ")"


_ENTROPY = """(SELECT coalesce(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) FROM (
   SELECT count(*)::DOUBLE AS n FROM (SELECT unnest(regexp_extract_all(hex({c}), '..')) AS b) GROUP BY b))"""


def _h(col: str) -> str:
    return _ENTROPY.format(c=col)


_HOSTILE = _like("payload", detect.WEB_ATTACK_STRINGS)
_D1 = _row("D1", "WEB_ATTACK", "critical", "Suspicious HTTP request detected", f"protocol = 'TCP' AND {_HOSTILE}", "payload")
_D2 = _agg(
    "D2", "PORT_SCAN", "'high'", "Port scan detected",
    "SELECT capture_id, src_ip AS s, count(DISTINCT dst_port) AS n FROM packets WHERE protocol = 'TCP' "
    "AND tcp_flags & 2 <> 0 GROUP BY 1, 2 HAVING count(DISTINCT dst_port) > 10", src="s", value="n",
)
_D3 = _agg(
    "D3", "SUSPICIOUS_DNS", "'medium'", "Suspicious DNS queries detected",
    "SELECT capture_id, count(*) AS n FROM packets WHERE dns_qr = 0 AND length(dns_query) > 20 "
    "AND regexp_matches(dns_query, '[0-9]') GROUP BY 1", value="n",
)
_D5_NX = _row("D5", "DNS_NXDOMAIN", "medium", "NXDOMAIN response for query", "dns_qr = 1 AND dns_rcode = 3")
_D5_TIMEOUT = _agg(
    "D5", "DNS_TIMEOUT", "'high'", "DNS queries without responses",
    "SELECT capture_id, sum(greatest(q - r, 0)) AS n FROM (SELECT capture_id, dns_id, count(*) FILTER (dns_qr = 0) AS q, "
    "count(*) FILTER (dns_qr = 1) AS r FROM packets GROUP BY 1, 2) GROUP BY 1 HAVING sum(greatest(q - r, 0)) > 0", value="n",
)


def _d6_flags(deep):
    return _union(
        _row("D6", "TCP_RESET", "medium" if deep else "high", "TCP connection reset detected", "protocol = 'TCP' AND tcp_flags & 4 <> 0"),
        _row("D6", "ZERO_WINDOW" if deep else "TCP_ZERO_WINDOW", "high", "TCP zero window detected", "protocol = 'TCP' AND tcp_window = 0"),
    )


_RT = (
    "SELECT capture_id, sum(n - 1)::BIGINT AS r, sum(n)::BIGINT AS total FROM (SELECT capture_id, count(*) AS n FROM packets "
    "WHERE protocol = 'TCP' GROUP BY capture_id, src_ip, src_port, dst_ip, dst_port, tcp_seq) GROUP BY 1"
)
_D6_RT = _agg("D6", "TCP_RETRANSMISSION", "'high'", "TCP retransmissions detected", f"SELECT * FROM ({_RT}) WHERE r > 0", value="r")
_D6_DEEP_RT = (
    "SELECT capture_id, 'D6' AS detector, 'TCP_RETRANSMISSION' AS type, 'high' AS severity, src_ip, dst_ip, frame_number, "
    "'TCP retransmission detected' AS description, NULL::VARCHAR AS evidence, NULL::DOUBLE AS value, NULL::DOUBLE AS confidence "
    "FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, src_ip, src_port, dst_ip, dst_port, tcp_seq "
    "ORDER BY frame_number) AS n FROM packets WHERE protocol = 'TCP') WHERE n > 1"
)
_D7 = _union(
    _agg("D7", "HIGH_BANDWIDTH", "'high'", "High bandwidth usage detected",
         "SELECT capture_id, sum(packet_size) AS n FROM packets GROUP BY 1 HAVING sum(packet_size) > 80000", value="n"),
    _agg("D7", "HIGH_CONNECTION_RATE", "'medium'", "High connection rate detected",
         "SELECT capture_id, count(*) AS n FROM (SELECT DISTINCT capture_id, src_ip, src_port, dst_ip, dst_port FROM packets "
         "WHERE protocol = 'TCP') GROUP BY 1 HAVING count(*) > 1000", value="n"),
    _agg("D7", "DUPLICATE_ACKS", "'medium'", "Duplicate ACKs detected",
         "SELECT capture_id, count(*) AS n FROM (SELECT capture_id, tcp_ack FROM packets WHERE protocol = 'TCP' "
         "AND tcp_flags & 16 <> 0 GROUP BY 1, 2 HAVING count(*) > 3) GROUP BY 1", value="n"),
)
_D8 = _union(
    _agg("D8", "high_latency", "CASE WHEN a < 500000 THEN 'medium' ELSE 'high' END", "High TCP handshake latency detected",
         """SELECT capture_id, sum(h)::BIGINT / count(h) AS a FROM (SELECT capture_id,
   CASE WHEN min(frame_number) FILTER (tcp_flags & 18 = 2) < min(frame_number) FILTER (tcp_flags & 18 = 18)
   THEN arg_min(us, frame_number) FILTER (tcp_flags & 18 = 18) - arg_min(us, frame_number) FILTER (tcp_flags & 18 = 2) END AS h
   FROM conv_packets WHERE protocol = 'TCP' GROUP BY capture_id, lo_ip, lo_port, hi_ip, hi_port) GROUP BY 1
   HAVING sum(h)::BIGINT / count(h) > 200000""", value="round(a / 1e6, 6)", conf="0.9"),
    _agg("D8", "packet_loss", "CASE WHEN r / total < 0.1 THEN 'medium' ELSE 'high' END", "High retransmission rate detected",
         f"SELECT * FROM ({_RT}) WHERE r / total > 0.05", value="round(r / total, 6)", conf="0.85"),
    _agg("D8", "dns_issues", "'medium'", "DNS performance issues detected",
         """SELECT capture_id, count(*) FILTER (v IS NULL OR rc <> 0) / count(*) AS fr FROM (
     SELECT q.capture_id, q.frame_number, min(r.us) - any_value(q.us) AS v, arg_min(r.dns_rcode, r.us) AS rc FROM packets q
     LEFT JOIN packets r ON r.capture_id = q.capture_id AND r.dns_id = q.dns_id AND r.dns_qr = 1 AND r.us > q.us
     WHERE q.dns_qr = 0 GROUP BY 1, 2) GROUP BY 1
     HAVING avg(v) / 1e6 > 0.1 OR count(*) FILTER (v IS NULL OR rc <> 0) / count(*) > 0.1""",
         value="round(fr, 6)", conf="0.8"),
)
_SQLI = "(" + _like("lower(http_uri)", detect.SQL_STRINGS) + " OR " + _like("lower(payload)", detect.SQL_STRINGS) + ")"
_XSS = "(" + _like("http_uri", detect.XSS_STRINGS) + " OR " + _like("payload", detect.XSS_STRINGS) + ")"
_D9 = _union(
    _row("D9", "SQL_INJECTION", "high", "SQL injection pattern detected", f"http_method IS NOT NULL AND {_SQLI}", "http_uri"),
    _row("D9", "XSS", "medium", "Cross-site scripting pattern detected", f"http_method IS NOT NULL AND {_XSS}", "http_uri"),
    _row("D9", "PATH_TRAVERSAL", "high", "Path traversal attempt detected",
         f"http_method IS NOT NULL AND {_like('http_uri', detect.TRAVERSAL_STRINGS)}", "http_uri"),
)
_D10 = _union(
    *[_row("D10", "sql_injection", "high", "SQL injection pattern detected", f"regexp_matches(payload, {_q(p)}, 'i')", _q(p))
      for p in detect.SQL_PATTERNS],
    *[_row("D10", "xss", "medium", "XSS pattern detected", f"regexp_matches(payload, {_q(p)}, 'i')", _q(p)) for p in detect.XSS_PATTERNS],
    _row("D10", "potential_credentials", "high", "Potential password transmission detected",
         f"regexp_matches(payload, {_q(detect.PASSWORD_PATTERN)}, 'i')"),
)
_D11 = _union(
    _row("D11", "LONG_SUBDOMAIN", "medium", "Unusually long DNS name", "length(dns_query) > 50", "dns_query", "length(dns_query)"),
    _row("D11", "dns_tunneling", "medium", "Unusually long domain name", "length(dns_query) > 100", "dns_query", "length(dns_query)"),
)
_D12_ENC = _union(
    *[_row("D12", "encoded_data", "medium", "Potential encoded data pattern", f"regexp_matches(payload, {_q(p)}, 'i')", _q(p),
           "strlen(payload)") for p in detect.ENCODED_PATTERNS]
)


def _d12_upload(threshold):
    return _agg("D12", "large_upload", "'high'", "Large data upload detected",
                "SELECT capture_id, dst_ip AS d, sum(strlen(payload)) AS n FROM packets WHERE payload <> '' GROUP BY 1, 2 "
                f"HAVING sum(strlen(payload)) > {threshold}", dst="d", value="n")


_MALWARE_LIKE = ("%MZ\\x90%",)
_D13 = _union(
    *[_row("D13", "malware_signature", "high", "Executable or archive header in payload",
           f"contains(hex(payload), {_q(sig.hex().upper())})", _q(sig.hex())) for sig in detect.MALWARE_SIGNATURES.values()]
)
_D14_DNS = _row("D14", "dns_covert_channel", "medium", "High entropy domain name suggesting covert communication",
                f"length(dns_query) > 20 AND {_h('dns_query')} > 4.5", "dns_query", f"round({_h('dns_query')}, 6)")
_D14_ICMP = _agg("D14", "icmp_covert_channel", "'medium'", "Unusual ICMP packet sizes detected",
                 "SELECT capture_id, max(coalesce(strlen(payload), 0)) AS n FROM packets WHERE protocol = 'ICMP' GROUP BY 1 "
                 "HAVING count(*) > 10 AND max(coalesce(strlen(payload), 0)) > 64", value="n")
_D15 = _union(
    _row("D15", "unusual_port_usage", "medium", "HTTP server port used as source port",
         "protocol = 'TCP' AND src_port = 80 AND dst_port > 1024"),
    _row("D15", "large_packet", "low", "Unusually large HTTP packet",
         "protocol = 'TCP' AND src_port <> 0 AND dst_port <> 0 AND (src_port = 80 OR dst_port = 80) AND packet_size > 1400",
         value="packet_size"),
)
_D16 = _row("D16", "suspicious_fin", "medium", "FIN packet to common service port",
            "protocol = 'TCP' AND tcp_flags & 1 <> 0 AND dst_port IN (21, 22, 23, 25, 53, 80, 110, 143, 443, 993, 995)", value="dst_port")


def _d17(percent, common):
    return _agg("D17", "unusual_protocol_distribution", "'medium'", "Unusual amount of protocol traffic",
                "SELECT capture_id, ip_proto, n, t FROM (SELECT capture_id, ip_proto, count(*) AS n, "
                "(sum(count(*)) OVER (PARTITION BY capture_id))::BIGINT AS t FROM packets GROUP BY 1, 2) "
                f"WHERE ip_proto NOT IN ({common}) AND n * 100 > t * {percent}", evidence="ip_proto", value="round(n * 100 / t, 6)")


_D18 = _row("D18", "weak_tls_version", "medium", "Weak TLS version detected", "tls_version < 771", value="tls_version")
_VOWELS = "length(regexp_replace(lower(dns_query), '[^aeiou]', '', 'g'))"
_LETTERS = r"length(regexp_replace(lower(dns_query), '[^\p{L}]', '', 'g'))"
_DGA = f"(length(dns_query) > 10 AND {_VOWELS} > 0 AND {_LETTERS} - {_VOWELS} > 4 * {_VOWELS})"
_PATTERN = (
    r"(regexp_matches(lower(dns_query), '\d{1,3}-\d{1,3}-\d{1,3}-\d{1,3}') OR regexp_matches(lower(dns_query), '[a-f0-9]{32,}')"
    " OR len(list_filter(string_split(lower(dns_query), ''), lambda c: contains(lower(dns_query), repeat(c, 5)))) > 0)"
)
_D20 = _union(
    _row("D20", "potential_dga", "medium", "Generated-looking domain", _DGA, "lower(dns_query)"),
    _row("D20", "suspicious_domain", "medium", "Suspicious domain pattern", _PATTERN, "lower(dns_query)"),
    _row("D20", "long_domain", "medium", "Long domain name", "length(dns_query) > 50", "lower(dns_query)"),
)


def _j9(domains):
    return _union(*[_row("J9", "suspicious_dns", "high", "Suspicious DNS query", f"contains(dns_query, {_q(d)})", _q(d)) for d in domains])


_TRIAGE = _union(_D1, _D2, _D3)
_DEEP = _union(_D9, _D10, _D11, _D12_ENC, _D13, _D14_DNS, _D15, _D16, _D18, _D20, _j9(detect.WATCHLIST))
_ALL = _union(
    _D1, _D5_NX, _d6_flags(False), _DEEP, _D2, _D3, _D5_TIMEOUT, _D6_RT, _D7, _D8, _d12_upload(10_000_000), _D14_ICMP,
    _d17(5, "1, 6, 17"),
)


def _packet_query(name, sql, rules):
    @query(name, sql)
    def run(spark, sf):
        return detect.packet_findings(derived.packets(spark, sf), rules())

    return run


_packet_query("d1_web_attacks", _D1, detect.web_attacks)
_packet_query("d9_http_request_attacks", _D9, detect.http_requests)
_packet_query("d10_payload_patterns", _D10, detect.payload_patterns)
_packet_query("d11_long_dns_names", _D11, detect.long_names)
_packet_query("d13_malware_signatures", _D13, detect.malware_signatures)
_packet_query("d15_port_anomalies", _D15, detect.port_anomalies)
_packet_query("d16_suspicious_fins", _D16, detect.suspicious_fins)
_packet_query("d18_weak_tls", _D18, detect.weak_tls)
_packet_query("d20_suspicious_names", _D20, detect.suspicious_names)
_packet_query("j9_domain_watchlist", _j9(("pool.example", ".tk", "www1")),
              lambda: detect.watchlist(("pool.example", ".tk", "www1")))


@query("d2_port_scans", _D2)
def d2(spark, sf):
    return detect.port_scans(derived.packets(spark, sf))


@query("d3_suspicious_dns", _D3)
def d3(spark, sf):
    return detect.suspicious_dns(derived.packets(spark, sf))


@query(
    "d4_risk_score",
    f"""SELECT capture_id, count(*) AS findings, round(least(1, sum(CASE severity WHEN 'critical' THEN 0.4 WHEN 'high' THEN 0.3
  WHEN 'medium' THEN 0.2 ELSE 0.1 END))::DOUBLE, 6) AS risk_score FROM ({_TRIAGE}) GROUP BY 1""",
)
def d4(spark, sf):
    return detect.risk_score(detect.security_triage(derived.packets(spark, sf)))


@query("d5_dns_failures", _union(_D5_NX, _D5_TIMEOUT))
def d5(spark, sf):
    p = derived.packets(spark, sf)
    return detect.packet_findings(p, detect.dns_failures()).unionByName(detect.dns_timeouts(p))


@query("d6_tcp_findings", _union(_d6_flags(False), _D6_RT))
def d6(spark, sf):
    p = derived.packets(spark, sf)
    return detect.packet_findings(p, detect.tcp_flags()).unionByName(detect.retransmission_alerts(p))


@query("d6_tcp_findings_deep", _union(_d6_flags(True), _D6_DEEP_RT))
def d6_deep(spark, sf):
    p = derived.packets(spark, sf)
    return detect.packet_findings(p, detect.tcp_flags(deep=True)).unionByName(
        detect.retransmission_findings(p)
    )


@query("d7_load_issues", _D7)
def d7(spark, sf):
    return detect.load_issues(derived.packets(spark, sf))


@query("d8_performance_issues", _D8)
def d8(spark, sf):
    return detect.performance_issues(derived.packets(spark, sf))


@query(
    "d9_http_risk",
    f"""SELECT capture_id, count(*) AS findings, round(least(1, sum(CASE severity WHEN 'high' THEN 0.3 ELSE 0.2 END))::DOUBLE, 6)
  AS risk_score FROM ({_D9}) GROUP BY 1""",
)
def d9_risk(spark, sf):
    return detect.risk_score(detect.packet_findings(derived.packets(spark, sf), detect.http_requests()))


@query("d12_exfiltration", _union(_D12_ENC, _d12_upload(2000)))
def d12(spark, sf):
    p = derived.packets(spark, sf)
    return detect.packet_findings(p, detect.encoded_payloads()).unionByName(
        detect.large_uploads(p, threshold=2000)
    )


@query("d14_covert_channels", _union(_D14_DNS, _D14_ICMP))
def d14(spark, sf):
    p = derived.packets(spark, sf)
    return detect.packet_findings(p, detect.covert_names()).unionByName(detect.covert_icmp(p))


@query("d17_unusual_protocols", _d17(2, "6, 17"))
def d17(spark, sf):
    return detect.unusual_l3(derived.packets(spark, sf), percent=2, common=(6, 17))


@query(
    "d19_overall_severity",
    f"""SELECT capture_id, count(*) AS findings, round(least(1.0, count(*) * 0.1::DOUBLE), 6) AS overall_severity,
  CASE WHEN count(*) = 0 THEN 'LOW' WHEN count(*) < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS deep_risk
FROM ({_ALL}) WHERE detector IN ('D1', 'D2', 'D3', 'D5', 'D6', 'D7') GROUP BY 1""",
)
def d19(spark, sf):
    return rounded(findings.overall(detect.triage_issues(derived.packets(spark, sf))))


# A second capture list: the four of the view and one without any packet of interest.
_QUIET = "(SELECT DISTINCT capture_id FROM packets UNION ALL SELECT 'quiet')"


def _captures(packets):
    quiet = packets.sparkSession.range(1).select(F.lit("quiet").alias("capture_id"))
    return packets.select("capture_id").distinct().unionByName(quiet)


@query(
    "d4_risk_of_every_capture",
    f"""SELECT c.capture_id, count(f.severity) AS findings, round(least(1.0, coalesce(sum(CASE severity WHEN 'critical' THEN 0.4 WHEN 'high' THEN 0.3
  WHEN 'medium' THEN 0.2 WHEN 'low' THEN 0.1 END), 0))::DOUBLE, 6) AS risk_score
FROM {_QUIET} c LEFT JOIN ({_TRIAGE}) f ON c.capture_id = f.capture_id GROUP BY 1""",
)
def d4_every(spark, sf):
    p = derived.packets(spark, sf)
    return detect.risk_score(detect.security_triage(p), _captures(p))


@query(
    "a31_risk_level_of_every_capture",
    f"""SELECT c.capture_id, count(f.severity) AS findings, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
  0::BIGINT AS anomalies, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'HIGH' WHEN count(*) FILTER (severity = 'high') > 3
  THEN 'MEDIUM-HIGH' WHEN count(*) FILTER (severity = 'high') > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM {_QUIET} c LEFT JOIN ({_TRIAGE}) f ON c.capture_id = f.capture_id GROUP BY 1""",
)
def a31_every(spark, sf):
    p = derived.packets(spark, sf)
    return findings.risk_level(detect.security_triage(p), _captures(p))


# Findings of outlier models, as a rule that SQL can tell: every packet over 1,400 bytes.
_LARGE = "SELECT capture_id, 'M6' AS detector, 'high' AS severity, src_ip FROM packets WHERE packet_size > 1400"


def _with_anomalies(packets):
    large = packets.where("packet_size > 1400").select(
        "capture_id", F.lit("size_anomaly").alias("anomaly_type"), F.lit("high").alias("severity"), "src_ip", "dst_ip",
        F.array(F.lit("isolation_forest")).alias("contributing"), F.col("packet_size").cast("double").alias("anomaly_score"), F.lit(1.0).alias("confidence"),
    )
    return detect.all_findings(packets, anomaly.as_findings(large))


_EVERY = f"""SELECT c.capture_id, count(f.detector) AS findings, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (detector = 'M6') AS anomalies,
  count(*) FILTER (detector <> 'D2' AND src_ip IS NOT NULL) AS suspicious_ip_count, count(*) FILTER (detector = 'D2') AS port_scan_count,
  count(*) FILTER (detector <> 'D2' AND src_ip IS NULL) AS anomaly_count,
  count(*) FILTER (detector <> 'D2' AND severity = 'high') AS high_severity_count,
  count(*) FILTER (detector <> 'D2' AND severity = 'medium') AS medium_severity_count,
  count(*) FILTER (detector <> 'D2' AND severity = 'low') AS low_severity_count
FROM {_QUIET} c LEFT JOIN (SELECT capture_id, detector, severity, src_ip FROM ({_ALL}) UNION ALL {_LARGE}) f ON c.capture_id = f.capture_id GROUP BY 1"""


@query(
    "a32_recommendations_of_every_capture",
    f""", t AS ({_EVERY})
SELECT capture_id, 'Address Critical Security Issues Immediately' AS title, 'CRITICAL' AS priority FROM t WHERE critical > 0
UNION ALL SELECT capture_id, 'Investigate High-Priority Security Findings', 'HIGH' FROM t WHERE high > 0
UNION ALL SELECT capture_id, 'Review Machine Learning Anomaly Findings', 'MEDIUM' FROM t WHERE anomalies > 0
UNION ALL SELECT capture_id, 'Implement Continuous Network Monitoring', 'MEDIUM' FROM t
UNION ALL SELECT capture_id, 'Regular Security Assessments', 'LOW' FROM t
UNION ALL SELECT capture_id, 'Update Security Policies', 'LOW' FROM t""",
)
def a32_every(spark, sf):
    p = derived.packets(spark, sf)
    return findings.recommendations(_with_anomalies(p), _captures(p))


@query(
    "a33_security_summary_of_every_capture",
    f"""SELECT capture_id, suspicious_ip_count, port_scan_count, anomaly_count, high_severity_count, medium_severity_count, low_severity_count,
  findings AS total_security_issues FROM ({_EVERY})""",
)
def a33_every(spark, sf):
    p = derived.packets(spark, sf)
    return findings.security_summary(_with_anomalies(p), _captures(p))


@query(
    "d19_overall_severity_of_every_capture",
    f"""SELECT c.capture_id, count(f.detector) AS findings, round(least(1.0, count(f.detector) * 0.1::DOUBLE), 6) AS overall_severity,
  CASE WHEN count(f.detector) = 0 THEN 'LOW' WHEN count(f.detector) < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS deep_risk
FROM {_QUIET} c LEFT JOIN (SELECT capture_id, detector FROM ({_ALL}) WHERE detector IN ('D1', 'D2', 'D3', 'D5', 'D6', 'D7')) f
  ON c.capture_id = f.capture_id GROUP BY 1""",
)
def d19_every(spark, sf):
    p = derived.packets(spark, sf)
    return rounded(findings.overall(detect.triage_issues(p), _captures(p)))


@query(
    "u2_all_findings",
    f"""SELECT *, CASE type WHEN 'high_latency' THEN 'Check network connectivity and server response times'
  WHEN 'packet_loss' THEN 'Investigate network path for packet loss'
  WHEN 'dns_issues' THEN 'Check DNS server configuration and connectivity'
  ELSE 'Investigate ' || type || ' behavior' END AS recommendation FROM ({_ALL})""",
)
def u2(spark, sf):
    return detect.with_recommendations(detect.all_findings(derived.packets(spark, sf)))


@query("a30_findings_by_severity", f"SELECT capture_id, severity, count(*) AS findings FROM ({_ALL}) GROUP BY ALL")
def a30_severity(spark, sf):
    return findings.counts_by(detect.all_findings(derived.packets(spark, sf)), "severity")


@query("a30_findings_by_type", f"SELECT capture_id, type, count(*) AS findings FROM ({_ALL}) GROUP BY ALL")
def a30_type(spark, sf):
    return findings.counts_by(detect.all_findings(derived.packets(spark, sf)), "type")


@query(
    "a30_findings_by_category",
    f"""SELECT capture_id, CASE WHEN contains(lower(description), 'malware') THEN 'Malware'
  WHEN contains(lower(description), 'exfiltration') THEN 'Data Exfiltration'
  WHEN contains(lower(description), 'anomaly') THEN 'Network Anomalies'
  WHEN contains(lower(description), 'protocol') THEN 'Protocol Violations' ELSE 'Suspicious Activity' END AS category,
  count(*) AS findings FROM ({_ALL}) GROUP BY ALL""",
)
def a30_category(spark, sf):
    return findings.counts_by_category(detect.all_findings(derived.packets(spark, sf)))


_TOTALS = f"""SELECT capture_id, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low, 0::BIGINT AS anomalies FROM ({_ALL}) GROUP BY 1"""


@query(
    "a31_risk_level",
    f"""SELECT *, CASE WHEN critical > 0 THEN 'HIGH' WHEN high > 3 THEN 'MEDIUM-HIGH' WHEN high > 0 THEN 'MEDIUM'
  ELSE 'LOW' END AS risk_level FROM ({_TOTALS})""",
)
def a31(spark, sf):
    return findings.risk_level(detect.all_findings(derived.packets(spark, sf)))


@query(
    "a32_recommendations",
    f""", t AS ({_TOTALS})
SELECT capture_id, 'Address Critical Security Issues Immediately' AS title, 'CRITICAL' AS priority FROM t WHERE critical > 0
UNION ALL SELECT capture_id, 'Investigate High-Priority Security Findings', 'HIGH' FROM t WHERE high > 0
UNION ALL SELECT capture_id, 'Review Machine Learning Anomaly Findings', 'MEDIUM' FROM t WHERE anomalies > 0
UNION ALL SELECT capture_id, 'Implement Continuous Network Monitoring', 'MEDIUM' FROM t
UNION ALL SELECT capture_id, 'Regular Security Assessments', 'LOW' FROM t
UNION ALL SELECT capture_id, 'Update Security Policies', 'LOW' FROM t""",
)
def a32(spark, sf):
    return findings.recommendations(detect.all_findings(derived.packets(spark, sf)))


@query(
    "a33_security_summary",
    f"""SELECT capture_id, count(*) FILTER (detector <> 'D2' AND src_ip IS NOT NULL) AS suspicious_ip_count,
  count(*) FILTER (detector = 'D2') AS port_scan_count,
  count(*) FILTER (detector <> 'D2' AND src_ip IS NULL) AS anomaly_count,
  count(*) FILTER (detector <> 'D2' AND severity = 'high') AS high_severity_count,
  count(*) FILTER (detector <> 'D2' AND severity = 'medium') AS medium_severity_count,
  count(*) FILTER (detector <> 'D2' AND severity = 'low') AS low_severity_count,
  count(*) AS total_security_issues FROM ({_ALL}) GROUP BY 1""",
)
def a33(spark, sf):
    return findings.security_summary(detect.all_findings(derived.packets(spark, sf)))


@query(
    "x17_severity_scores",
    f"""SELECT capture_id, severity, count(*) AS findings,
  CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS severity_rank,
  CASE severity WHEN 'critical' THEN 0.4::DOUBLE WHEN 'high' THEN 0.3::DOUBLE WHEN 'medium' THEN 0.2::DOUBLE
    WHEN 'low' THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS severity_score
FROM ({_union(_D1, _d6_flags(True), _D15, _D20)}) GROUP BY ALL""",
)
def x17(spark, sf):
    rules = [*detect.web_attacks(), *detect.tcp_flags(True), *detect.port_anomalies(), *detect.suspicious_names()]
    return findings.counts_by(
        detect.packet_findings(derived.packets(spark, sf), rules), "severity"
    ).withColumns(
        {
            "severity_rank": measures.severity_rank("severity"),
            "severity_score": measures.severity_score("severity"),
        }
    )


@query(
    "a24_tls_summary",
    """SELECT capture_id, tls_version, tls_cipher, count(*) AS hellos, tls_version < 771 AS weak FROM packets
WHERE tls_version IS NOT NULL OR tls_cipher IS NOT NULL GROUP BY ALL""",
)
def a24(spark, sf):
    from netlens.operators.tls import hello_counts

    return hello_counts(derived.packets(spark, sf))


@query(
    "x9_payload_entropy",
    f"SELECT capture_id, frame_number, round({_h('payload')}, 6) AS entropy FROM packets WHERE payload IS NOT NULL",
)
def x9(spark, sf):
    p = derived.packets(spark, sf).where(F.col("payload").isNotNull())
    return rounded(p.select("capture_id", "frame_number", text.entropy("payload").alias("entropy")))


@query(
    "x10_port_entropy",
    """, c AS (SELECT capture_id, ip, port, count(*)::DOUBLE AS n FROM (
   SELECT capture_id, src_ip AS ip, src_port AS port FROM packets WHERE src_port IS NOT NULL
   UNION ALL SELECT capture_id, src_ip, dst_port FROM packets WHERE dst_port IS NOT NULL) GROUP BY 1, 2, 3)
SELECT capture_id, ip AS src_ip, sum(n)::BIGINT AS ports_seen, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS port_entropy
FROM c GROUP BY 1, 2""",
)
def x10(spark, sf):
    from netlens.operators.anomaly import port_entropy

    return rounded(port_entropy(derived.packets(spark, sf), ["capture_id", "src_ip"]))


@query(
    "x12_x13_x14_domain_looks",
    f"""SELECT dns_query AS domain, count(*) AS queries, {_DGA} AS generated, {_PATTERN} AS suspicious,
  (length(dns_query) > 100 OR {_h('dns_query')} > 4.0 OR regexp_matches(dns_query, '[.](tk|ml|ga|cf)$')) AS suspicious_deep,
  array_to_string(list_filter([CASE WHEN length(dns_query) > 100 THEN 'excessive_length' END,
    CASE WHEN {_h('dns_query')} > 4.0 THEN 'high_entropy' END,
    CASE WHEN regexp_matches(dns_query, '[0-9]{{4,}}') THEN 'excessive_numbers' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT dns_query FROM packets WHERE dns_query IS NOT NULL) GROUP BY dns_query""",
)
def x12(spark, sf):
    names = (
        derived.packets(spark, sf)
        .where(F.col("dns_query").isNotNull())
        .groupBy(F.col("dns_query").alias("domain"))
        .agg(F.count("*").alias("queries"))
    )
    return names.select(
        "domain",
        "queries",
        text.looks_generated("domain").alias("generated"),
        text.suspicious_pattern("domain").alias("suspicious"),
        text.suspicious_deep("domain").alias("suspicious_deep"),
        F.concat_ws(",", text.suspicion_reasons("domain")).alias("reasons"),
    )


@query(
    "x15_application_protocol",
    """SELECT capture_id, frame_number, CASE WHEN coalesce(payload, '') = '' THEN 'unknown'
  WHEN payload LIKE 'GET %' OR payload LIKE 'POST %' OR payload LIKE 'HTTP/%' THEN 'HTTP'
  WHEN dst_port = 443 THEN 'HTTPS/TLS'
  WHEN contains(substr(payload, 1, 20), '220 ') OR dst_port IN (20, 21) THEN 'FTP'
  WHEN payload LIKE 'SSH-%' OR dst_port = 22 THEN 'SSH' WHEN dst_port = 53 THEN 'DNS'
  WHEN dst_port = 80 THEN 'HTTP' WHEN dst_port = 23 THEN 'Telnet' WHEN dst_port = 25 THEN 'SMTP'
  WHEN dst_port = 110 THEN 'POP3' WHEN dst_port = 143 THEN 'IMAP' WHEN dst_port = 993 THEN 'IMAPS'
  WHEN dst_port = 995 THEN 'POP3S' ELSE 'unknown' END AS application FROM packets""",
)
def x15(spark, sf):
    return derived.packets(spark, sf).select(
        "capture_id", "frame_number", text.application_protocol("payload", "dst_port").alias("application")
    )


@query(
    "x2_ip_class",
    """, ips AS (SELECT ip, count(*) AS packets FROM (SELECT src_ip AS ip FROM packets UNION ALL
   SELECT (frame_number % 256) || '.' || (frame_number // 10 % 256) || '.' || (frame_number // 7 % 256) || '.' || (255 - frame_number % 5)
   FROM packets UNION ALL SELECT '300.1.1.' || (frame_number % 9) FROM packets) GROUP BY 1),
n AS (SELECT *, string_split(ip, '.')::INT[] AS o FROM ips)
SELECT ip, packets, CASE WHEN o[1] > 255 THEN 'unknown' WHEN o[1] BETWEEN 224 AND 239 THEN 'multicast'
  WHEN o[4] = 255 THEN 'broadcast'
  WHEN o[1] IN (0, 10, 127) OR o[1] >= 240 OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31)
    OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 192 AND o[2] = 0 AND o[3] = 2)
    OR (o[1] = 192 AND o[2] = 0 AND o[3] = 0 AND o[4] NOT IN (9, 10))
    OR (o[1] = 198 AND o[2] IN (18, 19)) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113)
  THEN 'internal' ELSE 'external' END AS ip_class FROM n""",
)
def x2(spark, sf):
    p = derived.packets(spark, sf)
    n = F.col("frame_number")
    made = F.concat_ws(
        ".",
        (n % 256).cast("string"),
        (F.floor(n / 10) % 256).cast("string"),
        (F.floor(n / 7) % 256).cast("string"),
        (255 - n % 5).cast("string"),
    )
    ips = (
        p.select(F.col("src_ip").alias("ip"))
        .union(p.select(made))
        .union(p.select(F.concat(F.lit("300.1.1."), (n % 9).cast("string"))))
    )
    return (
        ips.groupBy("ip")
        .agg(F.count("*").alias("packets"))
        .withColumn("ip_class", net.ip_class("ip"))
    )


@query(
    "x19_node_ids",
    """SELECT host, count(*) AS packets, CASE WHEN regexp_matches(c, '^[0-9]') THEN 'node_' || c ELSE c END AS node_id
FROM (SELECT host, regexp_replace(host, '[^a-zA-Z0-9_]', '_', 'g') AS c FROM (SELECT src_ip AS host FROM packets
  UNION ALL SELECT http_host FROM packets WHERE http_host IS NOT NULL)) GROUP BY ALL""",
)
def x19(spark, sf):
    p = derived.packets(spark, sf)
    hosts = p.select(F.col("src_ip").alias("host")).union(
        p.where(F.col("http_host").isNotNull()).select("http_host")
    )
    return (
        hosts.groupBy("host").agg(F.count("*").alias("packets")).withColumn("node_id", net.node_id("host"))
    )


@query(
    "x21_ips_in_text",
    r""", t AS (SELECT capture_id, frame_number, 'Scan from ' || src_ip || ' to ' || dst_ip || ', v1.2.3' AS line FROM packets)
SELECT capture_id, frame_number, array_to_string(regexp_extract_all(line, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), ' ') AS ips FROM t""",
)
def x21(spark, sf):
    line = F.concat(F.lit("Scan from "), F.col("src_ip"), F.lit(" to "), F.col("dst_ip"), F.lit(", v1.2.3"))
    return derived.packets(spark, sf).select(
        "capture_id", "frame_number", F.concat_ws(" ", net.ips_in_text(line)).alias("ips")
    )

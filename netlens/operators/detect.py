"""Detectors. All return rows of the findings schema.

Rules about single packets are collected in tables and evaluated together: one scan of
the packets serves any number of them. Rules about groups are aggregates.
"""

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions import net, text
from netlens.functions.measures import severity_score
from netlens.operators import dns, tcp, traffic
from netlens.operators.findings import for_every
from netlens.schema import FINDINGS

# Detection strings and patterns.
WEB_ATTACK_STRINGS = ("../../../", "DROP TABLE", "SELECT * FROM", "<script>")
SQL_STRINGS = ("union select", "drop table", "or 1=1")
XSS_STRINGS = ("<script>", "javascript:", "onerror=")
TRAVERSAL_STRINGS = ("../", "..\\")
SQL_PATTERNS = (
    r"union.*select",
    r"drop\s+table",
    r"insert\s+into",
    r"delete\s+from",
    r"exec\s*\(",
    r"sp_executesql",
)
XSS_PATTERNS = (r"<script.*?>", r"javascript:", r"vbscript:", r"onload\s*=", r"onerror\s*=")
PASSWORD_PATTERN = r"""password\s*[:=]\s*["']?[^\s"']+"""
ENCODED_PATTERNS = (r"base64", r"[A-Za-z0-9+/]{100,}={0,2}", r"[0-9a-fA-F]{64,}")
MALWARE_SIGNATURES = {
    "PE": b"MZ\x90\x00",
    "ELF": b"\x7fELF",
    "ZIP": b"PK\x03\x04",
    "OLE": b"\xd0\xcf\x11\xe0",
}
FIN_SERVICE_PORTS = (21, 22, 23, 25, 53, 80, 110, 143, 443, 993, 995)
WATCHLIST = ("malware.com", "phishing.net", "suspicious.org")

# Thresholds.
SCAN_PORTS = 10
BANDWIDTH_BYTES = 80_000
CONNECTION_RATE = 1000
UPLOAD_BYTES = 10_000_000
COVERT_ICMP_PACKETS, COVERT_ICMP_PAYLOAD = 10, 64
L3_SHARE_PERCENT = 5
SLOW_HANDSHAKE_US, VERY_SLOW_HANDSHAKE_US = 200_000, 500_000
LOSS_RATE, HIGH_LOSS_RATE = 0.05, 0.1
SLOW_DNS_S, DNS_FAILURE_RATE = 0.1, 0.1


@dataclass(frozen=True)
class Rule:
    """One per-packet rule: when it applies, and what it reports."""

    detector: str
    type: str
    severity: str
    when: Column
    description: str
    evidence: Column | None = None
    value: Column | None = None
    #: A column without which the rule never holds: NULL there spares its evaluation.
    needs: str | None = None


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _payload() -> Column:
    return F.col("payload").cast("string")


def _has(column: Column, words) -> Column:
    return _any([column.contains(w) for w in words])


def _is_tcp() -> Column:
    return F.upper("protocol") == "TCP"


def _matches(column: Column, pattern: str) -> Column:
    return column.rlike("(?i)" + pattern)


def _needing(column: str, rules: list[Rule]) -> list[Rule]:
    return [replace(r, needs=column) for r in rules]


def web_attacks() -> list[Rule]:
    return _needing("payload", [
        Rule(
            "D1", "WEB_ATTACK", "critical", _is_tcp() & _has(_payload(), WEB_ATTACK_STRINGS),
            "Suspicious HTTP request detected", _payload(),
        )
    ])


def dns_failures() -> list[Rule]:
    return [
        Rule(
            "D5", "DNS_NXDOMAIN", "medium", (F.col("dns_qr") == 1) & (F.col("dns_rcode") == 3),
            "NXDOMAIN response for query",
        )
    ]


def tcp_flags(deep: bool = False) -> list[Rule]:
    return [
        Rule(
            "D6", "TCP_RESET", "medium" if deep else "high",
            _is_tcp() & net.has_flags(net.TCP_FLAGS["RST"]), "TCP connection reset detected",
        ),
        Rule(
            "D6", "ZERO_WINDOW" if deep else "TCP_ZERO_WINDOW", "high",
            _is_tcp() & (F.col("tcp_window") == 0), "TCP zero window detected",
        ),
    ]


def http_requests() -> list[Rule]:
    is_request = F.col("http_method").isNotNull()
    uri, body = F.coalesce("http_uri", F.lit("")), F.coalesce(_payload(), F.lit(""))
    low_uri, low_body = F.lower(uri), F.lower(body)
    return _needing("http_method", [
        Rule(
            "D9", "SQL_INJECTION", "high",
            is_request & (_has(low_uri, SQL_STRINGS) | _has(low_body, SQL_STRINGS)),
            "SQL injection pattern detected", uri,
        ),
        Rule(
            "D9", "XSS", "medium",
            is_request & (_has(uri, XSS_STRINGS) | _has(body, XSS_STRINGS)),
            "Cross-site scripting pattern detected", uri,
        ),
        Rule(
            "D9", "PATH_TRAVERSAL", "high", is_request & _has(uri, TRAVERSAL_STRINGS),
            "Path traversal attempt detected", uri,
        ),
    ])


def payload_patterns() -> list[Rule]:
    p = _payload()
    return _needing("payload", [
        *[
            Rule("D10", "sql_injection", "high", _matches(p, x), "SQL injection pattern detected", F.lit(x))
            for x in SQL_PATTERNS
        ],
        *[
            Rule("D10", "xss", "medium", _matches(p, x), "XSS pattern detected", F.lit(x))
            for x in XSS_PATTERNS
        ],
        Rule(
            "D10", "potential_credentials", "high", _matches(p, PASSWORD_PATTERN),
            "Potential password transmission detected",
        ),
    ])


def long_names() -> list[Rule]:
    name = F.col("dns_query")
    size = F.length(name)
    return _needing("dns_query", [
        Rule("D11", "LONG_SUBDOMAIN", "medium", size > 50, "Unusually long DNS name", name, size),
        Rule("D11", "dns_tunneling", "medium", size > 100, "Unusually long domain name", name, size),
    ])


def encoded_payloads() -> list[Rule]:
    return _needing("payload", [
        Rule(
            "D12", "encoded_data", "medium", _matches(_payload(), x),
            "Potential encoded data pattern", F.lit(x), F.octet_length("payload"),
        )
        for x in ENCODED_PATTERNS
    ])


def malware_signatures() -> list[Rule]:
    b = F.col("payload").cast("binary")
    return _needing("payload", [
        Rule(
            "D13", "malware_signature", "high", F.contains(b, F.lit(sig)),
            "Executable or archive header in payload", F.lit(sig.hex()),
        )
        for sig in MALWARE_SIGNATURES.values()
    ])


def covert_names() -> list[Rule]:
    name = F.col("dns_query")
    h = text.entropy(name)
    return _needing("dns_query", [
        Rule(
            "D14", "dns_covert_channel", "medium",
            (F.length(name) > 20) & (h > 4.5),
            "High entropy domain name suggesting covert communication", name, F.round(h, 6),
        )
    ])


def port_anomalies() -> list[Rule]:
    ported = _is_tcp() & net.has_ports()
    sp, dp = F.col("src_port"), F.col("dst_port")
    return [
        Rule(
            "D15", "unusual_port_usage", "medium", ported & (sp == 80) & (dp > 1024),
            "HTTP server port used as source port",
        ),
        Rule(
            "D15", "large_packet", "low",
            ported & ((sp == 80) | (dp == 80)) & (F.col("packet_size") > 1400),
            "Unusually large HTTP packet", None, F.col("packet_size"),
        ),
    ]


def suspicious_fins() -> list[Rule]:
    return [
        Rule(
            "D16", "suspicious_fin", "medium",
            _is_tcp() & net.has_flags(net.TCP_FLAGS["FIN"]) & F.col("dst_port").isin(*FIN_SERVICE_PORTS),
            "FIN packet to common service port", None, F.col("dst_port"),
        )
    ]


def weak_tls() -> list[Rule]:
    return _needing("tls_version", [
        Rule(
            "D18", "weak_tls_version", "medium", F.col("tls_version") < 0x0303,
            "Weak TLS version detected", None, F.col("tls_version"),
        )
    ])


def suspicious_names() -> list[Rule]:
    name = F.lower("dns_query")
    return _needing("dns_query", [
        Rule("D20", "potential_dga", "medium", text.looks_generated(name), "Generated-looking domain", name),
        Rule("D20", "suspicious_domain", "medium", text.suspicious_pattern(name), "Suspicious domain pattern", name),
        Rule("D20", "long_domain", "medium", F.length(name) > 50, "Long domain name", name),
    ])


def watchlist(domains=WATCHLIST) -> list[Rule]:
    """DNS names containing a listed domain. The list is plan text, so no join is needed."""
    name = F.col("dns_query")
    return _needing("dns_query", [
        Rule("J9", "suspicious_dns", "high", name.contains(d), "Suspicious DNS query", F.lit(d))
        for d in domains
    ])


def triage_rules() -> list[Rule]:
    return [*web_attacks(), *dns_failures(), *tcp_flags()]


def deep_rules() -> list[Rule]:
    return [
        *http_requests(),
        *payload_patterns(),
        *long_names(),
        *encoded_payloads(),
        *malware_signatures(),
        *covert_names(),
        *port_anomalies(),
        *suspicious_fins(),
        *weak_tls(),
        *suspicious_names(),
        *watchlist(),
    ]


def _hits(rules: list[Rule]) -> Column:
    """The findings of a packet by ``rules``, as an array."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    r.when,
                    F.struct(
                        F.lit(r.detector).alias("detector"),
                        F.lit(r.type).alias("type"),
                        F.lit(r.severity).alias("severity"),
                        F.lit(r.description).alias("description"),
                        (r.evidence if r.evidence is not None else F.lit(None))
                        .cast("string")
                        .alias("evidence"),
                        (r.value if r.value is not None else F.lit(None)).cast("double").alias("value"),
                    ),
                )
                for r in rules
            ]
        )
    )


def packet_findings(packets: DataFrame, rules: list[Rule]) -> DataFrame:
    """Evaluate per-packet rules in one pass; a packet may give several findings. Rules about the
    same column are passed over together where it is NULL."""
    columns = list(dict.fromkeys(r.needs for r in rules))
    parts = [
        hits if c is None else F.when(F.col(c).isNotNull(), hits).otherwise(F.array().cast(_HITS))
        for c, hits in ((c, _hits([r for r in rules if r.needs == c])) for c in columns)
    ]
    hits = F.concat(*parts)
    found = packets.select(
        "capture_id", "src_ip", "dst_ip", "frame_number", F.explode(hits).alias("f")
    )
    return _conform(found.select("capture_id", "src_ip", "dst_ip", "frame_number", "f.*"))


def _conform(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FINDINGS.fields
        ]
    )


def _report(df: DataFrame, detector: str, type_: str, severity, description: str, **extra) -> DataFrame:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return _conform(
        df.withColumns(
            {
                "detector": F.lit(detector),
                "type": F.lit(type_),
                "severity": severity,
                "description": F.lit(description),
                **extra,
            }
        )
    )


def port_scans(packets: DataFrame, ports: int = SCAN_PORTS) -> DataFrame:
    """Sources whose SYN-flagged packets reach more than ``ports`` distinct ports."""
    sources = (
        packets.where(_is_tcp() & net.has_flags(net.TCP_FLAGS["SYN"]))
        .groupBy("capture_id", "src_ip")
        .agg(F.count_distinct("dst_port").alias("value"))
        .where(F.col("value") > ports)
    )
    return _report(sources, "D2", "PORT_SCAN", "high", "Port scan detected")


def suspicious_dns(packets: DataFrame) -> DataFrame:
    """One finding per capture counting DNS names over 20 characters with a digit."""
    odd = (F.col("dns_qr") == 0) & (F.length("dns_query") > 20) & F.col("dns_query").rlike("[0-9]")
    counted = packets.where(odd).groupBy("capture_id").agg(F.count("*").alias("value"))
    return _report(counted, "D3", "SUSPICIOUS_DNS", "medium", "Suspicious DNS queries detected")


def dns_timeouts(packets: DataFrame) -> DataFrame:
    open_queries = dns.triage(packets).where(F.col("unanswered") > 0)
    return _report(
        open_queries, "D5", "DNS_TIMEOUT", "high", "DNS queries without responses",
        value=F.col("unanswered"),
    )


def retransmission_alerts(packets: DataFrame) -> DataFrame:
    """One finding per capture that has any retransmission."""
    counted = tcp.retransmissions(packets, tcp.CAPTURE).where(F.col("retransmissions") > 0)
    return _report(
        counted, "D6", "TCP_RETRANSMISSION", "high", "TCP retransmissions detected",
        value=F.col("retransmissions"),
    )


def retransmission_findings(packets: DataFrame) -> DataFrame:
    """One finding per retransmitted packet (the deep variant)."""
    return _report(
        tcp.retransmitted_packets(packets), "D6", "TCP_RETRANSMISSION", "high",
        "TCP retransmission detected",
    )


def load_issues(packets: DataFrame) -> DataFrame:
    """High bandwidth, high connection rate and duplicate ACKs of a capture, in one pass over
    the capture-level counts."""
    c = traffic.performance_triage(packets)

    def issue(cond, type_, severity, description, value):
        return F.when(
            cond,
            F.struct(
                F.lit("D7").alias("detector"),
                F.lit(type_).alias("type"),
                F.lit(severity).alias("severity"),
                F.lit(description).alias("description"),
                F.col(value).cast("double").alias("value"),
            ),
        )

    issues = F.array_compact(
        F.array(
            issue(
                F.col("bandwidth_usage") > BANDWIDTH_BYTES, "HIGH_BANDWIDTH", "high",
                "High bandwidth usage detected", "bandwidth_usage",
            ),
            issue(
                F.col("connection_rate") > CONNECTION_RATE, "HIGH_CONNECTION_RATE", "medium",
                "High connection rate detected", "connection_rate",
            ),
            issue(
                F.col("duplicate_acks") > 0, "DUPLICATE_ACKS", "medium",
                "Duplicate ACKs detected", "duplicate_acks",
            ),
        )
    )
    return _conform(c.select("capture_id", F.explode(issues).alias("f")).select("capture_id", "f.*"))


def performance_issues(packets: DataFrame) -> DataFrame:
    """Slow handshakes, packet loss and slow or failing DNS per capture."""
    rtt = (
        tcp.handshake_rtt(packets)
        .groupBy("capture_id")
        .agg((F.sum("handshake_us") / F.count("handshake_us")).alias("avg_us"))
        .where(F.col("avg_us") > SLOW_HANDSHAKE_US)
    )
    slow = _report(
        rtt, "D8", "high_latency",
        F.when(F.col("avg_us") < VERY_SLOW_HANDSHAKE_US, F.lit("medium")).otherwise("high"),
        "High TCP handshake latency detected",
        value=F.round(F.col("avg_us") / 1e6, 6), confidence=F.lit(0.9),
    )
    loss = tcp.retransmissions(packets, tcp.CAPTURE).where(F.col("retransmission_rate") > LOSS_RATE)
    lossy = _report(
        loss, "D8", "packet_loss",
        F.when(F.col("retransmission_rate") < HIGH_LOSS_RATE, F.lit("medium")).otherwise("high"),
        "High retransmission rate detected",
        value=F.round("retransmission_rate", 6), confidence=F.lit(0.85),
    )
    names = dns.performance(packets).where(
        (F.col("avg_response_time") > SLOW_DNS_S) | (F.col("failure_rate") > DNS_FAILURE_RATE)
    )
    failing = _report(
        names, "D8", "dns_issues", "medium", "DNS performance issues detected",
        value=F.round("failure_rate", 6), confidence=F.lit(0.8),
    )
    return slow.unionByName(lossy).unionByName(failing)


def large_uploads(packets: DataFrame, threshold: int = UPLOAD_BYTES) -> DataFrame:
    """Destinations that received more than ``threshold`` payload bytes in a capture."""
    volumes = (
        packets.where(F.octet_length("payload") > 0)
        .groupBy("capture_id", "dst_ip")
        .agg(F.sum(F.octet_length("payload")).alias("value"))
        .where(F.col("value") > threshold)
    )
    return _report(volumes, "D12", "large_upload", "high", "Large data upload detected")


def covert_icmp(packets: DataFrame) -> DataFrame:
    icmp = (
        packets.where(F.upper("protocol") == "ICMP")
        .groupBy("capture_id")
        .agg(
            F.count("*").alias("n"),
            F.max(F.coalesce(F.octet_length("payload"), F.lit(0))).alias("value"),
        )
        .where((F.col("n") > COVERT_ICMP_PACKETS) & (F.col("value") > COVERT_ICMP_PAYLOAD))
    )
    return _report(icmp, "D14", "icmp_covert_channel", "medium", "Unusual ICMP packet sizes detected")


def unusual_l3(packets: DataFrame, percent: float = L3_SHARE_PERCENT, common=(1, 6, 17)) -> DataFrame:
    """IP protocols outside the common ones holding more than ``percent`` of a capture."""
    counts = packets.groupBy("capture_id", "ip_proto").agg(F.count("*").alias("n"))
    totals = counts.groupBy("capture_id").agg(F.sum("n").alias("total"))
    odd = counts.join(totals, "capture_id").where(
        ~F.col("ip_proto").isin(*common) & (F.col("n") * 100 > F.col("total") * percent)
    )
    return _report(
        odd, "D17", "unusual_protocol_distribution", "medium", "Unusual amount of protocol traffic",
        evidence=F.col("ip_proto").cast("string"),
        value=F.round(F.col("n") * 100 / F.col("total"), 6),
    )


def risk_score(findings: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Per capture: the severity scores summed, at most 1; 0 for listed captures without any."""
    counted = findings.groupBy("capture_id").agg(
        F.count("*").alias("findings"),
        F.round(F.least(F.lit(1.0), F.sum(severity_score("severity"))), 6).alias("risk_score"),
    )
    return for_every(counted, captures)


def security_triage(packets: DataFrame) -> DataFrame:
    """The findings the triage risk score is computed from."""
    return (
        packet_findings(packets, web_attacks())
        .unionByName(port_scans(packets))
        .unionByName(suspicious_dns(packets))
    )


def _group_counts(packets: DataFrame) -> DataFrame:
    """What the rules about groups other than flows count, from one reading: scanning sources,
    receiving destinations, and one row per capture (acknowledgement numbers and IP protocols
    rolled up). The groupings share one shuffle; payloads enter it as lengths only."""
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    name, icmp = F.col("dns_query"), F.upper("protocol") == "ICMP"
    syn = _is_tcp() & net.has_flags(net.TCP_FLAGS["SYN"])
    acked = _is_tcp() & net.has_flags(net.TCP_FLAGS["ACK"])
    slim = packets.select(
        "capture_id", "packet_size", "ip_proto", size.alias("size"), syn.alias("syn"), acked.alias("acked"), icmp.alias("icmp"),
        ((F.col("dns_qr") == 0) & (F.length(name) > 20) & name.rlike("[0-9]")).alias("odd"),
        F.when(syn, F.col("src_ip")).alias("scanner"), F.when(syn, F.col("dst_port")).alias("port"),
        F.when(size > 0, F.col("dst_ip")).alias("receiver"), F.when(acked, F.col("tcp_ack")).alias("ack"),
    )
    sets = [("capture_id", "scanner", "port"), ("capture_id", "receiver"), ("capture_id", "ack"), ("capture_id", "ip_proto")]
    columns = list(dict.fromkeys(c for s in sets for c in s))
    counted = slim.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        *[(F.grouping(c) == 0).alias(f"by_{c}") for c in columns[1:]],
        F.count("*").alias("n"), F.sum("packet_size").alias("bytes"), F.sum("size").alias("uploaded"), F.count_if("syn").alias("syns"),
        F.count_if("acked").alias("acks"), F.count_if("odd").alias("odd"), F.count_if("icmp").alias("icmps"), F.max(F.when(F.col("icmp"), F.col("size"))).alias("icmp_size"),
    )
    whole = F.col("by_ip_proto")
    kind = F.when(F.col("by_scanner"), "scanner").when(F.col("by_receiver"), "receiver").otherwise("capture")
    total = lambda c: F.sum(F.when(whole, F.col(c))).alias(c)
    return counted.groupBy("capture_id", kind.alias("kind"), F.coalesce("scanner", "receiver").alias("ip")).agg(
        F.count_if(F.col("by_scanner") & (F.col("syns") > 0) & F.col("port").isNotNull()).alias("ports"),
        F.sum(F.when(F.col("by_receiver") & (F.col("uploaded") > 0), F.col("uploaded"))).alias("uploaded"),
        F.count_if(F.col("by_ack") & (F.col("acks") > 3)).alias("duplicate_acks"),
        F.max(F.when(whole, F.col("icmp_size"))).alias("icmp_size"), *[total(c) for c in ("n", "bytes", "odd", "icmps")],
        F.collect_list(F.when(whole, F.struct("ip_proto", "n"))).alias("protocols"),
    )


def _facts(detector: str, type_: str, severity, description: str, value=None, evidence=None, src=None, dst=None, confidence=None) -> Column:
    """A finding as a struct (see FINDINGS)."""
    given = {"value": value, "evidence": evidence, "src_ip": src, "dst_ip": dst, "confidence": confidence}
    fixed = {"detector": F.lit(detector), "type": F.lit(type_), "severity": severity if isinstance(severity, Column) else F.lit(severity), "description": F.lit(description)}
    have = fixed | {k: v for k, v in given.items() if v is not None}
    return F.struct(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDINGS.fields if f.name != "capture_id"])


def _unfolded(counts: DataFrame, cases: list[tuple[Column, Column]], more: Column | None = None) -> DataFrame:
    """One row per case that holds, and per entry of ``more``."""
    found = F.array_compact(F.array(*[F.when(when, fact) for when, fact in cases]))
    found = found if more is None else F.concat(found, F.coalesce(more, F.array().cast(_FACTS)))
    return counts.select("capture_id", F.inline(found)).select(*[f.name for f in FINDINGS.fields])


_HITS = "array<struct<detector: string, type: string, severity: string, description: string, evidence: string, value: double>>"
_FACTS = T.ArrayType(T.StructType([f for f in FINDINGS.fields if f.name != "capture_id"]))


def group_findings(packets: DataFrame, percent: float = L3_SHARE_PERCENT, common=(1, 6, 17)) -> DataFrame:
    """``port_scans``, ``suspicious_dns``, ``large_uploads``, ``covert_icmp``, ``unusual_l3`` and
    the load issues about bytes and acknowledgements, from one reading of the packets."""
    kind, share = F.col("kind"), F.col("n")
    whole = kind == "capture"
    cases = [
        ((kind == "scanner") & (F.col("ports") > SCAN_PORTS), _facts("D2", "PORT_SCAN", "high", "Port scan detected", F.col("ports"), src=F.col("ip"))),
        ((kind == "receiver") & (F.col("uploaded") > UPLOAD_BYTES), _facts("D12", "large_upload", "high", "Large data upload detected", F.col("uploaded"), dst=F.col("ip"))),
        (whole & (F.col("odd") > 0), _facts("D3", "SUSPICIOUS_DNS", "medium", "Suspicious DNS queries detected", F.col("odd"))),
        (whole & (F.col("bytes") > BANDWIDTH_BYTES), _facts("D7", "HIGH_BANDWIDTH", "high", "High bandwidth usage detected", F.col("bytes"))),
        (whole & (F.col("duplicate_acks") > 0), _facts("D7", "DUPLICATE_ACKS", "medium", "Duplicate ACKs detected", F.col("duplicate_acks"))),
        (
            whole & (F.col("icmps") > COVERT_ICMP_PACKETS) & (F.col("icmp_size") > COVERT_ICMP_PAYLOAD),
            _facts("D14", "icmp_covert_channel", "medium", "Unusual ICMP packet sizes detected", F.col("icmp_size")),
        ),
    ]
    odd = F.filter("protocols", lambda p: ~p["ip_proto"].isin(*common) & (p["n"] * 100 > share * percent))
    unusual = F.transform(
        odd,
        lambda p: _facts(
            "D17", "unusual_protocol_distribution", "medium", "Unusual amount of protocol traffic", F.round(p["n"] * 100 / share, 6), p["ip_proto"].cast("string")
        ),
    )
    return _unfolded(_group_counts(packets), cases, unusual)


def flow_findings(packets: DataFrame) -> DataFrame:
    """Retransmission alerts, connection rate, packet loss and slow handshakes, from one reading."""
    rate, us = F.col("retransmission_rate"), F.col("handshake_us")
    cases = [
        (F.col("retransmissions") > 0, _facts("D6", "TCP_RETRANSMISSION", "high", "TCP retransmissions detected", F.col("retransmissions"))),
        (F.col("connection_rate") > CONNECTION_RATE, _facts("D7", "HIGH_CONNECTION_RATE", "medium", "High connection rate detected", F.col("connection_rate"))),
        (
            rate > LOSS_RATE,
            _facts(
                "D8", "packet_loss", F.when(rate < HIGH_LOSS_RATE, F.lit("medium")).otherwise("high"), "High retransmission rate detected", F.round(rate, 6), confidence=F.lit(0.85)
            ),
        ),
        (
            us > SLOW_HANDSHAKE_US,
            _facts(
                "D8", "high_latency", F.when(us < VERY_SLOW_HANDSHAKE_US, F.lit("medium")).otherwise("high"), "High TCP handshake latency detected", F.round(us / 1e6, 6),
                confidence=F.lit(0.9),
            ),
        ),
    ]
    return _unfolded(tcp.capture_health(packets), cases)


def name_findings(packets: DataFrame) -> DataFrame:
    """DNS timeouts and slow or failing DNS, from one ordered scan."""
    slow = (F.col("avg_response_time") > SLOW_DNS_S) | (F.col("failure_rate") > DNS_FAILURE_RATE)
    cases = [
        (F.col("unanswered") > 0, _facts("D5", "DNS_TIMEOUT", "high", "DNS queries without responses", F.col("unanswered"))),
        (slow, _facts("D8", "dns_issues", "medium", "DNS performance issues detected", F.round("failure_rate", 6), confidence=F.lit(0.8))),
    ]
    return _unfolded(dns.health(packets), cases)


def load_and_performance(packets: DataFrame) -> DataFrame:
    """The issues of ``load_issues`` and ``performance_issues`` (D7, D8)."""
    parts = [group_findings(packets), flow_findings(packets), name_findings(packets)]
    return reduce(lambda a, b: a.unionByName(b), parts).where(F.col("detector").isin("D7", "D8"))


def triage_issues(packets: DataFrame) -> DataFrame:
    """All that the triage reports: DNS, TCP, security and load issues of every capture."""
    parts = [packet_findings(packets, triage_rules()), group_findings(packets), flow_findings(packets), name_findings(packets)]
    return reduce(lambda a, b: a.unionByName(b), parts).where(F.col("detector").isin("D1", "D2", "D3", "D5", "D6", "D7"))


def all_findings(packets: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Every detector in one table. The packets are read five times: once for the rules about
    single packets, once for each of the three families of groups, and once more by the carry of
    the ordered DNS scan. Findings of the outlier models may be added."""
    parts = [packet_findings(packets, [*triage_rules(), *deep_rules()]), group_findings(packets), flow_findings(packets), name_findings(packets)]
    parts += [] if anomalies is None else [_conform(anomalies)]
    return reduce(lambda a, b: a.unionByName(b), parts)


# Recommendation texts by finding type.
RECOMMENDATIONS = {
    "high_latency": "Check network connectivity and server response times",
    "packet_loss": "Investigate network path for packet loss",
    "dns_issues": "Check DNS server configuration and connectivity",
}


def with_recommendations(findings: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in RECOMMENDATIONS.items() for x in kv])
    return findings.withColumn(
        "recommendation",
        F.coalesce(
            F.try_element_at(table, F.col("type")),
            F.concat(F.lit("Investigate "), F.col("type"), F.lit(" behavior")),
        ),
    )

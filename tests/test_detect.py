"""Every detector fires on something, including those the derived view never reaches."""

from dataclasses import replace
from functools import reduce

import pytest

from netlens.operators import detect, findings, graph
from tests.conftest import one

TCP = {"src_port": 50000, "dst_port": 80, "tcp_flags": 24}


def kinds(df):
    return sorted(r["type"] for r in df.collect())


@pytest.mark.parametrize(
    "rules, row, want",
    [
        (detect.web_attacks, TCP | {"payload": "GET /../../../x"}, ["WEB_ATTACK"]),
        (detect.dns_failures, {"dns_qr": 1, "dns_rcode": 3}, ["DNS_NXDOMAIN"]),
        (detect.tcp_flags, TCP | {"tcp_flags": 4, "tcp_window": 0}, ["TCP_RESET", "TCP_ZERO_WINDOW"]),
        (detect.http_requests, {"http_method": "GET", "http_uri": "/..\\a?onerror=1 OR 1=1"}, ["PATH_TRAVERSAL", "SQL_INJECTION", "XSS"]),
        (detect.payload_patterns, {"payload": "EXEC (1); VBScript: password = 'x'"}, ["potential_credentials", "sql_injection", "xss"]),
        (detect.long_names, {"dns_query": "a" * 120}, ["LONG_SUBDOMAIN", "dns_tunneling"]),
        (detect.encoded_payloads, {"payload": "base64 " + "0f" * 60}, ["encoded_data"] * 3),
        (detect.malware_signatures, {"payload": b"..MZ\x90\x00..\x7fELF"}, ["malware_signature"] * 2),
        (detect.covert_names, {"dns_query": "abcdefghijklmnopqrstuvwxyz0123456789.net"}, ["dns_covert_channel"]),
        (detect.port_anomalies, {"src_port": 80, "dst_port": 2000, "packet_size": 1500}, ["large_packet", "unusual_port_usage"]),
        (detect.suspicious_fins, TCP | {"tcp_flags": 1, "dst_port": 22}, ["suspicious_fin"]),
        (detect.weak_tls, {"tls_version": 0x0301}, ["weak_tls_version"]),
        (detect.suspicious_names, {"dns_query": "10-1-2-3.rnd.zz"}, ["suspicious_domain"]),
        (detect.watchlist, {"dns_query": "x.malware.com"}, ["suspicious_dns"]),
    ],
)
def test_packet_rules(packets, rules, row, want):
    quiet = {"src_port": 40000, "dst_port": 9, "payload": "hello", "tcp_flags": 16, "tcp_window": 100}
    assert kinds(detect.packet_findings(packets(quiet, row), rules())) == want


def test_group_rules(packets):
    scan = packets(*[TCP | {"tcp_flags": 2, "dst_port": 1000 + i} for i in range(11)])
    assert one(detect.port_scans(scan))["value"] == 11
    assert detect.port_scans(scan.where("dst_port > 1000")).count() == 0
    odd = packets(*[{"dns_qr": 0, "dns_query": "averyveryverylongname1.net"}] * 2, {"dns_qr": 0, "dns_query": "short1.net"})
    assert one(detect.suspicious_dns(odd))["value"] == 2
    icmp = {"protocol": "ICMP", "ip_proto": 1}
    assert kinds(detect.covert_icmp(packets(*[icmp] * 10, icmp | {"payload": "x" * 65}))) == ["icmp_covert_channel"]
    assert detect.covert_icmp(packets(*[icmp] * 9, icmp | {"payload": "x" * 65})).count() == 0
    assert kinds(detect.unusual_l3(packets(*[TCP] * 15, {"protocol": "GRE", "ip_proto": 47}))) == ["unusual_protocol_distribution"]
    assert detect.unusual_l3(packets(*[TCP] * 19, {"protocol": "GRE", "ip_proto": 47})).count() == 0
    big = packets(*[{"payload": "x" * 60_000}] * 167)
    assert one(detect.large_uploads(big))["value"] == 167 * 60_000
    acks = packets(*[TCP | {"tcp_ack": 5, "packet_size": 30_000}] * 4)
    assert kinds(detect.load_issues(acks)) == ["DUPLICATE_ACKS", "HIGH_BANDWIDTH"]


def test_performance_issues(packets):
    slow = packets(
        TCP | {"tcp_flags": 2, "tcp_seq": 1},
        {"src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "src_port": 80, "dst_port": 50000, "tcp_flags": 18, "tcp_seq": 7, "at": 0.6},
        TCP | {"tcp_seq": 2, "at": 0.7},
        TCP | {"tcp_seq": 2, "at": 0.8},
        {"protocol": "UDP", "dns_qr": 0, "dns_id": 1, "at": 0.9},
    )
    got = {r["type"]: r["severity"] for r in detect.performance_issues(slow).collect()}
    assert got == {"high_latency": "high", "packet_loss": "high", "dns_issues": "medium"}


def test_reports_over_findings(packets):
    p = packets(*[TCP | {"tcp_flags": 4}] * 4, TCP | {"tls_version": 1})
    found = detect.packet_findings(p, [*detect.tcp_flags(), *detect.weak_tls()])
    assert one(findings.risk_level(found))["risk_level"] == "MEDIUM-HIGH"
    assert one(findings.overall(found))["deep_risk"] == "HIGH"
    titles = [r["priority"] for r in findings.recommendations(found).collect()]
    assert sorted(titles) == ["HIGH", "LOW", "LOW", "MEDIUM"]
    assert one(detect.risk_score(found))["risk_score"] == 1.0


def test_incident_hosts_rank_severity(spark):
    alerts = spark.createDataFrame(
        [("c", "A", "medium", "from 1.2.3.4"), ("c", "B", "high", "from 1.2.3.4"), ("c", "B", "low", "none")],
        "capture_id string, type string, severity string, description string",
    )
    r = one(graph.incident_hosts(alerts))
    assert (r["max_severity"], r["label"], r["alerts"]) == ("high", "A, B", 2)


def test_captures_without_findings_have_rows(packets):
    quiet = packets({})
    none = detect.packet_findings(quiet, detect.tcp_flags())
    assert one(detect.risk_score(none, quiet))["risk_score"] == 0
    r = one(findings.risk_level(none, quiet))
    assert (r["risk_level"], r["findings"], r["critical"]) == ("LOW", 0, 0)
    assert one(findings.overall(none, quiet))["deep_risk"] == "LOW"
    assert len(findings.recommendations(none, quiet).collect()) == 3
    assert one(findings.security_summary(none, quiet))["total_security_issues"] == 0
    assert findings.risk_level(none).count() == 0


def _eventful(packets):
    """A capture that fires every rule about groups, and one that fires none."""
    rows = [{"tcp_flags": 2, "src_port": 5000, "dst_port": p, "src_ip": "10.9.9.9"} for p in range(100, 115)]
    rows += [{"src_port": 6000, "dst_port": 80, "tcp_flags": 24, "tcp_seq": 5, "tcp_ack": 77, "packet_size": 30_000}] * 5
    rows += [
        {"at": 1, "src_port": 7000, "dst_port": 80, "tcp_flags": 2}, {"at": 2, "src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "src_port": 80, "dst_port": 7000, "tcp_flags": 18},
    ]
    udp = {"protocol": "UDP", "ip_proto": 17, "src_port": 999, "dst_port": 53}
    rows += [udp | {"dns_qr": 0, "dns_id": i, "dns_query": "a-long-enough-name-7.example.org"} for i in range(3)]
    rows += [{"protocol": "ICMP", "ip_proto": 1, "payload": "x" * 100}] * 11 + [{"protocol": "OTHER", "ip_proto": 47}] * 9
    return packets(*rows, {"capture_id": "quiet", "src_port": 1, "dst_port": 2})


def test_fused_findings_equal_the_single_detectors(packets):
    p = _eventful(packets)
    singles = [
        detect.packet_findings(p, [*detect.triage_rules(), *detect.deep_rules()]), detect.port_scans(p), detect.suspicious_dns(p), detect.dns_timeouts(p),
        detect.retransmission_alerts(p), detect.load_issues(p), detect.performance_issues(p), detect.large_uploads(p), detect.covert_icmp(p), detect.unusual_l3(p),
    ]
    want = sorted((tuple(r) for d in singles for r in d.collect()), key=repr)
    got = detect.all_findings(p).collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert {r["detector"] for r in got} >= {"D2", "D3", "D5", "D6", "D7", "D8", "D14", "D17"}
    issues = sorted(map(tuple, detect.load_and_performance(p).collect()), key=repr)
    assert issues == [r for r in want if r[1] in ("D7", "D8")]


def test_findings_read_a_table_five_times(spark, tmp_path, packets):
    _eventful(packets).write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))

    def readings(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    assert readings(detect.all_findings(table)) <= 5
    assert readings(detect.group_findings(table)) == readings(detect.flow_findings(table)) == 1
    assert readings(detect.load_and_performance(table)) <= 4


def test_rules_name_the_column_they_need(packets):
    """Rules with ``needs`` are passed over where that column is NULL, and could not hold there."""
    rules = [*detect.triage_rules(), *detect.deep_rules()]
    assert {r.needs for r in rules} == {None, "payload", "dns_query", "http_method", "tls_version"}
    full = TCP | {"payload": "password=1 <script>", "dns_query": "a" * 120, "http_method": "GET", "http_uri": "/../", "tls_version": 1, "src_port": 80, "dst_port": 2000, "tcp_flags": 4}
    for column in ("payload", "dns_query", "http_method", "tls_version"):
        p = packets(full | {column: None})
        assert p.where(reduce(lambda a, b: a | b, [r.when for r in rules if r.needs == column])).count() == 0
    everything = kinds(detect.packet_findings(packets(full), rules))
    ungated = [replace(r, needs=None) for r in rules]
    assert everything == kinds(detect.packet_findings(packets(full), ungated)) and "xss" in everything

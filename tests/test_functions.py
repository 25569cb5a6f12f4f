import ipaddress
import math
import random

from pyspark.sql import functions as F

from netlens.functions import measures, net, text
from netlens.operators import catalog
from netlens.plans import load


def evaluate(spark, values, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], f"x {schema}").select(*cols).collect()]


def test_ip_class_follows_the_standard_library(spark):
    rng = random.Random(1)
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(400)]
    ips += ["192.0.0.9", "192.0.0.10", "192.0.0.8", "10.1.2.255", "224.0.0.1", "255.255.255.255", "169.254.1.1",
            "172.16.0.1", "172.32.0.1", "100.64.0.1", "198.19.0.1", "203.0.113.7", "0.1.2.3", "240.0.0.1"]

    def want(ip):
        a = ipaddress.ip_address(ip)
        if a.is_multicast:
            return "multicast"
        if ip.endswith(".255"):
            return "broadcast"
        return "internal" if a.is_private else "external"

    got = evaluate(spark, ips, "string", net.ip_class("x"))
    assert [g[0] for g in got] == [want(i) for i in ips]
    odd = ["300.1.1.1", "a.b.c.d", "", "1.2.3", "01.2.3.4", "ff02::1", "fe80::1", "::1", "2606:4700::1111"]
    assert [g[0] for g in evaluate(spark, odd, "string", net.ip_class("x"))] == [
        "unknown"] * 5 + ["multicast", "internal", "internal", "external"]


def test_cidr(spark):
    ips = ["10.0.0.127", "10.0.0.128", "10.0.1.0", "nope", "2001:db8::5", "2001:db9::5"]
    got = evaluate(spark, ips, "string", net.in_cidr("x", "10.0.0.77/25"), net.in_cidr("x", "bad"), net.in_cidr("x", "2001:db8::/32"))
    assert [g[0] for g in got] == [True, False, False, False, False, False]
    assert not any(g[1] for g in got)
    assert [g[2] for g in got] == [False, False, False, False, True, False]


def test_flags(spark):
    got = evaluate(spark, ["0x0012", "24", "junk", "0xZZ", "255"], "string", net.flag_text("x"))
    assert [g[0] for g in got] == ["SYN,ACK", "PSH,ACK", "junk", "0xZZ", "FIN,SYN,RST,PSH,ACK,URG,ECE,CWR"]


def test_entropy_of_any_bytes(spark):
    rng = random.Random(2)
    values = [b"", b"aaaa", bytes(range(256)), bytes(rng.randrange(256) for _ in range(999))]

    def want(b):
        return -sum(b.count(x) / len(b) * math.log2(b.count(x) / len(b)) for x in set(b)) if b else 0.0

    got = evaluate(spark, values, "binary", text.entropy("x"))
    assert all(abs(g[0] - want(v)) < 1e-9 for g, v in zip(got, values, strict=True))


def test_domain_looks(spark):
    names = ["xkcdbrtplm.aa.net", "10-0-0-7.pool.net", "f" * 32 + ".com", "heeeeello.com", "www.example.com", "a" * 101, "x.tk"]
    got = evaluate(spark, names, "string", text.looks_generated("x"), text.suspicious_pattern("x"), text.suspicious_deep("x"))
    assert [g[1] for g in got] == [False, True, True, True, False, True, False]
    assert [g[2] for g in got][-2:] == [True, True]


def test_application_protocol(spark):
    rows = [(b"GET / ", 9), (b"\x16\x03\x01", 9), (b"x", 443), (b"220 hi", 25), (b"SSH-2", 9), (b"x", 53), (b"x", 995), (b"x", 9), (None, 80)]
    df = spark.createDataFrame(rows, "p binary, port int")
    got = [r[0] for r in df.select(text.application_protocol("p", "port")).collect()]
    assert got == ["HTTP", "HTTPS/TLS", "HTTPS/TLS", "FTP", "SSH", "DNS", "POP3S", "unknown", "unknown"]


def test_human_text(spark):
    sizes = [0, 1023, 1024, 1280, 1536, 1792, 123456789, 5 * 1024**3, 3 * 1024**4]

    def want(n):
        n = float(n)
        for unit in ("B", "KB", "MB", "GB"):
            if n < 1024:
                return f"{n:.1f} {unit}"
            n /= 1024
        return f"{n:.1f} TB"

    assert [g[0] for g in evaluate(spark, sizes, "long", measures.human_size("x"))] == [want(n) for n in sizes]
    got = evaluate(spark, [1500, 90_000, 5_400_000], "long", measures.human_duration("x"))
    assert [g[0] for g in got] == ["1.5 seconds", "1.5 minutes", "1.5 hours"]


def test_quality_and_state(spark):
    df = spark.createDataFrame([(0.06, 0.6, 3, 1), (0.0, 0.05, 0, 0), (0.02, None, 20, 9)], "r double, t double, o long, z long")
    score = measures.quality_score("r", "t", "o", "z")
    got = [tuple(r) for r in df.select(score, measures.quality_label(score)).collect()]
    assert got == [(100 - 30 - 25 - 6 - 3, "poor"), (100, "excellent"), (100 - 15 - 20 - 15, "poor")]


def test_node_ids_and_estimates(spark):
    assert [g[0] for g in evaluate(spark, ["10.0.0.1", "a-b", ""], "string", net.node_id("x"))] == ["node_10_0_0_1", "a_b", "unknown_node"]
    df = spark.createDataFrame([(10**9, "security_focused", "low"), (10**6, "basic", "urgent"), (10**8, "x", "y")], "file_size long, analysis_type string, priority string")
    assert [r[0] for r in df.select(catalog.estimated_seconds()).collect()] == [900, 30, 100]
    assert [g[0] for g in evaluate(spark, [None], "string", F.coalesce(net.protocol_name(F.col("x").cast("int")), F.lit("?")))] == ["OTHER"]


def test_blocks_are_told_by_the_text(spark):
    rng, texts = random.Random(5), ["10.0.2.1\n", "10.0.2.256", "010.0.2.1", "10.0.2", "10.0.2.1.1", "", None, "::1", "10.0.02.1", " 10.0.2.1", "10.0.2.1000"]
    texts += [f"{rng.choice([10, 11, 0, 255])}.{rng.choice([0, 1, 99, 255])}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)]
    table = spark.createDataFrame([(t,) for t in texts], "ip string")
    blocks = [ipaddress.ip_network(f"{a}/{n}", strict=False) for n in range(33) for a in (texts[-1], "10.0.2.1")]
    inside = {str(b): F.coalesce(net._in_network(net.ip_num("ip"), b), F.lit(False)) for b in blocks}
    wrong = [F.count_if(net.in_cidr("ip", b) != want).alias(b) for b, want in inside.items()]
    assert set(table.agg(*wrong).first()) == {0}
    assert "split" not in str(net.in_cidr("ip", "10.0.2.0/23")._jc)


def test_a_search_by_side_reads_its_records_once(spark):
    plan = load()[0]["f9_search_ip_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "events" not in plan and "Aggregate" not in plan and "Join" not in plan


def test_entropy_counts_its_bytes_once(spark):
    entropy = text.entropy("s")
    assert str(entropy).count("decode(") == 1
    rows = spark.createDataFrame([("aab\nb\n\n\0",), ("",), (None,), ("$1\\ü",)], "s string")
    assert [round(r[0], 6) for r in rows.select(entropy).collect()] == [1.905639, 0, 0, 2.321928]

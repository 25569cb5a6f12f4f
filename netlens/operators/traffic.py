"""Capture-level totals, distributions, talkers and series."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import net
from netlens.functions.measures import per_second, ratio, seconds

# Application name -> ports.
SERVICE_PORTS = {
    "http": (80, 8080, 8000),
    "https": (443, 8443),
    "dns": (53,),
    "dhcp": (67, 68),
    "ftp": (21, 20),
    "ssh": (22,),
    "telnet": (23,),
    "smtp": (25, 587),
    "pop3": (110, 995),
    "imap": (143, 993),
    "snmp": (161, 162),
    "ntp": (123,),
}


def _either_port(*ports: int) -> Column:
    return F.coalesce(F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports), F.lit(False))


def is_http() -> Column:
    return F.col("http_method").isNotNull() | F.coalesce(F.col("http_status") != 0, F.lit(False))


def is_dns() -> Column:
    return F.col("dns_query").isNotNull() | F.col("dns_response").isNotNull()


def top_n(df: DataFrame, measure: str, n: int, ties: list[str], per: list[str] | None = None):
    """The n rows with the largest measure, ties broken by the named columns, per group if
    groups are given. With groups this is a ``row_number() <= n`` filter, which Spark also
    applies before the shuffle, so a hot group sends n rows per task."""
    order = [F.desc(measure), *[F.asc(c) for c in ties]]
    if not per:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def capture_totals(packets: DataFrame) -> DataFrame:
    t = packets.groupBy("capture_id").agg(
        F.count("*").alias("packets"),
        F.sum("packet_size").alias("bytes"),
        F.min(net.us("ts")).alias("start_us"),
        F.max(net.us("ts")).alias("end_us"),
    )
    span = F.col("end_us") - F.col("start_us")
    return t.withColumns(
        {
            "duration_s": seconds(span),
            "avg_packet_size": ratio("bytes", "packets"),
            "packets_per_second": per_second("packets", span),
            "bytes_per_second": per_second("bytes", span),
            "throughput_mbps": per_second(F.col("bytes") * 8, span) / (1024 * 1024),
        }
    )


def label_distribution(packets: DataFrame) -> DataFrame:
    """Packets per label, a packet counting under every label it carries."""
    looks_http = F.coalesce(
        F.col("payload").cast("string").rlike("HTTP|GET|POST"), F.lit(False)
    ) & (F.col("protocol") == "TCP")
    labels = F.array_compact(
        F.array(
            *[
                F.when(F.col("protocol") == p, F.lit(p)) for p in ("TCP", "UDP", "ICMP", "ARP")
            ],
            F.when(is_dns(), F.lit("DNS")),
            F.when(looks_http, F.lit("HTTP")),
        )
    )
    return (
        packets.select("capture_id", F.explode(labels).alias("label"))
        .groupBy("capture_id", "label")
        .agg(F.count("*").alias("packets"))
    )


def protocol_distribution(packets: DataFrame) -> DataFrame:
    counts = packets.groupBy("capture_id", F.upper("protocol").alias("protocol")).agg(
        F.count("*").alias("packets"), F.sum("packet_size").alias("bytes")
    )
    total = F.sum("packets").over(Window.partitionBy("capture_id"))
    return counts.withColumn("percentage", F.col("packets") * 100.0 / total)


def protocol_counters(packets: DataFrame) -> DataFrame:
    def n(cond: Column, name: str) -> Column:
        return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)

    proto = F.upper("protocol")
    return packets.groupBy("capture_id").agg(
        n(proto == "TCP", "tcp_packets"),
        n(proto == "UDP", "udp_packets"),
        n(proto == "ICMP", "icmp_packets"),
        n(is_http(), "http_sessions"),
        n(F.col("tls_version").isNotNull() | (_either_port(443, 8443)), "https_sessions"),
        n(is_dns(), "dns_queries"),
        n(_either_port(67, 68) & (proto == "UDP"), "dhcp_packets"),
        n(proto == "ARP", "arp_packets"),
    )


def host_totals(packets: DataFrame) -> DataFrame:
    """Packets and bytes per host, a packet counting for both its ends.

    The pairs are summed before they are unfolded, so what is doubled is small.
    """
    pairs = packets.groupBy("capture_id", "src_ip", "dst_ip").agg(
        F.count("*").alias("n"), F.sum("packet_size").alias("b")
    )
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip"), F.lit(True).alias("sends")),
            F.struct(F.col("dst_ip").alias("ip"), F.lit(False).alias("sends")),
        )
    ).alias("end")
    sent, received = F.when(F.col("end.sends"), F.col("b")), F.when(~F.col("end.sends"), F.col("b"))
    return (
        pairs.select("capture_id", "n", "b", ends)
        .groupBy("capture_id", F.col("end.ip").alias("ip"))
        .agg(
            F.sum("n").alias("packets"),
            F.sum("b").alias("bytes"),
            F.coalesce(F.sum(sent), F.lit(0)).alias("bytes_sent"),
            F.coalesce(F.sum(received), F.lit(0)).alias("bytes_received"),
        )
    )


def top_talkers(packets: DataFrame, n: int = 10) -> DataFrame:
    hosts = host_totals(packets).select("capture_id", "ip", "packets", "bytes")
    return top_n(hosts, "packets", n, ["ip"], per=["capture_id"])


def flag_histogram(packets: DataFrame) -> DataFrame:
    return (
        packets.where(F.col("tcp_flags").isNotNull())
        .groupBy("capture_id", "tcp_flags")
        .agg(F.count("*").alias("packets"))
        .withColumn("flags", net.flag_names("tcp_flags"))
    )


def distinct_endpoints(packets: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct addresses and ports per capture, both ends pooled."""
    pairs = packets.groupBy("capture_id", "src_ip", "dst_ip", "src_port", "dst_port").agg(
        F.count("*").alias("n")
    )
    ends = pairs.select(
        "capture_id",
        F.explode(
            F.array(
                F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")),
                F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")),
            )
        ).alias("e"),
    )
    count = F.approx_count_distinct if approximate else F.count_distinct
    return ends.groupBy("capture_id").agg(
        count(F.col("e.ip")).alias("unique_ips"), count(F.col("e.port")).alias("unique_ports")
    )


def size_distribution(packets: DataFrame) -> DataFrame:
    return packets.groupBy("capture_id").agg(
        F.min("packet_size").alias("min_size"),
        F.max("packet_size").alias("max_size"),
        F.avg("packet_size").alias("avg_size"),
        F.sum("packet_size").alias("total_bytes"),
    )


def payload_statistics(packets: DataFrame) -> DataFrame:
    """Payload count, bytes and HTTP-looking count per capture."""
    p = F.col("payload").cast("string")
    return (
        packets.where(F.octet_length("payload") > 0)
        .groupBy("capture_id")
        .agg(
            F.count("*").alias("payloads"),
            F.sum(F.octet_length("payload")).alias("payload_bytes"),
            F.min(F.octet_length("payload")).alias("min_payload"),
            F.max(F.octet_length("payload")).alias("max_payload"),
            F.count_if(p.contains("HTTP")).alias("http_payloads"),
        )
    )


def payload_size_histogram(packets: DataFrame) -> DataFrame:
    return (
        packets.where(F.octet_length("payload") > 0)
        .groupBy("capture_id", F.octet_length("payload").alias("payload_size"))
        .agg(F.count("*").alias("payloads"))
    )


def performance_triage(packets: DataFrame, repeats: int = 3) -> DataFrame:
    """Bytes, distinct directed TCP 4-tuples, and ack numbers seen more than ``repeats`` times."""
    totals = packets.groupBy("capture_id").agg(F.sum("packet_size").alias("bandwidth_usage"))
    tcp = packets.where(F.upper("protocol") == "TCP")
    tuples = (
        tcp.select(*net.FLOW).distinct().groupBy("capture_id").agg(F.count("*").alias("connection_rate"))
    )
    acks = (
        tcp.where(net.has_flags(net.TCP_FLAGS["ACK"]))
        .groupBy("capture_id", "tcp_ack")
        .agg(F.count("*").alias("n"))
        .groupBy("capture_id")
        .agg(F.count_if(F.col("n") > repeats).alias("duplicate_acks"))
    )
    return totals.join(tuples, "capture_id", "left").join(acks, "capture_id", "left").na.fill(
        0, ["connection_rate", "duplicate_acks"]
    )


def series(packets: DataFrame, bucket: str = "1 minute") -> DataFrame:
    """Packets and bytes per time bucket, with per-second rates."""
    per_bucket = packets.groupBy("capture_id", F.window("ts", bucket).alias("w")).agg(
        F.count("*").alias("packets"), F.sum("packet_size").alias("bytes")
    )
    start, end = net.us("w.start"), net.us("w.end")
    return per_bucket.select(
        "capture_id",
        start.alias("bucket_us"),
        "packets",
        "bytes",
        per_second("packets", end - start).alias("packets_per_second"),
        per_second("bytes", end - start).alias("bytes_per_second"),
    )


def applications(packets: DataFrame) -> DataFrame:
    """Packets per application by well-known port on either side (port pairs are summed first)."""
    pairs = packets.groupBy("capture_id", "src_port", "dst_port").agg(F.count("*").alias("n"))
    names = F.array_compact(
        F.array(*[F.when(_either_port(*ps), F.lit(a)) for a, ps in SERVICE_PORTS.items()])
    )
    return (
        pairs.select("capture_id", "n", F.explode(names).alias("application"))
        .groupBy("capture_id", "application")
        .agg(F.sum("n").alias("packets"))
    )


def detected_protocols(packets: DataFrame) -> DataFrame:
    """Every protocol seen: by name, by port, by decoded HTTP or DNS fields."""
    named = packets.select("capture_id", F.lower("protocol").alias("protocol"))
    by_port = applications(packets).select("capture_id", F.col("application").alias("protocol"))
    http = packets.where(is_http()).select("capture_id", F.lit("http").alias("protocol"))
    dns = packets.where(is_dns()).select("capture_id", F.lit("dns").alias("protocol"))
    return named.union(by_port).union(http).union(dns).where("protocol IS NOT NULL").distinct()


def chunk_statistics(packets: DataFrame, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Per-chunk statistics as a chunked run would store them: one row per capture and day."""
    return (
        packets.groupBy("capture_id", F.floor(net.us("ts") / bucket_us).cast("long").alias("chunk"))
        .agg(
            F.count("*").alias("packets"),
            F.sum("packet_size").alias("bytes"),
            F.min(net.us("ts")).alias("start_us"),
            F.max(net.us("ts")).alias("end_us"),
            F.count_if(net.has_flags(net.TCP_FLAGS["RST"])).alias("resets"),
        )
        .withColumn("duration_us", F.col("end_us") - F.col("start_us"))
        .withColumn("reset_rate", ratio("resets", "packets"))
    )


def merge_chunks(chunks: DataFrame, weighted: dict[str, str] | None = None,
                 maxima: list[str] | None = None) -> DataFrame:
    """Fold stored chunk rows into one row per capture.

    Counts add up; the duration is last end minus first start; each column of ``weighted``
    (name -> output name) becomes its duration-weighted mean.
    """
    weights = [
        ratio(F.sum(F.col(c) * F.col("duration_us")), F.sum("duration_us")).alias(out)
        for c, out in (weighted or {}).items()
    ]
    merged = chunks.groupBy("capture_id").agg(
        F.count("*").alias("chunks"),
        F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        *weights,
        *[F.max(c).alias(f"max_{c}") for c in maxima or []],
    )
    span = F.col("end_us") - F.col("start_us")
    return merged.withColumns(
        {
            "duration_s": seconds(span),
            "avg_packet_size": ratio("bytes", "packets"),
            "packets_per_second": per_second("packets", span),
            "bytes_per_second": per_second("bytes", span),
        }
    )

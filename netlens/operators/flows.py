"""Conversations, TCP streams and UDP flows: grouped rows, never lists of packets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import net
from netlens.functions.measures import asymmetry, interactive, per_second, ratio, seconds
from netlens.functions.net import CONVERSATION
from netlens.operators.ordered import scan, time_chunk
from netlens.operators.traffic import top_n

FIRST = 10


def conversations(packets: DataFrame) -> DataFrame:
    """Packets and bytes per unordered endpoint pair, with the protocol of the last packet."""
    known = F.when(F.upper("protocol").isin("TCP", "UDP"), F.upper("protocol")).otherwise("IP")
    return (
        net.with_endpoints(packets)
        .groupBy(*CONVERSATION)
        .agg(
            F.count("*").alias("packets"),
            F.sum("packet_size").alias("bytes"),
            F.max_by(known, "frame_number").alias("protocol"),
        )
    )


def top_conversations(packets: DataFrame, n: int = 20) -> DataFrame:
    """The n busiest conversations of each capture, and how many conversations it has."""
    convs = conversations(packets)
    totals = convs.groupBy("capture_id").agg(F.count("*").alias("total_conversations"))
    top = top_n(convs, "packets", n, CONVERSATION[1:], per=["capture_id"])
    return top.join(totals, "capture_id")


def conversation_flows(packets: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """Client and server side of each conversation and the traffic each way.

    ``extra`` aggregates are computed in the same grouping and kept as columns.

    The client is the higher-port side of the first packet (its sender if there are no
    ports). A packet counts as the client's when it comes from the client's address.
    """
    low_is_source = F.col("src_port") < F.col("dst_port")
    flip = net.has_ports() & low_is_source
    sides = F.struct(
        F.when(flip, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("client_ip"),
        F.when(flip, F.col("dst_port")).otherwise(F.col("src_port")).alias("client_port"),
        F.when(flip, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("server_ip"),
        F.when(flip, F.col("src_port")).otherwise(F.col("dst_port")).alias("server_port"),
        F.col("protocol").alias("protocol"),
    )
    from_lo = F.col("src_ip") == F.col("lo_ip")
    grouped = (
        net.with_endpoints(packets)
        .groupBy(*CONVERSATION)
        .agg(
            F.min_by(sides, "frame_number").alias("s"),
            F.min_by(net.us("ts"), "frame_number").alias("start_us"),
            F.max_by(net.us("ts"), "frame_number").alias("end_us"),
            F.count("*").alias("packets"),
            F.sum("packet_size").alias("bytes"),
            F.count_if(from_lo).alias("lo_packets"),
            F.coalesce(F.sum(F.when(from_lo, F.col("packet_size"))), F.lit(0)).alias("lo_bytes"),
            F.struct(F.lit(1).alias("_"), *(extra or [])).alias("extra"),
        )
    )
    kept = [f"extra.{f}" for f in grouped.schema["extra"].dataType.names if f != "_"]
    client_lo = F.col("s.client_ip") == F.col("lo_ip")
    c_packets = F.when(client_lo, F.col("lo_packets")).otherwise(F.col("packets") - F.col("lo_packets"))
    c_bytes = F.when(client_lo, F.col("lo_bytes")).otherwise(F.col("bytes") - F.col("lo_bytes"))
    span = F.col("end_us") - F.col("start_us")
    return grouped.select(
        *CONVERSATION,
        "s.*",
        "start_us",
        "end_us",
        "packets",
        "bytes",
        c_packets.alias("client_packets"),
        (F.col("packets") - c_packets).alias("server_packets"),
        c_bytes.alias("client_bytes"),
        (F.col("bytes") - c_bytes).alias("server_bytes"),
        *kept,
    ).withColumns(
        {
            "duration_s": seconds(span),
            "bytes_per_second": per_second("bytes", span),
            "packets_per_second": per_second("packets", span),
            "asymmetry": asymmetry("client_bytes", "bytes"),
            "interactive": interactive("packets", "client_packets", "server_packets"),
        }
    )


def with_quality(flow_rows: DataFrame, packets: DataFrame) -> DataFrame:
    """Flows with their mean HTTP response time and retransmission rate."""
    from netlens.operators import http, tcp

    paired = http.transactions(packets).select(
        "capture_id",
        F.col("client_ip").alias("src_ip"),
        F.col("client_port").alias("src_port"),
        F.col("server_ip").alias("dst_ip"),
        F.col("server_port").alias("dst_port"),
        "response_us",
    )
    times = (
        net.with_endpoints(paired)
        .groupBy(*CONVERSATION)
        .agg((F.sum("response_us") / F.count("*") / 1e6).alias("avg_response_time"))
    )
    loss = tcp.retransmissions(packets).select(*CONVERSATION, "retransmission_rate")
    return flow_rows.join(times, CONVERSATION, "left").join(loss, CONVERSATION, "left")


def handshakes(packets: DataFrame) -> DataFrame:
    """Per TCP conversation: did its first ten packets hold SYN, SYN-ACK, then an ACK?"""
    w = Window.partitionBy(*CONVERSATION).orderBy("frame_number")
    head = (
        net.with_endpoints(packets.where(F.upper("protocol") == "TCP"))
        .select(*CONVERSATION, "frame_number", "tcp_flags")
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= FIRST)
    )
    seen = head.groupBy(*CONVERSATION).agg(
        F.max("n").alias("packets"),
        F.min(F.when(net.bare_syn(), F.col("n"))).alias("syn"),
        F.min(F.when(net.syn_ack(), F.col("n"))).alias("syn_ack"),
        F.max(F.when(net.ack_without_syn(), F.col("n"))).alias("ack"),
    )
    complete = (F.col("packets") >= 3) & (F.col("ack") > F.greatest("syn", "syn_ack"))
    both = F.col("syn").isNotNull() & F.col("syn_ack").isNotNull()
    return seen.select(
        *CONVERSATION, F.coalesce(both & complete, F.lit(False)).alias("handshake_complete")
    )


def tcp_streams(packets: DataFrame) -> DataFrame:
    """One row per TCP conversation: totals, rates, flag counts, low-port side, handshake."""
    tcp = net.with_endpoints(packets.where(F.upper("protocol") == "TCP"))
    flip = net.has_ports() & ~(F.col("src_port") < F.col("dst_port"))
    low_side = F.struct(
        F.when(flip, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("low_port_ip"),
        F.when(flip, F.col("dst_port")).otherwise(F.col("src_port")).alias("low_port"),
        F.when(flip, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("high_port_ip"),
        F.when(flip, F.col("src_port")).otherwise(F.col("dst_port")).alias("high_port"),
    )
    grouped = tcp.groupBy(*CONVERSATION).agg(
        F.min_by(low_side, "frame_number").alias("side"),
        F.count("*").alias("packets"),
        F.sum("packet_size").alias("bytes"),
        F.min(net.us("ts")).alias("start_us"),
        F.max(net.us("ts")).alias("end_us"),
        *[
            F.count_if(net.has_flags(net.TCP_FLAGS[f])).alias(f"{f.lower()}_packets")
            for f in ("SYN", "FIN", "RST")
        ],
    )
    span = F.col("end_us") - F.col("start_us")
    return (
        grouped.join(handshakes(packets), CONVERSATION)
        .select("*", "side.*")
        .drop("side")
        .withColumns(
            {
                "duration_s": seconds(span),
                "avg_packet_size": ratio("bytes", "packets"),
                "packets_per_second": per_second("packets", span),
                "bytes_per_second": per_second("bytes", span),
            }
        )
    )


def udp_flows(packets: DataFrame) -> DataFrame:
    """One row per UDP conversation; its first packet gives source and destination."""
    udp = net.with_endpoints(packets.where(F.upper("protocol") == "UDP"))
    first = F.struct("src_ip", "src_port", "dst_ip", "dst_port")
    grouped = udp.groupBy(*CONVERSATION).agg(
        F.min_by(first, "frame_number").alias("first"),
        F.count("*").alias("packets"),
        F.sum("packet_size").alias("bytes"),
        F.min(net.us("ts")).alias("start_us"),
        F.max(net.us("ts")).alias("end_us"),
    )
    return grouped.select("*", "first.*").drop("first")


def packet_gaps(packets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each packet with ``gap_us`` since the previous one of its group, in time order, and
    the previous packet's ports. Groups default to conversations."""
    keys = keys or CONVERSATION
    p = net.with_endpoints(packets)
    prev = F.struct(
        net.us("ts").alias("us"), F.col("src_port").alias("src_port"), F.col("dst_port").alias("dst_port")
    )
    out = scan(
        p,
        keys,
        [net.us("ts"), F.col("frame_number")],
        time_chunk(net.us("ts")),
        last={"prev": prev},
    )
    return out.withColumn("gap_us", net.us("ts") - F.col("prev.us"))


def gap_statistics(packets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and variance (population and sample) of the gaps, per group, in seconds."""
    keys = keys or CONVERSATION
    gap = F.col("gap_us") / 1e6
    return (
        packet_gaps(packets, keys)
        .groupBy(*keys)
        .agg(
            F.count("gap_us").alias("gaps"),
            F.sum("gap_us").alias("gap_sum_us"),
            (F.sum("gap_us") / F.count("gap_us") / 1e6).alias("mean_gap_s"),
            F.var_pop(gap).alias("gap_var_pop"),
            F.var_samp(gap).alias("gap_var_samp"),
        )
    )


def idle_sessions(packets: DataFrame, gap_s: int = 300) -> DataFrame:
    """Runs of packets of a conversation with no pause longer than ``gap_s`` seconds.

    Same rows as grouping by ``session_window``, which would sort a whole conversation in
    one task; here the session number is a running sum of "a pause ended here".
    """
    gap_us = gap_s * 1_000_000
    starts = F.when(F.col("gap_us").isNull() | (F.col("gap_us") > gap_us), 1).otherwise(0)
    numbered = scan(
        packet_gaps(packets).select(*CONVERSATION, "ts", "frame_number", "packet_size", "gap_us"),
        CONVERSATION,
        [net.us("ts"), F.col("frame_number")],
        time_chunk(net.us("ts")),
        sums={"session": starts.cast("long")},
    )
    return (
        numbered.groupBy(*CONVERSATION, "session")
        .agg(
            F.min(net.us("ts")).alias("start_us"),
            (F.max(net.us("ts")) + gap_us).alias("end_us"),
            F.count("*").alias("packets"),
            F.sum("packet_size").alias("bytes"),
        )
        .drop("session")
    )


def flow_summary(flows: DataFrame, retransmissions: DataFrame) -> DataFrame:
    """Per capture: flow count, durations, throughput, flows with retransmissions."""
    with_loss = flows.join(retransmissions, CONVERSATION, "left")
    return with_loss.groupBy("capture_id").agg(
        F.count("*").alias("flows"),
        F.count_if(F.col("protocol") == "TCP").alias("tcp_flows"),
        F.count_if(F.col("protocol") == "UDP").alias("udp_flows"),
        F.count_if(F.col("protocol") == "ICMP").alias("icmp_flows"),
        (F.sum(F.col("end_us") - F.col("start_us")) / F.count("*") / 1e6).alias("avg_duration_s"),
        (F.min(F.col("end_us") - F.col("start_us")) / 1e6).alias("min_duration_s"),
        (F.max(F.col("end_us") - F.col("start_us")) / 1e6).alias("max_duration_s"),
        F.avg("bytes_per_second").alias("mean_throughput"),
        F.count_if(F.col("retransmissions") > 0).alias("flows_with_retransmissions"),
    )


def flow_port_distribution(flows: DataFrame) -> DataFrame:
    return flows.groupBy("capture_id", "protocol", "server_port").agg(F.count("*").alias("flows"))

"""TCP measurements. ``grain`` is the grouping: one conversation, or a whole capture."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import net
from netlens.functions.measures import (
    congested,
    per_second,
    quality_label,
    quality_score,
    ratio,
    seconds,
    tcp_state,
)
from netlens.functions.net import CONVERSATION, FLOW
from netlens.operators.ordered import frame_chunk, scan

CAPTURE = ["capture_id"]
MIN_RTT_US, MAX_RTT_US = 1_000, 1_000_000


def tcp_packets(packets: DataFrame) -> DataFrame:
    return net.with_endpoints(packets.where(F.upper("protocol") == "TCP"))


def conversation_statistics(packets: DataFrame) -> DataFrame:
    """Everything that needs only the packets of one conversation, in one ordered scan.

    The scan carries the previous packet's time and, for each direction, the previous
    sequence number. Sides are kept as "from the low endpoint" until the client is known:
    the sender of the first bare SYN, else of the first packet.
    """
    frame, us = F.col("frame_number"), net.us("ts")
    forward = (F.col("src_ip") == F.col("lo_ip")) & (
        F.coalesce(F.col("src_port"), F.lit(0)) == F.col("lo_port")
    )
    scanned = scan(
        tcp_packets(packets).select(
            *CONVERSATION, "frame_number", "ts", "packet_size", "src_ip", "src_port",
            "tcp_flags", "tcp_seq", "tcp_window",
        ),
        CONVERSATION,
        [frame],
        frame_chunk(),
        last={
            "prev_us": us,
            "prev_forward": F.when(forward, F.col("tcp_seq")),
            "prev_backward": F.when(~forward, F.col("tcp_seq")),
        },
    )
    gap = us - F.col("prev_us")
    acked = net.has_flags(net.TCP_FLAGS["ACK"])
    rtt = F.when(acked & gap.between(MIN_RTT_US, MAX_RTT_US), gap)
    prev_seq = F.when(forward, F.col("prev_forward")).otherwise(F.col("prev_backward"))
    window = F.when(F.col("tcp_window") > 0, F.col("tcp_window"))
    at = F.struct(frame, us.alias("us"), F.col("src_ip").alias("src_ip"))
    from_lo = F.col("src_ip") == F.col("lo_ip")
    return scanned.groupBy(*CONVERSATION).agg(
        F.count("*").alias("packets"),
        F.sum("packet_size").alias("bytes"),
        F.count_if(from_lo).alias("lo_packets"),
        F.coalesce(F.sum(F.when(from_lo, F.col("packet_size"))), F.lit(0)).alias("lo_bytes"),
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        F.min(F.when(net.bare_syn(), at)).alias("first_syn"),
        F.min(F.when(net.syn_ack(), at)).alias("first_syn_ack"),
        F.count_if(net.bare_syn()).alias("syn_packets"),
        F.count_if(net.syn_ack()).alias("syn_ack_packets"),
        F.count_if(net.ack_without_syn()).alias("ack_packets"),
        F.count_if(net.has_flags(net.TCP_FLAGS["FIN"])).alias("fin_packets"),
        F.count_if(net.has_flags(net.TCP_FLAGS["RST"])).alias("rst_packets"),
        F.min(F.when(window.isNotNull(), F.struct(frame, window.alias("w")))).alias("first_window"),
        F.min(window).alias("min_window"),
        F.max(window).alias("max_window"),
        F.count_if(F.col("tcp_window") == 0).alias("zero_window_packets"),
        F.count(rtt).alias("rtt_samples"),
        (F.sum(rtt) / F.count(rtt) / 1e6).alias("avg_rtt"),
        (F.min(rtt) / 1e6).alias("min_rtt"),
        (F.max(rtt) / 1e6).alias("max_rtt"),
        F.var_samp(rtt / 1e6).alias("rtt_variance"),
        F.count_if(F.col("tcp_seq") < prev_seq).alias("out_of_order_packets"),
    )


def _handshake_us():
    ordered = F.col("first_syn.frame_number") < F.col("first_syn_ack.frame_number")
    return F.when(ordered, F.col("first_syn_ack.us") - F.col("first_syn.us"))


_SUMMED = [
    "packets", "bytes", "syn_packets", "syn_ack_packets", "ack_packets", "fin_packets",
    "rst_packets", "zero_window_packets", "out_of_order_packets",
]
_LOWEST = ["first", "first_syn", "first_syn_ack", "first_window", "min_window"]


def _by_conversation(stats: DataFrame) -> DataFrame:
    client_lo = F.col("client_ip") == F.col("lo_ip")
    return stats.withColumn(
        "client_ip", F.coalesce("first_syn.src_ip", "first.src_ip")
    ).withColumns(
        {
            "client_packets": F.when(client_lo, F.col("lo_packets")).otherwise(
                F.col("packets") - F.col("lo_packets")
            ),
            "client_bytes": F.when(client_lo, F.col("lo_bytes")).otherwise(
                F.col("bytes") - F.col("lo_bytes")
            ),
        }
    )


def _by_capture(stats: DataFrame) -> DataFrame:
    """Conversation rows rolled up to their capture (one row per capture is joined back)."""
    whole = stats.groupBy("capture_id").agg(
        *[F.sum(c).alias(c) for c in _SUMMED],
        *[F.min(c).alias(c) for c in _LOWEST],
        F.max("last").alias("last"),
        F.max("max_window").alias("max_window"),
    ).withColumn("client_ip", F.coalesce("first_syn.src_ip", "first.src_ip"))
    same_ip = F.col("lo_ip") == F.col("hi_ip")
    is_lo = F.col("lo_ip") == F.col("client_ip")
    is_hi = (F.col("hi_ip") == F.col("client_ip")) & ~same_ip
    sides = (
        stats.select("capture_id", "lo_ip", "hi_ip", "packets", "bytes", "lo_packets", "lo_bytes")
        .join(whole.select("capture_id", "client_ip"), "capture_id")
        .where(is_lo | is_hi)
        .groupBy("capture_id")
        .agg(
            F.sum(
                F.when(is_lo, F.col("lo_packets")).otherwise(F.col("packets") - F.col("lo_packets"))
            ).alias("client_packets"),
            F.sum(
                F.when(is_lo, F.col("lo_bytes")).otherwise(F.col("bytes") - F.col("lo_bytes"))
            ).alias("client_bytes"),
        )
    )
    return whole.join(sides, "capture_id")


def rtt_samples(packets: DataFrame, grain: list[str] = CONVERSATION) -> DataFrame:
    """Gaps before ACK-flagged packets, when between 1 ms and 1 s, in seconds."""
    us = net.us("ts")
    scanned = scan(
        tcp_packets(packets).select(
            *dict.fromkeys([*grain, "frame_number", "ts", "tcp_flags"])
        ),
        grain,
        [F.col("frame_number")],
        frame_chunk(),
        last={"prev_us": us},
    )
    gap = us - F.col("prev_us")
    usable = net.has_flags(net.TCP_FLAGS["ACK"]) & gap.between(MIN_RTT_US, MAX_RTT_US)
    sample = F.when(usable, gap)
    return scanned.groupBy(*grain).agg(
        F.count(sample).alias("rtt_samples"),
        (F.sum(sample) / F.count(sample) / 1e6).alias("avg_rtt"),
        (F.min(sample) / 1e6).alias("min_rtt"),
        (F.max(sample) / 1e6).alias("max_rtt"),
        F.var_samp(sample / 1e6).alias("rtt_variance"),
    )


def handshake_rtt(packets: DataFrame, grain: list[str] = CONVERSATION) -> DataFrame:
    """First SYN-ACK minus first bare SYN, if the SYN comes first."""
    at = F.struct("frame_number", net.us("ts").alias("us"))
    firsts = tcp_packets(packets).groupBy(*grain).agg(
        F.min(F.when(net.bare_syn(), at)).alias("syn"),
        F.min(F.when(net.syn_ack(), at)).alias("syn_ack"),
    )
    ordered = F.col("syn.frame_number") < F.col("syn_ack.frame_number")
    return firsts.select(
        *grain, F.when(ordered, F.col("syn_ack.us") - F.col("syn.us")).alias("handshake_us")
    )


def retransmissions(packets: DataFrame, grain: list[str] = CONVERSATION) -> DataFrame:
    """Repeats of a sequence number within a directed 4-tuple, and their share of packets."""
    cols = list(dict.fromkeys([*grain, *FLOW]))
    return (
        tcp_packets(packets)
        .groupBy(*cols, "tcp_seq")
        .agg(F.count("*").alias("n"))
        .groupBy(*grain)
        .agg(
            F.sum(F.when(F.col("tcp_seq").isNotNull(), F.col("n") - 1).otherwise(0)).alias(
                "retransmissions"
            ),
            F.sum("n").alias("_n"),
        )
        .withColumn("retransmission_rate", ratio("retransmissions", "_n"))
        .drop("_n")
    )


def capture_health(packets: DataFrame) -> DataFrame:
    """Retransmissions and their rate, distinct directed 4-tuples and the mean handshake time of
    each capture: one reading, rolled up from sequence numbers to flows, conversations, captures."""
    at = F.struct("frame_number", net.us("ts").alias("us"))
    firsts = [F.min(F.when(net.bare_syn(), at)).alias("syn"), F.min(F.when(net.syn_ack(), at)).alias("syn_ack")]
    earliest = [F.min("syn").alias("syn"), F.min("syn_ack").alias("syn_ack")]
    flow = list(dict.fromkeys([*CONVERSATION, *FLOW]))
    repeats = F.when(F.col("tcp_seq").isNotNull(), F.col("n") - 1).otherwise(0)
    added = [F.sum("n").alias("n"), F.sum("repeats").alias("repeats")]
    per_number = tcp_packets(packets).groupBy(*flow, "tcp_seq").agg(F.count("*").alias("n"), *firsts)
    per_flow = per_number.withColumn("repeats", repeats).groupBy(*flow).agg(*added, *earliest)
    per_conversation = per_flow.groupBy(*CONVERSATION).agg(F.count("*").alias("flows"), *added, *earliest)
    ordered = F.col("syn.frame_number") < F.col("syn_ack.frame_number")
    handshake = F.when(ordered, F.col("syn_ack.us") - F.col("syn.us"))
    return per_conversation.groupBy("capture_id").agg(
        F.sum("repeats").alias("retransmissions"),
        ratio(F.sum("repeats"), F.sum("n")).alias("retransmission_rate"),
        F.sum("flows").alias("connection_rate"),
        (F.sum(handshake) / F.nullif(F.count(handshake), F.lit(0))).alias("handshake_us"),
    )


def retransmitted_packets(packets: DataFrame) -> DataFrame:
    """The packets whose sequence number was already seen in their directed 4-tuple."""
    scanned = scan(
        packets.where((F.upper("protocol") == "TCP") & F.col("tcp_seq").isNotNull()),
        [*FLOW, "tcp_seq"],
        [F.col("frame_number")],
        frame_chunk(),
        last={"seen_at": F.col("frame_number")},
    )
    return scanned.where(F.col("seen_at").isNotNull())


def out_of_order(packets: DataFrame, grain: list[str] = CONVERSATION) -> DataFrame:
    """Packets with a sequence number below the previous one of their directed 4-tuple."""
    cols = list(dict.fromkeys([*grain, *FLOW]))
    scanned = scan(
        tcp_packets(packets)
        .where(F.col("tcp_seq").isNotNull())
        .select(*cols, "frame_number", "tcp_seq"),
        cols,
        [F.col("frame_number")],
        frame_chunk(),
        last={"prev_seq": F.col("tcp_seq")},
    )
    return scanned.groupBy(*grain).agg(
        F.count_if(F.col("tcp_seq") < F.col("prev_seq")).alias("out_of_order_packets")
    )


def analysis(packets: DataFrame, grain: list[str] = CONVERSATION) -> DataFrame:
    """All TCP measurements of a group on one row, with state and quality.

    At capture grain the conversation rows are rolled up, except that round trips are the
    gaps between successive packets of the whole capture.
    """
    stats = conversation_statistics(packets)
    if grain == CONVERSATION:
        base = _by_conversation(stats)
    else:
        base = _by_capture(stats).join(rtt_samples(packets, grain), grain, "left")
    joined = (
        base.join(retransmissions(packets, grain), grain, "left")
        .withColumns(
            {
                "duration_us": F.col("last.us") - F.col("first.us"),
                "handshake_us": _handshake_us(),
                "initial_window": F.coalesce("first_window.w", F.lit(0)),
                "min_window": F.coalesce("min_window", F.lit(0)),
                "max_window": F.coalesce("max_window", F.lit(0)),
                "server_packets": F.col("packets") - F.col("client_packets"),
                "server_bytes": F.col("bytes") - F.col("client_bytes"),
            }
        )
        .withColumn(
            "window_scaling",
            F.when(
                F.col("max_window") > 65535, F.floor(F.col("max_window") / 65536) + 1
            ).otherwise(0),
        )
        .drop("first", "last", "first_syn", "first_syn_ack", "first_window", "lo_packets", "lo_bytes")
    )
    score = quality_score(
        "retransmission_rate", "avg_rtt", "out_of_order_packets", "zero_window_packets"
    )
    return joined.withColumns(
        {
            "state": tcp_state(
                "syn_packets", "syn_ack_packets", "ack_packets", "rst_packets", "fin_packets"
            ),
            "duration_s": seconds("duration_us"),
            "throughput_bps": per_second(F.col("bytes") * 8, "duration_us"),
            "client_throughput_bps": per_second(F.col("client_bytes") * 8, "duration_us"),
            "server_throughput_bps": per_second(F.col("server_bytes") * 8, "duration_us"),
            "quality_score": score,
            "quality": quality_label(score),
            "congested": congested(
                "retransmission_rate", "zero_window_packets", "out_of_order_packets", "packets"
            ),
        }
    )


def triage(packets: DataFrame) -> DataFrame:
    """Connections (packets with SYN), retransmissions, resets and zero windows per capture."""
    counts = tcp_packets(packets).groupBy("capture_id").agg(
        F.count_if(net.has_flags(net.TCP_FLAGS["SYN"])).alias("tcp_connections"),
        F.count_if(net.has_flags(net.TCP_FLAGS["RST"])).alias("resets"),
        F.count_if(F.col("tcp_window") == 0).alias("zero_windows"),
    )
    return counts.join(retransmissions(packets, CAPTURE), "capture_id", "left")


def syn_spacing(packets: DataFrame, first: int = 10) -> DataFrame:
    """Positive gaps among the first bare SYNs of a capture: mean and maximum seconds."""
    w = Window.partitionBy("capture_id").orderBy("frame_number")
    head = (
        packets.where((F.upper("protocol") == "TCP") & net.bare_syn())
        .select("capture_id", "frame_number", net.us("ts").alias("us"))
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= first)
    )
    gap = F.col("us") - F.lag("us").over(w)
    return (
        head.withColumn("gap", gap)
        .groupBy("capture_id")
        .agg(
            F.coalesce(
                F.sum(F.when(F.col("gap") > 0, F.col("gap")))
                / F.nullif(F.count_if(F.col("gap") > 0), F.lit(0))
                / 1e6,
                F.lit(0.0),
            ).alias("avg_syn_gap_s"),
            F.coalesce(F.max(F.when(F.col("gap") > 0, F.col("gap"))) / 1e6, F.lit(0.0)).alias(
                "max_syn_gap_s"
            ),
        )
    )

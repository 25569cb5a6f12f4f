"""UDP flow statistics, response gaps, bursts and near-duplicates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions import net
from netlens.functions.measures import per_second, ratio, seconds
from netlens.functions.net import CONVERSATION
from netlens.operators.flows import packet_gaps
from netlens.operators.ordered import frame_chunk, scan

CAPTURE = ["capture_id"]
LARGE = 1400
HEADERS = 28
LOOKAHEAD = 9
DUPLICATE_US = 10_000
BURST_US = 100_000
# Packets per block in which near-duplicates are looked for.
BLOCK = 256


def udp_packets(packets: DataFrame) -> DataFrame:
    return packets.where(F.upper("protocol") == "UDP")


def flow_statistics(packets: DataFrame, grain: list[str] = CAPTURE) -> DataFrame:
    """Totals, request and response counts, sizes, large packets, throughput and loss.

    A group is bidirectional if it has more than one source or destination; then a packet
    to a port below 1024 is a request, any other a response.
    """
    frame = F.col("frame_number")
    us = net.us("ts")
    g = (
        net.with_endpoints(udp_packets(packets))
        .groupBy(*grain)
        .agg(
            F.count("*").alias("packets"),
            F.sum("packet_size").alias("bytes"),
            (F.max(F.struct(frame, us.alias("us")))["us"] - F.min(F.struct(frame, us.alias("us")))["us"]).alias(
                "duration_us"
            ),
            ((F.min("src_ip") != F.max("src_ip")) | (F.min("dst_ip") != F.max("dst_ip"))).alias(
                "bidirectional"
            ),
            F.count_if(F.col("dst_port") < 1024).alias("to_low"),
            F.avg("packet_size").alias("avg_packet_size"),
            F.min("packet_size").alias("min_packet_size"),
            F.max("packet_size").alias("max_packet_size"),
            F.avg(F.coalesce(F.col("udp_length"), F.col("packet_size") - HEADERS)).alias(
                "avg_payload_size"
            ),
            F.count_if(F.col("packet_size") > LARGE).alias("large_packets"),
        )
    )
    both = F.col("bidirectional")
    requests = F.when(both, F.col("to_low")).otherwise(0)
    responses = F.when(both, F.col("packets") - F.col("to_low")).otherwise(0)
    return g.select(
        *grain,
        "packets",
        "bytes",
        seconds("duration_us").alias("duration_s"),
        requests.alias("requests"),
        responses.alias("responses"),
        F.when(both, 0).otherwise(F.col("packets")).alias("unidirectional"),
        "avg_packet_size",
        "min_packet_size",
        "max_packet_size",
        "avg_payload_size",
        "large_packets",
        (F.col("large_packets") > 0).alias("potential_fragmentation"),
        per_second(F.col("bytes") * 8, "duration_us").alias("throughput_bps"),
        F.greatest(F.lit(0.0), ratio(requests - responses, requests)).alias("loss_rate"),
    )


def response_gaps(packets: DataFrame, grain: list[str] = CAPTURE) -> DataFrame:
    """Gap statistics of UDP conversations; gaps that look like an answer to a request apart."""
    gaps = packet_gaps(udp_packets(packets))
    answers = ((F.col("prev.dst_port") < 1024) & (F.col("src_port") < 1024)) | (
        (F.col("prev.src_port") > 1024) & (F.col("dst_port") > 1024)
    )
    r = F.when(answers, F.col("gap_us"))
    return gaps.groupBy(*grain).agg(
        F.count("gap_us").alias("gaps"),
        (F.sum("gap_us") / F.count("gap_us") / 1e6).alias("avg_inter_packet_gap"),
        F.count(r).alias("responses_timed"),
        (F.sum(r) / F.count(r) / 1e6).alias("avg_response_time"),
        (F.min(r) / 1e6).alias("min_response_time"),
        (F.max(r) / 1e6).alias("max_response_time"),
        F.stddev_samp(r / 1e6).alias("response_time_stddev"),
    )


def bursts(packets: DataFrame, grain: list[str] = CAPTURE, large: int = LARGE) -> DataFrame:
    """Per group: large packets, and whether two of them in succession are <0.1 s apart."""
    scanned = scan(
        net.with_endpoints(udp_packets(packets).where(F.col("packet_size") > large)),
        grain,
        [F.col("frame_number")],
        frame_chunk(),
        last={"prev_us": net.us("ts")},
    )
    close = (net.us("ts") - F.col("prev_us")) < BURST_US
    return scanned.groupBy(*grain).agg(
        F.count("*").alias("large_packets"),
        F.coalesce(F.bool_or(close), F.lit(False)).alias("burst_detected"),
    )


def near_duplicates(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per capture: UDP packets repeated (same ends and size, <10 ms) in the next nine.

    Packets get their UDP ordinal in the capture and are matched by equi-join on ends,
    size and block of ordinals. Rows at the start of a block are copied to the block
    before it, so a group holds at most block + 9 rows whatever the traffic looks like.
    """
    ordinal = scan(
        udp_packets(packets).select("capture_id", "frame_number", "ts", "src_ip", "dst_ip", "packet_size"),
        CAPTURE,
        [F.col("frame_number")],
        frame_chunk(),
        sums={"n": F.lit(1).cast("long")},
    ).withColumn("us", net.us("ts"))
    here = F.floor(F.col("n") / block).cast("long")
    left = ordinal.withColumn("block", here)
    copies = F.when(F.col("n") % block < LOOKAHEAD, F.array(here, here - 1)).otherwise(F.array(here))
    right = ordinal.select(
        "capture_id",
        "src_ip",
        "dst_ip",
        "packet_size",
        F.explode(copies).alias("block"),
        F.col("n").alias("n2"),
        F.col("us").alias("us2"),
    )
    keys = ["capture_id", "src_ip", "dst_ip", "packet_size", "block"]
    match = [left[k] == right[k] for k in keys] + [
        (F.col("n2") - F.col("n")).between(1, LOOKAHEAD),
        F.abs(F.col("us2") - F.col("us")) < DUPLICATE_US,
    ]
    repeated = left.join(right, match, "left_semi").groupBy("capture_id").agg(
        F.count("*").alias("duplicates")
    )
    totals = udp_packets(packets).groupBy("capture_id").agg(F.count("*").alias("packets"))
    return (
        totals.join(repeated, "capture_id", "left")
        .na.fill(0, ["duplicates"])
        .withColumn("duplicate_rate", ratio("duplicates", "packets"))
    )

"""HTTP request–response pairing and the aggregates over it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions import net
from netlens.functions.measures import ratio
from netlens.operators.ordered import frame_chunk, index_percentiles, scan
from netlens.operators.traffic import top_n

CONNECTION = ["capture_id", "client_ip", "client_port", "server_ip", "server_port"]


def messages(packets: DataFrame) -> DataFrame:
    """HTTP packets keyed by connection; the client is whoever sends the requests."""
    request = F.col("http_method").isNotNull()
    return (
        packets.where(request | F.coalesce(F.col("http_status") != 0, F.lit(False)))
        .withColumn("is_request", request)
        .withColumns(
            {
                "client_ip": F.when(request, F.col("src_ip")).otherwise(F.col("dst_ip")),
                "client_port": F.when(request, F.col("src_port")).otherwise(F.col("dst_port")),
                "server_ip": F.when(request, F.col("dst_ip")).otherwise(F.col("src_ip")),
                "server_port": F.when(request, F.col("dst_port")).otherwise(F.col("src_port")),
            }
        )
        .select(
            *CONNECTION,
            "frame_number",
            net.us("ts").alias("us"),
            "packet_size",
            "is_request",
            "http_method",
            "http_host",
            "http_uri",
            "http_status",
        )
    )


def transactions(packets: DataFrame) -> DataFrame:
    """A response closes the request right before it on the connection.

    (A newer request replaces an unanswered one, and a second response finds none.)
    """
    prev = F.struct(
        "is_request", "frame_number", "us", "packet_size", "http_method", "http_host", "http_uri"
    )
    scanned = scan(
        messages(packets), CONNECTION, [F.col("frame_number")], frame_chunk(), last={"prev": prev}
    )
    return scanned.where(~F.col("is_request") & F.col("prev.is_request")).select(
        *CONNECTION,
        F.col("prev.frame_number").alias("request_frame"),
        F.col("frame_number").alias("response_frame"),
        F.col("prev.http_method").alias("method"),
        F.col("prev.http_host").alias("host"),
        F.col("prev.http_uri").alias("uri"),
        F.col("http_status").alias("status"),
        F.col("prev.packet_size").alias("request_size"),
        F.col("packet_size").alias("response_size"),
        (F.col("us") - F.col("prev.us")).alias("response_us"),
    )


def ordinal_sessions(packets: DataFrame) -> DataFrame:
    """The i-th request of a capture with its i-th response, requests without one included."""
    numbered = [
        scan(
            messages(packets).where(F.col("is_request") == is_request),
            ["capture_id"],
            [F.col("frame_number")],
            frame_chunk(),
            sums={"session": F.lit(1).cast("long")},
        )
        for is_request in (True, False)
    ]
    requests = numbered[0].select(
        "capture_id", "session", F.col("frame_number").alias("request_frame"), "http_method", "http_uri"
    )
    responses = numbered[1].select(
        "capture_id", "session", F.col("frame_number").alias("response_frame"), "http_status"
    )
    return requests.join(responses, ["capture_id", "session"], "left")


def summary(packets: DataFrame) -> DataFrame:
    """Requests, responses, bytes, sizes, success and error counts per capture."""
    req = F.col("is_request")
    size, status = F.col("packet_size"), F.col("http_status")
    zero = F.lit(0).cast("long")
    return (
        messages(packets)
        .groupBy("capture_id")
        .agg(
            F.count_if(req).alias("requests"),
            F.count_if(~req).alias("responses"),
            F.coalesce(F.sum(F.when(req, size)), zero).alias("request_bytes"),
            F.coalesce(F.sum(F.when(~req, size)), zero).alias("response_bytes"),
            F.count_if(~req & status.between(200, 299)).alias("success_count"),
            F.count_if(~req & (status >= 400)).alias("error_count"),
        )
        .withColumns(
            {
                "total_bytes": F.col("request_bytes") + F.col("response_bytes"),
                "avg_request_size": ratio("request_bytes", "requests"),
                "avg_response_size": ratio("response_bytes", "responses"),
                "error_rate": ratio("error_count", "responses"),
            }
        )
    )


def response_times(packets: DataFrame) -> DataFrame:
    """Mean, min, max, p95 and p99 of the positive response times per capture, in seconds."""
    return response_time_statistics(transactions(packets))


def response_time_statistics(paired: DataFrame) -> DataFrame:
    positive = paired.where(F.col("response_us") > 0)
    basic = positive.groupBy("capture_id").agg(
        F.count("*").alias("timed"),
        (F.sum("response_us") / F.count("*") / 1e6).alias("avg_response_time"),
        (F.min("response_us") / 1e6).alias("min_response_time"),
        (F.max("response_us") / 1e6).alias("max_response_time"),
    )
    tails = index_percentiles(positive, ["capture_id"], "response_us", {"p95": 0.95, "p99": 0.99})
    return basic.join(tails, "capture_id").withColumns(
        {"p95": F.col("p95") / 1e6, "p99": F.col("p99") / 1e6}
    )


def method_counts(packets: DataFrame) -> DataFrame:
    return (
        messages(packets)
        .where("is_request")
        .groupBy("capture_id", "http_method")
        .agg(F.count("*").alias("requests"))
    )


def status_counts(packets: DataFrame) -> DataFrame:
    return (
        messages(packets)
        .where("NOT is_request")
        .groupBy("capture_id", "http_status")
        .agg(F.count("*").alias("responses"))
    )


def top_targets(packets: DataFrame, kind: str = "uri", n: int = 10) -> DataFrame:
    """The most requested ``uri`` or ``host`` values of the paired transactions."""
    counts = (
        transactions(packets)
        .where(F.length(kind) > 0)
        .groupBy("capture_id", kind)
        .agg(F.count("*").alias("transactions"))
    )
    return top_n(counts, "transactions", n, [kind], per=["capture_id"])


def parsed_messages(packets: DataFrame) -> DataFrame:
    """First payload line split into request-line or status-line fields (three parts or more)."""
    text = F.col("payload").cast("string")
    parts = F.split(F.get(F.split(text, "\r\n"), 0), " ")
    is_response = text.startswith("HTTP/")
    is_request = text.rlike("^(GET|POST|PUT|DELETE|HEAD|OPTIONS) ")
    return (
        packets.where((is_response | is_request) & (F.size(parts) >= 3))
        .select(
            "capture_id",
            "frame_number",
            F.when(is_response, F.lit("response")).otherwise("request").alias("kind"),
            F.when(is_request, F.get(parts, 0)).alias("method"),
            F.when(is_request, F.get(parts, 1)).alias("uri"),
            F.when(is_response, F.get(parts, 0)).otherwise(F.get(parts, 2)).alias("version"),
            F.when(is_response, F.get(parts, 1)).alias("status_code"),
            F.when(
                is_response, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), " ")
            ).alias("status_message"),
        )
    )

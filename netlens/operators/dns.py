"""DNS query–response matching and the aggregates over it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions import net
from netlens.functions.measures import per_second, ratio
from netlens.operators.http import response_time_statistics
from netlens.operators.ordered import frame_chunk, scan, time_chunk
from netlens.operators.traffic import top_n

CONNECTION = ["capture_id", "client_ip", "client_port", "server_ip", "server_port"]
NXDOMAIN, SERVFAIL = 3, 2


def messages(packets: DataFrame) -> DataFrame:
    """DNS packets keyed by connection; the client is whoever sends the queries."""
    query = F.length("dns_query") > 0
    is_query = F.coalesce(query, F.lit(False))
    return (
        packets.where(is_query | F.coalesce(F.length("dns_response") > 0, F.lit(False)))
        .withColumn("is_query", is_query)
        .withColumns(
            {
                "client_ip": F.when(is_query, F.col("src_ip")).otherwise(F.col("dst_ip")),
                "client_port": F.when(is_query, F.col("src_port")).otherwise(F.col("dst_port")),
                "server_ip": F.when(is_query, F.col("dst_ip")).otherwise(F.col("src_ip")),
                "server_port": F.when(is_query, F.col("dst_port")).otherwise(F.col("src_port")),
            }
        )
        .select(
            *CONNECTION,
            "frame_number",
            net.us("ts").alias("us"),
            "is_query",
            "dns_query",
            "dns_type",
            "dns_response",
            "dns_rcode",
        )
    )


def transactions(packets: DataFrame) -> DataFrame:
    """Answered queries and, per connection, the query still open at the end (TIMEOUT)."""
    m = messages(packets)
    sent = F.struct("is_query", "frame_number", "us", "dns_query", "dns_type")
    scanned = scan(m, CONNECTION, [F.col("frame_number")], frame_chunk(), last={"prev": sent})
    answered = scanned.where(~F.col("is_query") & F.col("prev.is_query")).select(
        *CONNECTION,
        F.col("prev.frame_number").alias("query_frame"),
        F.col("prev.us").alias("query_us"),
        F.col("prev.dns_query").alias("domain"),
        F.col("prev.dns_type").alias("query_type"),
        F.col("dns_response").alias("answer"),
        F.col("dns_rcode").alias("rcode"),
        F.lit("NOERROR").alias("outcome"),
        (F.col("us") - F.col("prev.us")).alias("response_us"),
    )
    still_open = (
        m.groupBy(*CONNECTION)
        .agg(F.max_by(sent, "frame_number").alias("last"))
        .where(F.col("last.is_query"))
        .select(
            *CONNECTION,
            F.col("last.frame_number").alias("query_frame"),
            F.col("last.us").alias("query_us"),
            F.col("last.dns_query").alias("domain"),
            F.col("last.dns_type").alias("query_type"),
            F.lit("TIMEOUT").alias("outcome"),
        )
    )
    return answered.unionByName(still_open, allowMissingColumns=True)


def _with_answers(packets: DataFrame, chunk_us: int = 60_000_000) -> DataFrame:
    """DNS packets, each with the first strictly later response carrying its transaction id.

    The scan runs backwards in time; at equal times queries come first, so a response never
    answers a query of its own instant.
    """
    us = net.us("ts")
    dns = packets.where(F.col("dns_qr").isNotNull()).select(
        "capture_id", "frame_number", "dns_id", "dns_qr", "dns_rcode", us.alias("us")
    )
    response = F.when(
        F.col("dns_qr") == 1,
        F.struct(F.col("us").alias("us"), F.col("dns_rcode").alias("rcode")),
    )
    return scan(
        dns,
        ["capture_id", "dns_id"],
        [
            -F.col("us"),
            F.col("dns_qr"),
            F.coalesce(-F.col("dns_rcode"), F.lit(0)),
            -F.col("frame_number"),
        ],
        time_chunk(-F.col("us"), chunk_us),
        last={"answer": response},
    )


def matched_by_id(packets: DataFrame, chunk_us: int = 60_000_000) -> DataFrame:
    """Each query with its answer; responses may serve several queries."""
    return _with_answers(packets, chunk_us).where(F.col("dns_qr") == 0).select(
        "capture_id",
        "frame_number",
        "dns_id",
        (F.col("answer.us") - F.col("us")).alias("response_us"),
        F.col("answer.rcode").alias("rcode"),
        (F.col("answer").isNull() | (F.col("answer.rcode") != 0)).alias("failed"),
    )


def health(packets: DataFrame) -> DataFrame:
    """What ``triage`` and ``performance`` say of a capture that the findings need, in one go:
    unanswered queries, failure rate and mean latency."""
    is_query = F.col("dns_qr") == 0
    answer = F.when(is_query, F.col("answer.us") - F.col("us"))
    failed = is_query & (F.col("answer").isNull() | (F.col("answer.rcode") != 0))
    per_id = (
        _with_answers(packets)
        .groupBy("capture_id", "dns_id")
        .agg(
            F.count_if(is_query).alias("q"),
            F.count_if(F.col("dns_qr") == 1).alias("r"),
            F.count_if(failed).alias("failures"),
            F.sum(answer).alias("total_us"),
            F.count(answer).alias("answered"),
        )
    )
    return per_id.groupBy("capture_id").agg(
        F.sum(F.greatest(F.col("q") - F.col("r"), F.lit(0))).alias("unanswered"),
        ratio(F.sum("failures"), F.sum("q")).alias("failure_rate"),
        (F.sum("total_us") / F.nullif(F.sum("answered"), F.lit(0)) / 1e6).alias("avg_response_time"),
    )


def performance(packets: DataFrame) -> DataFrame:
    """Per capture: queries, timeouts, failures, failure rate, mean and maximum latency."""
    return (
        matched_by_id(packets)
        .groupBy("capture_id")
        .agg(
            F.count("*").alias("queries"),
            F.count_if(F.col("response_us").isNull()).alias("timeouts"),
            F.count_if("failed").alias("failures"),
            (F.sum("response_us") / F.count("response_us") / 1e6).alias("avg_response_time"),
            (F.max("response_us") / 1e6).alias("max_response_time"),
        )
        .withColumn("failure_rate", ratio("failures", "queries"))
    )


def triage(packets: DataFrame) -> DataFrame:
    """Queries, responses, NXDOMAIN responses, and queries beyond the responses of their id."""
    q, r = F.col("dns_qr") == 0, F.col("dns_qr") == 1
    per_id = (
        packets.where(F.col("dns_qr").isNotNull())
        .groupBy("capture_id", "dns_id")
        .agg(
            F.count_if(q).alias("q"),
            F.count_if(r).alias("r"),
            F.count_if(r & (F.col("dns_rcode") == NXDOMAIN)).alias("nx"),
        )
    )
    return per_id.groupBy("capture_id").agg(
        F.sum("q").alias("dns_queries"),
        F.sum("r").alias("dns_responses"),
        F.sum("nx").alias("nxdomain"),
        F.sum(F.greatest(F.col("q") - F.col("r"), F.lit(0))).alias("unanswered"),
    )


def summary(packets: DataFrame) -> DataFrame:
    """Totals, success rate, timeouts, failure codes, distinct domains and query rate."""
    seen = messages(packets).groupBy("capture_id").agg(
        F.count_if("is_query").alias("queries"), F.count_if(~F.col("is_query")).alias("responses")
    )
    t = transactions(packets)
    done = t.groupBy("capture_id").agg(
        F.count_if(F.col("outcome") == "NOERROR").alias("answered"),
        F.count_if(F.col("outcome") == "TIMEOUT").alias("timeouts"),
        F.count_if(F.col("rcode") == NXDOMAIN).alias("nxdomain"),
        F.count_if(F.col("rcode") == SERVFAIL).alias("servfail"),
        F.count_distinct("domain").alias("unique_domains"),
        (F.max("query_us") - F.min("query_us")).alias("span_us"),
    )
    return (
        seen.join(done, "capture_id", "left")
        .na.fill(0)
        .withColumn("success_rate", ratio("answered", "queries"))
        .withColumn("queries_per_second", per_second("queries", "span_us"))
        .drop("span_us")
    )


def response_times(packets: DataFrame) -> DataFrame:
    return response_time_statistics(transactions(packets).where(F.col("response_us").isNotNull()))


def type_counts(packets: DataFrame) -> DataFrame:
    return (
        messages(packets)
        .where("is_query")
        .groupBy("capture_id", F.col("dns_type").alias("query_type"))
        .agg(F.count("*").alias("queries"))
    )


def top_domains(packets: DataFrame, n: int = 10) -> DataFrame:
    counts = transactions(packets).groupBy("capture_id", "domain").agg(F.count("*").alias("queries"))
    return top_n(counts, "queries", n, ["domain"], per=["capture_id"])


def servers(packets: DataFrame) -> DataFrame:
    """Queries per server and the mean of its positive response times."""
    rt = F.when(F.col("response_us") > 0, F.col("response_us"))
    return (
        transactions(packets)
        .groupBy("capture_id", "server_ip")
        .agg(
            F.count("*").alias("queries"),
            (F.sum(rt) / F.count(rt) / 1e6).alias("avg_response_time"),
        )
    )


# DNS query type numbers.
QUERY_TYPES = {"A": 1, "NS": 2, "CNAME": 5, "SOA": 6, "PTR": 12, "MX": 15, "TXT": 16, "AAAA": 28, "SRV": 33}


def type_number(text):
    """Query type as a number: its own digits, or the number of the type name."""
    table = F.create_map(*[F.lit(x) for kv in QUERY_TYPES.items() for x in kv])
    return F.coalesce(text.try_cast("int"), F.try_element_at(table, F.upper(text)))


def deep_summary(packets: DataFrame) -> DataFrame:
    """Query count and distinct names of the packets marked as queries."""
    return (
        packets.where(F.col("dns_qr") == 0)
        .groupBy("capture_id")
        .agg(F.count("*").alias("queries"), F.count_distinct("dns_query").alias("unique_domains"))
    )


def deep_type_counts(packets: DataFrame) -> DataFrame:
    return (
        packets.where((F.col("dns_qr") == 0) & F.col("dns_query").isNotNull())
        .groupBy("capture_id", type_number(F.col("dns_type")).alias("qtype"))
        .agg(F.count("*").alias("queries"))
    )

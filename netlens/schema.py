"""The canonical table schemas. Nothing in the package infers a schema."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

PACKETS = T.StructType(
    [
        T.StructField("capture_id", _S, False),
        T.StructField("frame_number", _L, False),
        T.StructField("ts", _TS),
        T.StructField("packet_size", _L),
        T.StructField("src_ip", _S, False),
        T.StructField("dst_ip", _S, False),
        T.StructField("protocol", _S),
        T.StructField("ip_proto", _I),
        T.StructField("src_port", _I),
        T.StructField("dst_port", _I),
        T.StructField("tcp_flags", _I),
        T.StructField("tcp_seq", _L),
        T.StructField("tcp_ack", _L),
        T.StructField("tcp_window", _I),
        T.StructField("udp_length", _I),
        T.StructField("icmp_type", _I),
        T.StructField("icmp_code", _I),
        T.StructField("http_method", _S),
        T.StructField("http_host", _S),
        T.StructField("http_uri", _S),
        T.StructField("http_status", _I),
        T.StructField("dns_id", _I),
        T.StructField("dns_qr", _I),
        T.StructField("dns_query", _S),
        T.StructField("dns_response", _S),
        T.StructField("dns_type", _S),
        T.StructField("dns_rcode", _I),
        T.StructField("tls_version", _I),
        T.StructField("tls_cipher", _I),
        T.StructField("vlan_id", _I),
        T.StructField("is_encrypted", _B),
        T.StructField("payload", T.BinaryType()),
    ]
)

# One row per live packet; `timestamp` is epoch seconds.
LIVE_PACKETS = T.StructType(
    [
        T.StructField("src_ip", _S),
        T.StructField("dst_ip", _S),
        T.StructField("protocol", _S),
        T.StructField("size", _L),
        T.StructField("dst_port", _I),
        T.StructField("timestamp", _D),
    ]
)

FINDINGS = T.StructType(
    [
        T.StructField("capture_id", _S),
        T.StructField("detector", _S),
        T.StructField("type", _S),
        T.StructField("severity", _S),
        T.StructField("src_ip", _S),
        T.StructField("dst_ip", _S),
        T.StructField("frame_number", _L),
        T.StructField("description", _S),
        T.StructField("evidence", _S),
        T.StructField("value", _D),
        T.StructField("confidence", _D),
    ]
)

REPORTS = T.StructType(
    [
        T.StructField("report_id", _L, False),
        T.StructField("job_id", _S, False),
        T.StructField("original_filename", _S, False),
        T.StructField("file_hash", _S),
        T.StructField("file_size", _L),
        T.StructField("status", _S, False),
        T.StructField("created_at", _TS, False),
        T.StructField("processing_time", _L),
        T.StructField("total_packets", _L),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("report_id", _L, False),
        T.StructField("job_id", _S, False),
        T.StructField("status", _S, False),
        T.StructField("progress", _I),
        T.StructField("started_at", _TS),
        T.StructField("completed_at", _TS),
    ]
)

# The states a catalog row may be in.
REPORT_STATUSES = ("pending", "processing", "completed", "failed", "cancelled")
JOB_STATUSES = ("pending", "started", "retry", "failure", "success")

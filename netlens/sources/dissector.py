"""Dissector JSON exports as packet rows.

A field may sit flat in ``layers`` or inside its layer, and be a scalar or a one-element
list. Leaves are declared STRING, so the JSON reader hands lists over as their text.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions import net
from netlens.schema import PACKETS

# Layer -> exported fields.
LAYER_FIELDS = {
    "frame": ("frame.number", "frame.time", "frame.len"),
    "ip": ("ip.src", "ip.dst", "ip.proto"),
    "tcp": ("tcp.srcport", "tcp.dstport", "tcp.flags", "tcp.seq", "tcp.ack", "tcp.window"),
    "udp": ("udp.srcport", "udp.dstport", "udp.length"),
    "icmp": ("icmp.type", "icmp.code"),
    "http": ("http.request.method", "http.host", "http.request.uri", "http.response.code"),
    "dns": (
        "dns.id", "dns.flags.response", "dns.qry.name", "dns.resp.name", "dns.qry.type",
        "dns.flags.rcode",
    ),
    "tls": ("tls.handshake.version", "tls.handshake.ciphersuite"),
}
_CORRUPT = "_corrupt_record"
_DISSECTOR_TIME = "MMM d, yyyy HH:mm:ss.SSSSSSSSS z"


def export_schema() -> T.StructType:
    s = T.StringType()
    flat = [T.StructField(f, s) for fs in LAYER_FIELDS.values() for f in fs]
    nested = [
        T.StructField(layer, T.StructType([T.StructField(f, s) for f in fs]))
        for layer, fs in LAYER_FIELDS.items()
    ]
    layers = T.StructType(flat + nested)
    return T.StructType(
        [
            T.StructField("_source", T.StructType([T.StructField("layers", layers)])),
            T.StructField(_CORRUPT, s),
        ]
    )


def read_export(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Packet rows of one or many exports. The capture is the file name without its ending, behind
    the folders below the first that ``path`` leaves open, so equal names in two folders stay apart.

    One JSON object per line is the splittable form; ``multiline`` reads files that hold
    one JSON array each.
    """
    raw = (
        spark.read.schema(export_schema())
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("multiLine", multiline)
        .json(path)
    )
    place = spark._jvm.org.apache.hadoop.fs.Path(re.split(r"/[^/]*[*?{\[]", path, maxsplit=1)[0])
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/")
    file = F.col("_metadata.file_path")
    inside = F.when(F.contains(file, F.lit(f"{root}/")), F.substring_index(file, f"{root}/", -1)).otherwise(F.col("_metadata.file_name"))
    return parse_export(raw, F.regexp_extract(inside, r"^(.*?)(\.[^./]*)?$", 1))


def _field(name: str) -> Column:
    layer = name.split(".")[0]
    layers = F.col("_source.layers")
    text = F.coalesce(layers[name], layers[layer][name])
    first = F.get(F.from_json(text, "array<string>"), 0)
    value = F.when(text.startswith("["), first).otherwise(text)
    return F.when(value != "", value)


def parse_export(raw: DataFrame, capture_id: Column) -> DataFrame:
    """Rows without both addresses, broken JSON and unreadable numbers are left out."""
    names = [f for fs in LAYER_FIELDS.values() for f in fs]
    alias = {n: n.replace(".", "_") for n in names}
    flat = raw.where(F.col(_CORRUPT).isNull()).select(
        capture_id.alias("capture_id"), *[_field(n).alias(a) for n, a in alias.items()]
    )
    proto = net.protocol_name(F.col("ip_proto").try_cast("int"))
    flat = flat.withColumn("protocol", proto)

    def of(protocol: str, column: str) -> Column:
        return F.when(F.col("protocol") == protocol, F.col(column))

    numbers = {
        "frame_number": (F.coalesce("frame_number", F.lit("0")), "long"),
        "packet_size": (F.coalesce("frame_len", F.lit("0")), "long"),
        "src_port": (F.coalesce(of("TCP", "tcp_srcport"), of("UDP", "udp_srcport")), "int"),
        "dst_port": (F.coalesce(of("TCP", "tcp_dstport"), of("UDP", "udp_dstport")), "int"),
        "tcp_seq": (of("TCP", "tcp_seq"), "long"),
        "tcp_ack": (of("TCP", "tcp_ack"), "long"),
        "tcp_window": (of("TCP", "tcp_window"), "int"),
        "udp_length": (of("UDP", "udp_length"), "int"),
        "icmp_type": (of("ICMP", "icmp_type"), "int"),
        "icmp_code": (of("ICMP", "icmp_code"), "int"),
    }
    readable = F.lit(True)
    for text, kind in numbers.values():
        readable = readable & (text.isNull() | text.try_cast(kind).isNotNull())
    when = F.regexp_replace("frame_time", r"\s+", " ")
    epoch = when.try_cast("double")
    ts = F.coalesce(
        F.timestamp_micros((epoch * 1e6).cast("long")),
        F.try_to_timestamp(when),
        F.try_to_timestamp(when, F.lit(_DISSECTOR_TIME)),
    )
    have = {
        **{n: text.try_cast(kind) for n, (text, kind) in numbers.items()},
        "capture_id": F.col("capture_id"),
        "ts": ts,
        "src_ip": F.col("ip_src"),
        "dst_ip": F.col("ip_dst"),
        "protocol": F.col("protocol"),
        "ip_proto": F.col("ip_proto").try_cast("int"),
        "tcp_flags": net.flags_from_text(of("TCP", "tcp_flags")),
        "http_method": F.col("http_request_method"),
        "http_host": F.col("http_host"),
        "http_uri": F.col("http_request_uri"),
        "http_status": F.col("http_response_code").try_cast("int"),
        "dns_id": _number("dns_id"),
        "dns_qr": F.when(F.lower("dns_flags_response").isin("1", "true"), 1).when(
            F.lower("dns_flags_response").isin("0", "false"), 0
        ),
        "dns_query": F.col("dns_qry_name"),
        "dns_response": F.col("dns_resp_name"),
        "dns_type": F.col("dns_qry_type"),
        "dns_rcode": _number("dns_flags_rcode"),
        "tls_version": _number("tls_handshake_version"),
        "tls_cipher": _number("tls_handshake_ciphersuite"),
    }
    return flat.where(F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull() & readable).select(
        *[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PACKETS.fields]
    )


def _number(column: str) -> Column:
    return net.flags_from_text(F.col(column))

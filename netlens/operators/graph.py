"""Host-graph tables: nodes, edges, flow steps, incident hosts, issue rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import net
from netlens.functions.measures import severity_of_rank, severity_rank
from netlens.operators.traffic import top_n

# Fixed values.
MAX_NODES = 50
MAX_CONVERSATIONS = 100
MIN_EDGE_PACKETS = 10
HIGH_TRAFFIC = 1000
GATEWAY_PEERS = 10
STEPS = 20
LABELLED_PORTS = (80, 443, 22, 25, 53, 21, 23)

_TIES = ["src_ip", "src_port", "dst_ip", "dst_port"]


def directed(flows: DataFrame) -> DataFrame:
    """Conversation flows as graph input: client as source."""
    return flows.select(
        "capture_id",
        F.col("client_ip").alias("src_ip"),
        F.col("client_port").alias("src_port"),
        F.col("server_ip").alias("dst_ip"),
        F.col("server_port").alias("dst_port"),
        "protocol",
        "packets",
        "bytes",
    )


def busiest(convs: DataFrame, n: int = MAX_CONVERSATIONS) -> DataFrame:
    return top_n(convs, "packets", n, _TIES, per=["capture_id"]).drop("rank")


def nodes(convs: DataFrame, n: int = MAX_CONVERSATIONS) -> DataFrame:
    """Hosts of each capture's n busiest conversations, with class and role.

    Packets and bytes come from those conversations; the role from all of them.
    """
    ends = F.array(
        F.struct(F.col("src_ip").alias("ip"), F.col("dst_ip").alias("peer"), F.lit(1).alias("out")),
        F.struct(F.col("dst_ip").alias("ip"), F.col("src_ip").alias("peer"), F.lit(0).alias("out")),
    )
    volume = (
        busiest(convs, n)
        .select("capture_id", "packets", "bytes", F.explode(ends).alias("e"))
        .groupBy("capture_id", "e.ip")
        .agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    )
    # A conversation of a host with itself counts once, as outgoing.
    pairs = convs.groupBy("capture_id", "src_ip", "dst_ip").agg(F.count("*").alias("n"))
    links = (
        pairs.select("capture_id", "n", F.explode(ends).alias("e"))
        .where((F.col("e.out") == 1) | (F.col("e.ip") != F.col("e.peer")))
        .groupBy("capture_id", "e.ip", "e.peer")
        .agg(
            F.sum(F.when(F.col("e.out") == 1, F.col("n")).otherwise(0)).alias("o"),
            F.sum(F.when(F.col("e.out") == 0, F.col("n")).otherwise(0)).alias("i"),
        )
        .groupBy("capture_id", "ip")
        .agg(
            F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.count("*").alias("peers")
        )
    )
    role = (
        F.when(F.col("incoming") > F.col("outgoing") * 2, F.lit("server"))
        .when(F.col("outgoing") > F.col("incoming") * 2, F.lit("client"))
        .when(F.col("peers") > GATEWAY_PEERS, F.lit("gateway"))
        .otherwise("peer")
    )
    return volume.join(links, ["capture_id", "ip"]).select(
        "capture_id",
        "ip",
        net.node_id("ip").alias("node_id"),
        "packets",
        "bytes",
        net.ip_class("ip").alias("ip_class"),
        role.alias("role"),
    )


def kept_nodes(convs: DataFrame, n: int = MAX_NODES) -> DataFrame:
    """The busiest nodes of each capture."""
    return top_n(nodes(convs), "packets", n, ["ip"], per=["capture_id"])


def between_kept(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes (at most MAX_NODES per capture)."""
    ips = kept.select("capture_id", "ip")
    return edges.join(ips.withColumnRenamed("ip", "src_ip"), ["capture_id", "src_ip"], "left_semi").join(
        ips.withColumnRenamed("ip", "dst_ip"), ["capture_id", "dst_ip"], "left_semi"
    )


def edges(convs: DataFrame, min_packets: int = MIN_EDGE_PACKETS) -> DataFrame:
    """Edges of the graph: busy conversations between kept nodes, labelled."""
    n = F.col("packets")
    count = F.when(n > 10000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).when(
        n > 50, n.cast("string")
    )
    port = F.when(
        F.col("dst_port").isin(*LABELLED_PORTS), F.concat(F.lit(":"), F.col("dst_port").cast("string"))
    )
    busy = busiest(convs).where(n >= min_packets)
    return between_kept(busy, kept_nodes(convs)).select(
        "capture_id",
        *_TIES,
        "protocol",
        "packets",
        "bytes",
        F.concat_ws(" ", "protocol", count, port).alias("label"),
        (n > HIGH_TRAFFIC).alias("high_traffic"),
    )


def flow_steps(convs: DataFrame, n: int = STEPS) -> DataFrame:
    """The busiest conversations of each capture as sequence steps."""
    p = F.col("packets")
    return top_n(convs, "packets", n, _TIES, per=["capture_id"]).select(
        "capture_id",
        F.col("rank").alias("step"),
        *_TIES,
        "packets",
        F.when(p > 100, F.concat(F.col("protocol"), F.lit(" ("), p.cast("string"), F.lit(" pkts)")))
        .otherwise(F.col("protocol"))
        .alias("label"),
        (p > 50).alias("has_response"),
    )


def incident_hosts(alerts: DataFrame, text: str = "description") -> DataFrame:
    """Hosts named in alert texts: alerts, distinct kinds, highest severity, and a label.

    Alerts are counted per (host, kind, severity) first; the label lists up to two kinds.
    """
    per_kind = (
        alerts.select("capture_id", "type", "severity", F.explode(net.ips_in_text(text)).alias("ip"))
        .groupBy("capture_id", "ip", "type")
        .agg(F.count("*").alias("n"), F.max(severity_rank("severity")).alias("rank"))
    )
    hosts = per_kind.groupBy("capture_id", "ip").agg(
        F.sum("n").alias("alerts"),
        F.count("*").alias("kinds"),
        F.max("rank").alias("rank"),
        F.min("type").alias("first"),
        F.max("type").alias("last"),
    )
    label = (
        F.when(F.col("kinds") == 1, F.col("first"))
        .when(F.col("kinds") == 2, F.concat_ws(", ", "first", "last"))
        .otherwise(F.concat(F.col("kinds").cast("string"), F.lit(" threat types")))
    )
    return hosts.select(
        "capture_id",
        "ip",
        "alerts",
        "kinds",
        severity_of_rank("rank").alias("max_severity"),
        label.alias("label"),
    )


def issue_rows(issues: DataFrame) -> DataFrame:
    """Performance issues with a short text and a severity class, numbered per capture."""
    d = F.col("description")
    s = F.lower("severity")
    w = Window.partitionBy("capture_id").orderBy("type", "severity", "description")
    return issues.select(
        "capture_id",
        F.row_number().over(w).alias("issue"),
        "type",
        "severity",
        F.when(F.length(d) > 50, F.concat(F.substring(d, 1, 47), F.lit("..."))).otherwise(d).alias("short_text"),
        F.when(s == "high", F.lit("highSeverity"))
        .when(s == "medium", F.lit("mediumSeverity"))
        .otherwise("lowSeverity")
        .alias("severity_class"),
    )

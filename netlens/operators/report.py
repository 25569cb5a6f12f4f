"""The analysis document (one nested row per capture), its sections and its exports.

Lists inside a document are all bounded: protocols, the ten busiest hosts, the twenty
busiest conversations, and capture-level issues. Per-packet findings stay a table; the
document holds their counts.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions.measures import severity_score
from netlens.operators import detect, dns, flows, http, tcp, traffic


def _list(df: DataFrame, name: str, order: list, *columns: str) -> DataFrame:
    """Rows of a bounded table as one ordered array per capture."""
    entry = F.struct(*order, F.struct(*columns).alias("v"))
    return df.groupBy("capture_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(name)
    )


def _section(df: DataFrame, name: str) -> DataFrame:
    return df.select("capture_id", F.struct(*[c for c in df.columns if c != "capture_id"]).alias(name))


def triage_sections(packets: DataFrame) -> DataFrame:
    """Totals, protocols, sizes, talkers and conversations of each capture."""
    totals = traffic.capture_totals(packets).join(traffic.distinct_endpoints(packets), "capture_id")
    protocols = traffic.protocol_distribution(packets).groupBy("capture_id").agg(
        F.map_from_entries(F.collect_list(F.struct("protocol", "packets"))).alias("protocols")
    )
    talkers = traffic.top_n(traffic.host_totals(packets), "packets", 10, ["ip"], per=["capture_id"])
    convs = flows.top_conversations(packets)
    return (
        _section(totals, "traffic_stats")
        .join(protocols, "capture_id", "left")
        .join(_section(traffic.size_distribution(packets), "packet_sizes"), "capture_id", "left")
        .join(
            _list(talkers, "top_talkers", ["rank"], "ip", "packets", "bytes", "bytes_sent", "bytes_received"),
            "capture_id", "left",
        )
        .join(
            _list(
                convs, "conversations", ["rank"],
                "lo_ip", "lo_port", "hi_ip", "hi_port", "protocol", "packets", "bytes",
            ),
            "capture_id", "left",
        )
    )


def _finding_sections(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Finding counts and risk of ``findings`` and the capture-level ``issues``, which are read
    once: both are counted together and told apart by a flag."""
    kind = F.struct("type", "severity", F.col("n").alias("findings"))
    issue = F.struct("type", "severity", "description", "value")
    both = findings.select("capture_id", F.lit(False).alias("issue"), "type", "severity", F.lit(None).cast("string").alias("description"), F.lit(None).cast("double").alias("value"))
    both = both.unionByName(issues.select("capture_id", F.lit(True).alias("issue"), "type", "severity", "description", "value"))
    counted = both.groupBy("capture_id", "issue", "type", "severity", "description").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    found = ~F.col("issue")
    scores = F.when(found, F.col("n") * severity_score("severity"))
    per_capture = counted.groupBy("capture_id").agg(
        F.array_sort(F.collect_list(F.when(found, kind))).alias("finding_counts"),
        F.array_sort(F.collect_list(F.when(F.col("issue"), issue))).alias("issues"),
        F.sum(F.when(found, F.col("n"))).alias("n"),
        F.round(F.least(F.lit(1.0), F.sum(scores)), 6).alias("score"),
    )
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    risk = F.when(F.col("n") > 0, F.struct(F.col("n").alias("findings"), F.col("score").alias("risk_score"))).alias("risk")
    return per_capture.select("capture_id", some("finding_counts"), some("issues"), risk)


def deep_sections(packets: DataFrame, findings: DataFrame) -> DataFrame:
    """Protocol sections, finding counts and capture-level issues."""
    return (
        _section(tcp.triage(packets), "tcp")
        .join(_section(http.summary(packets), "http"), "capture_id", "full")
        .join(_section(dns.summary(packets), "dns"), "capture_id", "full")
        .join(_finding_sections(findings, detect.load_and_performance(packets)), "capture_id", "full")
    )


def merge_sections(document: DataFrame, sections: DataFrame) -> DataFrame:
    """Add or replace sections of stored documents. A capture that is not in ``sections``, or
    has NULL there, keeps what it had; a new capture is added."""
    fresh = [c for c in sections.columns if c != "capture_id"]
    shared = [c for c in fresh if c in document.columns]
    renamed = sections.withColumnsRenamed({c: f"_new_{c}" for c in shared})
    merged = document.join(renamed, "capture_id", "full")
    return merged.select(
        "capture_id",
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in shared else F.col(c) for c in document.columns if c != "capture_id"],
        *[c for c in fresh if c not in shared],
    )


def documents(packets: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    found = findings if findings is not None else detect.security_triage(packets)
    return merge_sections(triage_sections(packets), deep_sections(packets, found))


def summaries(docs: DataFrame, protocols: int = 5) -> DataFrame:
    """Headline fields of each document with its leading protocols and issue count."""
    ranked = F.array_sort(
        F.transform(
            F.map_entries("protocols"),
            lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("name")),
        )
    )
    return docs.select(
        "capture_id",
        F.col("traffic_stats.packets").alias("total_packets"),
        F.col("traffic_stats.bytes").alias("total_bytes"),
        F.col("traffic_stats.duration_s").alias("duration_s"),
        F.transform(F.slice(ranked, 1, protocols), lambda e: e["name"]).alias("top_protocols"),
        F.coalesce(F.size("issues"), F.lit(0)).alias("issues_found"),
    )


def export_rows(docs: DataFrame) -> DataFrame:
    """Documents flattened to (capture, section, item, value text), one row per fact."""

    def facts(section: str):
        fields = docs.schema[section].dataType.fields
        return F.array(
            *[
                F.struct(
                    F.lit(section).alias("section"),
                    F.lit(f.name).alias("item"),
                    F.col(section)[f.name].cast("string").alias("value"),
                )
                for f in fields
            ]
        )

    def entry(section, item, value):
        return F.struct(
            F.lit(section).alias("section"), item.alias("item"), value.cast("string").alias("value")
        )

    lists = [
        F.transform(F.map_entries("protocols"), lambda e: entry("protocols", e["key"], e["value"])),
        F.transform(
            "top_talkers",
            lambda t: entry("top_talkers", t["ip"], t["bytes_sent"] + t["bytes_received"]),
        ),
        F.transform(
            "finding_counts",
            lambda k: entry("findings", F.concat_ws("/", k["type"], k["severity"]), k["findings"]),
        ),
        F.transform("issues", lambda i: entry("issues", i["type"], i["value"])),
    ]
    empty = F.array().cast("array<struct<section:string,item:string,value:string>>")
    parts = [facts(s) for s in ("traffic_stats", "packet_sizes", "tcp", "http", "dns", "risk")]
    parts += [F.coalesce(x, empty) for x in lists]
    return docs.select("capture_id", F.inline(F.concat(*parts))).where("value IS NOT NULL")


def numbered(rows: DataFrame) -> DataFrame:
    """Export rows numbered within their capture and section (both bounded)."""
    w = Window.partitionBy("capture_id", "section").orderBy("item", "value")
    return rows.withColumn("line", F.row_number().over(w))

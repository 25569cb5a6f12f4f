"""Reports over a findings table: counts, categories, risk levels, recommendations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Description keyword -> category, first match wins.
CATEGORIES = (
    ("malware", "Malware"),
    ("exfiltration", "Data Exfiltration"),
    ("anomaly", "Network Anomalies"),
    ("protocol", "Protocol Violations"),
)
OTHER_CATEGORY = "Suspicious Activity"

# Fixed values: (title, priority, the count that has to be positive, or None for always).
RECOMMENDATIONS = (
    ("Address Critical Security Issues Immediately", "CRITICAL", "critical"),
    ("Investigate High-Priority Security Findings", "HIGH", "high"),
    ("Review Machine Learning Anomaly Findings", "MEDIUM", "anomalies"),
    ("Implement Continuous Network Monitoring", "MEDIUM", None),
    ("Regular Security Assessments", "LOW", None),
    ("Update Security Policies", "LOW", None),
)


def for_every(counted: DataFrame, captures: DataFrame | None) -> DataFrame:
    """Counts per capture with a row of zeros for the captures that have none. Without a list of
    captures only those with findings are known."""
    if captures is None:
        return counted
    listed = captures.select("capture_id").distinct()
    return listed.join(counted, "capture_id", "left").na.fill(0)


def counts_by(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy("capture_id", column).agg(F.count("*").alias("findings"))


def category(description="description"):
    text = F.lower(description)
    out = None
    for word, name in CATEGORIES:
        out = F.when(text.contains(word), F.lit(name)) if out is None else out.when(
            text.contains(word), F.lit(name)
        )
    return out.otherwise(OTHER_CATEGORY)


def counts_by_category(findings: DataFrame) -> DataFrame:
    return (
        findings.withColumn("category", category())
        .groupBy("capture_id", "category")
        .agg(F.count("*").alias("findings"))
    )


def severity_totals(findings: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    s = F.lower("severity")
    counted = findings.groupBy("capture_id").agg(
        F.count("*").alias("findings"),
        *[F.count_if(s == x).alias(x) for x in ("critical", "high", "medium", "low")],
        F.count_if(F.col("detector") == "M6").alias("anomalies"),
    )
    return for_every(counted, captures)


def risk_level(findings: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    c, h = F.col("critical"), F.col("high")
    return severity_totals(findings, captures).withColumn(
        "risk_level",
        F.when(c > 0, F.lit("HIGH"))
        .when(h > 3, F.lit("MEDIUM-HIGH"))
        .when(h > 0, F.lit("MEDIUM"))
        .otherwise("LOW"),
    )


def recommendations(findings: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """The recommendation rows that apply to each capture."""
    rows = F.array_compact(
        F.array(
            *[
                F.when(
                    F.lit(True) if count is None else F.col(count) > 0,
                    F.struct(F.lit(title).alias("title"), F.lit(priority).alias("priority")),
                )
                for title, priority, count in RECOMMENDATIONS
            ]
        )
    )
    return severity_totals(findings, captures).select("capture_id", F.inline(rows))


def security_summary(findings: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Suspicious-address, scan and anomaly counts, and the severities of the first and last."""
    kind = (
        F.when(F.col("detector") == "D2", F.lit("scan"))
        .when(F.col("src_ip").isNotNull(), F.lit("ip"))
        .otherwise("anomaly")
    )
    rated = F.when(F.col("kind") != "scan", F.lower("severity"))
    counted = (
        findings.withColumn("kind", kind)
        .groupBy("capture_id")
        .agg(
            F.count_if(F.col("kind") == "ip").alias("suspicious_ip_count"),
            F.count_if(F.col("kind") == "scan").alias("port_scan_count"),
            F.count_if(F.col("kind") == "anomaly").alias("anomaly_count"),
            *[F.count_if(rated == s).alias(f"{s}_severity_count") for s in ("high", "medium", "low")],
            F.count("*").alias("total_security_issues"),
        )
    )
    return for_every(counted, captures)


def overall(findings: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Overall severity min(1, 0.1·n) and the deep-inspection risk word."""
    n = F.col("findings")
    counted = findings.groupBy("capture_id").agg(F.count("*").alias("findings"))
    return (
        for_every(counted, captures)
        .withColumns(
            {
                "overall_severity": F.least(F.lit(1.0), n * 0.1),
                "deep_risk": F.when(n == 0, F.lit("LOW"))
                .when(n < 5, F.lit("MEDIUM"))
                .otherwise("HIGH"),
            }
        )
    )

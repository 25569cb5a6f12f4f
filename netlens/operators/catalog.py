"""Report and job catalog queries."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.operators.traffic import top_n

NEWEST = ("created_at", ["report_id"])


def newest(reports: DataFrame, n: int) -> DataFrame:
    return top_n(reports, NEWEST[0], n, NEWEST[1])


def by_status(reports: DataFrame, status: str, n: int = 100) -> DataFrame:
    return newest(reports.where(F.col("status") == status), n)


def by_size(reports: DataFrame, low: int, high: int, n: int | None = None) -> DataFrame:
    hits = reports.where(F.col("file_size").between(low, high))
    return newest(hits, n) if n else hits.orderBy(F.desc("created_at"), "report_id")


def status_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy("status").agg(F.count("*").alias("reports"))


def processing_statistics(reports: DataFrame) -> DataFrame:
    done = reports.where((F.col("status") == "completed") & F.col("processing_time").isNotNull())
    return done.agg(
        F.count("*").alias("total_reports"),
        F.avg("processing_time").alias("avg_processing_time"),
        F.min("processing_time").alias("min_processing_time"),
        F.max("processing_time").alias("max_processing_time"),
        F.avg("file_size").alias("avg_file_size"),
        F.sum("total_packets").alias("total_packets_processed"),
        F.sum("file_size").alias("total_bytes_processed"),
    )


def _cutoff(as_of: str, days: int):
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def retained_reports(reports: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Reports not older than ``days`` at ``as_of``."""
    return reports.where(F.col("created_at") >= _cutoff(as_of, days))


def retained_jobs(jobs: DataFrame, reports: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Jobs whose report is not among the dropped ones."""
    dropped = reports.where(F.col("created_at") < _cutoff(as_of, days)).select("report_id")
    return jobs.join(dropped, "report_id", "left_anti")


def listing(
    reports: DataFrame,
    text: str | None = None,
    status: str | None = None,
    after: str | None = None,
    before: str | None = None,
) -> DataFrame:
    """List view: text in file name or job id, status, and an open date range."""
    df = reports
    if text:
        t = text.lower()
        df = df.where(F.lower("original_filename").contains(t) | F.lower("job_id").contains(t))
    if status and status != "all":
        df = df.where(F.col("status") == status)
    if after and before:
        df = df.where(
            (F.col("created_at") > F.lit(after).cast("timestamp"))
            & (F.col("created_at") < F.lit(before).cast("timestamp"))
        )
    return df


def dashboard(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count("*").alias("total"),
        *[
            F.count_if(F.col("status") == s).alias(s) for s in ("completed", "processing", "failed")
        ],
        F.sum("total_packets").alias("packets"),
        F.sum("file_size").alias("bytes"),
    )


def with_status(reports: DataFrame, job_ids: Sequence[str] | DataFrame, status: str) -> DataFrame:
    """Reports with the status set on the listed jobs; ``changed`` marks the rows touched.

    A list becomes an IN test; a table of ids (column job_id) becomes a join.
    """
    if isinstance(job_ids, DataFrame):
        marked = reports.join(
            job_ids.select("job_id").distinct().withColumn("_hit", F.lit(True)), "job_id", "left"
        )
        hit = F.coalesce("_hit", F.lit(False))
    else:
        marked, hit = reports, F.col("job_id").isin(*job_ids)
    return (
        marked.withColumn("changed", hit)
        .withColumn("status", F.when(F.col("changed"), F.lit(status)).otherwise(F.col("status")))
        .drop("_hit")
    )


def job_status(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Each job with its report."""
    r = reports.select(
        "report_id",
        F.col("status").alias("report_status"),
        "original_filename",
        "file_size",
        "created_at",
    )
    return jobs.join(r, "report_id")


def execution_times(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Seconds a job ran, beside its report's packets and processing time."""
    us = F.unix_micros("completed_at") - F.unix_micros("started_at")
    r = reports.select("report_id", "total_packets", "processing_time")
    return (
        jobs.where(F.col("started_at").isNotNull() & F.col("completed_at").isNotNull())
        .select("report_id", "job_id", (us / 1e6).alias("execution_s"))
        .join(r, "report_id")
    )


def latest_per_job(reports: DataFrame) -> DataFrame:
    """The newest report of each job id (the lowest report id among equals)."""
    w = Window.partitionBy("job_id").orderBy(F.desc("created_at"), "report_id")
    return reports.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_jobs(reports: DataFrame) -> DataFrame:
    return (
        reports.groupBy("job_id")
        .agg(F.count("*").alias("reports"), F.max("created_at").alias("newest"))
        .where(F.col("reports") > 1)
    )


def duplicate_files(reports: DataFrame) -> DataFrame:
    return (
        reports.groupBy("file_hash")
        .agg(
            F.count("*").alias("reports"),
            F.min("report_id").alias("first_report"),
            F.sum("file_size").alias("bytes"),
        )
        .where(F.col("reports") > 1)
    )


# Run-time factors.
TYPE_FACTORS = {"basic": 0.5, "comprehensive": 1.0, "security_focused": 1.5, "performance_focused": 1.2}
PRIORITY_FACTORS = {"urgent": 0.3, "high": 0.6, "normal": 1.0, "low": 2.0}


def estimated_seconds(size="file_size", analysis="analysis_type", priority="priority"):
    """Whole seconds a file will take: one per MB up to 300, by type and priority, at least 30."""

    def factor(table, column):
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(1.0))

    base = F.least(F.col(size) / 1e6, F.lit(300.0))
    seconds = base * factor(TYPE_FACTORS, analysis) * factor(PRIORITY_FACTORS, priority)
    return F.greatest(F.floor(seconds).cast("long"), F.lit(30))

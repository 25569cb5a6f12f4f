from pyspark.sql import functions as F

from netlens.operators import catalog
from netlens.plans.registry import query
from netlens.plans.shape import rounded
from netlens.sources import derived

_COLS = "report_id, job_id, status, file_size, original_filename"
_LIST = _COLS.split(", ")


def _q(name, sql):
    return query(name, sql, base="reports")


@_q("s8_report_catalog", "SELECT *, epoch_us(created_at) AS created_us FROM (SELECT * FROM reports) ".replace("SELECT *,", "SELECT * EXCLUDE (created_at),"))
def s8(spark, sf):
    r = derived.reports(spark, sf)
    return r.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


@_q(
    "s8_job_catalog",
    """SELECT report_id, job_id, status, progress, epoch_us(started_at) AS started_us, epoch_us(completed_at) AS completed_us FROM jobs""",
)
def s8_jobs(spark, sf):
    return derived.jobs(spark, sf).select(
        "report_id",
        "job_id",
        "status",
        "progress",
        F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("completed_at").alias("completed_us"),
    )


@_q("c1_reports_by_status", f"SELECT {_COLS} FROM reports WHERE status = 'completed' ORDER BY created_at DESC, report_id LIMIT 100")
def c1(spark, sf):
    return catalog.by_status(derived.reports(spark, sf), "completed").select(*_LIST)


@_q("c1_recent_reports", f"SELECT {_COLS} FROM reports ORDER BY created_at DESC, report_id LIMIT 50")
def c1_recent(spark, sf):
    return catalog.newest(derived.reports(spark, sf), 50).select(*_LIST)


@_q("c1_reports_by_size", f"SELECT {_COLS} FROM reports WHERE file_size BETWEEN 100000 AND 200000")
def c1_size(spark, sf):
    return catalog.by_size(derived.reports(spark, sf), 100000, 200000).select(*_LIST)


@_q("c2_status_counts", "SELECT status, count(*) AS reports FROM reports GROUP BY 1")
def c2(spark, sf):
    return catalog.status_counts(derived.reports(spark, sf))


@_q(
    "c3_processing_statistics",
    """SELECT count(*) AS total_reports, round(avg(processing_time), 6) AS avg_processing_time, min(processing_time) AS min_processing_time,
  max(processing_time) AS max_processing_time, round(avg(file_size), 6) AS avg_file_size,
  sum(total_packets)::BIGINT AS total_packets_processed, sum(file_size)::BIGINT AS total_bytes_processed
FROM reports WHERE status = 'completed' AND processing_time IS NOT NULL""",
)
def c3(spark, sf):
    return rounded(catalog.processing_statistics(derived.reports(spark, sf)))


_AS_OF, _DAYS = "1998-06-01 00:00:00", 365


@_q("c4_retained_reports", f"SELECT {_COLS} FROM reports WHERE created_at >= TIMESTAMP '{_AS_OF}' - INTERVAL {_DAYS} DAY")
def c4(spark, sf):
    return catalog.retained_reports(derived.reports(spark, sf), _AS_OF, _DAYS).select(*_LIST)


@_q(
    "j10_retained_jobs",
    f"""SELECT report_id, job_id, status FROM jobs WHERE report_id NOT IN (
  SELECT report_id FROM reports WHERE created_at < TIMESTAMP '{_AS_OF}' - INTERVAL {_DAYS} DAY)""",
)
def j10(spark, sf):
    return catalog.retained_jobs(
        derived.jobs(spark, sf), derived.reports(spark, sf), _AS_OF, _DAYS
    ).select("report_id", "job_id", "status")


@_q(
    "c5_report_listing",
    f"""SELECT {_COLS} FROM reports WHERE (contains(original_filename, 'p_12') OR contains(lower(job_id), 'p_12')) AND status = 'completed'
  AND created_at > TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1997-01-01'""",
)
def c5(spark, sf):
    return catalog.listing(
        derived.reports(spark, sf), "P_12", "completed", "1995-01-01", "1997-01-01"
    ).select(*_LIST)


@_q(
    "c6_dashboard",
    """SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'failed') AS failed, sum(total_packets)::BIGINT AS packets, sum(file_size)::BIGINT AS bytes FROM reports""",
)
def c6(spark, sf):
    return catalog.dashboard(derived.reports(spark, sf))


@_q(
    "c7_bulk_status",
    """SELECT report_id, job_id, CASE WHEN job_id IN ('job20', 'job40', 'job7') THEN 'cancelled' ELSE status END AS status,
  job_id IN ('job20', 'job40', 'job7') AS changed FROM reports""",
)
def c7(spark, sf):
    return catalog.with_status(
        derived.reports(spark, sf), ["job20", "job40", "job7"], "cancelled"
    ).select("report_id", "job_id", "status", "changed")


@_q(
    "c8_execution_times",
    """SELECT j.report_id, j.job_id, round((epoch_us(j.completed_at) - epoch_us(j.started_at)) / 1e6, 6) AS execution_s,
  r.total_packets, r.processing_time FROM jobs j JOIN reports r USING (report_id)
WHERE j.started_at IS NOT NULL AND j.completed_at IS NOT NULL""",
)
def c8(spark, sf):
    return rounded(catalog.execution_times(derived.jobs(spark, sf), derived.reports(spark, sf)))


@_q(
    "j5_job_status",
    """SELECT j.report_id, j.job_id, j.status, j.progress, r.status AS report_status, r.original_filename, r.file_size
FROM jobs j JOIN reports r USING (report_id)""",
)
def j5(spark, sf):
    return catalog.job_status(derived.jobs(spark, sf), derived.reports(spark, sf)).select(
        "report_id", "job_id", "status", "progress", "report_status", "original_filename", "file_size"
    )


@_q(
    "w11_latest_report_per_job",
    f"""SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, report_id) AS n FROM reports) WHERE n = 1""",
)
def w11(spark, sf):
    return catalog.latest_per_job(derived.reports(spark, sf)).select(*_LIST)


@_q(
    "w11_duplicate_jobs",
    "SELECT job_id, count(*) AS reports, epoch_us(max(created_at)) AS newest_us FROM reports GROUP BY 1 HAVING count(*) > 1",
)
def w11_duplicates(spark, sf):
    return (
        catalog.duplicate_jobs(derived.reports(spark, sf))
        .withColumn("newest_us", F.unix_micros("newest"))
        .drop("newest")
    )


@_q(
    "v5_duplicate_hashes",
    """SELECT file_hash, count(*) AS reports, min(report_id) AS first_report, sum(file_size)::BIGINT AS bytes FROM reports
GROUP BY 1 HAVING count(*) > 1""",
)
def v5_reports(spark, sf):
    return catalog.duplicate_files(derived.reports(spark, sf))


@_q(
    "v6_estimated_run_time",
    """, f AS (SELECT report_id, file_size * 2000 AS size, CASE report_id % 5 WHEN 0 THEN 'basic' WHEN 1 THEN 'comprehensive'
    WHEN 2 THEN 'security_focused' WHEN 3 THEN 'performance_focused' ELSE 'other' END AS analysis_type,
  CASE report_id % 4 WHEN 0 THEN 'urgent' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'low' END AS priority FROM reports)
SELECT report_id, greatest(30, floor(least(size / 1e6, 300::DOUBLE)
  * CASE analysis_type WHEN 'basic' THEN 0.5::DOUBLE WHEN 'security_focused' THEN 1.5::DOUBLE WHEN 'performance_focused' THEN 1.2::DOUBLE ELSE 1::DOUBLE END
  * CASE priority WHEN 'urgent' THEN 0.3::DOUBLE WHEN 'high' THEN 0.6::DOUBLE WHEN 'low' THEN 2::DOUBLE ELSE 1::DOUBLE END)::BIGINT) AS seconds FROM f""",
)
def v6(spark, sf):
    i = F.col("report_id")
    kind = (
        F.when(i % 5 == 0, F.lit("basic"))
        .when(i % 5 == 1, F.lit("comprehensive"))
        .when(i % 5 == 2, F.lit("security_focused"))
        .when(i % 5 == 3, F.lit("performance_focused"))
        .otherwise("other")
    )
    priority = (
        F.when(i % 4 == 0, F.lit("urgent"))
        .when(i % 4 == 1, F.lit("high"))
        .when(i % 4 == 2, F.lit("normal"))
        .otherwise("low")
    )
    f = derived.reports(spark, sf).select(
        "report_id",
        (F.col("file_size") * 2000).alias("file_size"),
        kind.alias("analysis_type"),
        priority.alias("priority"),
    )
    return f.select("report_id", catalog.estimated_seconds().alias("seconds"))

"""Packet, catalog and document tables in Parquet or JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.schema import JOBS, JOB_STATUSES, PACKETS, REPORT_STATUSES, REPORTS


def write_packets(packets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Packets partitioned by capture and day, so a time window prunes folders."""
    packets.withColumn("dt", F.to_date("ts")).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("capture_id", "dt").parquet(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """The packets table; filters on capture_id, dt and columns reach the scan."""
    day = T.StructField("dt", T.DateType())
    return spark.read.schema(T.StructType([*PACKETS.fields, day])).parquet(path)


def _known(df: DataFrame, statuses) -> DataFrame:
    required = [f.name for f in df.schema.fields if f.name in ("report_id", "job_id", "status")]
    ok = F.col("status").isin(*statuses)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return df.where(ok)


def read_reports(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The report catalog with its declared schema; rows outside it are left out."""
    return _known(spark.read.schema(REPORTS).format(fmt).load(path), REPORT_STATUSES)


def read_jobs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _known(spark.read.schema(JOBS).format(fmt).load(path), JOB_STATUSES).where(
        F.col("progress").isNull() | F.col("progress").between(0, 100)
    )


def write_documents(documents: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One document per capture; a capture written again replaces only its own folder."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "capture_id"
    ).format(fmt).save(path)


def write_export(rows: DataFrame, path: str, fmt: str = "json") -> None:
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)

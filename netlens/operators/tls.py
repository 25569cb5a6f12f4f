"""TLS hello counts from the decoded version and cipher columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEAK_BELOW = 0x0303


def hello_counts(packets: DataFrame) -> DataFrame:
    hello = F.col("tls_version").isNotNull() | F.col("tls_cipher").isNotNull()
    return (
        packets.where(hello)
        .groupBy("capture_id", "tls_version", "tls_cipher")
        .agg(F.count("*").alias("hellos"))
        .withColumn("weak", F.col("tls_version") < WEAK_BELOW)
    )

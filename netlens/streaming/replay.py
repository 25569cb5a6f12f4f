"""A stored feed played through a streaming query to its end."""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.operators.stage import shared_root
from netlens.streaming.pairing import stateful_session


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_root(spark).rstrip('/')}/netlens-feed-{uuid.uuid4().hex}"


def deliver(rows: DataFrame, end: dict[str, Column], path: str, fmt: str = "parquet") -> None:
    """Write the feed, and one more row after it (``end`` gives its values, the rest is null) whose
    time lets the watermark pass all others."""
    rows.write.format(fmt).save(path)
    last = rows.sparkSession.range(1).select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    last.write.format(fmt).mode("append").save(path)


def replayed(rows: DataFrame, end: dict[str, Column], build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What ``build`` makes of the rows as a stream, up to and without the end of the feed: read from
    files, run until nothing is left, and read back from the sink (in update mode with every
    version of a row)."""
    spark = rows.sparkSession
    place = folder(spark)
    deliver(rows, end, f"{place}/in")
    stream = stateful_session(spark).readStream.schema(rows.schema).parquet(f"{place}/in")
    out = build(stream)
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/out/batch_id={number}")
    query = out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out").select(*out.columns)

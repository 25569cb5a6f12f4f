"""Rolling baseline: a metrics row against the ten rows before it."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.operators.ordered import scan, time_chunk

HISTORY = 10
SPIKE, SURGE = 3, 2
# Metric rows per block; each block also gets the ten rows before it.
BLOCK = 100_000


def baseline_anomalies(metrics: DataFrame, block: int = BLOCK) -> DataFrame:
    """Spikes, surges and new protocols, for rows with at least ten before them.

    Needs ``feed, end_us, packets_per_second, connections, protocols``. Rows are numbered
    along time and cut into blocks; the last ten of a block are copied to the next one, so
    no feed's whole history lands in one task.
    """
    numbered = scan(
        metrics,
        ["feed"],
        [F.col("end_us")],
        time_chunk(F.col("end_us"), 86_400_000_000),
        sums={"n": F.lit(1).cast("long")},
    )
    here = F.floor(F.col("n") / block).cast("long")
    own = F.struct(here.alias("block"), F.lit(True).alias("own"))
    copy = F.struct((here + 1).alias("block"), F.lit(False).alias("own"))
    near_end = F.col("n") % block >= block - HISTORY
    placed = numbered.withColumn(
        "p", F.explode(F.when(near_end, F.array(own, copy)).otherwise(F.array(own)))
    ).select("*", "p.*")
    w = Window.partitionBy("feed", "block").orderBy("n").rowsBetween(-HISTORY, -1)
    compared = placed.withColumns(
        {
            "history": F.count("*").over(w),
            "avg_pps": F.avg("packets_per_second").over(w),
            "avg_connections": F.avg("connections").over(w),
            "seen": F.flatten(F.collect_list("protocols").over(w)),
        }
    ).where(F.col("own") & (F.col("history") >= HISTORY))

    def hit(cond, type_, severity, value, protocol=None):
        return F.when(
            cond,
            F.struct(
                F.lit(type_).alias("type"),
                F.lit(severity).alias("severity"),
                value.cast("double").alias("value"),
                F.lit(protocol).cast("string").alias("protocol"),
            ),
        )

    fixed = F.array_compact(
        F.array(
            hit(
                F.col("packets_per_second") > F.col("avg_pps") * SPIKE,
                "traffic_spike", "high", F.col("packets_per_second"),
            ),
            hit(
                F.col("connections") > F.col("avg_connections") * SURGE,
                "connection_surge", "medium", F.col("connections"),
            ),
        )
    )
    new = F.transform(
        F.array_except("protocols", "seen"),
        lambda p: F.struct(
            F.lit("new_protocol").alias("type"),
            F.lit("medium").alias("severity"),
            F.lit(1.0).alias("value"),
            p.alias("protocol"),
        ),
    )
    keep = [c for c in metrics.columns if c in ("feed", "end_us", "new")]
    return compared.select(*keep, F.explode(F.concat(fixed, new)).alias("a")).select(*keep, "a.*")

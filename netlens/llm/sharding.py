"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ring points per shard, and equal sectors of the ring. Both are fixed, so what is counted per
#: sector has a fixed size at any number of rows.
NODES = 64
SECTORS = 1 << 14


def _sector(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - (SECTORS.bit_length() - 1)).cast("int")


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """The virtual nodes in clockwise order: (last sector of the node's arc, shard). A shard's
    points depend on its number alone, so a further shard moves none of the others."""
    points = spark.range(shards * nodes).select((F.col("id") / nodes).cast("int").alias("shard"), (F.col("id") % nodes).alias("node"))
    placed = points.select("shard", "node", _sector(F.xxhash64(F.lit("node"), "shard", "node")).alias("sector"))
    return [(r["sector"], r["shard"]) for r in placed.orderBy("sector", "shard", "node").collect()]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each sector go: (sector, first rank, rank after the last, shard, slot
    of the first). Keys arrive at the node that ends their arc; a shard takes arrivals, in ring
    order, while it has room; the others go on to the next node, round after round."""
    room, taken = list(room), [0] * len(room)
    sectors = [n[0] for n in nodes]
    arrived: dict[int, list[tuple[int, int, int]]] = {}
    for sector in sorted(counts):
        arrived.setdefault(bisect_left(sectors, sector) % len(nodes), []).append((sector, 0, counts[sector]))
    out = []
    while arrived:
        onward: dict[int, list[tuple[int, int, int]]] = {}
        for node in sorted(arrived):
            shard = nodes[node][1]
            for sector, lo, hi in arrived[node]:
                cut = min(hi, lo + room[shard])
                if cut > lo:
                    out.append((sector, lo, cut, shard, taken[shard]))
                    taken[shard] += cut - lo
                    room[shard] -= cut - lo
                if cut < hi:
                    onward.setdefault((node + 1) % len(nodes), []).append((sector, cut, hi))
        arrived = onward
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold: equal shares that differ by one at most and add up to all
    rows, or (1 + slack) times the mean."""
    if slack:
        return [-(-int(rows * (1 + slack) + 1) // shards)] * shards
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _table(spark: SparkSession, rows: list[tuple], schema: str, names: list[str]) -> DataFrame:
    """A small literal table, made by the JVM."""
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row of ``docs``. size is the text's UTF-8
    bytes plus 1, slot a gapless number from 0 within the shard.

    A row's place on the ring is the hash of its id; within a sector rows are ranked by hash,
    id, size and checksum. Only counts per sector (a fixed number) reach the driver, which walks
    the overflow clockwise; ranks are cumulative sums within sectors. Rows that agree in id,
    size and checksum are counted as one before anything is shuffled and unfolded at the end,
    so no key is hot. Without slack, row counts of shards differ by one at most.

    A null text has no bytes and checksum 0; a null id is a key like any other; repeated rows
    get slots of their own; fewer rows than shards leave shards empty; no rows give no rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
    keyed = alike.withColumn("h", F.xxhash64("id")).withColumn("sector", _sector(F.col("h")))
    counts = {r["sector"]: r["n"] for r in keyed.groupBy("sector").agg(F.sum("n").alias("n")).collect()}
    plan = walk(counts, ring(spark, shards, nodes), capacities(sum(counts.values()), shards, slack))
    names = ["sector", "lo", "hi", "shard", "base"]
    ranges = _table(spark, plan, "sector int, lo bigint, hi bigint, shard int, base bigint", names)

    order = Window.partitionBy("sector").orderBy("h", "id", "size", "text_crc32")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ranked = keyed.withColumn("before", before)
    each = ranked.select("id", "size", "text_crc32", "sector", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("rank"))
    placed = each.join(F.broadcast(ranges), "sector").where("rank >= lo AND rank < hi")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))

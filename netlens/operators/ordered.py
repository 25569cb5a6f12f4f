"""Ordered scans (previous value, running sum) that survive a hot key.

A plain window sorts a whole key in one task. Here a key is cut into chunks of bounded
size along its order; each (key, chunk) is its own window group. What a chunk needs from
the chunks before it (the latest value, the sum so far) comes from a one-row-per-chunk
aggregate and enters the chunk as a single extra row in front, so no join is needed and
the big side is shuffled once.

The chunk expression has to grow with the order and bound the rows it holds:
``frame_number`` is unique per capture, so ``frame_chunk`` holds at most FRAME_CHUNK rows;
``time_chunk`` is bounded by what a link can carry in TIME_CHUNK_US.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_CHUNK = 1 << 20
TIME_CHUNK_US = 60 * 1_000_000


def _div(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(n)).cast("long")


def frame_chunk(size: int = FRAME_CHUNK, frame: str = "frame_number") -> Column:
    return _div(F.col(frame), size)


def time_chunk(us: Column, size_us: int = TIME_CHUNK_US) -> Column:
    return _div(us, size_us)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    chunk: Column,
    last: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` inside each key.

    ``last``: the latest non-NULL value strictly before the row.
    ``sums``: the running sum, the row included.
    ``order`` has to be a total order inside a key.
    """
    last, sums = last or {}, sums or {}
    base = df.withColumns(
        {
            "_chunk": chunk,
            **{f"_o{i}": c for i, c in enumerate(order)},
            **{f"_l_{n}": c for n, c in last.items()},
            **{f"_s_{n}": c for n, c in sums.items()},
        }
    )
    position = F.struct(*[F.col(f"_o{i}") for i in range(len(order))])
    if len(order) == 1 and base.schema["_o0"].dataType == T.LongType():
        # A number can be kept in a hash table, a struct has to be sorted.
        position = F.coalesce("_o0", F.lit(-(1 << 63)))
    per_chunk = base.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(F.col(f"_l_{n}"), F.when(F.col(f"_l_{n}").isNotNull(), position)).alias(f"_l_{n}")
            for n in last
        ],
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums],
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = [f"_l_{n}" for n in last] + [f"_s_{n}" for n in sums]
    carries = per_chunk.select(
        *keys,
        "_chunk",
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in last],
        *[F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums],
        F.lit(0).alias("_real"),
    ).where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in carried]))
    everything = base.withColumn("_real", F.lit(1)).unionByName(carries, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_chunk").orderBy(
        "_real", *[f"_o{i}" for i in range(len(order))]
    )
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = everything.withColumns(
        {
            **{n: F.last(f"_l_{n}", ignorenulls=True).over(earlier) for n in last},
            **{n: F.sum(f"_s_{n}").over(so_far) for n in sums},
        }
    ).where("_real = 1")
    return out.select(*df.columns, *last, *sums)


def index_percentiles(
    df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], bucket: int = 1 << 20
) -> DataFrame:
    """sorted[floor(f·n)] (0-based) of an integer column per key, for each named fraction.

    Equal values are counted first, so a chunk holds at most ``bucket`` distinct values
    however many rows the key has.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = scan(
        counts,
        keys,
        [F.col(value)],
        _div(F.col(value), bucket),
        sums={"_upto": F.col("_n")},
    )
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = ranked.join(totals, keys)
    picks = []
    for name, f in fractions.items():
        at = F.floor(F.col("_total") * F.lit(f))
        here = (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)
        picks.append(F.max(F.when(here, F.col(value))).alias(name))
    return joined.groupBy(*keys).agg(*picks)

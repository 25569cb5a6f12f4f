"""Connected components of an edge table, as a loop of grouped minima and joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.shared import checkpointed


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """Each row (a, b) with m, the least of a and all its b."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the least node it is connected with.

    Alternates two steps until nothing changes: every node ties its larger neighbours to its
    least neighbour, then ties all its smaller neighbours to the least of them. Components
    become stars in a number of rounds that grows with the logarithm of their length, and the
    edge count never grows. Each round is checkpointed in the shared folder. Edges with a null
    end and loops are left out; repeated edges count once; no edges give no rows."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = checkpointed(pairs.distinct())
    before = None
    while True:
        large = _with_minimum(_neighbours(pairs)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        tied = _with_minimum(down)
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(tied.select("a", F.col("m").alias("b")))
        pairs = checkpointed(small.where("a <> b").distinct())
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = (row[0], row[1])
        if now == before:
            break
        before = now
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

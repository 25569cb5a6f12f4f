"""Near-duplicate embeddings by sorted random projections."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.graph import components
from netlens.llm.shared import staged

THRESHOLD = 0.9
#: Neighbours in sorted order that a vector is compared with, before it.
WINDOW = 128
#: Chance of meeting a pair right at the threshold in some pass, from which passes are derived.
RECALL = 0.97
#: Vectors of one block where the links of a component are counted.
BLOCK = 256


def passes(rows: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that meet ``recall``: two vectors at the threshold agree in a hash bit with chance
    1 - angle / pi, and meet if they agree in as many leading bits as split the rows into runs
    of a window's length. (6 at least.)"""
    bit = 1 - math.acos(threshold) / math.pi
    meet = bit ** max(0.0, math.log2(max(1, rows) / window))
    return max(6, math.ceil(math.log(1 - recall) / math.log(1 - min(meet, 0.999))))


def unit(vectors: list[bytes], kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(v, kind) for v in vectors]).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # no overflow of squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _vectors(table: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """(id, node, vec): the vector's bytes and their hash, both null where it cannot link."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = []
            for v in batch.column(1):
                values = v.values if v.is_valid else None
                raw = None
                if values is not None and len(values) and not values.null_count:
                    row = values.to_numpy(zero_copy_only=False)
                    raw = (row + 0.0).astype(kind).tobytes() if np.isfinite(row).all() and row.any() else None
                vecs.append(raw)
            nodes = [None if v is None else xxhash.xxh64_intdigest(v) - (1 << 63) for v in vecs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(vecs, pa.binary())], ["id", "node", "vec"])

    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col))
    return rows.mapInArrow(read, "id bigint, node bigint, vec binary")


class _Union:
    """Which links a partition still has to tell."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        while (b := self.up.get(a, a)) != a:
            self.up[a] = a = self.up.get(b, b)
        return a

    def joined(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def candidates(classes: DataFrame, kind: str, count: int, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """Links (a, b) between nodes, enough to connect all that the passes find. In each pass
    vectors are sorted by 64 sign bits of random projections, dealt out by ranges, and compared
    with the ``window`` vectors before them by their cosine. Windows end at range borders,
    which differ from pass to pass."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column(1).to_pylist()
            size = np.array([len(v) for v in raw])
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                rows = unit([raw[i] for i in at], kind)
                if n not in planes:
                    planes[n] = np.random.default_rng(int(n)).normal(size=(rows.shape[1], 64 * count))
                bits = np.packbits(rows @ planes[n] > 0, axis=1).reshape(len(at), count, 8)
                part = batch.take(pa.array(at))
                for k in range(count):
                    keys = [f"{n:08x}".encode() + b.tobytes() for b in bits[:, k]]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array(keys, pa.binary()), *part.columns], ["pass", "key", "node", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Union()
        held: list[tuple] = []
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for lo in range(0, len(rows), 512):
                fresh = rows[lo : lo + 512]
                left, right = [], []
                for group in {(r[0], len(r[2])) for r in fresh}:
                    new = [r for r in fresh if (r[0], len(r[2])) == group]
                    old = [r for r in held if (r[0], len(r[2])) == group][-window:]
                    all_rows = old + new
                    vectors = unit([r[2] for r in all_rows], kind)
                    close = vectors[len(old) :] @ vectors.T >= threshold
                    x, y = np.nonzero(close)
                    x = x + len(old)
                    near = (y < x) & (x - y <= window)
                    for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
                        if links.joined(all_rows[i][1], all_rows[j][1]):
                            left.append(all_rows[j][1])
                            right.append(all_rows[i][1])
                held = (held + fresh)[-window:]
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    keyed = classes.select("node", "vec").mapInArrow(key, "pass int, key binary, node bigint, vec binary")
    dealt = keyed.repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node")
    return dealt.select("pass", "node", "vec").mapInArrow(compare, "a bigint, b bigint").distinct()


def counted(classes: DataFrame, roots: DataFrame, kind: str, threshold: float = THRESHOLD) -> DataFrame:
    """(node, links): vectors of other nodes that each node links with. All pairs of a component
    are compared, as pairs of blocks that are tasks of their own; only counts come out."""
    members = roots.join(classes, "node")
    blocks = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    each = members.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "vec")
    each = each.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "own", "node")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[dict] = []

        def done() -> pa.RecordBatch:
            nodes, links = [], []
            for size in {len(r["vec"]) for r in run}:
                rows = [r for r in run if len(r["vec"]) == size]
                vectors, n = unit([r["vec"] for r in rows], kind), np.array([r["n"] for r in rows])
                close = vectors @ vectors.T >= threshold
                np.fill_diagonal(close, False)
                if rows[0]["i"] != rows[0]["j"]:
                    own = np.array([r["own"] for r in rows])
                    close &= own[:, None] != own[None, :]
                nodes += [r["node"] for r in rows]
                links += (close @ n).tolist()
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64())], ["node", "links"])

        for batch in batches:
            for row in batch.to_pylist():
                if run and any(run[0][k] != row[k] for k in ("root", "i", "j")):
                    yield done()
                    run = []
                run.append(row)
        if run:
            yield done()

    return each.mapInArrow(count, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: the number of other rows linked directly
    (cosine of at least ``threshold``, in double precision), the least id that links lead to,
    and whether that is the row's own.

    Equal vectors are one node with a count, so copies are never compared pair by pair. The
    passes find which nodes hang together; then the links within each component are counted
    completely, so a dense group loses none to the bounded window. What can be lost is a
    connection that no pass meets (see ``passes``).

    Null, empty and zero vectors, and those with null or non-finite parts, link with nothing
    and stand for themselves; vectors of different lengths don't link. Rows with equal ids count
    as rows of their own; a null id never is the least; an empty table gives no rows."""
    element = next(f for f in table.schema.fields if f.name == vec_col).dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = staged(_vectors(table, id_col, vec_col, kind), "vectors")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = staged(classes, "classes")
    found = candidates(classes, kind, passes(classes.count(), threshold, window), threshold, window)
    roots = staged(components(found), "roots")
    links = counted(classes.select("node", "n", "vec"), roots, kind, threshold)

    nodes = classes.select("node", "least", "n").join(roots, "node", "left").join(links, "node", "left")
    nodes = nodes.select("node", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "root").select("node", "n_links", "component_id")
    out = rows.select("id", "node").join(nodes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )

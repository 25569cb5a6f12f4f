"""SimHash near-duplicates: fingerprints, a grid over segment bit counts, exact verification."""

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from netlens.llm.graph import components
from netlens.llm.shared import free_name, lean, mixed, pieces, staged

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Least Jaccard similarity of similar texts.
SIMILARITY = 0.8
#: Bands of least hashes: candidates agree in a whole band, as 99.98 % of pairs at 0.8 do.
BANDS, BAND = 36, 7
#: Least hashes that a sketch has one bit of each, and the standard deviations that it allows.
SKETCH, DEVIATIONS = 256, 6
#: Partners that a text is first compared with where a cell is long.
PARTNERS = 8
#: Bytes of shingle sets that one block of a long cell brings together.
BLOCK_BYTES = 1 << 24
#: White space between words.
BLANKS = " \t\n\x0b\x0c\r"
#: Runs of a cell up to this length are compared pair by pair; longer ones by growing groups.
SHORT_RUN = 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256
_EVEN = 0x5555555555555555
_SALTS, _ODDS, _JOIN = (x | np.uint64(1) for x in np.random.default_rng(SEED).integers(0, 1 << 64, (3, SKETCH), np.uint64))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` words of the text, A to Z lower-cased, words
    split at ASCII white space and joined by one space; of all words where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are those set in over half the hashes; 0 for no hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 200:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = (np.bincount((lanes + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, shingle: int = SHINGLE, count: int = 1) -> Column:
    """An array of ``count`` signed 64-bit fingerprints of the whole text. The first is made of
    the XXH64 values themselves, further ones of remixed values. Null and blank texts: 0."""

    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        made = []
        for value in texts:
            hashes = shingle_hashes(value, shingle)
            row = []
            for _ in range(count):
                row.append(majority(hashes))
                hashes = mixed(hashes) if count > 1 else hashes
            made.append(np.array(row, np.uint64).view(np.int64))
        return pd.Series(made)

    return of(text)


def bit_counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, in unary (0: 00, 1: 01, 2: 11): the number of
    differing bits of two such values is the Manhattan distance of the counts."""
    half = F.shiftrightunsigned(fp, 1)
    even = F.lit(_EVEN)
    return fp.bitwiseOR(half).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(even), 1))


def cell_masks(radius: int) -> list[int]:
    """Segments fall into radius + 2 groups. Counts at a Manhattan distance of at most
    ``radius`` differ in at most ``radius`` groups, so some two groups agree: a mask for every
    pair of groups (at 4: fifteen cells of ten to twelve segments)."""
    cuts = [int(x) // 2 * 2 for x in np.linspace(0, 64, radius + 3)]
    groups = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(groups, 2)]


def _unary(fp: np.ndarray) -> np.ndarray:
    half, even = fp >> np.uint64(1), np.uint64(_EVEN)
    return ((fp | half) & even) | ((fp & half & even) << np.uint64(1))


class _Values:
    """The fingerprints of some rows (rows x count), those that the rows' cells are made of, and
    their unary bit counts."""

    def __init__(self, fps: np.ndarray, own: np.ndarray, near: int, radius: int):
        self.fps, self.own, self.grid, self.near, self.radius = fps, own, _unary(own), near, radius

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of rows link: the Manhattan distance first, as the lower bound that it is,
        then the own fingerprint, then all bits."""
        found = np.bitwise_count(self.grid[x] ^ self.grid[y]) <= self.near
        x, y = x[found], y[found]
        exact = np.bitwise_count(self.own[x] ^ self.own[y]) <= self.near
        if self.fps.shape[1] > 1:
            x, y = x[exact], y[exact]
            exact[exact] = np.bitwise_count(self.fps[x] ^ self.fps[y]).sum(axis=1) <= self.radius
        found[found] = exact
        return found


def _forest(values: _Values, first: int, count: int) -> tuple[list, list]:
    """Edges that connect what links join among ``count`` rows from ``first``, one fewer than each
    connected group has rows: group by group, each member against those not yet reached."""
    left, right = [], []
    rest = np.arange(first, first + count)
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = values.linked(np.full(len(rest), at), rest)
            reached = rest[near]
            left.append(np.full(len(reached), at))
            right.append(reached)
            todo.extend(reached)
            rest = rest[~near]
    return left, right


def _links(cell: np.ndarray, mask: np.ndarray, values: _Values) -> tuple[np.ndarray, np.ndarray]:
    """Links within the cells of rows sorted by cell, as places of rows."""
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (mask[1:] != mask[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(cell)))
    left, right = [], []
    long = lengths > SHORT_RUN
    for at, n in zip(starts[long], lengths[long], strict=True):
        x, y = _forest(values, at, n)
        left += x
        right += y
    place = np.flatnonzero(np.repeat(~long & (lengths > 1), lengths))
    run = np.repeat(np.arange(len(starts)), lengths)[place]
    for step in range(1, SHORT_RUN):
        if step >= len(run) or not (near := run[step:] == run[:-step]).any():
            break
        x, y = place[:-step][near], place[step:][near]
        close = values.linked(x, y)
        left.append(x[close])
        right.append(y[close])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _celled(values: DataFrame, fps: Column, place: int) -> DataFrame:
    """(fps, node, mask, cell) of every cell that fingerprint ``place`` of the rows lies in."""
    masks = cell_masks(RADIUS)
    grid = bit_counts(fps[place])
    cells = [
        F.struct(F.lit(place * len(masks) + k).cast("smallint").alias("mask"), grid.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("cell"))
        for k, m in enumerate(masks)
    ]
    return values.select(fps.alias("fps"), "node", F.explode(F.array(*cells)).alias("at")).select("fps", "node", "at.mask", "at.cell")


def _pairs(cells: DataFrame, near: int, radius: int) -> DataFrame:
    """Edges (a, b) between nodes that share a cell, differ in at most ``near`` bits of the
    fingerprint it is made of and in ``radius`` bits of all. Cells are worked through in the
    order of a sorted partition; a long run gives a spanning forest, not its pairs."""
    dealt = cells.repartition("mask", "cell").sortWithinPartitions("mask", "cell", "node")
    per_place = len(cell_masks(RADIUS))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def made(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
            fps, node, mask, cell = (np.concatenate(x) for x in zip(*rows, strict=True))
            own = fps[np.arange(len(fps)), mask // per_place] if len(fps) else fps.ravel()
            a, b = _links(cell, mask, _Values(fps, own, near, radius))
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            rows = [fps.reshape(batch.num_rows, -1), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 4))]
            same = (rows[2] == rows[2][-1]) & (rows[3] == rows[3][-1])
            cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if not cut and held and (held[-1][2][-1], held[-1][3][-1]) == (rows[2][0], rows[3][0]):
                held.append(rows)  # the last cell goes on through the whole batch
                continue
            if held or cut:
                yield made([*held, [x[:cut] for x in rows]])
            held = [[x[cut:] for x in rows]]
        if held:
            yield made(held)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between the distinct ``fp`` of ``values`` that connect exactly what pairs of
    at most ``radius`` (up to 4) differing bits connect: such a pair shares some cell."""
    return _pairs(_celled(values.withColumn("node", F.col("fp")), F.array("fp"), 0), radius, radius)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each of ``SKETCH`` permutations."""
    out = np.full(SKETCH, np.uint64((1 << 64) - 1))
    for lo in range(0, len(hashes), 2048):
        np.minimum(out, ((hashes[lo : lo + 2048, None] ^ _SALTS) * _ODDS).min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key per band; equal keys of different bands are as unlikely as equal hashes."""
    return mixed((least[: BANDS * BAND] * _JOIN[: BANDS * BAND]).reshape(BANDS, BAND).sum(axis=1, dtype=np.uint64) + _SALTS[:BANDS]).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """One bit of each least hash: two sketches differ in a share of (1 - J) / 2 on the average."""
    return np.packbits((mixed(least) >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def sketch_bits(jaccard: float) -> int:
    """Bits in which sketches of sets of that similarity differ at most, but for chances under
    one in 10 million."""
    p = (1 - jaccard) / 2
    return math.ceil(SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, node, keys, sketch, fp) of every row; texts without words are node 0 and have no keys.
    ``fp`` is the fingerprint that ``fingerprints`` gives."""

    @lean
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            nodes, keys, sketches, fps = batch.column(1).to_pylist(), [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                hashes = shingle_hashes(text, shingle)
                fps.append(majority(hashes))
                if len(hashes):
                    least = minima(hashes)
                    keys.append(band_keys(least))
                    sketches.append(sketch(least))
                else:
                    nodes[i] = 0
                    keys.append([])
                    sketches.append([])
            longs = pa.list_(pa.int64())
            columns = [pa.array(nodes, pa.int64()), pa.array(keys, longs), pa.array(sketches, longs), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = ["id", "node", "keys", "sketch", "fp"]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    longs = T.ArrayType(T.LongType())
    kinds = [rows.schema["id"].dataType, T.LongType(), longs, longs, T.LongType()]
    return rows.mapInArrow(made, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns (key, node, sketch) of whole cells out of batches sorted by key."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        rows.append(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if not cut and held and held[-1][0][-1] == rows[0][0]:
            held.append(rows)
            continue
        if held or cut:
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in rows], strict=True)]
        held = [[x[cut:] for x in rows]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _grid_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates among the nodes (node, fp) by their fingerprints. Nodes of one fingerprint
    form a chain, and the first nodes of fingerprints that ``links`` finds on the grid of bit counts
    form a pair."""
    own = Window.partitionBy("fp").orderBy("node")
    chains = nodes.select(F.lag("node").over(own).alias("a"), F.col("node").alias("b")).where("a IS NOT NULL")
    firsts = staged(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    left, right = (firsts.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node")) for c in ("a", "b"))
    met = links(firsts.select("fp")).join(left, "a").join(right, "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    return chains.unionByName(met)


def _candidates(nodes: DataFrame, bits: int) -> DataFrame:
    """(a, b, bits, long, key): pairs of nodes (node, keys, sketch) that share a cell and whose
    sketches differ in at most ``bits`` bits. Short cells give all pairs. Long ones give one
    partner for each node, in an order of their own, and (node, null, null, true, key of the cell)
    for each node."""
    cells = nodes.select(F.explode("keys").alias("key"), "node", "sketch")
    dealt = cells.repartition("key").sortWithinPartitions("key", "node")
    names = ["a", "b", "bits", "long", "key"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, marks in _cells_of(batches):
            marks = marks.view(np.uint64)

            def told(x: np.ndarray, y: np.ndarray, long: bool, node=node, marks=marks) -> Iterator[pa.RecordBatch]:
                apart = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1)
                near = apart <= bits
                a, b = node[x[near]], node[y[near]]
                columns = [np.minimum(a, b), np.maximum(a, b), apart[near].astype(np.int32), np.full(len(a), long)]
                if len(a):
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.nulls(len(a), pa.int64())], names)

            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lengths = np.diff(np.append(starts, len(key)))
            place = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths))
            run = key[place]
            for step in range(1, SHORT_RUN):
                same = run[step:] == run[:-step]
                if not same.any():
                    break
                yield from told(place[:-step][same], place[step:][same], False)
            for at, n in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN], strict=True):
                order = at + np.argsort(mixed((node[at : at + n] ^ key[at]).view(np.uint64)), kind="stable")
                yield from told(order[:-1], order[1:], True)
                none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(node[at : at + n]), *none, pa.array(np.ones(n, bool)), pa.array(key[at : at + n])], names)

    return dealt.mapInArrow(run, "a bigint, b bigint, bits int, long boolean, key bigint")


def _united(node: np.ndarray, part: np.ndarray, root: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], bits: int, jaccard: float) -> list[tuple[int, int]]:
    """Links between rows of different roots that join what was not joined yet, so at most one for
    each row: each row's set against all sets left that its sketch allows, at once. Rows of two
    parts are compared across the parts only."""
    n = len(node)
    group = np.unique(root, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.append(0, np.cumsum(size))
    seen = np.zeros(int(flat.max()) + 1, bool)
    across = part[0] != part[-1]
    out = []
    for x in range(n - 1):
        y = np.arange(x + 1, n)
        y = y[(group[y] != group[x]) & (np.minimum(size[y], size[x]) >= jaccard * np.maximum(size[y], size[x]))]
        if across:
            y = y[part[y] != part[x]]
        y = y[np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1) <= bits]
        if not len(y):
            continue
        seen[flat[at[x] : at[x + 1]]] = True
        both = np.add.reduceat(seen[np.concatenate([flat[at[k] : at[k + 1]] for k in y])], np.append(0, np.cumsum(size[y])[:-1]), dtype=np.int64)
        seen[flat[at[x] : at[x + 1]]] = False
        for k in y[both >= jaccard * (size[x] + size[y] - both)]:
            if group[k] != group[x]:
                out.append((node[x], node[k]))
                group[group == group[k]] = group[x]
    return out


def _within_cells(cells: DataFrame, members: DataFrame, bits: int, jaccard: float, block_bytes: int) -> DataFrame:
    """Edges (a, b) that connect what links of that similarity connect inside the cells (key, node)
    beyond the roots of ``members`` (node, root, sketch, set).

    A cell is cut into blocks of about ``block_bytes`` of sets; each block, and each two blocks of a
    cell, is a group of its own, whose rows bring their sets along. What leaves a group is at most
    one edge for each of its rows. Cells whose members have one root already have nothing to add."""
    told = cells.join(members.select("node", "root", F.octet_length("set").alias("bytes")), "node")
    mixed_cells = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    told = told.join(mixed_cells, "key", "left_semi")
    inside = Window.partitionBy("key")
    upto = F.sum("bytes").over(inside.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    told = told.select("key", "node", F.floor(upto / F.lit(block_bytes)).cast("int").alias("part"))
    told = told.withColumn("last", F.max("part").over(inside)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    met = told.select("key", "node", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).join(members, "node")
    names = ["a", "b"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def made() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            node, part, root = (rows.column(c).to_numpy() for c in ("node", "part", "root"))
            marks = np.array(rows.column("sketch").to_pylist(), np.int64).view(np.uint64)
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("set")]
            edges = _united(node, part, root, marks, sets, bits, jaccard) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j = (batch.column(c).to_numpy() for c in (0, 1, 2))
            first = np.append(0, np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1)
            for lo, hi in zip(first, np.append(first[1:], batch.num_rows), strict=True):
                if held and now != (key[lo], i[lo], j[lo]):
                    yield made()
                    held.clear()
                now = (key[lo], i[lo], j[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield made()

    dealt = met.select("key", "i", "j", "part", "node", "root", "sketch", "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "part", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, set): the distinct shingle hashes of the nodes (node, first), whose text the row of
    id ``first`` has."""

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            made = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["node", "set"])

    texts = docs.select(F.col(id_col).alias("own"), F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    nodes = nodes.hint("merge")
    texts = texts.join(nodes, (texts["node"] == nodes["node"]) & texts["own"].eqNullSafe(nodes["first"]), "left_semi").select("node", "text")
    return staged(texts.mapInArrow(sets, "node bigint, set binary").groupBy("node").agg(F.first("set").alias("set")), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, shingle: int, jaccard: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have that Jaccard similarity. Only texts of nodes in
    a pair become sets; ``firsts`` (node, first) names one document of each node."""

    @lean
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= jaccard * max(len(x), len(y)) else 0
                good.append(both >= jaccard * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(firsts, "node")
    made = _sets(ends, docs, id_col, text_col, shingle)
    left = made.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge")
    right = made.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint bigint, component_id) of every row: component_id is the least id of the
    rows that links lead to. Two rows link when their fingerprints differ in at most ``radius``
    bits.

    Equal fingerprints are one node, so copies cost nothing beyond one grouped minimum. Null
    and blank texts have fingerprint 0 and link like any other; rows with a null id take part
    and have no say in the minimum; repeated rows stay; an empty table gives no rows."""
    rows = staged(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), shingle)[0].alias("node")), "fingerprints")
    out = _classes(rows, links(rows.select(F.col("node").alias("fp")).distinct(), radius))
    return out.select(F.col("id").alias(id_col), F.col("node").alias("fingerprint"), "component_id")


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int, jaccard: float, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, node), a node for each text, and edges (a, b) that connect what links of that
    similarity connect. Candidates come from the fingerprints on their grid, which hold every pair of
    up to ``RADIUS`` bits, and from bands of least hashes for the pairs that are further apart."""
    rows = staged(_keyed(docs, id_col, text_col, shingle), "least-hashes")
    nodes = rows.groupBy("node").agg(F.min("id").alias("first"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"))
    nodes = staged(nodes, "nodes")
    bits, firsts = sketch_bits(jaccard), nodes.select("node", "first")
    found = staged(_candidates(nodes.select("node", "keys", "sketch"), bits), "candidates")
    pairs = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.min("bits").alias("bits"), F.min("long").alias("long"))
    rank = F.row_number().over(Window.partitionBy("a", "long").orderBy("bits", "b"))
    pairs = pairs.withColumn("rank", rank).where(~F.col("long") | (F.col("rank") <= PARTNERS)).select("a", "b")
    worded = nodes.where(F.size("keys") > 0).select("node", "fp")
    pairs = staged(pairs.unionByName(_grid_pairs(worded)).distinct(), "pairs")
    edges = staged(_verified(pairs, docs, firsts, id_col, text_col, shingle, jaccard), "links")
    crowd = found.where("b IS NULL").select("key", F.col("a").alias("node"))
    if not crowd.isEmpty():
        who = staged(crowd.select("node").distinct().join(nodes.select("node", "first", "sketch"), "node"), "crowd")
        members = who.join(components(edges), "node", "left").select("node", "sketch", F.coalesce("root", "node").alias("root"))
        members = staged(members.join(_sets(who.select("node", "first"), docs, id_col, text_col, shingle), "node"), "members")
        edges = edges.unionByName(staged(_within_cells(crowd, members, bits, jaccard, block_bytes), "links"))
    return rows.select("id", "node"), edges


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, jaccard: float = SIMILARITY, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(id, component_id) like ``near_duplicates``, for a lower similarity than one fingerprint
    and few bits can tell: two texts link when their sets of shingles have a Jaccard similarity of
    ``jaccard`` or more. Fingerprints on the grid of ``links``, and bands of least hashes for what
    few bits cannot tell, name candidates; the sets themselves decide.

    Each text of a long cell is compared with a few others first; what stays in different groups
    then is compared inside the cell, in blocks, and only edges that join groups come out. Texts
    without words form one group."""
    rows, edges = _linked(docs, id_col, text_col, shingle, jaccard, block_bytes)
    return _classes(rows, edges).select(F.col("id").alias(id_col), "component_id")


def _classes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, node, component_id) of the rows (id, node)."""
    nodes = rows.groupBy("node").agg(F.min("id").alias("least")).join(components(edges), "node", "left")
    nodes = nodes.select("node", "least", F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(nodes.join(least, "root").select("node", "component_id"), "node").select("id", "node", "component_id")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, jaccard: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of each group of similar texts: the one with the least id (null ids last), then the
    least hash of its text. Rows are judged by id and text together, so rows of one id with
    different texts are judged each by itself, and of equal rows one stays. A document that is
    like no other stays, whatever its id."""
    rows, edges = _linked(docs, id_col, text_col, shingle, jaccard, block_bytes)
    copies = rows.groupBy("node", "id").agg(F.count("*").alias("n"))
    copies = staged(copies.join(components(edges), "node", "left").select("node", "id", "n", F.coalesce("root", "node").alias("root")), "copies")
    best = copies.groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "node")).alias("best"))
    first = (F.col("node") == F.col("best.node")) & F.col("id").eqNullSafe(F.col("best.id"))
    copies = staged(copies.join(best, "root").select("node", "id", "n", first.alias("first")), "judged")

    node, own, n = free_name(docs.columns, "_node"), free_name(docs.columns, "_own"), free_name(docs.columns, "_n")
    blank = F.coalesce(F.length(F.btrim(F.col(text_col), F.lit(BLANKS))), F.lit(0)) == 0
    known = docs.withColumn(node, F.when(blank, F.lit(0)).otherwise(F.xxhash64(text_col)).cast("bigint"))
    listed = copies.select(F.col("node").alias(f"{node}2"), F.col("id").alias(own), F.col("n").alias(n), "first")
    same = (F.col(node) == F.col(f"{node}2")) & F.col(id_col).eqNullSafe(F.col(own))
    out = known.join(listed.where(~F.col("first") | (F.col(n) > 1)), same, "left_anti").select(*docs.columns)
    repeated = listed.where(F.col("first") & (F.col(n) > 1)).select(f"{node}2", own)
    if not repeated.isEmpty():
        place = Window.partitionBy(node, id_col).orderBy(F.lit(0))
        rest = known.join(repeated, same, "left_semi").withColumn(n, F.row_number().over(place)).where(F.col(n) == 1)
        out = out.unionByName(rest.select(*docs.columns))
    return out

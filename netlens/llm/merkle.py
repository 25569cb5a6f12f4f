"""Merkle manifest of a table: a tree per source, a tree over the sources, and a proof per row.

Rows in order are cut into aligned blocks of ``fanout ** levels`` leaves. Each block hashes its own
subtree. Then blocks trade roots as in a butterfly: in round r, groups of ``fanout`` blocks that lie
``fanout ** r`` apart show each other the roots of their subtrees, and every member hashes the
common ancestor for itself. After the last round each block knows the tree's root and all siblings
above it, and nothing has to be sent down again."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.shared import staged

FANOUT = 3
#: Levels of the tree inside one block: 3 ** 7 = 2187 leaves.
LEVELS = 7

LEAVES = "id bigint, tree string, leaf binary, changed binary"
PROVED = "id bigint, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
_LOW = (1 << 33) - 1


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its text, or a dash."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, fields: list[str], tree: str, order: str, changes: dict[str, Column] | None = None) -> DataFrame:
    """(id, tree, leaf, changed): the digest of each row's ``fields``, and of the same fields with
    some of them replaced, as they are found later."""
    changes = changes or {}
    return docs.select(
        F.col(order).cast("bigint").alias("id"),
        F.col(tree).cast("string").alias("tree"),
        F.unhex(leaf([F.col(f) for f in fields])).alias("leaf"),
        F.unhex(leaf([changes.get(f, F.col(f)) for f in fields])).alias("changed"),
    )


def placed(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The rows with their place in the order of ``keys`` within their tree (``pos``), the rows of
    the tree (``n``) and the block (``block``). Equal rows are spread by where they were read, so
    no tree and no row repeated many times has to fit one partition."""
    order = ["tree", *keys, "_read"]
    spread = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = staged(spread.drop("_read").withColumn("_at", F.monotonically_increasing_id()), "leaves")
    numbered = numbered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_LOW)))
    runs = numbered.groupBy(F.col("tree").alias("_tree"), F.col("_part").alias("_run")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_tree").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).withColumn("n", F.sum("_rows").over(Window.partitionBy("_tree")))
    found = numbered.join(runs, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_run")))
    found = found.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return found.select(*rows.columns, "n", "pos", F.floor(F.col("pos") / F.lit(size)).cast("bigint").alias("block"))


def _blocks(batches: Iterator[pa.RecordBatch], mark) -> Iterator[pa.Table]:
    """The rows of each block; ``mark`` says which rows of a batch begin one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = np.flatnonzero(mark(batch)).tolist()
        for lo, hi in zip([0, *first], [*first, batch.num_rows], strict=True):
            if lo in first[:1] or (first and lo >= first[0]):
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _up(nodes: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a block level by level, up to its own root: at most ``levels`` above the
    leaves, less if the whole tree of ``n`` leaves ends before."""
    made = [nodes]
    for _ in range(levels):
        if n <= 1:
            break
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        made.append(nodes)
        n = -(-n // fanout)
    return made


def _roots(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, n, block, hash): the root of each block."""
    size = fanout**levels

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, lambda b: b.column(3).to_numpy() % size == 0):
            first = block.slice(0, 1)
            nodes = [x.hex() for x in block.column(4).to_pylist()]
            top = _up(nodes, first.column(1)[0].as_py(), fanout, levels)[-1]
            yield pa.RecordBatch.from_arrays([*(first.column(i).combine_chunks() for i in range(3)), pa.array(top)], ["tree", "n", "block", "hash"])

    spread = rows.select("tree", "n", "block", "pos", "leaf").repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return spread.mapInArrow(rooted, "tree string, n bigint, block bigint, hash string")


def _round(state: DataFrame, span: int, fanout: int) -> DataFrame:
    """One exchange between blocks ``span`` apart. A group has at most ``fanout`` members. Where
    the last subtree of a tree is missing members that later partners will look for, a member
    stands in for each of them; stand-ins carry the right roots and no path."""
    state = state.withColumn("group", F.floor(F.col("block") / F.lit(span * fanout)).cast("bigint")).withColumn("column", F.col("block") % span)
    child = F.floor(F.col("block") / F.lit(span)).cast("bigint") % fanout
    member = F.struct(child.cast("int").alias("child"), "hash", "path")
    met = state.groupBy("tree", "blocks", "group", "column").agg(F.array_sort(F.collect_list(member)).alias("met"))
    hashes = F.transform("met", lambda m: m["hash"])
    parent = F.sha2(F.array_join(hashes, ""), 256)

    def after(j: int) -> Column:
        sides = F.array(F.array_join(F.slice(hashes, 1, j), ""), F.array_join(F.slice(hashes, j + 2, fanout), ""))
        path = F.when(F.size("met") > j, F.concat(F.get("met", F.lit(j))["path"], sides)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(j).alias("child"), parent.alias("hash"), path.alias("path"))

    unfinished = F.col("blocks") > span
    out = met.select("tree", "blocks", "group", "column", F.explode(F.when(unfinished, F.array(*[after(j) for j in range(fanout)])).otherwise(F.col("met"))).alias("m"))
    block = F.col("group") * (span * fanout) + F.col("m.child") * span + F.col("column")
    return out.select("tree", "blocks", block.alias("block"), "m.hash", "m.path")


def butterfly(roots: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(tree, block, hash, path): for every block the root of its tree and, level by level above
    the block, the digests left and right of its ancestor. As many rounds as the longest tree has
    levels above its blocks; one shuffle each, of one row per block and up to two stand-ins."""
    size = fanout**levels
    start = staged(roots.select("tree", F.ceil(F.col("n") / F.lit(size)).cast("bigint").alias("blocks"), "block", "hash", F.array().cast("array<string>").alias("path")), "blocks")
    most = start.agg(F.max("blocks")).first()[0] or 0
    state, span = start, 1
    while span < most:
        state = _round(state, span, fanout)
        span *= fanout
    return state.where("block < blocks").select("tree", "block", "hash", "path")


def _sides(nodes: list[str], fanout: int) -> list[tuple[str, str]]:
    """What stands before and after each node in its run."""
    out = []
    for lo in range(0, len(nodes), fanout):
        run = nodes[lo : lo + fanout]
        out += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
    return out


def _proofs(rows: DataFrame, upper: DataFrame, fanout: int, levels: int, schema: str, made) -> DataFrame:
    """``made`` of every row: its place in its block, the sides of all nodes of the block level by
    level, and the row that ``upper`` has for the block (path, subroot, root)."""

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = schema.replace(",", " ").split()[::2], [pa.int64() if k == "bigint" else pa.list_(pa.string()) if k.startswith("array") else pa.string() for k in schema.replace(",", " ").split()[1::2]]
        for block in _blocks(batches, lambda b: b.column(3).to_numpy(zero_copy_only=False) < 0):
            above = block.slice(0, 1).to_pylist()[0]
            body = block.slice(1)
            nodes = _up([x.hex() for x in body.column(5).to_pylist()], above["n"], fanout, levels)
            sides = [_sides(level, fanout) for level in nodes[:-1]]
            out = made(body.select(["id", "tree", "leaf", "changed"]).to_pylist(), sides, above, fanout)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    none = F.lit(None)
    heads = upper.select(
        "tree", "n", "block", F.lit(-1).cast("bigint").alias("pos"), none.cast("bigint").alias("id"), none.cast("binary").alias("leaf"),
        none.cast("binary").alias("changed"), "path", "subroot", "root",
    )
    body = rows.select("tree", "n", "block", "pos", "id", "leaf", "changed", none.cast("array<string>").alias("path"), none.cast("string").alias("subroot"), none.cast("string").alias("root"))
    spread = heads.unionByName(body).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return spread.mapInArrow(proved, schema)


def _whole_paths(rows: list[dict], sides: list[list[tuple[str, str]]], above: dict, fanout: int) -> list[tuple]:
    out = []
    for i, row in enumerate(rows):
        path = []
        for level in sides:
            path += level[i]
            i //= fanout
        out.append((row["id"], [*path, *above["path"]], above["subroot"]))
    return out


def _folded(rows: list[dict], sides: list[list[tuple[str, str]]], above: dict, fanout: int) -> list[tuple]:
    """Each row with its proof and the root that its changed leaf leads to."""
    upper = above["path"]
    higher = list(zip(upper[::2], upper[1::2], strict=True))
    tails = ["".join(upper)]  # what is left of the proof above each node, from the block's root down
    for level in reversed(sides):
        tails = [before + after + tails[i // fanout] for i, (before, after) in enumerate(level)]
    out = []
    for i, row in enumerate(rows):
        node, at = row["changed"].hex(), i
        for level in sides:
            before, after = level[at]
            node, at = digest(before + node + after), at // fanout
        for before, after in higher:
            node = digest(before + node + after)
        out.append((row["id"], row["tree"], row["leaf"].hex(), above["subroot"], above["root"], digest(tails[i]), node))
    return out


def _tree(rows: DataFrame, keys: list[str], fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """The placed rows, and (tree, n, block, path, subroot) of their blocks."""
    rows = placed(rows, keys, fanout**levels)
    roots = staged(_roots(rows, fanout, levels), "roots")
    done = butterfly(roots, fanout, levels).select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "path", F.col("hash").alias("subroot"))
    return rows, staged(roots.join(done, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).select("tree", "n", "block", "path", "subroot"), "paths")


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """For each leaf (see ``leaves``): subroot, root, the digest of its proof, and the root that its
    changed leaf folds to with the original siblings (``PROVED``).

    In each tree leaves ascend by id (nulls first; equal ids by leaf); while more than one node
    remains, every ``fanout`` consecutive ones become the digest of their hex digests. What remains
    is the subroot, a lone leaf itself; subroots in the order of their trees (null first) give the
    root in the same way. A proof is all siblings from the leaf up, left to right, without gaps; a
    lone row of a lone tree has the empty proof. Repeated rows are leaves of their own. No rows
    give no rows.

    Ids and digests alone are shuffled: once into order, and twice by block; nothing depends on the
    number of rows of one tree."""
    rows, blocks = _tree(rows.select("id", "tree", "leaf", "changed"), ["id", "leaf"], fanout, levels)
    subroots = blocks.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.unhex("subroot").alias("leaf"), "subroot")
    above, top = _tree(subroots.select("tree", "name", "leaf"), ["name"], fanout, levels)
    # a tree is known by its place among the trees, so that the top is built like any other tree
    names = staged(above.select("name", F.col("pos").alias("id"), "leaf", "n", "block", "pos", "tree").withColumn("changed", F.lit(None).cast("binary")), "names")
    heads = top.withColumn("root", F.col("subroot"))
    paths = _proofs(names, heads, fanout, levels, "id bigint, above array<string>, root string", _whole_paths)
    paths = paths.join(names.select("id", "name"), "id").select("name", "above", "root")
    heads = blocks.join(paths, F.col("tree").eqNullSafe(F.col("name"))).select("tree", "n", "block", F.concat("path", "above").alias("path"), "subroot", "root")
    return _proofs(rows, heads, fanout, levels, PROVED, _folded)

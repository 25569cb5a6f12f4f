"""What several operators need: staged tables, bounded batches, words and hashes of raw bytes."""

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: UTF-8 bytes of text that a Python worker turns into arrays at once.
PIECE_BYTES = 1 << 20

#: Rolling hash: an odd base and its inverse modulo 2**64, and the odd constants of a final mix.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: Of the GNU C library only.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Only a session on one
    machine may lack the setting; it gets a temporary folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = context.getCheckpointDir() or tempfile.mkdtemp(prefix="netlens-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write the rows to the shared folder and read them from there: lineage is cut, a lost
    executor costs a re-read, and a table that is read twice is computed once. The files go
    when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/netlens-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts in ``column`` take at most ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop


def give_back() -> None:
    """Free memory of Arrow and of the C library goes back to the system. Workers live on from
    stage to stage, and what they keep is memory of the executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives back free memory when its task has no more rows."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, one more than it has rows."""
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the offsets of the rows in them; a null has no bytes."""
    offsets = offsets_of(column)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
        offsets = offsets_of(column)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes within the rows: starts, ends, row of each."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    borders = offsets[:-1][offsets[:-1] < n]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    fresh[borders] = inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(fresh)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _table(which: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base (which = 0) or of its inverse (1). Those that a piece needs
    are kept."""
    if len(_powers[which]) >= n:
        return _powers[which][:n]
    factors = np.full(max(n, PIECE_BYTES + 1), (BASE, INVERSE)[which], np.uint64)
    factors[0] = 1
    made = np.cumprod(factors, dtype=np.uint64)
    if len(made) == PIECE_BYTES + 1:
        _powers[which] = made
    return made[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of one running polynomial sum, moved to
    the span's start, so that equal spans get equal hashes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(0, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _table(1, n + 1)[starts] + (ends - starts).astype(np.uint64))


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A to Z lower-cased."""
    return LOWER[data]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

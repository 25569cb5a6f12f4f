"""A quality classifier: a factorisation machine over hashed words, structure and metadata."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.shared import LOWER, bytes_of, give_back, lean, mixed, pieces, span_hashes, spans

#: Buckets of hashed words, bins of each statistic, width of the factors.
WORD_BUCKETS = 1 << 15
BINS = 12
FACTORS = 6
#: Labelled rows that the model is fitted on, at most (expected number; chosen by a hash of the id).
MAX_LABELLED = 8000
EPOCHS = 12

_CLASS = np.zeros(256, np.uint8)  # 0 white space and controls
_CLASS[33:127] = 1  # punctuation, 5 the marks of prose
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("a") : ord("z") + 1] = 4
_CLASS[128:] = 6
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

STATISTICS = (
    "bytes", "words", "word_length", "marks", "symbols", "digits", "capitals", "other_letters",
    "lines", "line_words", "repeated_words", "distinct_words", "repeated_lines", "declared_length",
)
SIZE = WORD_BUCKETS + len(STATISTICS) * BINS


def features(text: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (offsets, feature ids, values): the square roots of the shares of a text's
    hashed words, and one bin of each statistic. ``n_chars`` is metadata: the length that the
    table declares, binned by its ratio to the real one (a null has its own bin)."""
    data, offsets = bytes_of(text)
    n = len(text)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    classes = np.bincount(row * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8)
    starts, ends, rows = spans(~_SPACE[data], offsets)
    low = LOWER[data]
    hashes = span_hashes(low, starts, ends)
    n_words = np.bincount(rows, minlength=n)
    line_start, line_end, line_row = spans(data != 10, offsets)
    lines = span_hashes(data, line_start, line_end)
    n_lines = np.bincount(line_row, minlength=n)

    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    n_again = np.bincount(rows[again], minlength=n)
    distinct_lines = np.bincount(_unique(line_row, lines >> np.uint64(32))[0], minlength=n)
    word_row, bucket, count = _unique(rows, hashes % np.uint64(WORD_BUCKETS))
    distinct = np.bincount(word_row, minlength=n)

    chars = size - np.bincount(row[(data & 0xC0) == 0x80], minlength=n)
    declared = n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    some = lambda x: np.maximum(x, 1)
    scaled = np.stack(
        [
            np.log2(size + 1) / 18, np.log2(n_words + 1) / 15, np.bincount(rows, ends - starts, n) / some(n_words) / 16,
            classes[:, 5] / some(size) * 8, classes[:, 1] / some(size) * 8, classes[:, 2] / some(size) * 4, classes[:, 3] / some(size) * 4,
            classes[:, 6] / some(size) * 2, np.log2(n_lines + 1) / 10, np.log2(n_words / some(n_lines) + 1) / 8, n_again / some(n_words) * 4,
            distinct / some(n_words), (n_lines - distinct_lines) / some(n_lines) * 2, np.where(np.isnan(declared), 1.0, np.abs(np.log2((declared.clip(0) + 1) / (chars + 1))) / 4),
        ],
        axis=1,
    )
    bins = np.minimum(np.nan_to_num(scaled, nan=1.0, posinf=1.0).clip(0, 1) * (BINS - 1), BINS - 1).round().astype(np.int64)
    where = WORD_BUCKETS + np.arange(len(STATISTICS)) * BINS + bins

    value = np.sqrt(count / n_words[word_row])
    ids = np.concatenate([bucket.astype(np.int64), where.ravel()])
    owner = np.concatenate([word_row, np.repeat(np.arange(n), len(STATISTICS))])
    values = np.concatenate([value, np.full(where.size, 0.5)])
    order = np.argsort(owner, kind="stable")
    return np.append(0, np.cumsum(np.bincount(owner, minlength=n))), ids[order].astype(np.int32), values[order].astype(np.float32)


def _unique(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs and how often each occurs; keys take at most 32 bits."""
    both, count = np.unique((rows.astype(np.uint64) << np.uint64(32)) | keys.astype(np.uint64), return_counts=True)
    return (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF), count


class Machine:
    """Bias, weights and factors. A row's score is the logistic function of
    bias + sum(w x) + (|sum(v x)|^2 - sum(|v x|^2)) / 2: all pairwise products in linear time."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def margin(self, offsets: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        table = np.concatenate([self.factors, self.weights[:, None]], axis=1)[ids] * values[:, None]
        n = len(offsets) - 1
        owner = np.repeat(np.arange(n), np.diff(offsets))
        sums = np.stack([np.bincount(owner, table[:, k], n) for k in range(table.shape[1])], axis=1)
        squares = np.bincount(owner, np.square(table[:, :-1]).sum(axis=1), n)
        return self.bias + sums[:, -1] + 0.5 * (np.square(sums[:, :-1]).sum(axis=1) - squares)

    def scores(self, offsets: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(offsets, ids, values).clip(-30, 30)))

    @classmethod
    def fitted(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> "Machine":
        """Logistic loss, both classes of equal total weight, AdaGrad over shuffled batches."""
        rng = np.random.default_rng(seed)
        bias, w, v = 0.0, np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, FACTORS))
        seen_w, seen_v, seen_b = np.full(SIZE, 1e-3), np.full((SIZE, FACTORS), 1e-3), 1e-3
        share = np.bincount(labels, minlength=2) / max(1, len(labels))
        weight = np.where(share[labels] > 0, 0.5 / np.maximum(share[labels], 1e-9), 0)
        for _ in range(epochs if len(labels) else 0):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), 64):
                pick = order[lo : lo + 64]
                ids = np.concatenate([rows[i][0] for i in pick])
                x = np.concatenate([rows[i][1] for i in pick]).astype(np.float64)
                owner = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
                vx = v[ids] * x[:, None]
                sums = np.stack([np.bincount(owner, vx[:, k], len(pick)) for k in range(FACTORS)], axis=1)
                z = bias + np.bincount(owner, w[ids] * x, len(pick))
                z += 0.5 * (np.square(sums).sum(axis=1) - np.bincount(owner, np.square(vx).sum(axis=1), len(pick)))
                g = (1 / (1 + np.exp(-z.clip(-30, 30))) - labels[pick]) * weight[pick] / len(pick)
                touched, back = np.unique(ids, return_inverse=True)
                gx = g[owner] * x
                dw = np.bincount(back, gx, len(touched)) + 1e-5 * w[touched]
                dv = np.stack([np.bincount(back, gx * (sums[owner, k] - vx[:, k]), len(touched)) for k in range(FACTORS)], axis=1) + 1e-4 * v[touched]
                seen_w[touched] += dw**2
                seen_v[touched] += dv**2
                seen_b += g.sum() ** 2
                w[touched] -= 0.3 * dw / np.sqrt(seen_w[touched])
                v[touched] -= 0.05 * dv / np.sqrt(seen_v[touched])
                bias -= 0.1 * g.sum() / np.sqrt(seen_b)
        return cls(float(bias), w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Machine:
    """Fit on labelled documents: about ``max_labelled`` of them, chosen by a hash of the id, or
    all where there are fewer. Null labels and ids are left out; an id with several labels takes
    the least. The chosen labels are few and are broadcast; one task fits the model, which has
    a fixed size. Without labels of both classes every score is 1/2."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    share = min(1.0, max_labelled / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col("n_chars").cast("bigint").alias("n_chars"))
    rows = rows.join(F.broadcast(chosen), "_id").select("_id", "text", "n_chars", "_y")

    @lean
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            offsets, ids, values = features(batch.column(1), batch.column(2))
            cut = lambda x: pa.array([x[lo:hi].tobytes() for lo, hi in zip(offsets, offsets[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), cut(ids), cut(values)], ["id", "y", "ids", "xs"])

    def fit(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = list(groups)
        if not groups:
            return
        table = pd.concat(groups, ignore_index=True)
        table = table.sort_values(["id", "ids", "xs"], kind="stable")
        made = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(table["ids"], table["xs"], strict=True)]
        y = table["y"].to_numpy(np.int64)
        if len(np.unique(y)) < 2:
            made, y = [], y[:0]
        machine = Machine.fitted(made, y)
        yield pd.DataFrame([[machine.bias, machine.weights.tobytes(), machine.factors.tobytes()]], columns=["bias", "weights", "factors"])

    table = rows.mapInArrow(sparse, "id bigint, y int, ids binary, xs binary")
    got = table.repartition(1).mapInPandas(fit, "bias double, weights binary, factors binary").collect()
    if not got:
        return Machine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32))
    return Machine(got[0]["bias"], np.frombuffer(got[0]["weights"], np.float32), np.frombuffer(got[0]["factors"], np.float32).reshape(SIZE, FACTORS))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a column ``to``: the chance of label 1, from the whole text and ``n_chars``
    alone. Null texts count as empty, which are scored like any other; a column of that name is
    replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def chance(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True), pa.array(n_chars, pa.float64(), from_pandas=True)], ["t", "n"])
        made = [sent.value.scores(*features(part.column(0), part.column(1))) for part in pieces(iter([batch]), 0)]
        del batch
        give_back()
        return pd.Series(np.concatenate(made) if made else np.zeros(0))

    return docs.withColumn(to, chance(F.col(text_col), F.col("n_chars").cast("double")))


def held_out(id_col: str = "doc_id"):
    """Whether a document's labels are kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))

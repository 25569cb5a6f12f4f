"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.shared import bytes_of, pieces

#: Fixed patterns, in the order of ties, and the least length of what counts of a match.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, as the class has no border inside one
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20}

#: What the models judge: long runs of key characters with a digit and a letter in them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Log-likelihood ratio (nats) per pair of characters, and in all, from which a run is random.
MEAN_RATIO, TOTAL_RATIO = 0.7, 16.0

_CODE = np.full(256, -1, np.int16)
for _k, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"):
    _CODE[_c] = _k
SIZE = 67
TABLE = "spans array<struct<kind: string, start: int, stop: int>>"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, stop) of all fixed patterns: leftmost matches that do not overlap, per
    kind; then those that are too short are dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def _pairs(codes: np.ndarray) -> np.ndarray:
    """How often each pair of neighbouring key characters occurs."""
    both = (codes[:-1] >= 0) & (codes[1:] >= 0)
    return np.bincount(codes[:-1][both].astype(np.int64) * SIZE + codes[1:][both], minlength=SIZE * SIZE)


def _secret(text: str, span: tuple[int, str, int]) -> str:
    start, kind, stop = span
    return ASSIGN.match(text, start)[2] if kind == "assign" else text[start:stop]


class Models:
    """Log-probabilities of the next character given the last, of both models."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        def log(counts: np.ndarray) -> np.ndarray:
            # a character's own frequency stands in where few pairs were seen
            table = counts.reshape(SIZE, SIZE).astype(float)
            single = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * SIZE)
            return np.log((table + 5 * single) / (table.sum(axis=1, keepdims=True) + 5))

        self.ratio = log(random) - log(ordinary)

    def score(self, run: str) -> tuple[float, float]:
        """Log-likelihood ratio in all and per pair."""
        codes = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
        each = self.ratio[codes[:-1], codes[1:]]
        return float(each.sum()), float(each.mean())

    def random(self, run: str) -> bool:
        total, mean = self.score(run)
        return total >= TOTAL_RATIO and mean >= MEAN_RATIO


def candidates(text: str) -> Iterator[re.Match]:
    """Runs that the models judge."""
    return (m for m in CANDIDATE.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0]))


def counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Character pairs of the labelled samples, over all texts: of the values that the fixed
    patterns find (random strings), and of all other key characters (identifiers and words) but
    those that await judgement. Each partition hands on its sums only; their number is fixed by the alphabet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = lambda run: _pairs(_CODE[np.frombuffer(run.encode("utf-8", "surrogatepass"), np.uint8)])
        random, total = np.zeros(SIZE * SIZE, np.int64), np.zeros(SIZE * SIZE, np.int64)
        for batch in pieces(batches, 0):
            data, offsets = bytes_of(batch.column(0))
            codes = _CODE[data]
            total += _pairs(codes)
            borders = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
            across = (codes[borders - 1] >= 0) & (codes[borders] >= 0)  # pairs of two texts
            np.subtract.at(total, codes[borders - 1][across].astype(np.int64) * SIZE + codes[borders][across], 1)
            for text in batch.column(0).to_pylist():
                base = base_spans(text or "")
                for span in base:
                    random += coded(_secret(text, span))
                    total -= coded(text[span[0] : span[2]])
                for m in candidates(text or ""):
                    if not any(s < m.end() and m.start() < e for s, _, e in base):
                        total -= coded(m[0])
        for name, table in (("random", random), ("ordinary", np.maximum(total, 0))):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], ["model", "pair", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "model string, pair int, n bigint")
    out = {"random": np.zeros(SIZE * SIZE, np.int64), "ordinary": np.zeros(SIZE * SIZE, np.int64)}
    for r in rows.groupBy("model", "pair").agg(F.sum("n").alias("n")).collect():
        out[r["model"]][r["pair"]] = r["n"]
    return out["random"], out["ordinary"]


def spans_of(text: str, models: Models | None) -> list[tuple[int, str, int]]:
    """All spans by start, then kind; the models' own never touch a fixed one. (Without any
    labelled random string there are no models.)"""
    base = base_spans(text)
    more = []
    if models is not None:
        for m in candidates(text):
            if not any(s < m.end() and m.start() < e for s, _, e in base) and models.random(m[0]):
                more.append((m.start(), "markov", m.end()))
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: start and end in code points. A null or empty text has no
    spans; rows with equal or null ids are scanned each by itself; no rows give no rows."""
    random, ordinary = counts(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(Models(random, ordinary) if random.sum() else None)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            made = [[{"kind": k, "start": s, "stop": e} for s, k, e in spans_of(t or "", sent.value)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(find, f"id bigint, {TABLE}").withColumnRenamed("id", id_col)


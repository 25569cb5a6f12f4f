"""Benchmark decontamination by a distributed positional inverted index."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.shared import LOWER, PIECE_BYTES, bytes_of, free_name, lean, pieces, span_hashes, spans, staged

WINDOW = 13
#: Words between a window's rarest word and any other, for a proximity match.
SLOP = 20
#: UTF-8 bytes of benchmark text that are searched (and broadcast) at once; more go block by block.
BLOCK_BYTES = 16 << 20
#: UTF-8 bytes of text in a segment of the index, about.
SEGMENT_BYTES = 4 << 20

#: Bytes of a word: digits, small letters, and all of code points from U+0080 on.
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[0x80:] = True

INDEX = (
    "segment string, ids array<bigint>, first array<int>, terms binary, term_starts binary, postings binary"
)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, and the number of words before each row."""
    data, offsets = bytes_of(column)
    data = LOWER[data]
    starts, ends, rows = spans(_WORD[data], offsets)
    hashes, done = np.empty(len(starts), np.uint64), 0
    while done < len(starts):  # some words at a time, for the hashes take many bytes for each of the text's
        lo = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, lo + PIECE_BYTES, side="right")))
        hashes[done:upto] = span_hashes(data[lo : ends[upto - 1]], starts[done:upto] - lo, ends[done:upto] - lo)
        done = upto
    return hashes, np.searchsorted(rows, np.arange(len(column) + 1))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all words of all texts, one row per segment (some MB of text):
    its documents, the position of each one's first word, the distinct words as sorted 64-bit
    hashes, and for each word its sorted positions. A document lies in one segment; null ids
    stay null; a null text has no words. Binary columns hold little-endian numbers."""

    @lean
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, 1, SEGMENT_BYTES):
            hashes, first = words(batch.column(1))
            order = np.argsort(hashes, kind="stable").astype("<u4")
            terms, starts = np.unique(hashes[order], return_index=True)
            row = [
                [f"{part}:{number}"], [batch.column(0).to_pylist()], [first.astype(np.int32)], [terms.astype("<u8").tobytes()],
                [np.append(starts, len(order)).astype("<u4").tobytes()], [order.tobytes()],
            ]
            number += 1
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], INDEX.replace(",", " ").split()[::2])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(index, INDEX)


class Windows:
    """The word windows of some benchmark items: ``terms`` (windows x size, padded with the last
    word), ``size`` words used, ``item`` the row of the item."""

    def __init__(self, texts: list[str | None], window: int):
        hashes, first = words(pa.array(texts, pa.string()))
        terms, size, item = [], [], []
        for i, (lo, hi) in enumerate(zip(first, first[1:], strict=False)):
            n = min(window, hi - lo)
            for at in range(lo, hi - n + 1) if n else ():
                terms.append(np.pad(hashes[at : at + n], (0, window - n), "edge"))
                size.append(n)
                item.append(i)
        self.terms = np.array(terms, np.uint64).reshape(-1, window)
        self.size, self.item = np.array(size, np.int64), np.array(item, np.int64)


class Segment:
    """One row of the index, as arrays."""

    def __init__(self, row: dict):
        self.first = np.asarray(row["first"], np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.starts = np.frombuffer(row["term_starts"], "<u4").astype(np.int64)
        self.postings = np.frombuffer(row["postings"], "<u4").astype(np.int64)
        #: (word, position) as one sorted number
        self.pairs = np.repeat(np.arange(len(self.terms)) << 32, np.diff(self.starts)) | self.postings

    def lookup(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose words occur here: their rows, their words' numbers, and the
        places within the window, rarest word first."""
        if not len(self.terms) or not len(windows.terms):
            return np.zeros(0, np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64)
        at = np.minimum(np.searchsorted(self.terms, windows.terms), len(self.terms) - 1)
        live = np.flatnonzero((self.terms[at] == windows.terms).all(axis=1))
        at = at[live]
        counts = np.diff(self.starts)[at]
        counts[np.arange(at.shape[1]) >= windows.size[live, None]] = 1 << 40  # padding goes last
        return live, at, np.argsort(counts, axis=1, kind="stable")

    def occurrences(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of each word of ``term``: index into ``term``, position."""
        lo, n = self.starts[term], self.starts[term + 1] - self.starts[term]
        which = np.repeat(np.arange(len(term)), n)
        return which, self.postings[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]]

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Exact occurrences: window, position of its first word. Starts from the postings of
        each window's rarest word and intersects them with the next rarest, moved by the
        distance of the two words, until all words are used."""
        live, at, order = self.lookup(windows)
        rows = np.arange(len(live))
        which, start = self.occurrences(at[rows, order[:, 0]]) if len(live) else (rows, rows)
        start = start - order[which, 0]
        for step in range(1, windows.terms.shape[1]):
            if not len(which):
                break
            place = order[which, step]
            key = (at[which, place] << 32) | (start + place)
            found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            fits = (self.pairs[found] == key) & (start >= 0)
            fits |= step >= windows.size[live[which]]
            which, start = which[fits], start[fits]
        whole = (start >= 0) & (self.document(start) == self.document(start + windows.size[live[which]] - 1)) if len(which) else np.zeros(0, bool)
        return live[which[whole]], start[whole]

    def near(self, windows: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Proximity matches: window, position of its rarest word, where every other word of the
        window stands at most ``slop`` words away in the same document, in any order."""
        live, at, order = self.lookup(windows)
        rows = np.arange(len(live))
        which, start = self.occurrences(at[rows, order[:, 0]]) if len(live) else (rows, rows)
        for step in range(1, windows.terms.shape[1]):
            if not len(which):
                break
            term = at[which, order[which, step]]
            doc = self.document(start)
            lo = np.maximum(start - slop, self.first[doc])
            hi = np.minimum(start + slop, self.first[doc + 1] - 1)
            found = np.searchsorted(self.pairs, (term << 32) | lo)
            inside = found < len(self.pairs)
            inside[inside] = self.pairs[found[inside]] <= ((term[inside] << 32) | hi[inside])
            inside |= step >= windows.size[live[which]]
            which, start = which[inside], start[inside]
        return live[which], start


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of a bounded size, each collected by itself."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-2 * total // BLOCK_BYTES))
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        got = part.orderBy(F.col("item").cast("string"), "text").collect()
        yield [r["item"] for r in got], [r["text"] for r in got]


SPANS = "segment string, row int, item string, kind string, start int, length int"


def search(
    index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int | None = SLOP
) -> DataFrame:
    """Matches of the benchmark's windows (``window`` consecutive words of an item, or all where
    it has fewer): segment and row of the document, item as a string, kind ``phrase`` (start
    and length in words of each exact occurrence) or ``near`` (a proximity match without exact
    occurrence of that window there; none if ``slop`` is null).

    The index is read once per block of the benchmark; a benchmark of any size is searched
    whole, and only one bounded block is ever sent to the executors. Words are compared by
    64-bit hashes. Items without words, null texts and empty tables match nothing; items with
    equal texts match alike; a null item id is the item ``null``."""
    context, found = index.sparkSession.sparkContext, None
    for items, texts in _blocks(benchmark, item_col, text_col):
        sent = context.broadcast((["null" if i is None else str(i) for i in items], Windows(texts, window)))

        @lean
        def hits(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, windows = sent.value
            for batch in batches:
                for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    segment = Segment(row)
                    which, start = segment.phrases(windows)
                    kinds = [("phrase", which, start, windows.size[which])]
                    if slop is not None:
                        other, about = segment.near(windows, slop)
                        size = len(segment.first)
                        fresh = ~np.isin(other * size + segment.document(about), which * size + segment.document(start))
                        kinds.append(("near", other[fresh], about[fresh], np.ones(int(fresh.sum()), np.int64)))
                    for kind, w, at, n in kinds:
                        doc = segment.document(at)
                        columns = [
                            pa.array([row["segment"]] * len(w), pa.string()), pa.array(doc, pa.int32()), pa.array([names[i] for i in windows.item[w]], pa.string()),
                            pa.array([kind] * len(w), pa.string()), pa.array(at - segment.first[doc], pa.int32()), pa.array(n, pa.int32()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, SPANS.replace(",", " ").split()[::2])

        part = index.select("segment", "first", "terms", "term_starts", "postings").mapInArrow(hits, SPANS)
        found = part if found is None else found.unionByName(part)
    return found


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit (words inside any exact occurrence),
    n_items, items_sha256 (digest of the sorted item ids), contaminated (a hit, and at least
    one word in ``share`` hit). Null texts have no words and are never contaminated; rows with
    equal or null ids are judged each by itself; an empty table gives no rows."""
    index = staged(build_index(docs, id_col, text_col), "index")
    spans_found = search(index, benchmark, window=window, slop=None).where("kind = 'phrase'")

    per_item = spans_found.groupBy("segment", "row", "item").agg(F.collect_set(F.struct("start", "length")).alias("at"))
    per_doc = per_item.groupBy("segment", "row").agg(
        F.array_sort(F.flatten(F.collect_list("at"))).alias("at"), F.array_sort(F.collect_set("item")).alias("items")
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))

    def add(done, span):
        end = span["start"] + span["length"]
        fresh = F.greatest(end, done["end"]) - F.greatest(span["start"], done["end"])
        return F.struct((done["n"] + F.when(end > done["end"], fresh).otherwise(0)).cast("bigint").alias("n"), F.greatest(end, done["end"]).alias("end"))

    hit = per_doc.select(
        "segment", "row", F.aggregate("at", zero, add)["n"].alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    number = F.posexplode("ids").alias("row", "id")
    rows = index.select("segment", "first", number).select(
        "segment", "row", "id", (F.col("first")[F.col("row") + 1] - F.col("first")[F.col("row")]).cast("bigint").alias("n_words")
    )
    return rows.join(hit, ["segment", "row"], "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.expr(f"coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= n_words").alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated. What a row holds decides, not its id: rows
    are judged by their text (by a 64-bit hash of it when the verdict is brought back), so null
    and repeated ids are like any others."""
    name = free_name(docs.columns, "_text")
    texts = docs.select(F.xxhash64(text_col).alias(name), F.col(text_col).alias("text"))
    bad = judged(texts, benchmark, name, "text", **options).where("contaminated").select(name).distinct()
    return docs.join(bad, F.xxhash64(docs[text_col]) == bad[name], "left_anti")

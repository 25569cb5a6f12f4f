"""Line dedup by content-defined chunks of lines."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from netlens.llm.shared import bytes_of, free_name, lean, mixed, pieces, span_hashes, spans, staged

#: A border stands before about one line in so many.
SPREAD = 3
#: A run of lines of so many words is a chunk wherever it starts and wherever it ends.
LONG_RUN = 50

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xD1342543DE82EF95)


class Chunks:
    """The chunks of some texts, as arrays: text row, place in the text, first and last byte
    (the last line break is not part of it), hash of the bytes.

    Lines end at each line feed; empty ones are not counted. There are two kinds of chunks.
    A border stands where the rolling hash of a line and the one before it falls below a share
    of its range, so that borders depend on two lines only and an insertion above moves none of
    those below; what lies between borders is a chunk if it has two or more lines. And as a
    passage of a few lines may hold no two borders, the shortest run of lines with ``long_run``
    words that starts at a line, and the one that ends at it, are chunks too: these meet every
    line of every passage of that many words, whatever stands around it. A run may be one
    line. Chunks overlap; blank ones are not returned."""

    def __init__(self, column: pa.Array, spread: int = SPREAD, long_run: int = LONG_RUN):
        data, offsets = bytes_of(column)
        self.data, self.base = data, offsets
        inside = data != 10
        starts, ends, rows = spans(inside, offsets)  # lines with any byte; empty lines join what is before them
        words = spans(~_SPACE[data], offsets)[0]
        n_words = np.searchsorted(words, ends) - np.searchsorted(words, starts)
        total = np.cumsum(np.append(0, n_words))
        hashes = span_hashes(data, starts, ends)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = rows[1:] != rows[:-1]
        before = np.zeros(len(starts), np.uint64)
        before[1:] = hashes[:-1]
        rolling = mixed(hashes * _STEP + np.where(fresh, np.uint64(0), before))
        border = np.flatnonzero(fresh | (rolling < np.uint64((1 << 64) // spread)))
        end = np.append(border, len(starts))[1:] - 1
        used = (end > border) & (total[end + 1] > total[border])
        runs = self._runs(rows, total, long_run)
        first, last = (np.concatenate(x) for x in zip((border[used], end[used]), *runs, strict=True))
        order = np.unique(first * (len(starts) + 1) + last)  # by first line, then last
        first, last = order // (len(starts) + 1), order % (len(starts) + 1)
        top = np.searchsorted(rows, rows)  # the first line of each line's text
        self.row, self.start, self.stop = rows[first], starts[first], ends[last]
        self.first, self.last = first - top[first], last - top[first]
        self.hash = span_hashes(data, self.start, self.stop).view(np.int64)
        self.ordinal = np.arange(len(first)) - np.searchsorted(self.row, self.row)

    @staticmethod
    def _runs(rows: np.ndarray, total: np.ndarray, long_run: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """First and last lines of the shortest long runs from each line on and up to each line."""
        here = np.arange(len(rows))
        to = np.searchsorted(total, total[:-1] + long_run, side="left") - 1
        since = np.searchsorted(total, total[1:] - long_run, side="right") - 1
        onward = to < len(rows)
        onward[onward] = rows[to[onward]] == rows[onward]
        back = since >= 0
        back[back] = rows[since[back]] == rows[back]
        return [(here[onward], to[onward]), (since[back], here[back])]

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.stop[k]].tobytes()


def _keys(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart, never null: id and hash of the text."""
    return [
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("_key"),
        F.xxhash64(F.col(text_col)).alias("_text_hash"),
    ]


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, spread: int = SPREAD, long_run: int = LONG_RUN) -> DataFrame:
    """(_key, _text_hash, ordinal, lo, hi, hash) of every chunk; lo and hi are its first and last line."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            found = Chunks(batch.column(2), spread, long_run)
            at = pa.array(found.row)
            numbers = [pa.array(x.astype(np.int32)) for x in (found.ordinal, found.first, found.last)]
            columns = [batch.column(0).take(at), batch.column(1).take(at), *numbers, pa.array(found.hash)]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_text_hash", "ordinal", "lo", "hi", "hash"])

    schema = "_key bigint, _text_hash bigint, ordinal int, lo int, hi int, hash bigint"
    return docs.select(*_keys(id_col, text_col), text_col).mapInArrow(cut, schema)


def cover(lo: np.ndarray, hi: np.ndarray) -> list[int]:
    """Places of as few of the spans (in order of ``lo``, ends included) as hold every line that
    any of them holds."""
    chosen, reach, best = [], -1, -1
    for k, (start, end) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        if start > reach + 1 and best >= 0:  # all that could follow without a gap were seen
            chosen.append(best)
            reach, best = int(hi[best]), -1
        if start > reach + 1:
            reach = start - 1
        if end > reach and (best < 0 or end > hi[best]):
            best = k
    if best >= 0:
        chosen.append(best)
    return chosen


def _covers(repeats: DataFrame) -> DataFrame:
    """Per document of (_key, _text_hash, marks): what to look at of the chunks that an earlier
    place has (a cover of their lines), and those it has first itself."""

    @lean
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.column(2)
            values, bounds = marks.flatten(), np.append(0, np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False)))
            lo, hi, first = (values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 4))
            row, at = [], []
            for r in range(batch.num_rows):
                own = np.arange(bounds[r], bounds[r + 1])
                later = own[~first[own]]
                use = np.concatenate([later[np.array(cover(lo[later], hi[later]), np.int64)], own[first[own]]])
                row.append(np.full(len(use), r))
                at.append(use)
            row, at = (pa.array(np.concatenate(x)) for x in (row, at))
            columns = [batch.column(0).take(row), batch.column(1).take(row), *(values.field(k).take(at) for k in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_text_hash", "ordinal", "hash", "first"])

    return repeats.mapInArrow(choose, "_key bigint, _text_hash bigint, ordinal int, hash bigint, first boolean")


def _bodies(marked: DataFrame, text_at: int, spread: int, long_run: int) -> DataFrame:
    """The bytes of the chunks that the last columns (_key, _text_hash, marks) name."""
    names = ["_key", "_text_hash", "ordinal", "first", "hash", "body"]

    @lean
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_at):
            found = Chunks(batch.column(text_at), spread, long_run)
            key, text_hash, marks = batch.columns[-3:]
            marks = [{m["ordinal"]: m["first"] for m in row or ()} for row in marks.to_pylist()]
            hit = [k for k, (r, o) in enumerate(zip(found.row.tolist(), found.ordinal.tolist(), strict=True)) if o in marks[r]]
            at = pa.array(found.row[hit])
            first = pa.array([marks[found.row[k]][int(found.ordinal[k])] for k in hit], pa.bool_())
            body = pa.array([found.text(k) for k in hit], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [key.take(at), text_hash.take(at), pa.array(found.ordinal[hit].astype(np.int32)), first, pa.array(found.hash[hit]), body], names
            )

    return marked.mapInArrow(take, "_key bigint, _text_hash bigint, ordinal int, first boolean, hash bigint, body binary")


def _rebuilt(texts: pa.Array, gone: list, copies: list, spread: int, long_run: int) -> tuple[list, list]:
    """New texts and numbers of stretches cut, of rows that lose some."""
    found = Chunks(texts, spread, long_run)
    bounds = np.searchsorted(found.row, np.arange(len(texts) + 1))
    values, removed = texts.to_pylist(), [0] * len(texts)
    for r in range(len(texts)):
        cut = [k for k in range(bounds[r], bounds[r + 1]) if copies[r] > 1 or int(found.ordinal[k]) in gone[r]]
        if not cut:
            continue
        out, done, end, n = [], int(found.base[r]), int(found.base[r + 1]), 0
        for k in cut:  # in order of their starts; they may overlap
            if found.start[k] > done or n == 0:
                out.append(found.data[done : found.start[k]].tobytes())
                n += 1
            done = max(done, min(int(found.stop[k]) + 1, end))  # with its line break
        out.append(found.data[done:end].tobytes())
        values[r], removed[r] = b"".join(out).decode("utf-8", "replace"), n
    return values, removed


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD, long_run: int = LONG_RUN) -> DataFrame:
    """All rows and columns of ``docs``, without the lines of every chunk that stands, byte for
    byte, in an earlier place of the table as well, and last ``_removed`` (lengthened if the
    name is taken): the number of stretches cut. An earlier place is a lesser (id, hash of the
    text, place in the text), so each line stays where it stands first.

    Only hashes are shuffled to find what repeats. Of the overlapping chunks that a document
    repeats, as few as hold all their lines go on (``cover``). The texts meet the list of these
    once, and only their bytes are compared with the first place's; a chunk whose bytes differ
    in spite of an equal hash stays. Rows that agree in id and text are one document stored
    more than once: all but one of them lose all their chunks. A null text stays null, a blank
    text as it is; a null id counts as the least; no rows give no rows."""
    given, keys = docs.schema, ["_key", "_text_hash"]
    at = given.names.index(text_col)
    names = [f"c{k}" for k in range(len(given))]  # no clash with what is added here
    docs, id_col, text_col = docs.toDF(*names), names[given.names.index(id_col)], names[at]

    rows = staged(chunk_rows(docs, id_col, text_col, spread, long_run), "chunks")
    place = F.struct(*keys, "ordinal")
    ends = rows.groupBy("hash").agg(F.min(place).alias("least"), F.max(place).alias("most"))
    repeated = ends.where("least <> most").select("hash", "least")
    repeats = rows.join(repeated, "hash").select(*keys, "lo", "hi", "ordinal", "hash", (place == F.col("least")).alias("first")).distinct()
    listed = F.sort_array(F.collect_list(F.struct("lo", "hi", "ordinal", "hash", "first")))
    chosen = staged(_covers(repeats.groupBy(*keys).agg(listed.alias("_marks"))), "chosen")
    # first places are looked at only where something is compared with them
    later = chosen.where("NOT first")
    models = chosen.where("first").join(later.select("hash").distinct().hint("merge"), "hash", "left_semi").select(chosen.columns)
    marks = later.union(models).groupBy(*keys).agg(F.collect_list(F.struct("ordinal", "first")).alias("_marks"))
    marks = staged(marks, "marks")

    # both lists grow with the table: the joins are never planned as broadcasts
    marked = docs.select(*names, *_keys(id_col, text_col)).join(marks.hint("merge"), keys, "left").select(*names, *keys, "_marks")
    bodies = staged(_bodies(marked.where("_marks IS NOT NULL"), at, spread, long_run), "bodies")
    firsts = bodies.where("first").groupBy("hash").agg(F.first("body").alias("model"))
    unlike = bodies.where("NOT first").join(firsts, "hash").where("body <> model").groupBy(*keys).agg(F.collect_set("ordinal").alias("_unlike"))

    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    ready = marked.withColumn("_copy", copy).join(unlike.hint("merge"), keys, "left")
    lost = F.filter("_marks", lambda m: ~m["first"] & ~F.coalesce(F.array_contains("_unlike", m["ordinal"]), F.lit(False)))
    ready = ready.select(*names, F.coalesce(F.transform(lost, lambda m: m["ordinal"]), F.array().cast("array<int>")).alias("_gone"), "_copy")
    schema = T.StructType([*docs.schema.fields, T.StructField("_removed", T.IntegerType())])

    @lean
    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, copies = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            hit = [r for r in range(batch.num_rows) if gone[r] or copies[r] > 1]
            texts, removed = batch.column(at), np.zeros(batch.num_rows, np.int32)
            if hit:
                values, of = texts.to_pylist(), 0
                for part in pieces(iter([pa.RecordBatch.from_arrays([texts.take(pa.array(hit))], ["t"])]), 0):
                    own = hit[of : of + part.num_rows]
                    made, cut = _rebuilt(part.column(0), [set(gone[r]) for r in own], [copies[r] for r in own], spread, long_run)
                    for r, value, n in zip(own, made, cut, strict=True):
                        values[r], removed[r] = value, n
                    of += part.num_rows
                texts = pa.array(values, texts.type)
            columns = [texts if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], [*names, "_removed"])

    return ready.mapInArrow(rebuilt, schema).toDF(*given.names, free_name(given.names, "_removed"))

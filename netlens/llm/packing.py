"""Packing of token sequences: BM25 neighbours of a seed document fill its window."""

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.shared import bytes_of, lean, span_hashes, staged
from netlens.llm.tokens import LONGEST, Cutter

WINDOW = 2048
END = 1
#: Tokens of one shard of the index, about; a shard is built, searched and packed in memory.
SHARD_TOKENS = 1 << 20
#: A seed's terms of highest weight, which are searched for.
QUERY_TERMS = 24
K1, B = 1.2, 0.75
#: Units of texts whose ids a worker remembers, and places to find them by hash.
REMEMBERED = 700_000
PLACES = 1 << 22

TOKENS = "id bigint, ids binary, route bigint, seen binary"
PIECES = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


#: Letters and numbers below U+0100, as the tokenizer's own pattern has them, and that pattern
#: for lower-cased text without white space; a line feed stands between two words.
_LETTERS, _NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\n{_LETTERS}{_NUMBERS}]+")
#: What _PARTS is not right for: controls, white space, all from U+0100 on.
_ODD = re.compile("[^\x21-\x7e\xa1-\xff]")
#: How the vocabulary spells bytes: printable ones as themselves, the others from U+0100 on.
_SPELT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = {b: chr(b) for b in _SPELT} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SPELT)))}
END_OF_WORD = "</w>"


class _Grown:
    """An array that is appended to."""

    def __init__(self, kind: np.dtype):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            wider = np.empty(max(2 * self.n, self.n + len(values)), self.data.dtype)
            wider[: self.n] = self.data[: self.n]
            self.data = wider
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Known:
    """The ids of units, in flat arrays without an object per unit. A unit has one place, by its
    hash; what stands there counts only if its bytes are the same, and a later unit takes it."""

    def __init__(self, kind: np.dtype):
        self.places = np.zeros(PLACES, np.int32)  # number of the unit, from 1
        self.texts, self.ids = _Grown(np.uint8), _Grown(kind)
        self.text_ends, self.id_ends = _Grown(np.int64), _Grown(np.int64)
        for ends in (self.text_ends, self.id_ends):
            ends.add(np.zeros(1, np.int64))

    def __len__(self) -> int:
        return self.text_ends.n - 1

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(PLACES - 1)).astype(np.int64)

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the units in ``data`` are known; of these, the ids and how many each has."""
        at = self.places[self._place(hashes)].astype(np.int64) - 1
        found = at >= 0
        own = self.text_ends.data[at]
        found &= self.text_ends.data[at + 1] - own == sizes
        if found.any():
            same = data[_ranges(starts[found], sizes[found])] == self.texts.data[_ranges(own[found], sizes[found])]
            found[found] = np.logical_and.reduceat(same, np.cumsum(sizes[found]) - sizes[found])
        at = at[found]
        first = self.id_ends.data[at]
        n = self.id_ends.data[at + 1] - first
        return found, self.ids.data[_ranges(first, n)], n

    def add(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        self.places[self._place(hashes)] = np.arange(len(self) + 1, len(self) + 1 + len(sizes))
        self.text_ends.add(np.cumsum(sizes) + self.texts.n)
        self.id_ends.add(np.cumsum(n) + self.ids.n)
        self.texts.add(data[_ranges(starts, sizes)])
        self.ids.add(ids)


class Encoder:
    """Token ids of texts. The tokenizer drops white space and never joins what stands on its
    two sides, nor a letter with the punctuation after it (``Cutter`` asks its file), so each
    unit between such places is encoded once and looked up afterwards. Units of Latin-1 are cut
    into the parts that the tokenizer's pattern gives, which go through its model; all others,
    and texts with special tokens, go through the whole tokenizer."""

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cutter = Cutter(json.loads(self.tokenizer.to_str()))
        self.size = max(self.tokenizer.get_vocab_size(), end + 1)
        self.kind = id_type(self.size)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.last = np.zeros(self.size, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = token.endswith(END_OF_WORD)
        self.known = Known(self.kind)
        self.end = np.array([end], self.kind).tobytes()

    def direct(self, texts: list[str]) -> list[bytes]:
        """What the whole tokenizer gives."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of printed Latin-1, and how many each has."""
        parts = _PARTS.findall("\n".join([*units, ""]).lower())
        number = {p: k for k, p in enumerate(dict.fromkeys(["\n", *parts]))}
        part = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        del number["\n"]
        spelt = [p if p.isascii() else "".join(map(_SPELLING.__getitem__, p.encode())) for p in number]
        ids = np.array(self.model.encode_batch_fast([" ".join(spelt)])[0].ids, self.kind)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(spelt):
            raise ValueError("this tokenizer does not end each part of a word with an end-of-word token")
        starts, sizes = (np.append(0, x) for x in (np.append(0, stops)[:-1], np.diff(stops, prepend=0)))  # a line feed has none
        made = sizes[part]
        n = np.diff(np.cumsum(made)[part == 0], prepend=0)  # a line feed stands after each unit
        return ids[_ranges(starts[part], made)], n

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units without ASCII blanks and special tokens, and how many each has."""
        if not _ODD.search("".join(units)):
            return self.plain(units)
        odd = np.array([_ODD.search(u) is not None for u in units])
        whole = [np.frombuffer(x, self.kind) for x in self.direct([u for u, o in zip(units, odd.tolist(), strict=True) if o])]
        ids, made = self.plain([u for u, o in zip(units, odd.tolist(), strict=True) if not o])
        n = np.zeros(len(units), np.int64)
        n[odd], n[~odd] = [len(x) for x in whole], made
        out = np.empty(n.sum(), self.kind)
        of_odd = np.repeat(odd, n)
        out[of_odd], out[~of_odd] = np.concatenate(whole), ids
        return out, n

    def _looked_up(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, and how many each has."""
        data, offsets = bytes_of(units)
        starts, sizes = offsets[:-1], np.diff(offsets)
        hashes = span_hashes(data, starts, offsets[1:])
        found, ids, n = self.known.find(data, starts, sizes, hashes)
        if found.all():
            return ids, n
        fresh, made = self.encoded(units.filter(pa.array(~found)).to_pylist())
        counts = np.zeros(len(units), np.int64)
        counts[found], counts[~found] = n, made
        out, of_known = np.empty(counts.sum(), self.kind), np.repeat(found, counts)
        out[of_known], out[~of_known] = ids, fresh
        if len(self.known) + len(made) > REMEMBERED:
            self.known = Known(self.kind)
        short = ~found & (sizes <= LONGEST)
        self.known.add(data, starts[short], sizes[short], hashes[short], out[np.repeat(short, counts)], counts[short])
        return out, counts

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if self.cutter.cuts != "words":
            return [x + self.end for x in self.direct(texts)]
        marked = [any(m in t for m in self.marks) for t in texts]
        data, offsets = bytes_of(pa.array(["" if m else t for t, m in zip(texts, marked, strict=True)], pa.large_string()))
        body, total = [], np.zeros(len(texts), np.int64)
        for lo, hi in self.cutter.parts(data, offsets):
            units, starts = self.cutter.units(data[lo:hi], offsets[(offsets >= lo) & (offsets < hi)] - lo)
            if not len(units):
                continue
            coded = units.dictionary_encode()
            ids, n = self._looked_up(coded.dictionary)
            unit = coded.indices.to_numpy()
            made = n[unit]
            body.append(ids[_ranges((np.cumsum(n) - n)[unit], made)].tobytes())
            rows = np.searchsorted(offsets, starts + lo, side="right") - 1
            total += np.bincount(rows, made, len(texts)).astype(np.int64)
        body, stops = b"".join(body), (np.cumsum(total) * self.kind.itemsize).tolist()
        made = map(body.__getitem__, map(slice, [0, *stops], stops))
        return [(self.direct([t])[0] if m else x) + self.end for t, m, x in zip(texts, marked, made, strict=True)]


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts."""
    ids = np.sort(ids, kind="stable")
    at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[at].astype(np.int64), np.diff(np.append(at, len(ids)))


def tokenized(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, route, seen): the token ids of each whole text with the end token, and a key
    that sorts documents by the two terms that mark them most among those of the same batch. It
    decides only which documents share a shard. A null text has the end token alone. One more
    row per partition, without ids, has in ``seen`` how many of its documents have each id."""

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end)
        names = ["id", "ids", "route", "seen"]
        total = np.zeros(encoder.size, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = encoder(part.column(1).to_pylist())
                found = [counted(np.frombuffer(x, encoder.kind)) for x in ids]
                seen = np.bincount(np.concatenate([t for t, _ in found]), minlength=encoder.size)
                total += seen
                share = seen / len(found)
                rarity = np.log(1 / np.maximum(share, 1e-9)).clip(0)
                rarity[share * len(found) < 2] = 0.5  # what no other document has leads nowhere
                route = []
                for terms, n in found:
                    weight = rarity[terms] * n / (n + K1)
                    best = terms[np.argsort(-weight, kind="stable")[:2]]
                    route.append(int(best[0]) << 32 | int(best[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(route, pa.int64()), pa.nulls(len(ids), pa.binary())], names)
        if total.any():
            sums = pa.array([total.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), sums], names)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, TOKENS)


def document_frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """In how many documents each id occurs: the partitions' counts, summed by Spark. The result
    has one number per entry of the vocabulary, which bounds it."""

    @lean
    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seen in batch.column(0):
                total = np.frombuffer(seen.as_py(), "<i8")
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["token", "n"])

    rows = tokens.where("seen IS NOT NULL").select("seen").mapInArrow(unfold, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["token"]] = r["n"]
    return out


class Shard:
    """The inverted index of some documents: for each term the documents that have it, with
    their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        found = [counted(d) for d in docs]
        self.n = len(docs)
        self.first = np.cumsum([0, *(len(t) for t, _ in found)])
        terms = np.concatenate([t for t, _ in found])
        count = np.concatenate([n for _, n in found])
        doc = np.repeat(np.arange(self.n), np.diff(self.first))
        length = np.array([len(d) for d in docs])[doc]
        self.weight = (idf[terms] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean_length))).astype(np.float32)
        order = np.argsort(terms.astype(np.uint32), kind="stable")
        self.doc, self.posted = doc[order].astype(np.int32), self.weight[order]
        distinct, self.of = np.unique(terms, return_inverse=True)
        self.starts = np.append(np.searchsorted(terms[order], distinct), len(order))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a searched term with the seed, best first (ties: the
        earlier document)."""
        lo, hi = self.first[seed], self.first[seed + 1]
        weight = self.weight[lo:hi]
        best = np.argsort(-weight, kind="stable")[:QUERY_TERMS]
        terms = self.of[lo:hi][best]
        begin, n = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
        score = np.bincount(self.doc[at], self.posted[at], self.n)
        score[~unused] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def fill(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences, as lists of (document, start, length). Whole windows are cut off long
    documents first. Then each window starts with what a cut has left over, or the next unused
    document; its neighbours that fit whole go in by rank, and the best one that doesn't fit is
    cut to fill the rest; where neighbours run out, the next document is the seed of the rest.
    What is left in the end is cut into sequences of a power of two, which need no padding."""
    size = np.array([len(d) for d in docs])
    start = size // window * window
    for d in np.flatnonzero(start):
        for at in range(0, start[d], window):
            yield [(int(d), at, window)]
    index = Shard(docs, idf, mean_length)
    unused = start < size
    made: list[tuple[int, int, int]] = []
    room, carry, cursor = window, None, 0

    def put(d: int) -> int | None:
        """Place what fits; the document where some of it is left over."""
        nonlocal room
        unused[d] = False
        n = int(min(room, size[d] - start[d]))
        made.append((int(d), int(start[d]), n))
        start[d] += n
        room -= n
        return d if start[d] < size[d] else None

    while True:
        if carry is None:
            while cursor < len(docs) and not unused[cursor]:
                cursor += 1
            if cursor == len(docs):
                break
            carry = cursor
        seed, carry = carry, put(carry)
        if room:
            spare = None
            for d in index.neighbours(seed, unused):
                if size[d] - start[d] <= room:
                    put(d)
                    if not room:
                        break
                elif spare is None:
                    spare = d
            if room and spare is not None:
                carry = put(spare)
        if not room:
            yield made
            made, room = [], window
    while made:
        goal = 1 << (int(sum(m[2] for m in made)).bit_length() - 1)
        taken, rest = [], []
        for d, at, n in made:
            use = min(n, goal)
            if use:
                taken.append((d, at, use))
            if use < n:
                rest.append((d, at + use, n - use))
            goal -= use
        yield taken
        made = rest


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of the documents' token ids, each with its sequence and its place there: (id,
    start, length, ids as little-endian unsigned 32-bit numbers, doc_tokens, sequence_id,
    offset). Every id lies in one piece; sequences hold at most ``window`` ids.

    Tokens are staged once and sorted by a lexical key into range partitions, so any number of
    like documents spreads over partitions; each partition is packed shard by shard in bounded
    memory. The idf of the ranking covers all documents. A null text is the end token alone;
    rows with equal or null ids are packed each by itself; no rows give no pieces."""
    encoder = _encoder(path, end)
    kind, size = encoder.kind, encoder.size
    tokens = staged(tokenized(docs, path, end, id_col, text_col), "tokens")
    n_docs, n_bytes = tokens.agg(F.count("ids"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()
    seen = document_frequencies(tokens, size)
    idf = np.log(1 + (n_docs - seen + 0.5) / (seen + 0.5))
    mean_length = n_bytes / kind.itemsize / max(1, n_docs)
    sent = tokens.sparkSession.sparkContext.broadcast(idf)

    @lean
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        ids: list = []
        docs: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal number
            rows: list[tuple] = []
            for pieces in fill(docs, sent.value, mean_length, window):
                offset = 0
                for d, start, n in pieces:
                    rows.append((ids[d], start, n, docs[d][start : start + n].astype("<u4").tobytes(), len(docs[d]), number, offset))
                    offset += n
                number += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], PIECES.replace(",", " ").split()[::2])

        held = 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                docs.append(np.frombuffer(x.as_py(), kind))
                held += len(docs[-1])
                if held >= shard_tokens:
                    yield out()
                    ids, docs, held = [], [], 0
        if docs:
            yield out()

    spread = tokens.where("ids IS NOT NULL").select("id", "ids", "route").repartitionByRange("route", F.xxhash64("id", "ids"))
    return spread.sortWithinPartitions("route", "id", "ids").select("id", "ids").mapInArrow(packed, PIECES)

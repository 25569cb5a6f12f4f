"""Token counts of whole texts: batches balanced by bytes, cut at safe boundaries, lengths only."""

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.shared import LOWER, PIECE_BYTES, bytes_of, free_name, offsets_of

#: Units whose lengths a worker remembers, and the longest of them in bytes.
REMEMBERED = 1_000_000
LONGEST = 64
#: UTF-8 bytes that go to the tokenizer in one call.
CALL_BYTES = 1 << 18

#: Pattern of pre-tokenizers that drop white space and never join a letter with what follows it,
#: unless that is a letter. Fixed value: the pattern as such tokenizers have it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What may be cut off the letter before it there.
ENDING = b',.;:!?)"'


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_BLANK, _PRINTED, _ENDING = _flags(b"\t\n\r "), _flags(bytes(range(0x21, 0x7F))), _flags(ENDING)
_NONE = np.zeros(0, np.int64)
_LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)))


class Cutter:
    """Where texts may be cut without changing their tokens, by what a tokenizer's ``.json`` file
    says. ``cuts`` is one of:

    * ``words``: white space is dropped and nothing is joined over it, nor a letter with the
      punctuation after it.
    * ``kept``: a blank between two printed ASCII characters starts a token of the right one.
    * ``dropped``: such a blank is what the library puts in front of each text itself.
    * ``whole``: unknown; texts are not cut."""

    def __init__(self, config: dict | None = None):
        self.cuts, self.lowered, self.marks = "whole", False, np.zeros(256, bool)
        if config:
            self._judge(config)

    def _judge(self, config: dict) -> None:
        """Where the parts named in the tokenizer's file allow a cut."""
        added = config["added_tokens"]
        contents = [t["content"].encode() for t in added]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added) or config.get("post_processor"):
            return
        if any(_BLANK[np.frombuffer(c, np.uint8)].any() for c in contents):
            return
        normal, before = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
        normal = normal.get("normalizers", [normal] if normal else [])
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not normal:
            self.cuts = "kept"
            return
        steps = before.get("pretokenizers", [])
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            return
        split = steps[0]
        if split["pattern"] != {"Regex": WORD_PATTERN} or split["behavior"] != "Removed" or not split["invert"]:
            return
        spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        if any(n["type"] not in ("NFC", "Lowercase") and n != spaces for n in normal):
            return
        if any(_ENDING[b] and _LETTER[a] for c in contents for a, b in zip(c, c[1:], strict=False)):
            return
        self.cuts = "words"
        self.lowered = any(n["type"] == "Lowercase" for n in normal)
        self.marks = _flags(bytes(c[0] for c in contents))

    def breaks(self, data: np.ndarray, borders: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray]:
        """For each byte: whether it belongs to a unit, and whether it can start one. Rows begin
        at ``borders``."""
        inside, fresh = np.ones(len(data), bool), np.zeros(len(data), bool)
        if self.cuts == "words":
            inside = ~_BLANK[data]
            fresh[1:] = ~inside[:-1] | (_LETTER[data[:-1]] & _ENDING[data[1:]])
        elif self.cuts in ("kept", "dropped"):
            printed = _PRINTED[data]
            blank = np.zeros(len(data), bool)
            blank[1:-1] = (data[1:-1] == 32) & printed[:-2] & printed[2:]
            blank[borders] = False
            blank[borders[borders > 0] - 1] = False
            if self.cuts == "kept":
                fresh = blank
            else:
                inside = ~blank
                fresh[1:] = blank[:-1]
        return inside, fresh

    def parts(self, data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
        """Ranges of about ``limit`` bytes at most that end between rows or, in a longer row, at
        a safe boundary; a stretch without one is not cut."""
        at, end = int(offsets[0]), int(offsets[-1])
        while at < end:
            stop = int(offsets[np.searchsorted(offsets, at + limit, side="right") - 1])
            if stop <= at:
                close = int(offsets[np.searchsorted(offsets, at, side="right")])
                width, gap = limit, 0
                while True:
                    stop = min(at + width, close)
                    if stop == close:
                        break
                    # one more byte, so that a blank at the end sees what follows it
                    inside, fresh = self.breaks(data[at : stop + 1])
                    safe = np.flatnonzero(fresh[1:] & inside[1:]) + 1
                    if len(safe):
                        stop = at + int(safe[-1])
                        gap = int(not inside[stop - at - 1] and self.cuts == "dropped")
                        break
                    width *= 2
                yield at, stop - gap
            else:
                yield at, stop
            at = stop

    def units(self, data: np.ndarray, borders: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The units of some bytes whose rows begin at ``borders``, and where each starts."""
        inside, fresh = self.breaks(data, borders)
        fresh[borders] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | fresh[1:]
        last[:-1] &= ~inside[1:] | fresh[1:]
        starts = np.flatnonzero(first)
        sizes = np.flatnonzero(last) + 1 - starts
        body, ends = data[inside], np.cumsum(sizes)
        if self.lowered and len(body):
            odd = (body >= 128) | self.marks[body]
            plain = np.add.reduceat(odd, ends - sizes, dtype=np.int64) == 0
            body = np.where(np.repeat(plain, sizes), LOWER[body], body)
        offsets = np.append(0, ends).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))), starts


class Counter(Cutter):
    """Token counts of one tokenizer file (``.json`` or sentencepiece ``.model``), without begin,
    end or other added special tokens; special strings in a text count as the library's defaults
    have it, and nothing is truncated or padded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            super().__init__()
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            joining = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
            if not joining and model.encode("a b") == model.encode("a") + model.encode("b"):
                self.cuts = "dropped"
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        super().__init__(json.loads(tokenizer.to_str()))

    def encoded(self, texts: list[str]) -> list[int]:
        """Lengths of texts, in calls of about CALL_BYTES characters."""
        out: list[int] = []
        lo, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= CALL_BYTES or i + 1 == len(texts):
                out += self.encode(texts[lo : i + 1])
                lo, held = i + 1, 0
        return out

    def __call__(self, column: pa.Array, limit: int = PIECE_BYTES) -> np.ndarray:
        """The token count of each row; a null counts as empty."""
        data, offsets = bytes_of(column)
        total = np.zeros(len(column), np.int64)
        for lo, hi in self.parts(data, offsets, limit):
            units, starts = self.units(data[lo:hi], offsets[(offsets >= lo) & (offsets < hi)] - lo)
            coded = units.dictionary_encode()
            words = coded.dictionary
            sizes = np.diff(offsets_of(words))
            texts = words.to_pylist()
            known = [_known.get((self.cuts, t), -1) if n <= LONGEST else -1 for t, n in zip(texts, sizes.tolist(), strict=True)]
            lengths = np.array(known, np.int64)
            fresh = np.flatnonzero(lengths < 0)
            if len(fresh):
                made = self.encoded([texts[i] for i in fresh])
                lengths[fresh] = made
                if len(_known) + len(fresh) > REMEMBERED:
                    _known.clear()
                _known.update(((self.cuts, texts[i]), n) for i, n in zip(fresh.tolist(), made, strict=True) if sizes[i] <= LONGEST)
            rows = np.searchsorted(offsets, starts + lo, side="right") - 1
            total += np.bincount(rows, lengths[coded.indices.to_numpy()], len(column)).astype(np.int64)
        return total


_known: dict[tuple[str, str], int] = {}
_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters.clear()
        _known.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def counted(docs: DataFrame, path: str, limit: int = 2048, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``
    tokens), each row judged by itself; names already taken get underscores.

    Only lengths come back from Python. A worker cuts its batches into parts of about a megabyte,
    a long text at boundaries that its tokenizer cannot join over, and encodes each distinct unit
    it has not met yet, so memory does not grow with the length of a text (unless it has no
    boundary). A null text counts as empty: no bytes, no tokens. An empty table stays empty."""

    @F.arrow_udf("bigint")
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(path)(texts))

    names: list[str] = []
    for name in ("n_bytes", "n_tokens", "over_limit"):
        names.append(free_name([*docs.columns, *names], name))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn(names[0], F.octet_length(text).cast("bigint")).withColumn(names[1], lengths(text))
    return out.withColumn(names[2], F.col(names[1]) > limit)

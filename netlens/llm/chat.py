"""Chat formatting by columnar byte assembly."""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.shared import bytes_of, pieces

#: Fixed template. In roles and texts a backslash becomes two, and a backslash goes between the
#: characters of ``<|``, so that no control string of the template can come from them.
OPEN, HEAD_END, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
TRAINED = "assistant"
#: UTF-8 bytes of turns that are assembled into one output row, about.
PART_BYTES = 1 << 20

_ESCAPE = re.compile(r"\\(.)", re.S)

FORMATTED = "conv_id bigint, part int, formatted string, loss array<struct<start: int, stop: int>>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escaped(column: pa.Array) -> pa.Array:
    """Text without control strings; ``unescaped`` gives it back."""
    column = pc.replace_substring(pc.fill_null(column, ""), "\\", "\\\\")
    return pc.replace_substring(column, "<|", "<\\|")


def _head(column: pa.Array) -> pa.Array:
    """A role, whose line breaks are escaped too, as one ends it."""
    return pc.replace_substring(escaped(column), "\n", "\\n")


def unescaped(text: str) -> str:
    """What ``escaped`` was given: each backslash stands for the character after it, and one
    before an n for a line break."""
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def assemble(columns: list[pa.Array | bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of n rows that are the columns side by side, and the segments' offsets (n x
    columns + 1): lengths of all segments, their running sum, then each column's bytes are
    scattered to their places in one preallocated buffer."""
    lengths = np.zeros((n, len(columns)), np.int64)
    data = []
    for k, values in enumerate(columns):
        if isinstance(values, bytes):
            lengths[:, k] = len(values)
            data.append(np.tile(np.frombuffer(values, np.uint8), n))
        else:
            body, offsets = bytes_of(values)
            lengths[:, k] = np.diff(offsets)
            data.append(body)
    offsets = np.append(0, np.cumsum(lengths.ravel()))
    out = np.empty(offsets[-1], np.uint8)
    for k, body in enumerate(data):
        size = lengths[:, k]
        start = offsets[:-1].reshape(n, -1)[:, k]
        out[np.arange(len(body)) + np.repeat(start - (np.cumsum(size) - size), size)] = body
    return out, offsets


def format_chats(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Conversations in the template: (conv_id, part, formatted, loss). A conversation's turns
    are ordered by turn, role and text; its output is cut between turns into parts of about
    ``part_bytes``, numbered from 0, so that one of any length passes through bounded memory.
    loss lists the spans (code points of the part) of assistant texts, which are trained on.

    A null role or text is empty, a null turn comes first, null ids form one conversation;
    repeated rows are turns of their own; no rows give no rows."""

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part = object(), 0
        for batch in pieces(batches, 2, part_bytes):
            role, text = batch.column(1), batch.column(2)
            n = batch.num_rows
            out, offsets = assemble([OPEN, _head(role), HEAD_END, escaped(text), CLOSE], n)
            chars = np.append(0, np.cumsum((out & 0xC0) != 0x80))
            at = chars[offsets]
            ids = batch.column(0).to_pylist()
            trained = np.array([r == TRAINED for r in role.to_pylist()])
            borders = [i for i in range(n) if not i or ids[i] != ids[i - 1]]
            rows = []
            for lo, hi in zip(borders, [*borders[1:], n], strict=True):
                part = part + 1 if lo == 0 and conv == ids[0] else 0
                conv = ids[lo]
                base = at[lo * 5]
                loss = [{"start": int(at[i * 5 + 3] - base), "stop": int(at[i * 5 + 4] - base)} for i in range(lo, hi) if trained[i]]
                rows.append((conv, part, loss))
            cuts = np.array([*(offsets[lo * 5] for lo in borders), offsets[-1]])
            formatted = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), formatted.cast(pa.large_string()).cast(pa.string()),
                    pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                ],
                ["conv_id", "part", "formatted", "loss"],
            )

    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"), F.col("turn"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(assembled, FORMATTED)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted part."""
    start, mid, end = OPEN.decode(), HEAD_END.decode(), CLOSE.decode()
    out, at = [], 0
    while at < len(formatted):
        close = formatted.index(end, at)
        if not formatted.startswith(start, at):
            raise ValueError(f"no turn starts at {at}")
        head = formatted.index(mid, at)
        out.append((formatted[at + len(start) : head], formatted[head + 1 : close]))
        at = close + len(end)
    return [(unescaped(r), unescaped(t)) for r, t in out]


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the output back gives, per conversation: its turns and what the loss mask
    covers, as running digests over its parts in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def done() -> tuple:
            return conv, state["n"], state["turns"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["chars"]

        for batch in batches:
            rows = []
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if state is None or row["conv_id"] != conv:
                    if state:
                        rows.append(done())
                    conv, state = row["conv_id"], {"n": 0, "turns": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0}
                text = row["formatted"]
                state["chars"] += len(text)
                for role, said in parsed(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    said = unescaped(text[span["start"] : span["stop"]])
                    state["loss"] += len(said)
                    state["masked"].update(said.encode("utf-8", "surrogatepass"))
            if rows:
                yield _digest_rows(rows)
        if state:
            yield _digest_rows([done()])

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(read, DIGEST)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from netlens.llm import chat, packing
from netlens.llm.queries import tokenizer_path
from tests.llm.conftest import MESSY, prose

TRICKY = ["", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "a\\", "\\n", "<\\|", "<", "|x", "\\<|\\", "é<|東", "\n", "<<||"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@given(st.text(alphabet="<|\\n\nai_ém", max_size=30))
def test_escape_round_trip(text):
    out = chat.escaped(pa.array([text])).to_pylist()[0]
    assert "<|" not in out and chat.unescaped(out) == text


def test_assembled_bytes():
    out, offsets = chat.assemble([b"<", pa.array(["a", "", "ccé"]), b">"], 3)
    assert out.tobytes().decode() == "<a><><ccé>"
    assert offsets.tolist() == [0, 1, 2, 3, 4, 4, 5, 6, 10, 11]


@pytest.mark.parametrize("part_bytes", [1, 40, 1 << 20])
def test_chats_round_trip(spark, part_bytes):
    turns = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TRICKY)]
    turns += [(2, 0, "we\nird<|", "x"), (2, None, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (None, 1, "user", "hi")]
    table = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id bigint, turn bigint, role string, text string, part string").repartition(4)
    formatted = chat.format_chats(table, part_bytes)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert len(got) == 3
    for conv, r in got.items():
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in turns if c == conv))
        said = [text for _, role, text in own if role == "assistant"]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{role}\n{text}\n" for _, role, text in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len("".join(said)), sha("".join(said)))
    assert sum(r["formatted_chars"] for r in got.values()) == sum(len(r["formatted"]) for r in formatted.collect())
    assert chat.digests(chat.format_chats(table.limit(0))).count() == 0


# packing


def ids_of(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [1]


ODD = ["", None, "Hello, World!", "İstanbul ΣΑΣ\x1cx\x85y\u00a0z\u2028w", "e\u0301 \u0301x", "a<|endoftext|>b <|ENDOFTEXT|>", "it's WE'LL 123 ÀÉ", "\r\n\t x \x0b y", "\ufb01 ½ \U0001f600", "x² µ ª¼ ça!'s 'send l'été\x7f\x01 \xad¿QUÉ?"]


def test_ids_equal_the_tokenizers_own():
    path = tokenizer_path()
    encoder = packing.Encoder(path)
    texts = ODD + [prose(1, 300)]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == ids_of(path, text), repr(text)


def test_a_full_memory_of_words_is_begun_anew(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    encoder = packing.Encoder(tokenizer_path())
    once, again = encoder([prose(1, 100), "x"]), encoder([prose(2, 100), prose(1, 100)])
    assert again[1] == once[0] and len(encoder.known) < 300


def test_a_unit_is_encoded_once_whatever_stands_after_it():
    encoder = packing.Encoder(tokenizer_path())
    texts = ["foo foo, foo. (foo) foo", None, "FOO\n\tfoo.", "Foo! " * 400_000, ", foo"]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == ids_of(tokenizer_path(), text)
    assert len(encoder.known) == 6  # foo (foo , . ) !


def test_units_of_one_place_are_told_apart(monkeypatch):
    monkeypatch.setattr(packing, "PLACES", 4)
    encoder = packing.Encoder(tokenizer_path())
    texts = [prose(k, 60) for k in range(5)] + ODD + ["x" * 70 + " " + "é" * 40 + ", y"]
    for _ in range(2):
        for text in texts:
            assert np.frombuffer(encoder([text])[0], encoder.kind).tolist() == ids_of(tokenizer_path(), text), repr(text)


def test_a_worker_remembers_words_in_few_bytes():
    encoder = packing.Encoder(tokenizer_path())
    encoder(["begin"])
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for k in range(0, 60_000, 2000):
        encoder([" ".join(f"{n:x}q{n:o}" for n in range(k, k + 2000))])
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert len(encoder.known) > 59_000 and held < 100 * 60_000


def checked(rows, ids, window):
    """Every id in one piece, sequences gapless and within the window; the padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    bodies = sorted(b"".join(p[2] for p in sorted(own)) for own in pieces.values())
    assert bodies == sorted(np.array(x, "<u4").tobytes() for x in ids)
    sizes = [sum(n for _, n in own) for own in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else window - n for n in sizes) / sum(sizes)


def test_packing_keeps_every_id(spark, messy, no_docs):
    path = tokenizer_path()
    docs = messy.where("doc_id IS NULL OR doc_id NOT IN (7, 9)")
    ids = [ids_of(path, r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = packing.pack(docs, path).collect()
    assert checked(rows, ids, 2048) < 0.02
    assert packing.pack(messy, path).agg({"length": "sum"}).first()[0] == sum(len(ids_of(path, t)) for _, t in MESSY)
    assert packing.pack(no_docs, path).count() == 0


def test_shards_are_bounded_and_neighbours_share_windows(spark):
    path = tokenizer_path()
    topics = [[f"{a}{b}" for b in "abcdefghij"] for a in ("stone", "river", "boat", "light")]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(topics[i % 4], 40)) + " and so it was") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack(docs, path, window=512, shard_tokens=20_000).collect()
    assert checked(got, [ids_of(path, t) for _, t in rows], 512) < 0.02
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r["id"] % 4)
    pure = [max(np.bincount(own)) / len(own) for own in by_sequence.values() if len(own) > 2]
    assert np.mean(pure) > 0.8


def test_neighbours_are_ranked_by_bm25():
    docs = [np.array(d, "<u2") for d in ([5, 6, 7, 8], [5, 6, 7, 9], [5, 10, 11, 12], [13, 14, 15, 16])]
    idf = np.full(20, 2.0)
    shard = packing.Shard(docs, idf, 4.0)
    unused = np.array([False, True, True, True])
    assert shard.neighbours(0, unused).tolist() == [1, 2]
    assert shard.neighbours(0, np.array([False, False, True, True])).tolist() == [2]

"""Token counts, phrase mining and the Merkle manifest against slow versions."""

import hashlib
import random
import re
from collections import Counter as Bag

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netlens.llm import merkle, phrases, tokens
from tests.llm.conftest import MESSY

public = pytest.importorskip("public_tokenizers")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
ODD = [
    "", None, " ", "it's 's ,'s. x's, don't<|endoftext|>a. <|ENDOFTEXT|>, <|endoftext|>.b H̱ ́x Å, é. a b c",
    "Ⅷ١٢ Σας ΣΑΣ. x̸, = ̸a", "a  b   c\t\td \n\n e", "x" * 3000 + " y",
    "a‍b \U0001f469‍\U0001f467, ok\").;x", " lead and trail ", "I. A, Kelvin K, ſ. ŉ ǰ, ẖ",
]


# token counts


@pytest.fixture(params=FILES)
def counter(request):
    tokens._known.clear()
    return tokens.Counter(public.path(request.param))


def test_counts_equal_whole_encoding(counter):
    rng = random.Random(1)
    letters = "aB.,'s<|>é́\t\n  ΣK1!?)\"x東 "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2000)]
    want = counter.encode([t or "" for t in texts])
    assert counter.cuts != "whole"
    for limit in (1 << 20, 60, 7):
        tokens._known.clear()
        assert counter(pa.array(texts), limit).tolist() == want
        assert counter(pa.array(texts).slice(3, 50), limit).tolist() == want[3:53]


def test_unknown_tokenizers_are_not_cut(counter):
    counter.cuts = "whole"
    texts = [t or "" for t in ODD]
    assert counter(pa.array(texts), 10).tolist() == counter.encode(texts)


def test_parts_are_bounded(counter):
    text = "some words, and more " * 500
    data = np.frombuffer(text.encode(), np.uint8)
    got = list(counter.parts(data, np.array([0, len(data)]), 100))
    assert max(b - a for a, b in got) <= 100 and got[0][0] == 0 and got[-1][1] == len(data)
    solid = np.frombuffer(b"x" * 1000, np.uint8)
    assert list(counter.parts(solid, np.array([0, 1000]), 100)) == [(0, 1000)]


def test_counted_table(spark, messy, no_docs):
    path = public.path(FILES[0])
    whole = tokens.Counter(path).encode([t or "" for _, t in MESSY])
    got = tokens.counted(messy.withColumn("N_TOKENS", F.lit(1)), path, 60)
    assert got.columns[-3:] == ["n_bytes", "n_tokens_", "over_limit"] and got.columns[0] == "doc_id"
    rows = Bag((r["doc_id"], r["text"], r["n_bytes"], r["n_tokens_"], r["over_limit"]) for r in got.collect())
    assert rows == Bag((i, t, len((t or "").encode()), n, n > 60) for (i, t), n in zip(MESSY, whole, strict=True))
    assert tokens.counted(no_docs, path).count() == 0


# phrases


def slow_phrases(rows, min_count, longest, cover, top):
    counts, total = Bag(), Bag()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= min_count}
    for (lang, *w), a in candidates.items():
        covered = any(
            p[0] == lang and len(p) > len(w) + 1 and 100 * f >= cover * a and any(list(p[1 + i : 1 + i + len(w)]) == w for i in range(len(p) - len(w)))
            for p, f in candidates.items()
        )
        if covered:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[(lang, *w[:k])], counts[(lang, *w[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(best, 1)]
    return sorted(ranked)


def invented(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "dé", "e", "f", "東"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; "]
    text = lambda: "".join(rng.choice(vocabulary[: rng.randrange(2, 8)]) + rng.choice(gaps) for _ in range(rng.randrange(40)))
    rows = [(rng.choice(["en", "de", None]), rng.choice([None, "", text(), text(), text()])) for _ in range(n)]
    return rows + [("en", "the b the b the b")] * 30


@pytest.mark.parametrize(("seed", "longest", "sample", "bits"), [(0, 3, 1 / 8, 1 << 26), (1, 3, 0.0, 1 << 26), (2, 3, 0.5, 1 << 4), (3, 4, 1 / 8, 1 << 16), (4, 2, 0.02, 1 << 20)])
def test_phrases_equal_a_slow_count(spark, seed, longest, sample, bits):
    rows = invented(seed, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({"phrase": F.lit("x"), "n": F.lit(1)})
    got = phrases.collocations(docs, 5, longest, 50, 25, sample=sample, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == slow_phrases(rows, 5, longest, 50, 25)


def test_long_texts_are_cut_between_pieces():
    text = "one two three, four five six. " * 40 + "x " * 200
    whole = Bag()
    for limit in (1 << 20, 70):
        made = Bag()
        batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([text, "a b c"])], ["lang", "text"])
        for part in phrases._parts(iter([batch]), limit):
            for lang, phrase, n in phrases._counted(part, 3, kept=np.full(1, 255, np.uint8)):
                for key in zip(lang.to_pylist(), phrase.to_pylist(), n.tolist(), strict=True):
                    made[key[:2]] += key[2]
        assert not whole or made == whole
        whole = made
    assert whole["en", "one two three"] == 40 and whole["en", "three four"] == 0


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    rows = [("en", "", 10 * big, 0), ("en", "x", 2 * big, 1), ("en", "y", big + 7, 1), ("en", "x y", big, 2)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, n long, size int")).collect()
    assert [r["score"] for r in got] == [1_000_000 * big * big // (2 * big * (big + 7))]


def test_phrases_of_messy_rows(messy, no_docs):
    docs = messy.withColumn("lang", F.lit(None).cast("string"))
    got = phrases.collocations(docs, 3, top=300).collect()
    assert sorted(map(tuple, got)) == slow_phrases([(None, t) for _, t in MESSY], 3, 3, 50, 300)
    assert phrases.collocations(no_docs.withColumn("lang", F.lit("x"))).count() == 0


# manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_tree(leaves, fanout):
    nodes, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            lo = i // fanout * fanout
            run = nodes[lo : lo + fanout]
            paths[k].append(("".join(run[: i - lo]), "".join(run[i - lo + 1 :])))
            at[k] = i // fanout
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def slow_manifest(rows, fanout):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    trees = {}
    for i, name, text in rows:
        changed = None if text is None else text.replace("\n", "")
        trees.setdefault(name, []).append((i is not None, i or 0, digest(field(i) + field(name) + field(text)), digest(field(i) + field(name) + field(changed)), i))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for n in names:
        trees[n].sort(key=lambda r: r[:3])
    sub = {n: slow_tree([r[2] for r in trees[n]], fanout) for n in names}
    root, tops = slow_tree([sub[n][0] for n in names], fanout) if names else (None, [])
    out = []
    for n, top in zip(names, tops, strict=True):
        for row, path in zip(trees[n], sub[n][1], strict=True):
            node = row[3]
            for before, after in path + top:
                node = digest(before + node + after)
            out.append((row[4], n, row[2], sub[n][0], root, digest("".join(b + a for b, a in path + top)), node))
    return sorted(out, key=repr)


def proved(df, fanout, levels):
    rows = merkle.leaves(df, ["doc_id", "source", "text"], "source", "doc_id", {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    return sorted(map(tuple, merkle.manifest(rows, fanout, levels).collect()), key=repr)


@pytest.mark.parametrize(("seed", "fanout", "levels", "sizes"), [(0, 3, 1, [1, 28, 82, 4, 3]), (1, 2, 1, [33, 1, 5]), (2, 3, 7, [100, 1, 1, 1, 1, 1, 1, 1, 1, 2]), (3, 4, 2, [64, 65, 200])])
def test_manifest_equals_a_slow_tree(spark, seed, fanout, levels, sizes):
    rng = random.Random(seed)
    names = [None, "", "é", "zz", *(f"s{i}" for i in range(9))]
    rows = [(rng.choice([None, 5, rng.randrange(10**6)]), n, rng.choice([None, "", "x\ny", "z"])) for n, size in zip(names, sizes, strict=False) for _ in range(size)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    assert proved(df.withColumns({"leaf": F.lit(1), "pos": F.lit("x")}), fanout, levels) == slow_manifest(rows, fanout)


def test_manifest_of_messy_rows(messy, no_docs):
    assert proved(messy, 3, 1) == slow_manifest([(i, "x", t) for i, t in MESSY], 3)
    assert proved(no_docs, 3, 7) == []
    assert proved(messy.where("doc_id = 10"), 3, 7) == slow_manifest([(10, "x", "one")], 3)


def test_changed_rows_do_not_verify(messy):
    for _, _, _, _, root, _, folded in proved(messy.where("doc_id IN (4, 5)"), 3, 7):
        assert folded != root

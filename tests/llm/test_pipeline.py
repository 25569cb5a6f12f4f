import re

import numpy as np
import pytest

import corpus_pipeline
from netlens.llm import quality, queries
from tests.llm.conftest import MESSY, prose
from tests.llm.test_format import ids_of
from tests.llm.test_text import slow_judgement

SF = "/root/testdata/sf0.001"
TABLES = ("labels", "benchmark")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The smallest tables, with copies, near copies, benchmark passages and messy rows added."""
    folder = tmp_path_factory.mktemp("planted")
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, rows = docs.schema, [tuple(r) for r in docs.collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # plain prose of the corpus itself: every second word of two good documents
    source = [w for r in rows if r[1] and r[2] == "en" and not re.search(r"[|]|!!|###", r[1]) for w in r[1].split()[::2]]
    text = lambda k: "\n".join(" ".join(source[(k * 131 + 12 * i) % 4000 :][:12]) for i in range(14))
    near = lambda t, k: t.replace(t.split()[5 + k], "changed", 1)
    more = [(1000 + k, text(k)) for k in range(12)]
    more += [(1100 + k, text(k)) for k in range(3)] + [(1200 + k, near(text(k + 4), k)) for k in range(3)]
    more += [(1300 + k, text(k + 30) + "\n" + items[k]) for k in range(3)]
    more += [(1400 + i if i is not None else None, t) for i, t in MESSY]
    rows += [(i, t, "en", "src0", None if t is None else len(t)) for i, t in more]
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, planted, tmp_path_factory):
    """Rows before the first stage and after each."""
    folder, at = tmp_path_factory.mktemp("stages"), f"{planted}/documents.parquet"
    out = [spark.read.parquet(at)]
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, spark.read.parquet(at), planted).write.parquet(f"{folder}/{k}")
        at = f"{folder}/{k}"
        out.append(spark.read.parquet(at))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.where("doc_id IS NOT NULL").collect())


def test_all_but_the_last_return_documents(stages):
    for df in stages[1:5]:
        assert df.columns == stages[0].columns


def test_rejected_documents_go(spark, planted, stages):
    machine = quality.train(stages[0], spark.read.parquet(f"{planted}/labels.parquet").where(~quality.held_out()))
    want = quality.score(stages[0], machine).where("score >= 0.5")
    assert ids(stages[1]) == ids(want) and len(ids(stages[1])) < len(ids(stages[0]))
    assert set(range(1000, 1012)) <= set(ids(stages[1]))


def test_line_dedup_keeps_every_document(stages):
    assert ids(stages[2]) == ids(stages[1])
    first, second = ({r["doc_id"]: r for r in s.where("doc_id BETWEEN 1000 AND 1399").collect()} for s in stages[1:3])
    assert second[1000]["text"] == first[1000]["text"]
    assert len(second[1100]["text"]) < 0.5 * len(first[1100]["text"])  # lines that are chunks of their own stay
    assert all(r["n_chars"] == len(r["text"]) for r in second.values())


def shingles(text):
    words = re.findall(r"\S+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_document_of_each_near_group_stays(stages):
    before, after = ({r["doc_id"]: shingles(r["text"]) for r in s.where("doc_id IS NOT NULL").collect()} for s in stages[2:4])
    assert set(after) <= set(before)
    alike = lambda a, b: len(a & b) / max(1, len(a | b))
    long = {i: s for i, s in after.items() if len(s) > 30}
    assert not [(i, j) for i in long for j in long if i < j and alike(long[i], long[j]) > 0.95]
    for i in set(before) - set(after):
        assert not before[i] or max(alike(before[i], s) for j, s in before.items() if j < i) > 0.6


def test_contaminated_documents_go(spark, planted, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect()]
    rows = stages[3].where("doc_id IS NOT NULL").collect()
    bad = {r["doc_id"] for r, j in zip(rows, slow_judgement([r["text"] for r in rows], items), strict=True) if j[-1]}
    assert ids(stages[4]) == sorted(r["doc_id"] for r in rows if r["doc_id"] not in bad)
    assert {1300, 1301, 1302} & set(ids(stages[3])) <= bad


def test_packed_ids_are_those_of_what_is_left(stages):
    path = queries.tokenizer_path()
    want = sorted(np.array(ids_of(path, r["text"]), "<u4").tobytes() for r in stages[4].collect())
    pieces = {}
    for r in stages[5].collect():
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    assert sum(map(len, (b for own in pieces.values() for _, b in own))) == sum(map(len, want))
    single = [own for (i, _), own in pieces.items() if i is not None]
    assert {b"".join(b for _, b in sorted(own)) for own in single} <= set(want)


def test_run_gives_the_last_stage(spark, planted, stages):
    got = corpus_pipeline.run(spark, planted)
    assert got.columns == stages[5].columns
    assert got.agg({"length": "sum"}).first() == stages[5].agg({"length": "sum"}).first()


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netlens.llm import embeddings, graph, simhash
from tests.llm.conftest import MESSY, prose


def least_reachable(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (200, 201), (200, 201), (201, 200)]
    got = dict(graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def slow_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "one two THREE", "a b c d", "a\x0bb\x1cc d e", "É é x y z z z z z", prose(3, 500)])
def test_fingerprint_is_the_bit_majority(text):
    assert simhash.majority(simhash.shingle_hashes(text, 4)) == slow_fingerprint(text, 4)


@pytest.mark.parametrize("radius", [2, 4])
def test_every_link_lies_in_some_cell(spark, radius):
    rng = np.random.default_rng(1)
    values = [int(rng.integers(0, 1 << 63)) for _ in range(40)]
    for v in list(values):
        for bits in range(1, 8):
            values.append(v ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    same = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
    want = least_reachable(len(values), [(i, j) for i, a in enumerate(values) for j, b in enumerate(values[:i]) if same(a, b)])
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"), radius).collect()
    assert all(same(*e) for e in edges)
    at = {v: i for i, v in enumerate(values)}
    assert least_reachable(len(values), [(at[a], at[b]) for a, b in edges]) == want


def test_a_long_cell_gives_a_forest():
    values = np.array(sorted({(1 << a) | (1 << b) for a in range(24) for b in range(24)} | {0xFFFF << 48}), np.uint64)
    left, right = simhash._forest(simhash._Values(values[:, None], values, 4, 4), 0, len(values))
    left, right = np.concatenate(left), np.concatenate(right)
    assert len(left) == len(values) - 2 and (np.bitwise_count(values[left] ^ values[right]) <= 4).all()


@pytest.mark.parametrize("groups", [simhash.near_duplicates, simhash.similar_groups])
def test_simhash_of_a_messy_table(messy, no_docs, groups):
    rows = groups(messy).collect()
    assert len(rows) == len(MESSY)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["component_id"] == by_id[6]["component_id"] == 1
    assert {by_id[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert sum(r["doc_id"] == 7 and r["component_id"] == 7 for r in rows) == 2
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {2, None}
    assert groups(no_docs).count() == 0


def test_similar_texts_group_and_others_do_not(spark):
    rows = []
    for g in range(40):
        words = prose(g, 150).split()
        rows.append((g * 10, " ".join(words)))
        for k in range(1, 4):
            changed = list(words)
            for at in range(20 * k, 150, 80):  # two words: a similarity of about 0.87
                changed[at] = f"new{k}{at}"
            rows.append((g * 10 + k, " ".join(changed)))
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5).collect()
    assert all(r["component_id"] // 10 == r["doc_id"] // 10 for r in got)
    assert sum(r["component_id"] == r["doc_id"] // 10 * 10 for r in got) >= 0.95 * len(got)


def test_isolated_pairs_link_by_the_similarity_of_their_sets(spark):
    rows, want = [], {}
    for g in range(240):
        words = [f"w{g}x{i}" for i in range(204)]
        changed = list(words)
        for k in range(4 if g % 2 else 5):  # 180 / 220 or 175 / 225 shingles
            changed[10 + 40 * k] = f"new{g}x{k}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(changed))]
        want[2 * g + 1] = 2 * g if g % 2 else 2 * g + 1
    got = dict(simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5).collect())
    assert {i: got[i] for i in want} == want


@pytest.mark.parametrize("block_bytes", [1 << 24, 40_000])
def test_long_cells_link_whom_sets_link(spark, block_bytes):
    rows = []
    for g in range(3):  # the groups share cells, at a similarity of 0.72 to each other
        for k in range(40):
            words = [f"w{i}" for i in range(404)]
            for j in range(7):
                words[50 * j + 20] = f"group{g}x{j}" if g else words[50 * j + 20]
            words[398] = f"own{g}x{k}"
            rows.append((100 * g + k, " ".join(words)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x & y) >= 0.8 * len(x | y)]
    want = least_reachable(len(rows), links)
    got = dict(simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5, block_bytes=block_bytes).collect())
    assert [got[i] for i, _ in rows] == [rows[r][0] for r in want]


def test_one_document_of_each_group_stays(messy):
    left = sorted((r["doc_id"] or 0) for r in simhash.kept(messy).collect())
    assert left == [0, 1, 2, 5, 7, 9, 9, 10]


def test_rows_are_kept_by_id_and_text(spark):
    a, k, x = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(5, a), (1, a), (5, k), (7, x), (7, x), (7, x), (None, x + " more"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"first": F.lit(1), "_node": F.lit(2)})
    got = simhash.kept(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, (tuple(r)[:2] for r in got.collect()))) == sorted(map(repr, [(1, a), (5, k), (7, x), (None, None)]))


def cluster_rows(seed=5, dims=32):
    """Single vectors, pairs around the threshold, a dense group and exact copies."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dims) for _ in range(300)]
    for i in range(60):
        rows.append(rows[i] + rng.normal(size=dims) * rng.uniform(0.05, 0.6))
    rows += [rows[299] + 0.02 * rng.normal(size=dims) for _ in range(400)]
    rows += [rows[100]] * 30 + [2 * rows[101]]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def test_embedding_links_against_brute_force(spark):
    rows = cluster_rows()
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    close = m @ m.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), window=64).collect()}
    links = np.array([got[i]["n_links"] for i, _ in rows])
    assert (links <= close.sum(axis=1)).all() and links.sum() >= 0.99 * close.sum()
    want = least_reachable(len(rows), zip(*np.nonzero(close), strict=True))
    assert np.mean([got[i]["component_id"] == want[i] for i, _ in rows]) > 0.99
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_passes_grow_with_the_logarithm_of_rows():
    assert embeddings.passes(100) == 6
    assert embeddings.passes(10**5) < embeddings.passes(10**8) < 200


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [0.0, 0.0], "x"), (4, None, "x"), (5, [1.0, None], "x"), (6, [1.0, nan], "x"), (7, [inf, 1.0], "x"),
        (8, [], "x"), (9, [1.0, 0.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (10, [1e-300, 0.0], "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node string")
    got = embeddings.near_duplicates(table).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"]} == {
        1: (4, 1, True), 2: (4, 1, False), 10: (4, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)},
    }
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_fingerprints_on_the_grid_name_candidates(spark, monkeypatch):
    base = [prose(k, 400) for k in range(8)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t + " changed") for k, t in enumerate(base)] + [(200, ""), (201, None), (202, " ")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = simhash._keyed(table, "doc_id", "text", 5)
    assert {r["id"]: r["fp"] % (1 << 64) for r in keyed.collect()} == {i: simhash.majority(simhash.shingle_hashes(t, 5)) for i, t in rows}
    # without any band the fingerprints alone find copies of few differing bits, and the sets decide
    monkeypatch.setattr(simhash, "_candidates", lambda nodes, bits: spark.createDataFrame([], "a bigint, b bigint, bits int, long boolean, key bigint"))
    got = dict(simhash.similar_groups(table, shingle=5).collect())
    near = lambda k: (simhash.majority(simhash.shingle_hashes(base[k], 5)) ^ simhash.majority(simhash.shingle_hashes(base[k] + " changed", 5))).bit_count() <= 4
    assert sum(map(near, range(8))) >= 6 and all(got[100 + k] == k for k in range(8) if near(k)) and got[201] == got[202] == 200
    monkeypatch.undo()
    assert all(dict(simhash.similar_groups(table, shingle=5).collect())[100 + k] == k for k in range(8))

"""Similarity joins and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pricewake.llm import common, ngram_join, vectors
from pricewake.llm.components import connected_components
from pricewake.llm.ngram_join import JoinSetting, drop_near_duplicates, least_matches, near_duplicates, overlaps, shingle_set


def roots(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    n = 300
    pairs = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(220)],
        "path": [(i, i + 1) for i in range(n - 1)][::-1],
        "star": [(n - 1, i) for i in range(n - 1)] * 2,
        "none": [],
    }[shape]
    edges = spark.createDataFrame([*pairs, (None, 3), (4, 4)], "x long, y long")
    found = {r["node"]: r["component"] for r in connected_components(edges, "x", "y").collect()}
    expected = roots(n, pairs)
    touched = {a for p in pairs if p[0] != p[1] for a in p}
    assert found == {i: expected[i] for i in touched}


# N-gram join


def test_posterior_bounds_agree_with_sampling():
    setting = JoinSetting(tolerance=0.01)
    rng = np.random.default_rng(2)
    for n, m in zip(range(16, 129, 16), least_matches(setting)):
        chance = lambda k: (rng.beta(k + 1, n - k + 1, 200_000) >= 0.8).mean()
        assert chance(m) > 0.008 and chance(m - 1) < 0.012


def test_overlaps_in_pieces():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(12)]
    got = overlaps(sets[:5], sets[5:], columns=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(30)
    rows = []
    for _ in range(25):
        base = text(rng.randint(1, 120))
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy) if rng.random() < 0.7 else "\n".join(copy).upper())
    hot = text(200)
    for i in range(60):
        copy = list(hot)
        copy[i * 3] = "other"
        rows.append(" ".join(copy))
    rows += [" ".join(hot)] * 15 + [None, "", "  ", "a", "A", "a b", "a a a a a a", "a a a a a a a"]
    rows.append("long " + " ".join(text(30_000)))
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(None, rows[0]), (5, rows[5]), (6, rows[9])]


def plain_join(rows):
    def plain_set(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [plain_set(t) if i is not None else set() for i, t in rows]
    links = [0] * len(rows)
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            m = len(sets[a] & sets[b])
            if m and m / (len(sets[a]) + len(sets[b]) - m) >= 0.8:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    root = roots(len(rows), pairs)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i) if i is not None else None
    return sorted((str(i), str(least[r]), n) for (i, _), r, n in zip(rows, root, links))


@pytest.mark.parametrize("blocks", [(8192, 512, 10**6), (8, 7, 0)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(common, "HOT_KEYS", blocks[2])
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, key string, cluster int").repartition(4)
    setting = JoinSetting(bucket_block=blocks[0], cluster_block=blocks[1], broadcast_rows=blocks[2])
    found = near_duplicates(docs, setting=setting).collect()
    assert sorted((str(r["id"]), str(r["class_id"]), r["n_links"]) for r in found) == plain_join(rows)


def test_one_document_of_each_group_stays(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] not in (5, 6)] + [(None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = drop_near_duplicates(docs)
    expected = [i for i, c, _ in plain_join(rows) if i == c]
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(expected)


def test_join_of_empty_and_unlinked_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    apart = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(apart).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]


def test_shingles_do_not_depend_on_the_process():
    assert shingle_set("one Two three four five six", 5).tolist() == shingle_set("ONE two\nthree  four five six", 5).tolist()
    assert shingle_set("a b", 5).tolist() != shingle_set("b a", 5).tolist() and len(shingle_set("a b", 5)) == 1


def test_text_without_shared_band_is_rare():
    setting = JoinSetting()
    assert (1 - 0.8**setting.rows) ** setting.bands < 6e-5
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(200):
        common = rng.integers(0, 2**63, 800, np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 2**63, 100, np.uint64)]) for _ in range(2))
        v = ngram_join.minhash_values([a, b], setting)
        keys = ngram_join.band_keys(v, setting)
        lost += not (keys[0] == keys[1]).any() or not ngram_join.still_likely(v[:1], v[1:], setting, least_matches(setting))[0]
    assert lost == 0


# Vectors


def embeddings():
    rng = np.random.default_rng(7)
    rows = rng.standard_normal((250, 16))
    near = np.repeat(rng.standard_normal((6, 16)), [3, 10, 40, 2, 2, 2], 0)
    near = near + rng.standard_normal(near.shape) * 0.18
    same = np.repeat(rng.standard_normal((1, 16)), 30, 0)
    out = [list(map(float, np.float32(x))) for x in np.vstack([rows, near, same])]
    out += [[x * 1e-30 for x in out[0]], [x * 1e30 for x in out[1]], [-x for x in out[2]]]
    out += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [1.0, 0.1], [1.0, 0.0, 0.0]]
    return out


@pytest.mark.parametrize("block", [4096, 5])
def test_links_equal_all_cosines(spark, monkeypatch, block):
    monkeypatch.setattr(common, "HOT_KEYS", 10**6 if block == 5 else -1)
    given = embeddings()
    rows = [(1000 - i, v) for i, v in enumerate(given)] + [(None, given[0])]
    frame = spark.createDataFrame([(i, v, 0, b"") for i, v in rows], "vec_id long, embedding array<double>, bucket int, key binary").repartition(3)
    found = {r["id"]: r for r in vectors.link_vectors(frame, hashing=vectors.Hashing(recall=0.99999, block=block)).collect()}
    ids = [i for i, _ in rows]
    usable = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) and i is not None for i, v in rows]
    unit = [np.array(v) / np.abs(v).max() if u else None for (_, v), u in zip(rows, usable)]
    unit = [x / np.linalg.norm(x) if x is not None else None for x in unit]
    pairs, links = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                pairs.append((a, b))
                links[a] += 1
                links[b] += 1
    root = roots(len(rows), pairs)
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(least.get(r, i), i) if i is not None else None
    assert len(pairs) > 600 and len(found) == len(rows)
    for i, r, n in zip(ids, root, links):
        assert (found[i]["n_links"], found[i]["component_id"]) == (n, least[r])
        assert found[i]["kept"] == (least[r] == i)


def test_vectors_of_an_empty_table(spark):
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bits_and_tables_follow_the_size():
    h = vectors.Hashing()
    assert h.bits(0) == 6 and h.bits(10**6) == 16 and h.bits(10**9) == 26
    for bits in (6, 16, 26):
        p = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - p) ** h.tables(bits, 0.9) >= h.recall


def test_vector_recall_against_brute_force(spark):
    """All vectors of the largest sample tables."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    given = frame.toPandas()
    x = np.array(given.embedding.tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    expected = dict(zip(given.vec_id, near.sum(1) - 1))
    found = {r["id"]: r["n_links"] for r in vectors.link_vectors(frame).collect()}
    assert all(found[i] <= expected[i] for i in expected)
    assert sum(found.values()) >= 0.98 * sum(expected.values())

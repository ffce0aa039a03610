"""The three trained operators: language, toxicity, quality."""

from __future__ import annotations

import itertools
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from pricewake.llm import langid, ngram_join, quality, toxicity, wordpieces
from pricewake.llm.common import crc_remainder, fit_logistic
from pricewake.llm.sampling import bounded_sample
from pricewake.llm.toxicity import BlockMaxIndex

EDGES = [(None, None), (-1, ""), (-2, " 12 %% "), (-3, "x"), (-4, "x"), (-4, "the words of the text " * 20_000), (-5, "漢字 é\n" * 50)]


@pytest.fixture(scope="module")
def sf01():
    return "/root/testdata/sf0.01"


def edges(spark):
    return spark.createDataFrame([(i, t, "keep", 9.5) for i, t in EDGES], "doc_id long, text string, lang_pred string, score double")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_remainder_is_that_of_the_id_as_text(spark):
    rows = spark.createDataFrame([(5,), (123456,), (None,)], "i long").select("i", crc_remainder("i", 5).alias("r")).collect()
    assert [r["r"] for r in rows] == [zlib.crc32(b"5") % 5, zlib.crc32(b"123456") % 5, -1]


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(40_000).selectExpr("id", "case when id % 100 = 0 then 'rare' when id % 7 = 0 then null else 'common' end as l")
    draw = lambda: sorted((r["l"], r["id"]) for r in bounded_sample(rows, "l", "id", 1000).collect())
    first = draw()
    assert first == draw()
    n = {x: sum(l == x for l, _ in first) for x in ("rare", "common")}
    assert n["rare"] == 400 and 850 < n["common"] < 1150
    assert bounded_sample(rows.limit(0), "l", "id", 10).count() == 0


# Language


def test_subwords_of_a_word():
    buckets, owner, has = langid.subword_buckets(["Ab", "ab", "", "1 2", "ab  ab", "ab ab"], 1 << 20)
    split = [buckets[owner == i].tolist() for i in range(6)]
    assert split[0] == split[1] and len(split[0]) == 3 + 2 + 1
    assert split[2] == split[3] == [] and has.tolist() == [True, True, False, False, True, True]
    assert sorted(split[4]) == sorted(split[5])


def test_language_accuracy_and_fields(spark, sf01):
    rows = langid.op4_language_id(spark, sf01).toPandas()
    docs = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(docs, on="doc_id")
    assert len(both) == len(docs) == len(rows)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert held.score.between(0, 1).all()
    sure = held[held.accepted]
    assert len(sure) > 0.8 * len(held) and (sure.lang == sure.lang_pred).mean() >= 0.985


def test_language_never_sees_held_out_rows(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").limit(300)
    held = crc_remainder("doc_id", 4) == 2
    a = langid.train(docs.where(~held), "text", "lang", "doc_id")
    spoiled = docs.withColumn("lang", docs.lang.substr(1, 1)).where(held).unionByName(docs.where(~held))
    b = langid.train(spoiled.where(~held), "text", "lang", "doc_id")
    assert a.languages == b.languages and np.array_equal(a.table, b.table)


def test_language_edges(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").limit(300)
    model = langid.train(docs, "text", "lang", "doc_id")
    found = model.predict(edges(spark))
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "accepted"]
    by_id = {(r["doc_id"], r["text"]): r for r in found.collect()}
    for key in [(None, None), (-1, ""), (-2, " 12 %% ")]:
        assert (by_id[key]["lang_pred"], by_id[key]["score"], by_id[key]["accepted"]) == ("und", 0.0, False)
    assert by_id[-4, EDGES[5][1]]["lang_pred"] == "en"
    none = langid.train(docs.limit(0), "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in none.predict(edges(spark)).collect()} == {"und"}
    assert model.predict(edges(spark).limit(0)).count() == 0


# Toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    n_terms = 40

    def vector():
        terms = np.sort(rng.choice(n_terms, rng.integers(1, 9), replace=False))
        w = rng.choice([0.5, 1.0, 2.0], len(terms))
        return terms, w / np.sqrt(w @ w)

    examples = [vector() for _ in range(500)] + [(np.zeros(0, np.int64), np.zeros(0))] * 3
    dense = np.zeros((len(examples), n_terms))
    for i, (t, w) in enumerate(examples):
        dense[i, t] = w
    index = BlockMaxIndex(examples, n_terms, 16)
    for _ in range(200):
        t, w = vector()
        cosines = dense[:, t] @ w
        for but in (-1, 7):
            found, got = index.nearest(t, w, 12, but)
            allowed = np.flatnonzero((cosines > 0) & (np.arange(len(examples)) != but))
            best = np.sort(cosines[allowed])[::-1][:12]
            assert np.allclose(got, best) and len(set(found)) == len(found)
            assert np.allclose(cosines[found], got) and but not in found


def _vectors(n: int, n_terms: int, seed: int) -> list:
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(n):
        terms = np.sort(rng.choice(n_terms, rng.integers(5, n_terms // 2), replace=False))
        found.append((terms, rng.random(len(terms))))
    return found


def test_search_in_parts_is_that_of_one_part(monkeypatch):
    """Memory of a search is bounded, and its sums are the same to the last bit."""
    index, queries = BlockMaxIndex(_vectors(300, 80, 1), 80, 64), _vectors(30, 80, 2)
    whole = [index.nearest(*q, 40) for q in queries]
    monkeypatch.setattr(toxicity, "PRODUCTS", 500)
    held = []
    arange = np.arange
    monkeypatch.setattr(toxicity.np, "arange", lambda *a, **k: held.append(a[0]) or arange(*a, **k))
    for q, (found, cosines) in zip(queries, whole):
        again = index.nearest(*q, 40)
        assert found.tolist() == again[0].tolist() and cosines.tolist() == again[1].tolist()
    # One list of examples of a term may pass the bound.
    assert max(held) <= 500 + 300


def test_workers_get_the_index_and_not_the_vectors(monkeypatch):
    vectors = _vectors(300, 80, 3)
    index = BlockMaxIndex(vectors, 80, 64)
    sent = pickle.dumps(index)
    # Two bytes for the number of an example, eight for a weight, four for each term and block.
    assert len(sent) < 10 * sum(len(t) for t, _ in vectors) + 4 * 80 * index.n_blocks + 2000
    again = pickle.loads(sent)
    assert (again.largest == index.largest).all() and again.largest.any()


def test_logistic_fit_finds_the_curve():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(6 * x - 3)))).astype(float)
    slope, offset = fit_logistic(x, y, np.ones_like(x))
    assert abs(slope - 6) < 0.5 and abs(offset + 3) < 0.3


def test_logistic_curve_crosses_one_half_where_errors_are_fewest():
    """One label in two bunches: the likeliest curve misses the nearer one."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0.25, 0.08, 500), rng.normal(0.52, 0.04, 200), rng.normal(0.95, 0.02, 300)])
    y = np.repeat([0.0, 1.0], 500)
    weight = np.where(y == 1, 0.2, 1.8)

    def errors(slope, offset):
        return weight @ ((slope * x + offset >= 0) != (y == 1))

    least = min(weight @ ((x >= t) != (y == 1)) for t in x)
    slope, offset = fit_logistic(x, y, weight, middle=False)
    assert errors(slope, offset) > 1.4 * least
    moved = fit_logistic(x, y, weight)
    assert moved[0] == slope and errors(*moved) <= 1.1 * least
    # Nothing to move to: all rows alike, one label, or a curve that falls.
    for args in ((np.full(4, 0.3), np.array([0.0, 1, 0, 1])), (x, np.zeros(1000)), (-x, y)):
        assert fit_logistic(*args, np.ones(len(args[0]))) == fit_logistic(*args, np.ones(len(args[0])), middle=False)


def test_toxic_rows_held_out_are_caught(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = toxicity.op8_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").toPandas()
    assert held.predicted[held.toxic == 1].mean() > 0.66 and held.predicted[held.toxic == 0].mean() < 0.01


def test_toxic_texts_in_many_bunches_are_dropped(spark, monkeypatch):
    """A filter learns from more examples than a few hundred, and from as many neighbours in proportion."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrst"
    word = lambda kind, n: kind + "".join(letters[int(c)] for c in f"{n:04d}")
    docs, labels = [], []
    for i in range(3_900):
        toxic = int(i % 3 == 0)
        own = [word("xz"[toxic] + "qv"[k], i // 12) for k in (0, 1) for _ in range(2)]
        words = own + [word("c", rng.randint(0, 30)) for _ in range(8)]
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    used = []
    score = toxicity.score_toxicity
    monkeypatch.setattr(toxicity, "score_toxicity", lambda rows, model, text: used.append(model) or score(rows, model, text))
    kept = {r["doc_id"] for r in toxicity.drop_toxic(frame, marks).collect()}
    assert used[0].labels.sum() == 1_300 and used[0].setting.neighbours == 156
    assert sum(y and i in kept for i, y in labels) <= 0.02 * 1_300
    assert sum(not y and i in kept for i, y in labels) >= 0.98 * 2_600
    # Where a label has few rows, no more than usual are drawn of the other one.
    for sizes, n in (({0: 9_000, 1: 449}, 500), ({0: 9_000}, 500), ({0: 9_000, 1: 700}, 700), ({0: 9_000, 1: 8_000}, 2_000)):
        assert toxicity.THOROUGH.drawn(sizes) == n and toxicity.Setting().drawn(sizes) == 500


def test_toxicity_accuracy_and_evidence(spark, sf01):
    rows = toxicity.op8_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert auc(held.score.values, held.toxic.values) > 0.93
    assert (held.predicted == held.toxic).mean() > 0.95
    used = {e["id"] for near in rows.evidence for e in near}
    assert used and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in used)


def test_toxicity_edges(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    labels = spark.read.parquet(f"{sf01}/labels.parquet")
    odd = spark.createDataFrame([(None, 1, 1), (10**9, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels.unionByName(odd))
    found = toxicity.score_toxicity(edges(spark), model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "predicted", "evidence"]
    rows = found.collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] < 0.5 for r in rows)
    base = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score_toxicity(edges(spark), base).collect()} == {0.0}
    assert toxicity.fit(docs, labels.limit(0)).blank == 0.0
    assert toxicity.fit(docs.limit(0), labels).term_ids == {}
    kept = toxicity.drop_toxic(edges(spark), labels)
    assert kept.columns == edges(spark).columns and kept.count() == len(EDGES)


def plain_scores(docs, labels, setting):
    """Cosines, votes and scores in plain Python; the sample holds all labelled rows."""
    texts = {i: t or "" for i, t in docs}

    def counts(text):
        found = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            found.update([word, *("^" + word[:k] for k in (4,) if len(word) > k)])
        return found

    frequency = Counter(t for _, text in docs for t in counts(text or ""))
    examples = {i: (y, counts(texts[i])) for i, y in labels}
    known = {t for _, c in examples.values() for t in c}
    weigh = lambda t: math.log((1 + len(docs)) / (1 + (frequency[t] if t in known else 0))) ** 2

    def vector(c):
        w = {t: (1 + math.log(n)) * weigh(t) for t, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / length for t, x in w.items()}

    vectors = {i: vector(c) for i, (_, c) in examples.items()}
    base = sum(y for _, y in labels) / len(labels)

    def near(text, but=None):
        v = vector(counts(text))
        cosines = {i: sum(x * u.get(t, 0.0) for t, x in v.items()) for i, u in vectors.items() if i != but}
        best = sorted((c for c in cosines.items() if c[1] > 1e-12), key=lambda c: -c[1])[: setting.neighbours]
        total = sum(c for _, c in best)
        vote = (sum(c * examples[i][0] for i, c in best) + toxicity.FAR * base) / (total + toxicity.FAR)
        return vote, best

    order = [i for i in examples if examples[i][1]]
    y = np.array([examples[i][0] for i in order], float)
    n1, n = sum(y for y, _ in examples.values()), len(examples)
    weight = np.where(y == 1, base / n1, (1 - base) / (n - n1)) * n
    slope, offset = fit_logistic(np.array([near(texts[i], i)[0] for i in order]), y, weight)
    found = {}
    for i, text in docs:
        vote, best = near(text or "")
        found[i] = (1 / (1 + math.exp(-(slope * vote + offset))), best) if best else None
    return found


def test_term_hashes_count_words_and_beginnings(monkeypatch):
    rng = random.Random(2)
    signs = [*"abcdE DÉßıİΣςſé漢字٣²½_-9.,\n\t\x85  ’“”é́🙂ªºⅫ", "words ", "wordy "]
    texts = ["", "12 _", "words wordy words abcd", *("".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(400))]
    seen: dict = {}
    for stretch in (7, 1 << 20):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        for text in texts:
            expected = Counter()
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                expected.update([word, *(["^" + word[:4]] if len(word) > 4 else [])])
            hashes, times = toxicity.counts_of(text)
            found = dict(zip(hashes.tolist(), times.tolist()))
            assert len(found) == len(expected) and sum(found.values()) == sum(expected.values())
            for term in expected:
                if term not in seen:
                    # The beginning of a longer word is the term that the word alone does not give.
                    one = set(toxicity.counts_of(term.lstrip("^") + "zzzzz" * term.startswith("^"))[0].tolist())
                    seen[term] = one
                assert any(found.get(h) == expected[term] for h in seen[term])
    assert all(toxicity._tables[0].letters[ord(c)] == bool(re.fullmatch(r"[^\W\d_]", c)) for c in map(chr, range(0x3000)))


@pytest.mark.parametrize("names", ["number", "text"])
def test_toxicity_equals_a_plain_computation(spark, names):
    """Ids may be texts; the result's names, in any case, give way."""
    rng = random.Random(6)
    common, foul = [f"word{chr(97 + i)}" for i in range(26)], ["vile", "scummy", "rotten", "abominable"]
    docs = []
    for i in range(150):
        words = [rng.choice(common) for _ in range(rng.randint(5, 40))] + ["".join(rng.choice("abcdefgh") for _ in range(6))]
        words += [rng.choice(foul) for _ in range(rng.randint(1, 3))] if i % 3 == 0 else []
        rng.shuffle(words)
        docs.append((i if names == "number" else f"d{i}", " ".join(words)))
    docs += [(900 if names == "number" else "none", None), (901 if names == "number" else "new", "zzz qqq")]
    labels = [(d, int(i % 3 == 0)) for i, (d, _) in enumerate(docs[:100])]
    setting = toxicity.Setting(neighbours=9, block=8)
    kind = "long" if names == "number" else "string"
    frame = spark.createDataFrame([(*d, "s", "p", "e", "k") for d in docs], f"doc_id {kind}, text string, SCORE string, `__tox` string, Evidence string, kept string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, f"doc_id {kind}, toxic int"), setting=setting)
    scored = toxicity.score_toxicity(frame, model)
    assert scored.columns == ["doc_id", "text", "__tox", "kept", "score", "predicted", "evidence"]
    expected = plain_scores(docs, labels, setting)
    for row in scored.collect():
        if expected[row["doc_id"]] is None:
            assert row["score"] == pytest.approx(model.blank) and row["evidence"] == []
            continue
        score, best = expected[row["doc_id"]]
        assert row["score"] == pytest.approx(score, abs=1e-6)
        assert [e["cosine"] for e in row["evidence"]] == pytest.approx([c for _, c in best[:3]])
        assert all(e["cosine"] == pytest.approx(dict(best)[e["id"]]) for e in row["evidence"])
    assert toxicity.drop_toxic(frame, spark.createDataFrame(labels, f"doc_id {kind}, toxic int")).columns == frame.columns


# Quality


def field(rng, n=3):
    return rng.normal(size=(2, 2)), rng.normal(size=n)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([1, 4, 2, 6, 3])
    t, _ = field(rng)
    score = rng.normal(size=counts.sum()) * 2
    forward, backward = quality.Chains(counts).passes(score, t)
    got = 1 / (1 + np.exp(-(forward + backward)))
    at = 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(score[at + k] for k in range(n) if path[k]) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += p
            good += p * np.array(path)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_line_features_by_hand():
    x, sizes, counts = quality.line_features(["Ab 1!\n\naa aa", ""])
    assert counts.tolist() == [3, 1] and sizes.tolist() == [5, 0, 5, 0]
    assert np.allclose(x[0, :4], [1 / 5 * 4, 1 / 2, 1 / 5, 0])
    assert np.allclose(x[2, 5], 0.5) and np.allclose(x[0, 2 * quality.OWN : 3 * quality.OWN], x[1, : quality.OWN])
    assert not x[0, quality.OWN : 2 * quality.OWN].any() and not x[2, 2 * quality.OWN : 3 * quality.OWN].any()
    assert (x[:, -1] == 1).all()


def test_drawn_spans():
    how = quality.Training(lines=12, spans=3)
    assert quality.drawn_spans(12, how, 1) == [(0, 12)]
    for n in (13, 50, 1000):
        spans = quality.drawn_spans(n, how, n)
        assert [b - a for a, b in spans] == [4, 4, 4] and spans == sorted(spans) and spans[-1][1] <= n
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])) and spans == quality.drawn_spans(n, how, n)
    # A stretch knows the lines beside it.
    text = "\n".join(f"line {i} " + "x" * (i % 7) for i in range(100))
    drawn, (x, _, _) = quality.Drawn.of(1, text, how), quality.line_features([text])
    lines = np.concatenate([np.arange(a, b) for a, b in quality.drawn_spans(100, how, zlib.crc32(text.encode()))])
    assert np.array_equal(drawn.features, x[lines]) and drawn.counts.tolist() == [4, 4, 4]


def test_quality_is_learned_from_long_texts(spark):
    """One label lives in texts of over 100,000 characters only."""
    rng = random.Random(9)
    prose = lambda: " ".join(f"{rng.choice(['the', 'a'])} {''.join(rng.choice('abcdefghij') for _ in range(rng.randint(3, 9)))}" for _ in range(9)) + "."
    junk = lambda: " ".join(rng.choice(["BUY", "$$$", "NOW!!!", "100%", "|", ">>"]) for _ in range(12))
    docs = [(i, "\n".join(junk() for _ in range(4000))) for i in range(12)] + [(i, "\n".join(prose() for _ in range(6))) for i in range(12, 40)]
    assert min(len(t) for _, t in docs[:12]) > 100_000
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 12)) for i, _ in docs if i % 2], "doc_id long, quality int")
    field = quality.train(frame, labels)
    assert field.weights.any()
    for row in quality.score_quality(frame, field).collect():
        assert row["predicted"] == int(row["doc_id"] >= 12)


def plain_quality(text, field):
    """Features, marginals by enumeration over label pairs, and score of a text, line by line."""
    kind = lambda c: (2 if c.isupper() else 1) if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in PUNCTUATION else 0
    lines = text.split("\n")
    own = []
    for line in lines:
        kinds, words = Counter(map(kind, line)), line.split()
        letters, n = kinds[1] + kinds[2], max(1, len(line))
        copies = lines.count(line) if line else 1
        own.append([
            kinds[0] / n * 4, kinds[2] / max(1, letters), kinds[3] / n, kinds[5] / n * 4, 1 - kinds[1] / n,
            1 - len(set(words)) / max(1, len(words)), float(len(words) - len(set(words)) >= 5), math.log(copies) / 2,
            min(letters / max(1, len(words)), 20) / 10, math.log1p(len(line)) / 6,
        ])
    none = [0.0] * 10
    score = [float(np.dot(own[i] + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(own) else none) + [1.0], field.weights)) for i in range(len(own))]
    t = field.transitions
    good = []
    for k in range(len(lines)):
        # Sums over all labellings, label by label from both ends.
        ahead = [1.0, math.exp(score[0])]
        for i in range(1, k + 1):
            ahead = [sum(ahead[a] * math.exp(t[a, b]) for a in (0, 1)) * (math.exp(score[i]) if b else 1.0) for b in (0, 1)]
        behind = [1.0, 1.0]
        for i in range(len(lines) - 1, k, -1):
            behind = [sum(math.exp(t[a, b]) * (math.exp(score[i]) if b else 1.0) * behind[b] for b in (0, 1)) for a in (0, 1)]
        good.append(ahead[1] * behind[1] / (ahead[0] * behind[0] + ahead[1] * behind[1]))
    mean = sum(g * (len(x) + 1) for g, x in zip(good, lines)) / sum(len(x) + 1 for x in lines)
    return 1 / (1 + math.exp(-(field.slope * mean + field.offset))), len(lines), sum(g < 0.5 for g in good)


def test_quality_scores_equal_a_plain_computation(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    field = quality.train(docs, spark.read.parquet(f"{sf01}/labels.parquet"))
    short = docs.where("n_chars < 600").select("doc_id", "text").limit(40)
    odd = spark.createDataFrame([(-1, "A b\n\n\nA b\nÉé 12 %%"), (-2, "")], short.schema)
    rows = quality.score_quality(short.unionByName(odd), field).collect()
    assert len(rows) == 42
    for r in rows:
        score, n, bad = plain_quality(r["text"], field)
        assert r["score"] == pytest.approx(score, abs=1e-9) and (r["n_lines"], r["n_bad_lines"]) == (n, bad)


PUNCTUATION = ".,;:'\"?()-"
NAMES = ["kept", "found", "row", "id", "text_", "__lang", "__tox", "__quality", "__counts", "__gone", "LANG_PRED", "Score", "Predicted", "N_TOKENS"]


def test_reserved_and_case_changed_names(spark, sf01):
    """Columns of any name pass through; those named like a result's, in any case, give way."""
    docs = spark.read.parquet(f"{sf01}/documents.parquet").limit(200).select("doc_id", "text", "lang", *[F.lit(n).alias(n) for n in NAMES])
    labels = spark.read.parquet(f"{sf01}/labels.parquet")
    results = {
        "lang_pred score accepted": langid.train(docs, "text", "lang", "doc_id").predict(docs),
        "score predicted n_lines n_bad_lines": quality.score_quality(docs, quality.train(docs, labels)),
        "n_words n_tokens n_unknown": wordpieces.token_counts(docs, [bytes([b]) for b in range(256)], [bytes([b]) for b in range(256)]),
    }
    for new, frame in results.items():
        new = new.split()
        assert frame.columns == [c for c in docs.columns if c.lower() not in new] + new
        row = frame.first()
        assert all(row[n] == n for n in NAMES if n.lower() not in new)
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.first()["row"] == "row"


def test_quality_accuracy(spark, sf01):
    rows = quality.op10_quality(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert auc(held.score.values, held.quality.values) > 0.98
    assert (held.predicted == held.quality).mean() > 0.97


def test_quality_edges(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    labels = spark.read.parquet(f"{sf01}/labels.parquet")
    model = quality.train(docs, labels)
    found = quality.score_quality(edges(spark), model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "predicted", "n_lines", "n_bad_lines"]
    rows = found.collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["n_lines"] >= 1 for r in rows)
    assert quality.score_quality(edges(spark).limit(0), model).count() == 0
    one = quality.train(docs, labels.where("quality = 1"))
    assert all(r["score"] > 0.99 for r in quality.score_quality(edges(spark), one).collect())
    quality.train(docs.limit(0), labels.limit(0))

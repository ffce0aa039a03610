from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks import compare
from pricewake.llm import decontaminate, ngram_join, secrets, toxicity
from pricewake.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_queries_against_sql(spark, sf_dir, name):
    connection = compare.connect(sf_dir)
    expected = connection.sql(ORACLE_SQL[name])
    columns = sorted(expected.columns)
    got = QUERIES[name](spark, sf_dir).select(*columns).collect()
    rows = connection.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_registered_under_their_numbers():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run


def test_stages_take_effect(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing",
    ]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert after.columns == docs.columns
            kept = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "toxicity":
            score = toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
            assert set(kept) == {r["doc_id"] for r in score.where("predicted = 0").collect()}
            clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()} & set(before)
            assert len(clean - set(kept)) <= 0.02 * len(clean) and len(kept) < len(before)
        elif name == "n-gram Jaccard join":
            found = ngram_join.near_duplicates(docs).collect()
            assert set(kept) == {r["class_id"] for r in found} and len(kept) < len(before)
        elif name == "benchmark decontamination":
            leaked = {r["doc"] for r in decontaminate.find_leaks(docs, benchmark).collect()}
            assert leaked and set(kept) == set(before) - leaked
        elif name == "secret scans":
            assert set(kept) == set(before) and any("<secret>" in t for t in kept.values())
            assert all(kept[i] == before[i] or "<secret>" in kept[i] for i in kept)
            again = secrets.secret_spans(after).where("size(secret_spans) > 0")
            assert again.count() == 0
        else:
            pieces = after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
            assert {r["doc_id"] for r in pieces} == set(before)
            assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)
        docs = after


def test_run_applies_the_stages(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.count() > 0 and "sequence_id" in pieces.columns


def test_a_worker_keeps_the_words_of_one_operator():
    """What packing kept is gone when the join, the next operator in the same worker, begins."""
    from pricewake.llm import common, tokens, wordpieces  # noqa: F401

    content = tokens.read_tokenizer(tokens.public_tokenizer("byte_bpe_50k.json"))
    first = tokens.encoder(content)
    first.encode(["some words to keep"])
    assert tokens.encoder(content) is first and len(first.young) > 2
    ngram_join.shingle_set("one two three four five six", 5)
    assert [owner for owner, _ in common._held] == ["ngram_join"]
    assert tokens.encoder(content) is not first
    common.free_worker_cache()
    assert not common._held


def test_what_a_worker_kept_is_gone_at_once():
    """Things that refer to themselves do not wait for a collection."""
    import gc
    import weakref

    from pricewake.llm import common

    class Kept:
        def __init__(self):
            self.own = self

    gc.disable()
    try:
        first = weakref.ref(common.worker_cache("one", "a", Kept))
        second = weakref.ref(common.worker_cache("two", "b", Kept))
        assert first() is None and second() is not None
        common.free_worker_cache()
        assert second() is None
    finally:
        gc.enable()


def test_packing_bounds_the_words_of_a_worker(spark, sf_dir, monkeypatch):
    """Two workers of the last stage keep words in 200 MB, and fewer words give the same pieces."""
    from pricewake.llm import packing

    asked, plain = [], packing.encoder
    monkeypatch.setattr(packing, "encoder", lambda content, kept: asked.append(kept) or plain(content, kept))
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, kind: task)
    assert list(corpus_pipeline.pack(spark, docs, sf_dir)([])) == []
    assert 2 * 200 * asked[0] <= 200e6
    monkeypatch.undo()

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = packing.public_tokenizer("byte_bpe_50k.json")
    pieces = [sorted(map(tuple, packing.pack_documents(docs, path, kept_words=n).drop("ids").collect())) for n in (10, 10_000)]
    assert pieces[0] == pieces[1] and pieces[0]


@pytest.mark.parametrize("step", ["frequencies", "examples"])
def test_toxicity_holds_nothing_of_other_operators(spark, step):
    """Its first steps in a worker free what the operator before it kept there."""
    from pricewake.llm import common

    class Here:
        """A frame whose task runs in this process, over no batch."""

        sparkSession, schema = spark, spark.range(1).schema

        def select(self, *columns):
            return self

        def mapInArrow(self, task, schema):
            list(task(iter([])))
            raise StopAsyncIteration

    common.worker_cache("before", "x", list)
    with pytest.raises(StopAsyncIteration):
        if step == "frequencies":
            toxicity._document_frequencies(Here(), "text", np.zeros(0, np.uint64))
        else:
            toxicity._examples(Here())
    assert not common._held


def test_run_leaves_no_folder_but_the_last(spark):
    import os

    from pricewake.llm.common import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    new = [x for x in os.listdir(shared_dir(spark)) if x not in before and x.startswith("pipeline-")]
    assert len(new) == 1 and new[0].startswith("pipeline-packing")

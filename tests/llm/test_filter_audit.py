from __future__ import annotations

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pricewake.llm import filter_audit
from pricewake.llm.filter_audit import audit_filters, measures, store_failures, text_filters

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain_fails(docs):
    """Letters that each (doc_id, text, ...) row fails, by definition."""
    found = []
    for doc_id, text, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 50)
        fails += "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in docs))
        found.append(fails)
    return found


def plain_audit(docs, labels):
    """Every order run one filter after the other over the rows of every part."""
    fails = plain_fails(docs)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = {}
    for part in {d[2] or "" for d in docs}:
        mine = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[name] += len(gone)
                failing = [x for x in mine if name in x[1]]
                lines.append([
                    part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(f == name for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), name,
                ])
        rows.update({tuple(x[:3]): (*x[3:-1], shapley[x[-1]]) for x in lines})
    return rows


def result(frame):
    assert frame.columns == COLUMNS
    found = {(r[0], r[1], r[2]): tuple(r[3:]) for r in frame.collect()}
    return found


def sample_rows(n):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = [None, "", " \t\n", "A" * 9, "# tag", "Ein Wort\x0bund\x0cnoch\rs"]
    for _ in range(20):
        text = " ".join(rng.choice(words[: rng.choice([20, 200])]) for _ in range(rng.choice([10, 49, 50, 51, 400])))
        texts.append(text + rng.choice(["", " $", " &"]) if rng.random() < 0.7 else text.upper())
    # Exactly on the bounds: 65 of 100 distinct words, five capitals in a hundred characters, fifty words.
    texts.append(" ".join([*words[:65], *[words[0]] * 35]))
    texts.append("ABCDE" + "e" * 95)
    texts.append("é" * 95 + "ABCDEF")
    docs = []
    for _ in range(n):
        doc_id = None if rng.random() < 0.1 else rng.randint(-5, n // 2)
        docs.append((doc_id, rng.choice(texts), rng.choice([None, "", "web", "a.b"]), "x", "y"))
    labels = [(rng.choice([None, *range(n // 2)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(n)]
    return docs, labels


DOCS = "doc_id long, text string, source string, `row` string, Failed string"
LABELS = "doc_id long, quality long, toxic long"


def test_audit_equals_filters_run_in_every_order(spark):
    """With null and repeated ids and rows, null parts and texts, repeated labels, and columns named like inner ones."""
    docs, labels = sample_rows(150)
    found = result(audit_filters(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)))
    assert found == plain_audit(docs, labels)


def test_joins_by_shuffle_give_the_same(spark):
    docs, labels = sample_rows(60)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        found = result(audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
    assert found == plain_audit(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit_filters(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a b", "s", "", "")], DOCS)
    found = result(audit_filters(one, labels))
    assert len(found) == 600 and found["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
    assert found["s", "EDCBA", 4] == (1, 0, 0, 0, 0, 0, 0)


def test_id_tables(spark, tmp_path):
    docs, _ = sample_rows(80)
    frame = spark.createDataFrame(docs, DOCS)
    rows, failures = store_failures(frame, text_filters(measures(F.coalesce("text", F.lit("")))), str(tmp_path / "a"))
    ids = {r["row"]: r["doc_id"] for r in rows.collect()}
    assert len(ids) == 80
    for name in "ABCDE":
        failing = [ids[r["row"]] for r in failures[name].collect()]
        expected = [d[0] for d, f in zip(docs, plain_fails(docs)) if name in f]
        assert sorted(failing, key=str) == sorted(expected, key=str), name


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "bb", "s"), (3, "a", "s"), (4, None, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(3, 1, 0)], LABELS)
    found = {tuple(r[1:3]): r for r in audit_filters(docs, labels, {"S": F.length("text") < 2}).collect()}
    assert set(found) == {("SE", 1), ("SE", 2), ("ES", 1), ("ES", 2)}
    # A null condition is not met; the repeated short text fails both.
    assert found["SE", 1][3:] == (2, 2, 0, 1, 1, 0, 3) and found["SE", 2][3:] == (2, 0, 1, 0, 0, 0, 1)
    assert found["ES", 1][3:] == (3, 1, 0, 0, 1, 0, 1) and found["ES", 2][3:] == (2, 1, 1, 1, 0, 0, 3)
    with pytest.raises(ValueError, match="one letter"):
        audit_filters(docs, labels, {"E": F.lit(True)})


def test_plan_has_no_hot_group(spark):
    """Chains of anti joins deal the rows by their own number, once."""
    docs, labels = sample_rows(30)
    rows = spark.createDataFrame([(i, "p", 0, 1) for i in range(30)], "row long, part string, good int, toxic int")
    ids = {n: rows.where(F.col("row") % k == 0).select("row") for n, k in zip("ABC", (2, 3, 5))}
    frames = filter_audit.prefix_counts(rows, {k: v.hint("merge") for k, v in ids.items()})
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in frames]
    assert len(plans) == 11 and "LeftSemi" in plans[-1]
    whole = plans[7]
    # The rows are dealt once for three joins, and each id table once.
    assert whole.count("LeftAnti") == 3 and whole.count("hashpartitioning(row") == 4 and "Cartesian" not in whole

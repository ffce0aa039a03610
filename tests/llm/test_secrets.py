from __future__ import annotations

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pricewake.llm import secrets
from pricewake.llm.secrets import KINDS, EntropyRule, redact, secret_spans

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
RULE = EntropyRule()


def is_noisy(x: str) -> bool:
    """A window judged by its own characters."""
    if re.fullmatch("[0-9]+", x):
        return False
    if re.fullmatch("[0-9a-fA-F]+", x):
        bits = RULE.hex_bits
    elif re.search("[0-9]", x) and re.search("[A-Za-z]", x):
        bits = RULE.mixed_bits
    else:
        bits = RULE.plain_bits
    counts = [x.count(c) for c in set(x)]
    return -sum(n / len(x) * math.log2(n / len(x)) for n in counts) >= bits - 1e-10


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        # Allowed parts are blanked out; what they leave is judged piece by piece.
        blank = lambda p: " " * len(p[0]) if p[0][0] not in "/=_" and any(re.search(a, p[0]) for a in RULE.allowed) else p[0]
        for piece in re.finditer("[^ ]{20,}", re.sub("[A-Za-z0-9+-]+|[/=_]+", blank, m[0])):
            s = piece[0]
            hits = [w for w in range(len(s) - 19) if is_noisy(s[w : w + 20])]
            if hits:
                at = m.start() + piece.start()
                found.append((at + hits[0], 3, at + hits[-1] + 20))
    return sorted(found)


def hard_texts() -> list[str]:
    rng = random.Random(4)
    pieces = [
        "password=", "Token: ", "api_key = '", 'SECRET":"', "APIKEY=", "passwd :", "token=secret: ", "AKIA", "deadbeef", "0123456789abcdef",
        "aZ3", "Q9x+", "é", "漢", " ", "\n", ".", "x" * 25, "ABCDEFGHIJ0123456789", "example", "550e8400-e29b-41d4-a716-446655440000", "-_=", "12345",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(250)]
    texts += ["".join(rng.choice("abcdef0123456789") for _ in range(rng.randint(14, 45))) for _ in range(60)]
    texts += ["".join(rng.choice("abcdXYZ0189+/") for _ in range(rng.randint(18, 60))) for _ in range(60)]
    return texts + ["", "token=secret: abcdefghijklmnop", "password = " + "ab1" * 5000, "plain words only"]


def test_spans_equal_a_plain_scan(spark):
    texts = hard_texts()
    rows = secret_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    for r in rows:
        assert [tuple(s) for s in r["secret_spans"]] == plain_spans(texts[r["i"]]), texts[r["i"]][:200]


def test_no_python_in_the_plan(spark):
    plan = secret_spans(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_redaction_cuts_merged_spans_and_keeps_columns(spark):
    texts = hard_texts()
    names = ["secret_spans", "__clean", "clean", "row", "Spans"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "i int, text string, n_chars long")
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names])
    out = {r["i"]: r for r in redact(docs).collect()}
    for i, text in enumerate(texts):
        expected, at, end = "", 0, 0
        for start, _, stop in plain_spans(text):
            if start >= end and (start > end or not expected):
                expected += text[end:start] + "<secret>"
            end = max(end, stop)
        expected += text[end:]
        assert out[i]["text"] == expected
        assert out[i]["n_chars"] == len(expected)
        assert [out[i][n] for n in names] == names
    assert redact(docs).columns == docs.columns
    spans = secret_spans(docs.withColumnRenamed("secret_spans", "SECRET_spans"))
    assert spans.columns == ["i", "text", "n_chars", *names[1:], "secret_spans"]


def test_time_grows_with_the_matches(spark):
    """200,000 keys in one text, with characters of two and four bytes between them; running maxima cross strides."""
    n = 200_000
    text = "".join(f"{i:016x}é " if i % 5 else f"{i:016x}\U0001f600 " for i in range(n))
    docs = spark.createDataFrame([(1, text, 0)], "i int, text string, n_chars long")
    begin = time.monotonic()
    spans = secret_spans(docs).select(F.size("secret_spans").alias("n"), F.col("secret_spans")[n - 1].alias("last")).first()
    assert spans["n"] == n and spans["last"]["end"] == len(text) - 2
    clean = redact(docs).first()["text"]
    assert clean == re.sub("[0-9a-f]{16}", "<secret>", text)
    assert time.monotonic() - begin < 60


def test_class_and_allowed_words_are_those_of_the_window(spark):
    """A hex key keeps its class beside other signs; an allowed word hides its own part alone."""
    key = "4f9c1e7a2b8d3f60e5a1c97b42d8f30e"
    texts = [f"/keys/{key.upper()}", f"SIGNATURE={key.upper()}", f"sample/{key.upper()}/{key.upper()[::-1]}", f"{key.upper()}_your_dummy_{key.upper()}"]
    found = secret_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    entropy = [[(s["start"], s["end"]) for s in r["secret_spans"] if s["kind"] == 3] for r in found]
    assert len(entropy[0]) == 1 and entropy[0][0][1] == len(texts[0])
    assert len(entropy[1]) == 1 and entropy[1][0][1] == len(texts[1])
    assert len(entropy[2]) == 1 and entropy[2][0][0] >= 6 and entropy[2][0][1] == len(texts[2])
    assert len(entropy[3]) == 2
    for r, text in zip(found, texts):
        assert [tuple(s) for s in r["secret_spans"]] == plain_spans(text)


def test_empty_table_nulls_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secret_spans(empty).count() == 0 and redact(empty).count() == 0
    rows = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert [r["secret_spans"] for r in secret_spans(rows).collect()] == [[], [], []]
    assert sorted(redact(rows).collect(), key=str) == sorted(rows.collect(), key=str)


def test_query_digests(spark, sf_dir):
    rows = secrets.op9_secret_scans(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        written = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
        base = [w for w, (_, k, _) in zip(written, spans) if k < 3]
        assert r["spans"] == ",".join(written)
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))


@pytest.mark.parametrize("kind", ["UUID", "placeholder"])
def test_allow_list(spark, kind):
    text = {"UUID": "550e8400-e29b-41d4-a716-446655440000", "placeholder": "Your-Api9Key8Goes7Here6Now5"}[kind]
    row = secret_spans(spark.createDataFrame([(text,)], "text string")).first()
    assert row["secret_spans"] == []

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from pricewake.llm import turn_trie
from pricewake.llm.turn_trie import numbered_turns, prefix_trie, regrafted

SCHEMA = "conv_id long, turn long, role string, text string, pos string, `Digest` string, words int"


def plain_order(rows):
    """(role, text) of each conversation in order; ties of a turn by SHA-256 of role and text."""

    def key(r):
        written = f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()
        return (r[1] is not None, r[1] or 0, hashlib.sha256(written).digest())

    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((conv, turn, role or "", text or ""))
    return {c: [(r[2], r[3]) for r in sorted(v, key=key)] for c, v in own.items()}


def plain_rebuilt(own):
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        found[c] = own.get(base, [])[:h] + turns[h:]
    return found


def plain_trie(convs):
    """Nodes as dictionaries by prefix, everything counted from the definition."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = {}
    for prefix, ids in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = sorted(c for c in ids if len(convs[c]) == len(prefix))
        rows[min(ids), len(prefix)] = (
            min(members[prefix[:-1]]) if prefix else None,
            len(ids),
            sum(len(p) == len(prefix) + 1 for p in below),
            len(childless),
            saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return rows


def collected(frame):
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = frame.collect()
    found = {(r[0], r[1]): tuple(r[2:]) for r in rows}
    assert len(found) == len(rows)
    return found


def messy_rows(seed):
    rng = random.Random(seed)
    talk = ["", None, "hello there", "a b c", "tab\tand\vline", "ünïcode", "x" * 50]
    rows = []
    for c in [*range(-25, 25), 40, 41, 60, 200, 2**40, 2**40 + 1]:
        if rng.random() < 0.15:
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 17])):
            rows.append((c, None if rng.random() < 0.1 else turn, rng.choice(["user", "user", "assistant", None]), rng.choice(talk)))
    # Repeated rows, ties of a turn, and rows of no conversation.
    rows += rng.sample(rows, 20) + [(None, 1, "user", "lost"), (None, None, None, None)]
    return [(*r, "p", "d", 7) for r in rows]


def test_rebuilt_trie_equals_the_definition(spark):
    for seed in (1, 2):
        rows = messy_rows(seed)
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
        turns, conversations = regrafted(numbered_turns(frame))
        expected = plain_rebuilt(plain_order(rows))
        assert {r[0]: r[1] for r in conversations.collect()} == {c: len(t) for c, t in expected.items()}
        assert collected(prefix_trie(turns, conversations)) == plain_trie(expected)


def trie_of(spark, convs):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    turns = numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    lengths = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id long, n_turns long")
    return collected(prefix_trie(turns, lengths))


def test_long_conversations_part_inside_blocks(spark):
    """Several levels of blocks: copies, prefixes that end at and beside block ends, and turns changed deep inside."""
    rng = random.Random(7)
    spoken = [("user" if i % 2 else "assistant", f"turn {rng.randint(0, 3)} of it") for i in range(150)]
    convs = {i: spoken for i in range(3)}
    for i, n in enumerate([1, 3, 4, 5, 15, 16, 17, 63, 64, 65, 128, 149], 10):
        convs[i] = spoken[:n]
        convs[i + 100] = [*spoken[: n - 1], ("user", f"other {i}")]
        convs[i + 200] = [*spoken[:n], ("user", "on"), *spoken[n:]]
    convs[400] = []
    convs[401] = []
    assert trie_of(spark, convs) == plain_trie(convs)


def test_one_conversation_holds_most_rows(spark):
    """Its turns are numbered range by range."""
    rng = random.Random(3)
    rows = [(5, rng.randint(0, 10**6), "user", f"t{i}") for i in range(3000)] + [(c, i, "user", "t") for c in range(4, 9) for i in range(3)]
    found = numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert found.select(F.spark_partition_id()).count() == len(rows)
    expected = plain_order(rows)
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    got = {(r["conv_id"], r["pos"]): bytes(r["digest"]) for r in found.collect()}
    assert got == {(c, i): digest(*x) for c, turns in expected.items() for i, x in enumerate(turns)}


def test_many_ends_at_one_node(spark, monkeypatch):
    """The list of ids that end at a node is hashed in pieces, by number and not by text, negative ids first."""
    monkeypatch.setattr(turn_trie, "ID_RANGE_BITS", 3)
    convs = {c: [("user", "same")] for c in [*range(-30, 120), 10**12]} | {500: [("user", "other")], 501: []}
    assert trie_of(spark, convs) == plain_trie(convs)


def test_empty_table(spark):
    turns, conversations = regrafted(numbered_turns(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")))
    assert prefix_trie(turns, conversations).count() == 0


def test_query_equals_the_definition(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(turn_trie.op13_conversation_trie(spark, sf_dir)) == plain_trie(plain_rebuilt(plain_order(rows)))

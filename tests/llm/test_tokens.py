from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricewake.llm import packing, tokenfiles
from pricewake.llm.packing import Costs, pack_documents, plan_cuts
from pricewake.llm.tokens import TokenIds, is_regular, public_tokenizer, read_tokenizer, sentence_ends

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
SIGNS = [*"abcABCÉéßıİΣςſ \n\t\r    .,!?'s't1259#$é́漢字🙂\x1c\x85​_-<|>\"()&%*", "<|endoftext|>", "don't", " \n", "\n\n", "word", "Über", ". ", ".\n", "###", "$$$ "]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    found = {}
    for name in FILES:
        library = Tokenizer.from_file(public_tokenizer(name))
        library.encode_special_tokens = True
        found[name] = (TokenIds(read_tokenizer(public_tokenizer(name)), kept=2000), library)
    return found


def ids_of(library, text: str) -> bytes:
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(libraries, name):
    own, library = libraries[name]
    rng = random.Random(6)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for low in range(0, len(texts), 50):
        some = texts[low : low + 50]
        for text, got in zip(some, own.encode(some)):
            assert got == ids_of(library, text), repr(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library_on_any_text(libraries, text):
    text = text.encode("utf-8", "ignore").decode()
    for own, library in libraries.values():
        assert own.encode([text])[0] == ids_of(library, text)


def test_sentence_ends_are_places_between_ids(libraries):
    own, library = libraries[FILES[0]]
    text = "One two. Three!\nFour five? six"
    ends = sentence_ends(text, own.parts([text])[0])
    expected = [len(ids_of(library, text[:k])) // 4 for k in (8, 15, 26)]
    assert is_regular(text) and ends.tolist() == expected


def least_cost(places, penalties, window):
    cost = {0: 0}
    for j in range(1, len(places)):
        cost[j] = min(cost[i] + window - (places[j] - places[i]) + penalties[j] for i in range(j) if places[j] - places[i] <= window)
    return cost[len(places) - 1]


def test_plan_is_the_cheapest():
    rng = random.Random(1)
    for _ in range(300):
        window = rng.randint(4, 30)
        places = [0]
        for _ in range(rng.randint(1, 40)):
            places.append(places[-1] + rng.randint(1, window))
        penalties = [rng.choice([0, 1, 5]) for _ in places]
        cuts = plan_cuts(places, penalties, window)
        assert cuts[0] == places[0] and cuts[-1] == places[-1]
        at = dict(zip(places, penalties))
        cost = sum(window - (b - a) + at[b] for a, b in zip(cuts, cuts[1:]))
        assert all(0 < b - a <= window for a, b in zip(cuts, cuts[1:]))
        assert cost == least_cost(places, penalties, window)


def texts_with_edges(sf_dir, spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()]
    return rows + [(-5, None), (-4, ""), (None, "no id here. Two."), (7, "repeated id"), (7, "repeated id"), (10**12, "long words. " * 30_000), (-9, "x" * 20_000), (-8, "  odd   spaces \n\n ")]


def test_packing_covers_every_id_once(spark, sf_dir, libraries):
    rows = texts_with_edges(sf_dir, spark)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start int, ids string").repartition(3)
    found = pack_documents(docs, public_tokenizer(FILES[0]), costs=Costs(horizon=8)).collect()
    _, library = libraries[FILES[0]]
    expected = sorted((str(i), ids_of(library, t or "") + bytes(4)) for i, t in rows)
    by_doc = {}
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"]) > 0
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    got = []
    for (doc, n), pieces in by_doc.items():
        # A repeated id has each of its pieces as often as it stands in the table.
        times = sum(i == doc and len(ids_of(library, t or "")) // 4 + 1 == n for i, t in rows)
        pieces.sort()
        for k in range(times):
            mine = pieces[k::times]
            assert [s for s, _ in mine] == np.cumsum([0, *[len(p) // 4 for _, p in mine]])[:-1].tolist()
            got.append((str(doc), b"".join(p for _, p in mine)))
    assert sorted(got) == expected
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    used = 0
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist()
        assert sum(n for _, n in pieces) <= 1024
        used += sum(n for _, n in pieces)
    assert used > 0.97 * 1024 * (len(sequences) - 3)


def test_packing_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, public_tokenizer(FILES[0])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=70))
def test_values_round_trip(values):
    given_ = np.array(values, "<u4")
    (control,), (data,) = tokenfiles.encode_values(given_)
    assert len(data) <= 4 * len(control) * 4
    back = tokenfiles.decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8))
    assert back[: len(values)].tolist() == values and not back[len(values) :].any()


def test_block_round_trip():
    docs = [[5, 70_000, 1], [], [2**32 - 1] * 9, [0]]
    counts = [len(d) for d in docs]
    controls, datas = tokenfiles.encode_values(np.array([v for d in docs for v in d], "<u4"), np.array(counts))
    block = tokenfiles.write_block([3, None, -7, 2**62], counts, controls, datas)
    (ids, lengths, values), (again, _, _) = tokenfiles.read_blocks((block + b"\n") * 2)
    assert ids.tolist() == [3, tokenfiles.NULL_ID, -7, 2**62] == again.tolist()
    assert lengths.tolist() == [3, 0, 9, 1]
    assert values.tolist() == [v for d in docs for v in d]


def test_files_round_trip_in_order(spark, sf_dir, libraries, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 5000)
    rows = texts_with_edges(sf_dir, spark)
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, bucket int").repartition(5)
    path = str(tmp_path / "files")
    tokenfiles.write_token_files(docs, path, public_tokenizer(FILES[1]))
    found = tokenfiles.read_token_files(spark, path).orderBy("start").collect()
    _, library = libraries[FILES[1]]
    assert [str(r["doc_id"]) for r in found] == [str(i) for i, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    expected = sorted((str(i), ids_of(library, t or "") + (2).to_bytes(4, "little")) for i, t in rows)
    at, got = 0, []
    for r in found:
        raw = np.array(r["ids"], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(raw))
        at += r["n_tokens"]
        got.append((str(r["doc_id"]), raw))
    assert sorted(got) == expected
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert ranks[0]["id"] in {library.token_to_id(t) for t in (".</w>", "the</w>", "words</w>", "long</w>", "x")} | {r["id"] for r in ranks[:3]}


def test_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    tokenfiles.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, public_tokenizer(FILES[1]))
    assert tokenfiles.read_token_files(spark, path).count() == 0


def test_damaged_file_is_refused():
    with pytest.raises(ValueError):
        list(tokenfiles.read_blocks(b"something else, long enough to be a block"))


def test_packing_query_covers_documents(spark, sf_dir):
    rows = packing.op2_packing(spark, sf_dir).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in rows)
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


IRREGULAR = [
    ("One two.\n\nThree four! Five\n", (8, 21, 26)),
    ("  Lead. Two\r\nnext.  Last", (7, 11, 18)),
    ('He said "stop." Then (he left.) So “why?” End', (15, 31, 41)),
    ("句子一。句子二！「他说。」然后？　完", (4, 8, 13, 16)),
    ("Tab.\tNext\x0bline. x", (4, 9, 15)),
    ("He left.» Then ’ “x", (9,)),
    ("« Oui. » Non.\xa0» fin", (6, 13)),
]


@pytest.mark.parametrize("text, places", IRREGULAR)
def test_sentence_ends_in_any_text(libraries, text, places):
    own, library = libraries[FILES[0]]
    (parts, regular), = own.parts_and_shape([text])
    assert b"".join(parts) == ids_of(library, text)
    expected = [len(ids_of(library, text[:k])) // 4 for k in places]
    assert own.sentence_ends(text, parts, regular).tolist() == expected


def test_places_split_ids_in_odd_texts(libraries):
    signs = [*SIGNS, *"。！？」”’»　\xa0     \x0b\x0c٣²ⅷ๗́", "'s", "’s"]
    rng = random.Random(7)
    for own, library in libraries.values():
        for _ in range(4000):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
            (parts, regular), = own.parts_and_shape([text])
            assert b"".join(parts) == ids_of(library, text), repr(text)
            own.sentence_ends(text, parts, regular)


def test_packing_cuts_between_paragraphs(spark):
    text = "".join(f"This is the sentence of paragraph number {i}, in plain words.\n\n" for i in range(400))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    rows = pack_documents(docs, public_tokenizer(FILES[0])).orderBy("start").collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizer(FILES[0]))
    assert len(rows) > 4 and all(library.decode(list(np.frombuffer(r["ids"], "<u4"))).endswith("words.") for r in rows[:-1])


def test_an_id_that_fills_files_is_split(spark, tmp_path, monkeypatch):
    """Rows without an id, and rows of one id, in several files; the least id there is stays what it is."""
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 40)
    monkeypatch.setattr(tokenfiles, "COARSE", 3)
    rows = [(None, "no id"), (7, "seven words are not so very many here")] * 40 + [(-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    rows += [(i, f"text number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "files")
    tokenfiles.write_token_files(docs, path, public_tokenizer(FILES[1]))
    found = tokenfiles.read_token_files(spark, path).orderBy("start").collect()
    order = [i for i, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [r["doc_id"] for r in found] == order
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    folders = [x.name for x in (tmp_path / "files" / "files").iterdir() if x.name.startswith("bucket=")]
    numbers = [int(x.removeprefix("bucket=")) for x in folders]
    assert sum(n < tokenfiles.SPREAD for n in numbers) > 1 and len({n // tokenfiles.SPREAD for n in numbers}) < len(numbers) - 2

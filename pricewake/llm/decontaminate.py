"""Benchmark decontamination by SimHash of item-sized windows, on built-in functions only.

1. Words are the runs of letters and digits of the lower-cased text; a shingle is
   five words in a row. A window is as long as a benchmark item. It starts at a
   shingle shared with the item (moved inwards at the end of a text), or is
   *anchored* by one: it starts where the item would start for that shingle to
   be in place. Sliding a window right to the next shared shingle drops none, so
   no other start gives more similarity. Windows at shared shingles that hold too
   few of them for the threshold are not fingerprinted.
2. Every window gets a 64-bit SimHash of its shingles, the k-th copy of a shingle
   being an element of its own. Windows and items of one length then are sets of
   one size, and their overlap is that of the weighted similarity below.
3. Windows and items of equal length are matched through a multi-index over
   ``radius + 1`` blocks of the fingerprint: two fingerprints within the radius
   differ in at most ``radius`` bits, so at least one block is equal. All pairs
   within the radius are thus found, and no others are kept.
4. Those pairs are verified exactly: weighted Jaccard similarity of the shingle
   multisets, sum of smaller counts over sum of larger counts.

Most of the work is one pass over the words of each text with a hash join against
the benchmark's shingles; only windows, a few words each, are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm.common import table, text_of

SHINGLE = 5
BITS = 64
# Hashes of up to so many shingle places (some 50 MB) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingle_hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(SHINGLE)])


def _shingle_texts(words: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.transform(places, lambda p: F.array_join(F.slice(words, p + 1, SHINGLE), " "))


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, n_words) of items with an id and at least five words."""
    items = benchmark.where(F.col(item_id).isNotNull())
    items = items.select(F.col(item_id).alias("item"), words_of(text_of(text)).alias("words")).distinct()
    return items.withColumn("n_words", F.size("words")).where(F.col("n_words") >= SHINGLE)


def _anchors(items: DataFrame) -> DataFrame:
    """Distinct (hash, place in the item, length of the item)."""
    places = items.select("words", "n_words", F.explode(F.sequence(F.lit(0), F.col("n_words") - SHINGLE)).alias("place"))
    return places.select(_shingle_hash(F.col("words"), F.col("place")).alias("h"), "place", "n_words").distinct()


def candidate_windows(docs: DataFrame, anchors: DataFrame, threshold: float) -> DataFrame:
    """Distinct (doc, start, n_words, window) for (doc, words); no other window is better and reaches ``threshold``."""
    docs = docs.select("doc", "words", F.xxhash64("words").alias("text"), F.size("words").alias("size"))
    long_enough = docs.where(F.col("size") >= SHINGLE)
    at = F.explode(F.sequence(F.lit(0), F.col("size") - SHINGLE)).alias("at")
    hashed = long_enough.select("doc", "words", "text", "size", at)
    hashed = hashed.select("doc", "text", "size", "at", _shingle_hash(F.col("words"), F.col("at")).alias("h"))
    if anchors.count() <= BROADCAST_ROWS:
        anchors = F.broadcast(anchors)
    last = F.greatest(F.lit(0), F.col("size") - F.col("n_words"))
    anchored = F.greatest(F.lit(0), F.least(F.col("at") - F.col("place"), last))
    # Text is not shuffled by shingle: places go back to their text by id and hash.
    hits = hashed.join(anchors, "h").groupBy("doc", "text", "size", "n_words").agg(
        F.sort_array(F.collect_set("at")).alias("at"), F.collect_set(anchored).alias("anchored")
    )
    # At the threshold so many of the window's places at least are shared.
    both = F.least("size", "n_words") + F.col("n_words") - 2 * (SHINGLE - 1)
    least = F.greatest(F.lit(1), F.ceil(both * (threshold / (1 + threshold)) - 1e-9).cast("int"))
    hits = hits.select("*", last.alias("last"), least.alias("least"))
    enough = F.filter(
        "at",
        lambda x, i: (x <= F.col("last"))
        & (F.get(F.col("at"), i + F.col("least") - 1) <= x + F.col("n_words") - SHINGLE),
    )
    at_end = F.get("at", F.size("at") - F.col("least")) >= F.col("last")
    starts = F.concat("anchored", enough, F.when(at_end, F.array("last")).otherwise(F.array().cast("array<int>")))
    placed = hits.select("doc", "text", "n_words", F.explode(F.array_distinct(starts)).alias("start")).join(docs, ["doc", "text"])
    window = F.slice("words", F.col("start") + 1, F.col("n_words")).alias("window")
    # Equal texts of one id give a window once.
    return placed.select("doc", "start", "n_words", window).distinct()


def _lanes(bits: Column) -> Column:
    """Two bits spread to the two 32-bit lanes of a long, so that one sum counts both."""
    return bits.bitwiseAND(F.lit(1)).bitwiseOR(F.shiftleft(bits.bitwiseAND(F.lit(2)), 31))


def _copies(words: Column) -> Column:
    """A hash for every shingle of the words and number of its copy: (s, 1), (s, 2) and so on.

    Sorting brings copies together. The one-element arrays bind what is used
    more than once; every step passes over the shingles once.
    """
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    hashes = F.array_sort(F.transform(places, lambda p: _shingle_hash(words, p)))

    def runs(h: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        return F.struct(h.alias("h"), begins.alias("begins"))

    def numbered(x: Column) -> Column:
        def run(begin: Column, j: Column) -> Column:
            length = F.coalesce(F.get(x["begins"], j + 1), F.size(x["h"])) - begin
            return F.transform(F.sequence(F.lit(1), length), lambda k: F.xxhash64(F.get(x["h"], begin), k))

        return F.flatten(F.transform(x["begins"], run))

    return F.get(F.transform(F.transform(F.array(hashes), runs), numbered), F.lit(0))


def with_simhash(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """``keys`` and ``fingerprint``: bit k is set if more than half of the hashes of ``_copies`` have it.

    Each lane counts more shingles than an array holds; the top one is read without its sign.
    """
    hashed = rows.select(*keys, F.explode(_copies(F.col(words))).alias("__h"))
    sums = [
        F.sum(_lanes(F.shiftrightunsigned("__h", 2 * j).bitwiseAND(F.lit(3).cast("long")))).alias(f"__s{j}")
        for j in range(BITS // 2)
    ]
    counted = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *sums)
    lanes = F.array(*[F.col(f"__s{j}") for j in range(BITS // 2)])

    def bit(k: Column) -> Column:
        lane = F.call_function("shiftrightunsigned", F.get(F.col("__lanes"), F.floor(k / 2).cast("int")), 32 * (k % 2))
        set_ = 2 * lane.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) > F.col("__n")
        return F.when(set_, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit)
    fingerprint = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    counted = counted.select(*keys, "__n", lanes.alias("__lanes"))
    return counted.select(*keys, fingerprint.alias("fingerprint"))


def _blocks(fingerprint: str, radius: int) -> Column:
    """The fingerprint's radius + 1 blocks in order."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    shapes = F.array(
        *[
            F.struct(F.lit(low).alias("low"), F.lit((1 << (high - low)) - 1).cast("long").alias("mask"))
            for low, high in zip(edges, edges[1:])
        ]
    )
    return F.transform(
        shapes, lambda s: F.call_function("shiftrightunsigned", F.col(fingerprint), s["low"]).bitwiseAND(s["mask"])
    )


def within_radius(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Pairs (doc, start, n_words, window, item, item_words) of equal length, fingerprints within the radius.

    Pairs are found by block and kept at their first equal block, so each comes once.
    """
    left = windows.withColumn("__blocks", _blocks("fingerprint", radius))
    right = items.withColumn("__item_blocks", _blocks("item_fingerprint", radius))
    left = left.select("*", F.posexplode("__blocks").alias("block", "value"))
    right = right.select("*", F.posexplode("__item_blocks").alias("block", "value"))
    pairs = left.join(right, ["n_words", "block", "value"])
    first = F.array_position(F.zip_with("__blocks", "__item_blocks", lambda a, b: a == b), True) - 1
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius
    kept = pairs.where(near & (first == F.col("block")))
    return kept.select("doc", "start", "n_words", "window", "item", "item_words")


def _weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger counts of two multisets of texts.

    The one-element arrays bind the multisets, and then the overlap, so that
    each is computed once and not again wherever it is used.
    """
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))

    def overlap(x: Column) -> Column:
        shared = F.aggregate(
            F.array_intersect(x["a"], x["b"]),
            F.lit(0),
            lambda n, s: n + F.least(count(x["a"], s), count(x["b"], s)),
        )
        return F.struct(shared.alias("shared"), (F.size(x["a"]) + F.size(x["b"])).alias("both"))

    overlaps = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), overlap)
    return F.get(F.transform(overlaps, lambda y: y["shared"] / (y["both"] - y["shared"])), F.lit(0))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    radius: int = 19,
) -> DataFrame:
    """(doc, item, start, similarity) of every document and benchmark item of which it has a window.

    The best of all windows as long as the item; of equals the first that is
    anchored or starts at a shared shingle. ``start`` counts words from 0. At
    similarity 0.8 two sets of one size share 8 of 9 elements, repeated shingles
    or not, and a bit of their fingerprints differs with probability 0.15; so a
    radius of 19 of 64 bits passes all but 5 in 10,000 of the pairs that only
    just reach the threshold, and more of all others.

    Null or short texts (fewer than five words) and rows without an id yield
    nothing; an item of fewer than five words has no shingle and is never found.
    Rows with one id count as one document. Either table empty: no rows.
    """
    items = benchmark_items(benchmark)
    named = docs.where(F.col(doc_id).isNotNull())
    texts = named.select(F.col(doc_id).alias("doc"), words_of(text_of(text)).alias("words"))
    windows = candidate_windows(texts, _anchors(items), threshold)
    marked = with_simhash(windows, ["doc", "start", "n_words", "window"], "window")
    item_marks = with_simhash(items, ["item", "words", "n_words"], "words").select(
        "item", F.col("words").alias("item_words"), "n_words", F.col("fingerprint").alias("item_fingerprint")
    )
    pairs = within_radius(marked, item_marks, radius)
    similarity = _weighted_jaccard(F.col("a"), F.col("b"))
    verified = (
        pairs.select("doc", "item", "start", _shingle_texts(F.col("window")).alias("a"), _shingle_texts(F.col("item_words")).alias("b"))
        .select("doc", "item", "start", similarity.alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    return verified.groupBy("doc", "item").agg(best.alias("best")).select(
        "doc", "item", (-F.col("best.back")).alias("start"), "best.similarity"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without a benchmark passage, columns unchanged; rows without an id stay."""
    leaked = find_leaks(docs, benchmark, doc_id, text).select("doc").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(leaked, F.col("row")[doc_id] == F.col("doc"), "left_anti").select("row.*")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a passage."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("start").cast("long").alias("start"),
        F.round("similarity", 6).alias("similarity"),
    )

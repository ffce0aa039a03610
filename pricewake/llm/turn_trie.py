"""Trie of the turns that conversations start with, built from digests of blocks of turns.

A conversation is cut into blocks of ``BLOCK`` turns, these into blocks of
blocks, and so on up to one block for all of it. From the top, equal blocks after
an equal beginning become one row; a block's parts are grouped with those of
others only where blocks with the same beginning differ. The last level are the
turns themselves, whose groups are the nodes of the trie.

Everything is keyed by digests of 128 bits and more. Levels and rounds grow with
the logarithm of the longest conversation, and no conversation, node or group of
copies is gathered in one task; only the list of the ids that end at a node is
one stream, as its SHA-256 is defined from first to last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewake.llm.common import cut, join_split, prepare_python, quoted, table, text_of

# Turns of a block, and blocks of a block of blocks.
BLOCK = 4
# The beginning that all conversations share.
ROOT = bytes(16)
# Ids that end at a node are joined to texts by ranges of so many (a power of 2).
ID_RANGE_BITS = 10


def numbered_turns(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id``, ``pos`` (from 0), ``digest`` (of role and text) and ``words`` of every turn.

    Turns go by ``turn``, null first, then by digest. A null role or text is
    empty; rows without conversation are left out; repeated rows are turns of
    their own. Rows are dealt by ranges of the order itself, so that a long
    conversation lies in many tasks; a place is the one in its range plus the
    sizes of the conversation's ranges before.
    """
    who, what = text_of(quoted(role)), text_of(quoted(text))
    written = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what)
    words = F.array_remove(F.split(F.translate(what, "\t\n\v\f\r", "     "), " "), "")
    keyed = rows.where(quoted(conversation).isNotNull()).select(
        quoted(conversation).alias("conv_id"),
        quoted(turn).alias("turn"),
        F.unhex(F.sha2(written, 256)).alias("digest"),
        F.size(words).cast("long").alias("words"),
    )
    order = ["conv_id", "turn", "digest"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits are the range's number, the lower ones the place in it.
    placed = cut(ranged.select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("place")))
    placed = placed.withColumn("range", F.shiftright("place", 33))
    runs = placed.groupBy("conv_id", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "range", F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0)), "n")
    runs = runs.toDF("conv_id", "range", "shift", "n")
    return placed.join(runs, ["conv_id", "range"]).select("conv_id", (F.col("place") - F.col("shift")).alias("pos"), "digest", "words")


def regrafted(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations c whose first h turns are replaced by those of c - c % ``family``; h is crc32(c) % ``most``.

    Takes ``numbered_turns``; gives turns in the same form, and ``conv_id`` and
    ``n_turns`` of every conversation, turnless ones too. Remainders have the
    sign of c. If the other conversation is shorter than h, all its turns are
    taken; if there is none, no turn.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = cut(convs.select("conv_id", "base", "n", "h", taken.alias("taken")))
    own = join_split(turns.where(F.col("pos") >= head), convs.select("conv_id", "h", "taken"), "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    lead = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    lead = lead.join(convs.select("conv_id", "base", "taken"), "base").where(F.col("pos") < F.col("taken"))
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return own.unionByName(lead.select("conv_id", "pos", "digest", "words")), lengths


def _after(beginning: Column, part: Column) -> Column:
    """Key of a beginning followed by a part."""
    return F.substring(F.unhex(F.sha2(F.concat(beginning, part), 256)), 1, 16)


def _blocks(parts: DataFrame) -> DataFrame:
    """Blocks of neighbouring parts: ``conv_id``, ``at``, ``parts`` in order, and ``digest`` of all of them."""
    grouped = parts.groupBy("conv_id", F.expr(f"at div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", "words"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["digest"]))
    return grouped.select("conv_id", F.col("block").alias("at"), "parts", F.unhex(F.sha2(joined, 256)).alias("digest"))


def _refined(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Groups of the parts of blocks, from the groups of the blocks."""
    several = groups.groupBy("start").agg((F.count(F.lit(1)) > 1).alias("diverges"))
    known = blocks.select(F.col("conv_id").alias("conv"), "at", "parts")
    whole = join_split(groups, several, "start").join(known, ["conv", "at"])
    parts = whole.select("*", F.posexplode("parts").alias("i", "part"))
    start = F.aggregate(F.slice("parts", F.lit(1), F.col("i")), F.col("start"), lambda key, p: _after(key, p["digest"]))
    end = F.when(F.col("i") == BLOCK - 1, F.col("end")).otherwise(_after(F.col("begins"), F.col("part.digest")))
    parts = parts.withColumn("begins", start).select(
        F.col("begins").alias("start"),
        end.alias("end"),
        F.col("part.at").alias("at"),
        F.col("part.digest").alias("digest"),
        F.col("part.words").alias("words"),
        "conv",
        "n",
        F.when(F.col("i") == F.size("parts") - 1, F.col("ender")).alias("ender"),
        "diverges",
    )
    merged = parts.where("diverges").groupBy("start", "digest").agg(
        # All but conv, n and ender are the same for equal parts after an equal beginning.
        F.min("end").alias("end"), F.min("at").alias("at"), F.min("words").alias("words"),
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("ender").alias("ender"),
    )
    return merged.unionByName(parts.where(~F.col("diverges")).select(merged.columns))


def _end_digests(ends: DataFrame) -> DataFrame:
    """``ender`` (smallest id) and ``ends_sha256`` of the ids with equal ``digest``."""
    prepare_python(ends.sparkSession)
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = ends.groupBy("digest", F.shiftright("conv_id", ID_RANGE_BITS).alias("range")).agg(
        F.array_join(ids, ",").alias("ids"), F.min("conv_id").alias("least")
    )
    dealt = pieces.repartition("digest").sortWithinPartitions("digest", "range").select("digest", "ids", "least")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least, state = None, None, None

        def done(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            ids, texts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["ender", "ends_sha256"])

        for batch in batches:
            rows = []
            for digest, ids, low in zip(*(c.to_pylist() for c in batch.columns)):
                if digest == last:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    rows.append((least, state.hexdigest()))
                last, least, state = digest, low, hashlib.sha256(ids.encode())
            if rows:
                yield done(rows)
        if state is not None:
            yield done([(least, state.hexdigest())])

    return dealt.mapInArrow(hashed, "ender long, ends_sha256 string")


def _with_subtree_sums(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes with ``leaves`` and ``saved`` summed over their subtrees, by doubling distances.

    After round k a node holds the sums over what lies less than 2^k below it,
    and knows its ancestor 2^k above.
    """
    state = nodes.select("id", F.col("parent").alias("above"), "leaves", "saved")
    for _ in range(depth.bit_length()):
        state = cut(state)
        climbing = state.where(F.col("above").isNotNull())
        sums = climbing.groupBy("above").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = state.select(F.col("id").alias("above"), F.col("above").alias("further"))
        moved = join_split(climbing, further, "above").select("id", F.col("further").alias("above"), "leaves", "saved")
        stayed = state.where(F.col("above").isNull())
        state = moved.unionByName(stayed).join(sums.withColumnRenamed("above", "id"), "id", "left").select(
            "id",
            "above",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
    sums = cut(state.select("id", "leaves", "saved"))
    return nodes.drop("leaves", "saved").join(sums, "id")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, one for every distinct beginning, the empty one too.

    ``turns``: ``conv_id``, ``pos`` (0 to the length without gaps), ``digest``,
    ``words``. ``conversations``: every ``conv_id`` and its ``n_turns``, 0 for one
    without turns. Result, a row per node: ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes of its subtree),
    ``saved_tokens`` (over its subtree, (members - 1) times the words of the last
    turn) and ``ends_sha256`` (of the sorted ids of members that end there). No
    conversation gives no node. Lists of ends are streamed; the longest one is
    read by one task in pieces of at most 2^``ID_RANGE_BITS`` ids.
    """
    depth = conversations.agg(F.max("n_turns")).first()[0] or 0
    levels = []
    parts = turns.select("conv_id", F.col("pos").alias("at"), "digest", "words")
    while not levels or BLOCK ** len(levels) < depth:
        levels.append(cut(_blocks(parts)))
        parts = levels[-1].select("conv_id", "at", "digest", F.lit(0).cast("long").alias("words"))
    top = levels[-1].select("conv_id", "digest")

    root = F.lit(ROOT)
    groups = top.groupBy("digest").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"))
    groups = groups.select(
        root.alias("start"), _after(root, F.col("digest")).alias("end"), F.lit(0).cast("long").alias("at"), "digest",
        F.lit(0).cast("long").alias("words"), "conv", "n", F.col("conv").alias("ender"),
    )
    for blocks in reversed(levels):
        groups = cut(_refined(cut(groups), blocks))

    turnless = conversations.where(F.col("n_turns") == 0)
    everyone = conversations.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min(F.when(F.col("n_turns") == 0, F.col("conv_id"))).alias("ender"),
    )
    below = groups.select(
        F.col("end").alias("id"), F.col("start").alias("parent"), (F.col("at") + 1).alias("depth"), F.col("conv").alias("conv_id"),
        F.col("n").alias("n_convs"), "words", "ender",
    )
    first = everyone.where(F.col("n_convs") > 0).select(
        root.alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id",
        "n_convs", F.lit(0).cast("long").alias("words"), "ender",
    )
    nodes = below.unionByName(first)
    children = groups.groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    saved = (F.col("n_convs") - 1) * F.col("words")
    nodes = cut(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": saved}))
    summed = _with_subtree_sums(nodes, depth)
    ends = _end_digests(top.unionByName(turnless.select("conv_id", F.lit(b"").alias("digest"))))
    named = summed.where(F.col("ender").isNotNull()).join(ends, "ender", "left")
    named = named.unionByName(summed.where(F.col("ender").isNull()), allowMissingColumns=True)
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = join_split(named.where(F.col("parent").isNotNull()), parents, "parent")
    placed = placed.unionByName(named.where(F.col("parent").isNull()), allowMissingColumns=True)
    nobody = hashlib.sha256(b"").hexdigest()
    return placed.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations`` after their first turns were exchanged within families of twenty."""
    turns, conversations = regrafted(numbered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(cut(turns), cut(conversations))

"""How filters act on each other when they run one after the other, in every order.

Each filter has a table of the ids that fail it. What a prefix of filters leaves
is the left-anti join of the rows with their tables, one after the other; what a
filter fails by itself is the left-semi join with its table. A prefix leaves the
same whatever the order within it, so there is one chain of joins for every set
of filters, and an order reads its steps off the sets it passes.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm.common import cut, join_split, new_folder, quoted, remove_folder, table, text_of

# The filter that removes texts which a smaller id has, too.
REPEATED = "E"
# All orders are listed, so the number of filters is small.
MOST_FILTERS = 6
# Sets of filters that are counted by one job.
AT_ONCE = 5


def measures(text: Column) -> Column:
    """What the filters ask of a text: ``counts`` of words, ``n``, and distinct ones, ``d``, ``points``, ``capitals``, ``marked``."""
    # Words stand between ASCII white space; a text is split once for both counts, by one sign, as that is quick.
    spaced = reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit(" ")), "\t\n\v\f\r", text)
    words = F.array_remove(F.split(spaced, " "), "")
    both = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d"))
    return F.struct(
        F.transform(F.array(words), both)[0].alias("counts"),
        F.length(text).cast("long").alias("points"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("capitals"),
        text.rlike("[#$%&*|]").alias("marked"),
    )


def text_filters(of: Column) -> dict[str, Column]:
    """Failure conditions on the measures of a text: too short, too repetitive, too many capitals, signs of markup."""
    return {
        "A": of["counts"]["n"] < 50,
        "B": 100 * of["counts"]["d"] < 65 * of["counts"]["n"],
        "C": 100 * of["capitals"] > 5 * of["points"],
        "D": of["marked"],
    }


def store_failures(
    docs: DataFrame, filters: dict[str, Column], folder: str, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows (``row``, ``doc_id``, ``part``) and for every filter the rows that fail it (``row``), stored below a folder.

    ``row`` numbers the rows of the table, so that null and repeated ids are
    rows of their own. Besides the given filters there is the one for repeated
    texts: a row fails it if a smaller id has the same text. A null id is neither
    smaller nor larger than another. A null part is the empty string.
    """
    spark = docs.sparkSession
    conditions = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in filters.items()]
    whole = text_of(quoted(text))
    judged = docs.select(
        F.monotonically_increasing_id().alias("row"),
        quoted(doc_id).alias("doc_id"),
        F.coalesce(quoted(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.array_compact(F.array(*conditions)).alias("failed"),
    )
    # Once written, the numbers stand, whatever is computed again.
    judged.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    rows.select("row", F.explode("failed").alias("filter")).write.partitionBy("filter").parquet(f"{folder}/failures")
    repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    repeated = repeated.where(F.col("least") < F.col("most")).select("digest", "least")
    late = join_split(rows.select("row", "doc_id", "digest"), repeated, "digest").where(F.col("doc_id") > F.col("least"))
    late.select("row", F.lit(REPEATED).alias("filter")).write.mode("append").partitionBy("filter").parquet(f"{folder}/failures")
    failures = spark.read.schema("row long, filter string").parquet(f"{folder}/failures")
    names = [*filters, REPEATED]
    return rows.select("row", "doc_id", "part"), {n: failures.where(F.col("filter") == n).select("row") for n in names}


def prefix_counts(rows: DataFrame, failures: dict[str, DataFrame]) -> list[DataFrame]:
    """A frame for every set of filters and every filter, small plans each, with the same columns.

    Per part and set of filters (``passed``, a bit each): ``kept``, ``good``, ``toxic`` of the rows that no filter of the set fails.

    Per part and filter also the rows that fail it, in ``kept`` beside
    ``fails``, its place; there ``passed`` is null. Parts without such rows have
    no line. ``row`` is unique, so no join has a hot key, and all joins of a
    chain use one dealing of the rows.
    """
    names = list(failures)

    def counted(frame: DataFrame, passed: int | None, fails: int | None) -> DataFrame:
        return frame.groupBy("part").agg(
            F.lit(passed).cast("int").alias("passed"),
            F.lit(fails).cast("int").alias("fails"),
            F.count(F.lit(1)).alias("kept"),
            F.sum("good").alias("good"),
            F.sum("toxic").alias("toxic"),
        )

    left = {(): rows}
    found = [counted(rows, 0, None)]
    for size in range(1, len(names) + 1):
        for chosen in combinations(range(len(names)), size):
            left[chosen] = left[chosen[:-1]].join(failures[names[chosen[-1]]], "row", "left_anti")
            found.append(counted(left[chosen], sum(1 << i for i in chosen), None))
    for i, name in enumerate(names):
        found.append(counted(rows.join(failures[name], "row", "left_semi"), None, i))
    return found


def order_report(counts: DataFrame, names: list[str]) -> DataFrame:
    """``prefix_counts`` read as the steps of every order of the filters; zeros are rows, too."""
    n = len(names)
    entry = F.struct("kept", "good", "toxic")
    sets = F.map_from_entries(F.collect_list(F.when(F.col("passed").isNotNull(), F.struct("passed", entry))))
    single = F.map_from_entries(F.collect_list(F.when(F.col("fails").isNotNull(), F.struct("fails", "kept"))))
    parts = counts.groupBy("part").agg(sets.alias("sets"), single.alias("single"))

    def of(passed: Column | int, field: str) -> Column:
        passed = F.lit(passed) if isinstance(passed, int) else passed
        return F.coalesce(F.try_element_at("sets", passed)[field], F.lit(0).cast("long"))

    # In so many orders exactly the filters of a set come before a filter.
    shares = []
    for i in range(n):
        others = [x for x in range(n) if x != i]
        terms = [
            factorial(size) * factorial(n - 1 - size) * (of(low, "kept") - of(low | 1 << i, "kept"))
            for size in range(n)
            for chosen in combinations(others, size)
            for low in [sum(1 << x for x in chosen)]
        ]
        shares.append(sum(terms[1:], terms[0]))
    everything = (1 << n) - 1
    alone = [of(everything & ~(1 << i), "kept") - of(everything, "kept") for i in range(n)]
    parts = parts.select("part", "sets", "single", F.array(*shares).alias("shares"), F.array(*alone).alias("alone"))

    orders = F.split(F.lit(",".join("".join(p) for p in permutations(names))), ",")
    steps = parts.select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    places = [F.instr("filter_order", name) for name in names]
    before = sum((F.when(at < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, at in enumerate(places)), F.lit(0))
    here = F.instr(F.lit("".join(names)), F.expr("substring(filter_order, step, 1)")) - 1
    steps = steps.select("*", before.alias("before"), here.alias("here"))
    after = F.col("before").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("here")))
    removed = of(F.col("before"), "kept") - of(after, "kept")
    fails = F.coalesce(F.try_element_at("single", F.col("here")), F.lit(0).cast("long"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        of(after, "kept").alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        F.get("alone", F.col("here")).alias("unique_fails"),
        (of(F.col("before"), "good") - of(after, "good")).alias("good_lost"),
        (of(F.col("before"), "toxic") - of(after, "toxic")).alias("toxic_lost"),
        F.get("shares", F.col("here")).alias("shapley"),
    )


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant and lost.

    ``filters`` maps one-letter names to failure conditions on columns of
    ``docs``; a condition that is null is not met. The filter of repeated texts
    is always the last named. By default they are those of ``text_filters``.
    ``labels`` holds ``doc_id``, ``quality`` and ``toxic``; of repeated labels one
    that is 1 is enough, a null id has none. A null text is empty. Repeated rows
    count one by one, an empty table gives no rows, other columns are not read.

    The id tables are stored in the shared folder and removed when the counts
    are made, at once, one row per part and set of filters.
    """
    spark = docs.sparkSession
    if filters is None:
        docs = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text"), quoted(part).alias("part"))
        # A generator of one row, so that the measures are taken once and not by every filter.
        docs = docs.select("*", F.inline(F.array(F.struct(measures(text_of("text")).alias("measures")))))
        doc_id, text, part, filters = "id", "text", "part", text_filters(F.col("measures"))
    if len(filters) >= MOST_FILTERS or REPEATED in filters or any(len(n) != 1 for n in filters):
        raise ValueError(f"up to {MOST_FILTERS - 1} filters, named by one letter other than {REPEATED}")
    folder = new_folder(spark, "filter-audit")
    rows, failures = store_failures(docs, filters, folder, doc_id, text, part)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    marked = join_split(rows, marks, "doc_id", "left").select(
        "row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    marked.write.parquet(f"{folder}/marked")
    frames = prefix_counts(spark.read.parquet(f"{folder}/marked"), failures)
    for low in range(0, len(frames), AT_ONCE):
        # One plan of all sets would hold some eighty joins.
        some = reduce(DataFrame.unionByName, frames[low : low + AT_ONCE])
        some.write.mode("append").parquet(f"{folder}/counts")
    counts = cut(spark.read.parquet(f"{folder}/counts"))
    remove_folder(spark, folder)
    return order_report(counts, [*filters, REPEATED])


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on whole ``documents`` texts in all 120 orders, per source."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

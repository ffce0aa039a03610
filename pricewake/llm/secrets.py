"""Secret scans: stated patterns and sliding-window entropy, on built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm.common import columns_without, quoted, table, text_of

# The base patterns and the lengths they must reach.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
# A run of fewer characters cannot pass, and a run holds no second start that
# could, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"


@dataclass(frozen=True)
class EntropyRule:
    """Windows of ``window`` characters at or over their class's bits per character are secrets.

    A candidate is a run of at least ``window`` letters, digits and signs of
    ``+/_=-``. Its parts stand between the signs ``/``, ``=`` and ``_``; parts that
    ``allowed`` matches are blanked out, and what is left on either side is
    a candidate of its own. A window's class goes by its own characters: ``hex``
    if all are hexadecimal digits, ``mixed`` if there are letters and digits, else
    ``plain``; digits alone are no secret.
    """

    window: int = 20
    hex_bits: float = 3.05
    mixed_bits: float = 3.65
    plain_bits: float = 4.15
    allowed: tuple[str, ...] = (
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        r"(?i)example|sample|placeholder|dummy|changeme|your-|your$",
        r"^[+-]*$",
        r"^(0123456789|abcdefghij)",
    )

    alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

    @property
    def pattern(self) -> str:
        return f"[A-Za-z0-9+/_=-]{{{self.window},}}"


# The parts of a candidate and the signs between them.
PARTS = r"[A-Za-z0-9+-]+|[/=_]+"
# Elements that a fold copies again and again; see _running.
STRIDE = 256


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of the values (int, one or more) those before it combined, from 0.

    A fold that appends copies what it has at every step. Folding strides of the
    values, then one value per stride, keeps the copies short.
    """

    def before(xs: Column, first: Column) -> Column:
        start = F.array(first.cast("int"))
        return F.aggregate(xs, start, lambda done, x: F.array_append(done, combine(F.element_at(done, -1), x).cast("int")))

    def cut(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / STRIDE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * STRIDE + 1, F.lit(STRIDE)))

    def offset(strides: Column) -> Column:
        totals = F.transform(strides, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: combine(a, x).cast("int")))
        return F.struct(strides.alias("strides"), before(totals, F.lit(0)).alias("offsets"))

    def joined(x: Column) -> Column:
        each = lambda xs, b: F.slice(before(xs, F.get(x["offsets"], b)), F.lit(1), F.size(xs))
        return F.flatten(F.transform(x["strides"], each))

    # One-element arrays bind what is used more than once.
    strides = F.transform(F.array(values), cut)
    return F.get(F.transform(F.transform(strides, offset), joined), F.lit(0))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _placed(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Matches in order as structs (start, end, value); code points, end exclusive.

    What lies between the matches gives their places: the k-th starts after k + 1
    gaps and k matches.
    """
    found = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(_matches(text, pattern))).alias("gap"),
        _matches(text, pattern).alias("hit"),
        _matches(text, pattern, value_group).alias("value"),
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def sized(matches: Column) -> Column:
        sizes = F.transform(matches, lambda x: F.length(x["gap"]) + F.length(x["hit"]))
        return F.struct(matches.alias("matches"), _running(sizes, lambda a, b: a + b).alias("before"))

    def placed(x: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.get(x["before"], i) + F.length(m["gap"])
            return F.struct(start.alias("start"), (start + F.length(m["hit"])).alias("end"), m["value"].alias("value"))

        return F.transform(x["matches"], span)

    spans = F.get(F.transform(F.transform(F.array(found), sized), placed), F.lit(0))
    # Most texts hold no match: one search settles them.
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(empty)


def _gain(count: Column, rule: EntropyRule) -> Column:
    """f(c + 1) - f(c) with f(c) = c log2 c, from a table."""
    f = [0.0] + [c * math.log2(c) for c in range(1, rule.window + 2)]
    steps = F.array(*[F.lit(f[c + 1] - f[c]) for c in range(rule.window + 1)])
    return F.get(steps, count)


def _noisy_range(codes: Column, rule: EntropyRule) -> Column:
    """Ends of the first and the last window over its class's entropy, as (first, last); 0 for none.

    With counts c of the window's characters, entropy is log2 w - sum(c log2 c) / w.
    Moving the window by one adds one character and takes one away, so only two
    counts and two terms of the sum change, and likewise the numbers of letters,
    digits and hexadecimal digits. Each step judges the window that the step
    before completed, so that nothing is computed twice.
    """
    w = rule.window
    n = F.size(codes)
    kinds = {
        "letters": [c.isalpha() for c in rule.alphabet],
        "digits": [c.isdigit() for c in rule.alphabet],
        "hexes": [c in "0123456789abcdefABCDEF" for c in rule.alphabet],
    }
    start = F.struct(
        F.array_repeat(F.lit(0), len(rule.alphabet)).alias("counts"),
        F.lit(0.0).alias("sum"),
        *[F.lit(0).alias(k) for k in kinds],
        F.lit(0).alias("first"),
        F.lit(0).alias("last"),
    )

    def step(s: Column, i: Column) -> Column:
        bits = (
            F.when(s["hexes"] == w, rule.hex_bits)
            .when((s["digits"] > 0) & (s["letters"] > 0), rule.mixed_bits)
            .otherwise(rule.plain_bits)
        )
        ready = (i > w) & (s["digits"] < w) & (s["sum"] <= w * (math.log2(w) - bits) + 1e-9)
        new = F.get(codes, i - 1)
        old = F.when(i > w, F.get(codes, i - 1 - w)).otherwise(-1)
        counts = F.transform(
            s["counts"],
            lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0),
        )
        added = _gain(F.get(s["counts"], new), rule)
        taken = F.when(i > w, _gain(F.get(s["counts"], old) - 1, rule)).otherwise(0.0)

        def moved(kind: str) -> Column:
            is_one = F.array(*[F.lit(int(x)) for x in kinds[kind]])
            gone = F.when(i > w, F.get(is_one, old)).otherwise(0)
            return F.when(i <= n, s[kind] + F.get(is_one, new) - gone).otherwise(s[kind])

        return F.struct(
            F.when(i <= n, counts).otherwise(s["counts"]).alias("counts"),
            F.when((i > n) | (new == old), s["sum"]).otherwise(s["sum"] + added - taken).alias("sum"),
            *[moved(k).alias(k) for k in kinds],
            F.when(ready & (s["first"] == 0), i - 1).otherwise(s["first"]).alias("first"),
            F.when(ready, i - 1).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(F.sequence(F.lit(1), n + 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _noisy_spans(text: Column, rule: EntropyRule) -> Column:
    """Spans (start, end) of candidate strings with windows over the entropy of their class."""
    value = lambda x: x["value"]

    def is_allowed(part: Column) -> Column:
        found = F.lit(False)
        for pattern in rule.allowed:
            found = found | F.regexp_like(part, F.lit(pattern))
        return found

    def candidates(run: Column) -> Column:
        """The run itself, or what allowed parts leave of it."""
        parts = _matches(value(run), PARTS)
        blanked = F.array_join(F.transform(parts, lambda p: F.when(is_allowed(p), F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")

        def rest(x: Column) -> Column:
            return F.struct((run["start"] + x["start"]).alias("start"), (run["start"] + x["end"]).alias("end"), x["value"].alias("value"))

        found = F.transform(F.array(blanked), lambda b: F.transform(_placed(b, rule.pattern), rest))
        return F.get(found, F.lit(0))

    def coded(x: Column) -> Column:
        characters = F.filter(F.split(value(x), ""), lambda c: c != "")
        codes = F.transform(characters, lambda c: F.instr(F.lit(rule.alphabet), c) - 1)
        return F.struct(x["start"].alias("start"), codes.alias("codes"))

    def ranged(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), _noisy_range(x["codes"], rule).alias("r"))

    runs = F.filter(_placed(text, rule.pattern), lambda x: ~F.regexp_like(value(x), F.lit("^[0-9]+$")))
    words = F.flatten(F.transform(runs, candidates))
    ranges = F.filter(F.transform(F.transform(words, coded), ranged), lambda x: x["r"]["first"] > 0)
    return F.transform(
        ranges,
        lambda x: F.struct(
            (x["start"] + x["r"]["first"] - rule.window).alias("start"),
            (x["start"] + x["r"]["last"]).alias("end"),
            F.lit("").alias("value"),
        ),
    )


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(
        spans,
        lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")),
    )


def _spans(content: Column, rule: EntropyRule) -> Column:
    assign = F.filter(_placed(content, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_VALUE)
    return F.array_sort(
        F.concat(
            _tagged(assign, 0),
            _tagged(_placed(content, ACCESS), 1),
            _tagged(_placed(content, HEX), 2),
            _tagged(_noisy_spans(content, rule), 3),
        )
    )


def secret_spans(docs: DataFrame, text: str = "text", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """Every column of ``docs`` and ``secret_spans``: structs (start, kind, end) by start, then kind.

    ``kind`` is an index into KINDS; code points, end exclusive. Null or empty
    text: no spans. Other columns are passed through, whatever their names,
    unless one is called ``secret_spans`` in any case, which is replaced. Rows
    are handled one by one, so repeats and an empty table need no care, and
    nothing moves. Time grows with the text and its matches.
    """
    spans = _spans(text_of(quoted(text)), rule)
    return docs.select(*columns_without(docs, ["secret_spans"]), spans.alias("secret_spans"))


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for every group of spans that touch or overlap.

    Pieces are cut from four bytes a character, whose places need no search.
    """

    def pieces(x: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            at = F.get(x["ends"], i)
            between = F.decode(F.substring(x["wide"], 4 * at + 1, 4 * (span["start"] - at)), "UTF-32")
            return F.when((i == 0) | (span["start"] > at), F.concat(between, F.lit(mark))).otherwise("")

        end = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        rest = F.decode(F.substring(x["wide"], 4 * end + 1, F.octet_length(x["wide"])), "UTF-32")
        return F.concat(F.array_join(F.transform(x["spans"], piece), ""), rest)

    ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    parts = F.struct(F.encode(text, "UTF-32").alias("wide"), spans.alias("spans"), ends.alias("ends"))
    return F.get(F.transform(F.array(parts), pieces), F.lit(0))


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; spans that touch or overlap become one.

    Columns stay as they are, whatever their names; ``length``, where there is
    such a column, is counted anew for texts that changed. A null text stays null.
    """
    found = docs.select(F.struct("*").alias("row"), _spans(text_of(quoted(text)), EntropyRule()).alias("spans"))
    whole = F.col("row")[text]
    found = found.withColumn("clean", F.when(F.size("spans") > 0, _redacted(whole, F.col("spans"), mark)).otherwise(whole))

    def column(name: str) -> Column:
        if name == text:
            return F.col("clean").alias(name)
        old = F.col("row")[name]
        if name == length:
            counted = F.length("clean").cast(docs.schema[name].dataType)
            return F.when(F.size("spans") > 0, counted).otherwise(old).alias(name)
        return old.alias(name)

    return found.select(*map(column, docs.columns))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text of ``documents``."""
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
    )

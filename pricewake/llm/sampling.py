"""Bounded training samples, by hash of the id, so that a rerun draws the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels that are learned; a column that names thousands of them is no label.
MOST_LABELS = 500


def bounded_sample(rows: DataFrame, label: str, id_column: str, per_label: int, seed: int = 17) -> DataFrame:
    """About ``per_label`` rows of every label, all of them where there are fewer.

    Rows are kept whose hashed id falls under their label's share, so no label's
    rows ever meet in one task. The count is a random one around the bound (a
    tenth above it at most, for bounds of some hundred). Rows with a null label
    are left out, and those of any but the ``MOST_LABELS`` commonest labels.
    """
    named = rows.where(F.col(label).isNotNull())
    sizes = named.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(MOST_LABELS)
    shares = {r[label]: min(1.0, per_label / r["n"]) for r in sizes.collect()}
    if not shares:
        return named.limit(0)
    place = (F.xxhash64(F.lit(seed), F.col(id_column)).bitwiseAND(F.lit((1 << 53) - 1).cast("long"))) / float(1 << 53)
    share = F.lit(0.0)
    for value, part in shares.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(part)).otherwise(share)
    return named.where(place < share)

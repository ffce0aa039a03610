"""Shuffles sized by the input."""

from __future__ import annotations

import pytest

from checks import queries
from pricewake import session
from pricewake.operators.daily import daily_prices
from pricewake.sources import sample_tables

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.fixture
def restored(spark):
    """The session, its settings put back afterwards."""
    yield spark
    spark.conf.unset(INITIAL)


def _partitions(frame) -> set[int]:
    """Partition counts of all hash exchanges of a frame's first plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return {int(x.split("), ")[0].rsplit(", ", 1)[1]) for x in plan.split("hashpartitioning(")[1:]}


def test_shuffles_grow_with_the_input(restored, sf_dir, monkeypatch):
    def daily():
        products = sample_tables.products(restored, sf_dir)
        return daily_prices(products, sample_tables.price_history(restored, sf_dir))

    session.configure(restored, *sample_tables.paths(sf_dir))
    # Never fewer than the session has.
    assert _partitions(daily()) == {4}
    size = sum(session.stored_bytes(restored, path) for path in sample_tables.paths(sf_dir))
    for n in (9, 18):
        monkeypatch.setattr(session, "PARTITION_BYTES", size / n)
        session.configure(restored, *sample_tables.paths(sf_dir))
        assert _partitions(daily()) <= {n, n + 1} and daily().count() > 0


def test_size_of_inputs(restored, tmp_path):
    path = str(tmp_path / "folder")
    restored.range(100).repartition(3).write.parquet(path)
    files = sum(x.stat().st_size for x in (tmp_path / "folder").glob("*.parquet"))
    assert session.stored_bytes(restored, path) >= files > 0
    assert session.stored_bytes(restored, str(tmp_path / "missing")) == 0
    session.configure(restored, str(tmp_path / "missing"))
    assert restored.conf.get(INITIAL) == "4"


def test_every_query_sizes_its_shuffles(restored, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "PARTITION_BYTES", 1000)
    frame = queries.run("spec_features", restored, sf_dir)
    assert min(_partitions(frame)) > 100
    assert restored.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


@pytest.mark.parametrize("name", ["fit_metrics", "fit_gap"])
def test_reports_of_both_categories_fold_the_prices_once(restored, sf_dir, monkeypatch, name):
    passes = []

    def counted(products, prices, category=None, **options):
        passes.append(category)
        return daily_prices(products, prices, category, **options)

    monkeypatch.setattr(queries, "daily_prices", counted)
    monkeypatch.setattr(queries.plans, "daily_prices", counted)
    found = queries.run(name, restored, sf_dir).collect()
    assert {r["category"] for r in found} == {"mobile", "tablet"}
    assert passes == [None]

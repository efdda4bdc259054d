"""Queries over whole tables: every row of the tables counts, and the walk has no bound of its own."""

import datetime

import pytest

from impactlake.plans import catalogue


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    day = datetime.date(2020, 1, 1)
    part = [(i, f"n{i}", "B1" if i < 20 else f"B{i % 3}", "STEEL", i % 40 + 1) for i in range(1, 61)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(1, "AUTOMOBILE"), (2, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(i, 1 + i % 2, day, 1.0) for i in range(1, 61)], "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(i, 1, i, "A", "F") for i in range(1, 61)], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string").write.parquet(f"{path}/lineitem.parquet")
    return path


def test_every_test_is_asked(spark, folder):
    got = {int(r.test_id.rpartition("o")[2]) for r in catalogue.queries()["sources_from_tests"](spark, folder).collect()}
    assert got == set(range(1, 61))


def test_every_part_counts(spark, folder):
    got = {r.symbol: r.p_brand for r in catalogue.queries()["ambiguity_poison"](spark, folder).collect()}
    assert got == {**{i: "B1" for i in range(10)}, 30: "B0"}


def test_walk_takes_the_default_depth(spark, folder, monkeypatch):
    seen = {}
    monkeypatch.setattr(catalogue, "derive", lambda *a, **k: seen.update(k) or spark.createDataFrame([], "test_id string, source string, confidence double, partial boolean, provenance array<string>"))
    monkeypatch.setattr(catalogue.G, "facts_and_links", lambda *a: (None, None))
    catalogue.queries()["traverse_edges"](spark, folder)
    assert "max_depth" not in seen

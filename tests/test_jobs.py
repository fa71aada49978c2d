"""Queries on a few rows, all of small quantity."""

from __future__ import annotations

import pytest

from weftline.jobs.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two orders: parts 9, 7, 5, 3 and 1 one after the other, and part 9 before part 4."""
    found = str(tmp_path_factory.mktemp("tables"))
    lines = [(1, p, 1, i, 1.0) for i, p in enumerate((9, 7, 5, 3, 1), 1)] + [(2, 9, 1, 1, 1.0), (2, 4, 1, 2, 1.0)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"),
        "orders": ([(1, 1), (2, 1)], "o_orderkey long, o_custkey long"),
        "supplier": ([(1, 0)], "s_suppkey long, s_nationkey int"),
        "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{found}/{name}.parquet")
    return found


def test_heaviest_counts_links_and_orders(spark, folder):
    found = {r.id: r.transitive_dep_count for r in QUERIES["a8_heaviest"](spark, folder).collect()}
    assert (found["l9"], found["l7"], found["l4"]) == (5, 3, 0)
    assert (found["c1"], found["o2"]) == (11, 5)


def test_critical_chain_of_all_links(spark, folder):
    assert [r.id for r in QUERIES["g8_critical_chain"](spark, folder).orderBy("position").collect()] == [9, 7, 5, 3, 1]


def test_dependencies_over_all_links(spark, folder):
    found = [tuple(r) for r in QUERIES["g10_dependencies"](spark, folder).collect()]
    chain = [(9, 7), (7, 5), (5, 3), (3, 1)]
    assert sorted(found) == sorted([(9, 9, 4)] + [(s, a, b) for s in (9, 7, 5, 3) for a, b in chain if a <= s])


def test_removals_name_their_orphans(spark, folder):
    found = {r.removed_id: (r.orphaned, r.orphaned_count, r.affected_edges) for r in QUERIES["g12_simulate_removal"](spark, folder).collect()}
    assert found == {9: ("1, 3, 4, 5, 7", 5, 2), 7: ("1, 3, 5", 3, 2), 5: ("1, 3", 2, 2), 3: ("1", 1, 2), 1: ("", 0, 1), 4: ("", 0, 1)}


def test_roots_of_links_and_orders_are_ranked(spark, folder):
    found = [(r.rank, r.id, r.reach, r.is_main) for r in QUERIES["g13_rank_roots"](spark, folder).orderBy("rank").collect()]
    assert found == [(1, "c1", 12, True), (2, "l9", 6, False)]


def test_dependencies_over_orders_too(spark, folder):
    found = {tuple(r) for r in QUERIES["g10_dependencies_orders"](spark, folder).collect()}
    assert {("c1", "c1", "o1"), ("c1", "o2", "p4"), ("c1", "p9", "s1"), ("c1", "n0", "r0"), ("o1", "o1", "p1"), ("o1", "s1", "n0")} <= found
    assert ("o2", "o2", "p7") not in found and all(r[0][0] in "copsnr" for r in found)

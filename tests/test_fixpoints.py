"""Loops over graphs against brute force: levels, counts, dominators, chains and deviations on many random graphs at once."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph import frames, reached, rows, simple_paths

from weftline.functions.lineage import Pile, cut
from weftline.operators import fixpoint, impact, paths


def many_graphs(seed, graphs, most_nodes, dense=3):
    """Edges of graphs side by side, nodes of graph k from 100 * k."""
    rnd = random.Random(seed)
    out = []
    for k in range(graphs):
        n = rnd.randrange(3, most_nodes)
        out.append({(100 * k + rnd.randrange(n), 100 * k + rnd.randrange(n)) for _ in range(rnd.randrange(n, dense * n))})
    return out


def test_peeled_levels(spark):
    edges = [e for own in many_graphs(1, 20, 12, 2) for e in own] + [(5000 + k, 5001 + k) for k in range(12)] + [(5000, 5012)]
    v, e = frames(spark, edges, alone=[9000])
    ids = {x for p in edges for x in p} | {9000}
    level: dict = {}
    while True:
        new = {x for x in ids - set(level) if all(a in level for a, b in edges if b == x)}
        if not new:
            break
        level |= {x: max((level[a] + 1 for a, b in edges if b == x), default=0) for x in new}
    assert rows(fixpoint.topo_levels(v, e), "id", "level") == {(x, level.get(x)) for x in ids}
    # from some starts only: null where none of them leads
    starts = {x for x, n in level.items() if n == 0 and x % 2 == 0}
    far: dict = {}
    for x in sorted(level, key=level.get):
        told = [far[a] + 1 for a, b in set(edges) if b == x and far.get(a) is not None]
        far[x] = 0 if x in starts else max(told, default=None)
    assert rows(fixpoint.peel(v, e, spark.createDataFrame([(x,) for x in starts], "id long")), "id", "level") == set(far.items())


@pytest.mark.parametrize(("few", "room", "cycles"), [(1024, 16, True), (3, 100, True), (1024, 0, True), (2, 100, False)])
def test_counts_by_rows_and_bits(spark, monkeypatch, few, room, cycles):
    edges = [e for own in many_graphs(2, 12, 12) for e in own] + [(7000, 7001 + k) for k in range(9)] + [(7001 + k, 7100) for k in range(9)] + [(7100, 7000)]
    edges = edges if cycles else [(max(x), min(x)) for x in edges if x[0] != x[1]]
    v, e = frames(spark, edges, alone=[9000])
    monkeypatch.setattr(fixpoint.short_reach, "__defaults__", (few, room))
    ids = {x for p in edges for x in p} | {9000}
    assert rows(fixpoint.transitive_dep_count(v, e, few), "id", "transitive_dep_count") == {(x, len(reached(edges, [x])) - 1) for x in ids}


def test_dominators(spark):
    edges, starts, want, rnd = [], [], {}, random.Random(4)
    for k, own in enumerate(many_graphs(3, 60, 13)):
        first = sorted({100 * k + rnd.randrange(3) for _ in range(2)})
        edges += own
        starts += [(k, x) for x in first]
        base = reached(own, first)
        want |= {(k, x): {d for d in base if d == x or x not in reached(own, first, d)} for x in base}
    got = {(r.key, r.id): r.path for r in impact.dominator_paths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(starts, "key long, id long")).collect()}
    assert {k: set(p) for k, p in got.items()} == want
    # in order: what is above a node has the way up to it
    assert all(p[-1] == x and all(got[k, y] == p[: n + 1] for n, y in enumerate(p)) for (k, x), p in got.items())


def test_removal_of_a_hub(spark):
    # one node that holds a third of all nodes, most of them at once below it
    edges = [(0, 1)] + [(1, 10 + k) for k in range(300)] + [(0, 1000 + k) for k in range(600)] + [(10, 2000), (11, 2000), (2000, 2001), (2001, 2000)]
    v, e = frames(spark, edges)
    figures, orphans = impact.simulate_removal(v, e, spark.createDataFrame([(1,), (2000,), (0,), (77_777,)], "id long"))
    assert rows(figures, "removed_id", "orphaned_count", "affected_edges", "savings", "deps_before") == {(1, 302, 301, 303, 904), (2000, 1, 4, 2, 904), (0, 903, 601, 904, 904), (77_777, 0, 0, 0, 904)}
    assert orphans.where("removed_id = 1").count() == 302 and rows(orphans.where("removed_id = 2000"), "id") == {(2001,)}


def test_a_long_chain(spark):
    n = 5000
    e = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(k, k + 2) for k in range(0, n - 2, 3)], "src long, dst long")
    chain = fixpoint.critical_chain(e, spark.range(n + 1).select("id", F.col("id").cast("int").alias("depth")))
    assert [tuple(r) for r in chain.orderBy("position").collect()] == [(k, k) for k in range(n + 1)]
    assert fixpoint.critical_chain(e, spark.createDataFrame([(1, 0)], "id long, depth int")).count() == 0


def test_deviations_on_cycles(spark):
    edges, asked, want, rnd = [], [], {}, random.Random(6)
    for k in range(16):
        n = rnd.randrange(4, 9)
        own = {(100 * k + rnd.randrange(n), 100 * k + rnd.randrange(n)) for _ in range(rnd.randrange(n, 4 * n))}
        edges += own
        asked.append((k, 100 * k, 100 * k + n - 1))
        want[k] = simple_paths(own, 100 * k, 100 * k + n - 1)[:4]
    e = cut(spark.createDataFrame(edges, "src long, dst long"))
    got = {k: [] for k in want}
    for r in sorted(paths.k_shortest_paths(spark.createDataFrame(asked, "pair_id long, src long, dst long"), e, 4).collect(), key=lambda r: r["rank"]):
        got[r.pair_id].append(r.path)
    assert got == want


def test_shortest_path_without_edges_and_nodes(spark):
    e = spark.createDataFrame([(1, 2), (2, 9), (1, 3), (3, 9), (1, 4), (4, 5), (5, 9)], "src long, dst long")
    asked = spark.createDataFrame([(1, 1, 9), (2, 1, 9), (3, 1, 9), (4, 1, 9)], "pair_id long, src long, dst long")
    barred = spark.createDataFrame([(2, 1, 2), (3, 1, 2), (3, 3, 9)], "pair_id long, src long, dst long")
    blocked = spark.createDataFrame([(1, 9), (4, 2), (4, 3)], "pair_id long, id long")
    got = paths.shortest_paths(asked, e, blocked=blocked, barred=barred)
    assert {r.pair_id: r.path for r in got.collect()} == {1: [1, 2, 9], 2: [1, 3, 9], 3: [1, 4, 5, 9], 4: [1, 4, 5, 9]}
    most = spark.createDataFrame([(3, 2), (4, 3)], "pair_id long, most int")
    assert {r.pair_id: len(r.path) for r in paths.shortest_paths(asked, e, blocked=blocked, barred=barred, most=most).collect()} == {1: 3, 2: 3, 3: 0, 4: 4}


def test_pile_keeps_everything(spark):
    pile = Pile()
    for k in range(70):
        pile.add(spark.createDataFrame([(k,)], "k long"))
    assert sorted(r.k for r in pile.all().collect()) == list(range(70)) and len(pile._steps) == 3


def test_counts_of_deep_and_shallow_parts(spark, monkeypatch):
    # a deep part, a deep one with a cycle, a cycle by itself and shallow parts side by side
    rnd = random.Random(7)
    deep = {(a, a - 1) for a in range(1, 60)} | {tuple(sorted((rnd.randrange(60), rnd.randrange(60)), reverse=True)) for _ in range(90)}
    turned = {(200 + a, 199 + a) for a in range(1, 40)} | {(205, 230), (300, 220)}
    shallow = {(400 + a, 500 + a % 5) for a in range(30)} | {(500 + a, 600) for a in range(5)}
    edges = sorted(deep | turned | shallow | {(700, 701), (701, 700), (701, 702)})
    v, e = frames(spark, edges, alone=[9000])
    want = {(x, len(reached(edges, [x])) - 1) for x in {x for p in edges for x in p} | {9000}}
    assert rows(fixpoint.transitive_dep_count(v, e), "id", "transitive_dep_count") == want
    # parts too large for a group
    monkeypatch.setattr(fixpoint, "LOCAL_NODES", 10)
    assert rows(fixpoint.transitive_dep_count(v, e), "id", "transitive_dep_count") == want


@pytest.mark.parametrize("columns", [64, 128, 8192])
def test_counts_by_columns(columns):
    rnd = random.Random(8)
    edges = sorted({(max(a, b), min(a, b)) for a, b in ((rnd.randrange(300), rnd.randrange(300)) for _ in range(900)) if a != b})
    src, dst = (np.array(side) for side in zip(*edges, strict=True))
    ids = sorted({x for p in edges for x in p})
    parts = [fixpoint._column_counts(c, src, dst, columns) for c in range(-(-len(ids) // columns))]
    assert all(part[0].tolist() == ids for part in parts)
    assert sum(part[1] for part in parts).tolist() == [len(reached(edges, [x])) for x in ids]
    assert fixpoint._column_counts(0, np.array([1, 2, 3]), np.array([2, 3, 2]), columns)[1] is None


def test_closure_by_packed_rows(spark):
    rnd = random.Random(9)
    edges = [(f"{'abcd'[k]}{rnd.randrange(200)}", f"{'abcd'[k + 1]}{rnd.randrange(200)}") for k in range(3) for _ in range(300)] + [("a1", "d1"), ("a1", "d1")]
    e = spark.createDataFrame(edges, "src string, dst string")
    want = {(x, y) for x in {x for p in edges for x in p} for y in reached(edges, [x]) if x != y}
    found = [tuple(r) for r in fixpoint.closure(e).collect()]
    assert len(found) == len(want) and set(found) == want
    # on a cycle as before
    assert rows(fixpoint.closure(e.unionByName(spark.createDataFrame([("z", "y"), ("y", "z"), ("z", "z")], e.schema)).where("src >= 'y'")), "src", "dst") == {("z", "y"), ("y", "z")}


@pytest.mark.parametrize("backward", [False, True])
def test_dependencies_of_many_starts(spark, backward):
    edges = [x for own in many_graphs(10, 20, 12) for x in own]
    starts = sorted({x for p in edges for x in p})[:150]
    _, e = frames(spark, edges)
    turned = [(b, a) for a, b in edges] if backward else edges
    got = {s: reached(turned, [s]) for s in starts}
    nodes, links = fixpoint.dependencies(e, spark.createDataFrame([(s,) for s in starts], "id long"), backward)
    assert sorted(tuple(r) for r in nodes.select("start", "id").collect()) == sorted((s, x) for s in starts for x in got[s])
    assert sorted(tuple(r) for r in links.select("start", "src", "dst").collect()) == sorted((s, a, b) for s in starts for a, b in set(edges) if (b if backward else a) in got[s])


def test_layers_with_and_without_cycles(spark):
    for more in ([], [(4, 1)]):
        v, e = frames(spark, [(0, 1), (1, 2), (2, 4), (0, 4), (4, 5), (6, 5), *more], alone=[9])
        depths, phases, acyclic = fixpoint.layers(v, e)
        assert acyclic is not bool(more)
        assert rows(depths, "id", "depth") == rows(fixpoint.depth(v, e), "id", "depth") and rows(phases, "id", "build_phase") == rows(fixpoint.build_phase(v, e), "id", "build_phase")

"""Neighbours and whitening against brute force: odd vectors, ties, repeated ids, clashing names."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import neighbours, whitening

SHAPE = "vec_id long, embedding array<float>, id string, v int, row int, x int"
ODD = [None, [], [None, 1.0, 0.0, 0.0], [math.nan, 1.0, 0.0, 0.0], [math.inf, 1.0, 0.0, 0.0]]


def table(spark, vectors):
    rows = [(i, None if v is None else [x if x is None else float(x) for x in v], "a", 1, 2, 3) for i, v in vectors]
    return spark.createDataFrame(rows, SHAPE)


def some(n, dims, seed=0):
    rnd = np.random.default_rng(seed)
    return rnd.normal(size=(n, dims)).astype(np.float32)


def brute(vectors, asked, k):
    out = {}
    for q, (i, a) in enumerate(vectors):
        if not asked(i):
            continue
        a = np.asarray(a, float)
        told = []
        for p, (j, b) in enumerate(vectors):
            if p != q:
                b = np.asarray(b, float)
                told.append((-float((b * a).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum()))), j is None, j or 0))
        out.setdefault(i, []).append([(j if not none else None, -s) for s, none, j in sorted(told)[:k]])
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 64)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    v = [(k, list(x)) for k, x in enumerate(some(400, 12))]
    v += [(400 + k, v[7][1]) for k in range(150)] + [(600, [0.0] * 12), (601, [1.0, 2.0]), (None, v[7][1])] + [(700 + k, [*x, *[0.0] * 8] if x else x) for k, x in enumerate(ODD)]
    want = brute([x for x in v if x[0] is None or x[0] < 600], lambda i: i is not None and i % 50 == 0, 5)
    got = found(neighbours.nearest(table(spark, v), F.col("id") % 50 == 0))
    exact = found(neighbours.nearest(table(spark, v), F.col("id") % 50 == 0, exact=True))
    assert {q: [(i, pytest.approx(s, abs=1e-12)) for _, i, s in rows] for q, rows in exact.items()} == {q: rows[0] for q, rows in want.items()}
    same = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q][0]}) for q in want)
    assert set(got) == set(want) and all([r for r, *_ in x] == [1, 2, 3, 4, 5] for x in got.values()) and same >= 0.9 * 5 * len(want)
    # the copies of a query are its nearest, by id
    assert [i for _, i, _ in got[400]] == [7, 401, 402, 403, 404]


def test_every_code_within_a_radius_is_found():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 16, (20, neighbours.PARTS), dtype=np.uint16)
    codes = np.concatenate([base, *(base ^ (np.uint16(1) << rnd.integers(0, 16, base.shape).astype(np.uint16)) * (rnd.random(base.shape) < 0.5).astype(np.uint16) for _ in range(20))])
    tables = neighbours.Tables(codes)
    for radius in (0, 3, 7, 8, 20, 45, 60, 127, 128):
        for code in codes[::60]:
            far = np.bitwise_count(codes ^ code).sum(axis=1)
            assert tables.within(code, radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_few_and_far_neighbours(spark):
    two = found(neighbours.nearest(table(spark, [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (50, [0.0, 2.0])]), F.col("id") % 50 == 0))
    assert two == {0: [(1, 50, 0.0), (2, 1, -1.0)], 50: [(1, 0, 0.0), (2, 1, 0.0)]}
    assert neighbours.nearest(table(spark, [(0, [1.0, 0.0])]), F.col("id") % 50 == 0).count() == 0
    assert neighbours.nearest(table(spark, [(0, x) for x in ODD]), F.col("id") % 50 == 0).count() == 0
    assert neighbours.nearest(table(spark, []), F.col("id") % 50 == 0).count() == 0
    # one's own row is left out, others of the same id are not; long vectors are whole
    long = [(0, list(some(1, 300)[0])), (0, list(some(1, 300, 1)[0])), (3, list(some(1, 300, 2)[0]))]
    told = neighbours.nearest(table(spark, long), F.col("id") == 0).collect()
    assert sorted((r.query_id, r.id) for r in told) == [(0, 0), (0, 0), (0, 3), (0, 3)]


def whole(v):
    return [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in x] for x in v]


def test_whitening_against_numpy(spark):
    v = some(300, 40) * np.linspace(1, 3, 40, dtype=np.float32)
    rows = [(k % 250, list(x)) for k, x in enumerate(v)] + [(900 + k, [*x, *[0.0] * 36] if x else x) for k, x in enumerate(ODD)] + [(None, [1.0, 2.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 300 * 32 and {r.n for r in got} == {300} and {r.component for r in got} == set(range(1, 33))
    x = np.array(whole(v))
    d = x - x.sum(axis=0) / 300
    e, w = np.linalg.eigh(d.T @ d / 300)
    e, w = e[::-1], w[:, ::-1]
    want = d @ w[:, :32] / np.sqrt(e[:32])
    dev = [sum((300 * int(c) - int(s)) ** 2 for c, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    told = sorted((r.component, Decimal(r.deviation), r.id, abs(r.whitened)) for r in got)
    hoped = sorted((c + 1, Decimal(dev[k]), k % 250, abs(want[k, c])) for k in range(300) for c in range(32))
    assert [t[:3] for t in told] == [h[:3] for h in hoped] and np.allclose([t[3] for t in told], [h[3] for h in hoped], atol=1e-7)
    # either sign, but the same for all rows
    first = {(r.id, r.deviation): r.whitened for r in got if r.component == 1}
    mine = {(k % 250, Decimal(dev[k])): want[k, 0] for k in range(300)}
    assert len({np.sign(first[k] * mine[k]) for k in first}) == 1
    assert all(abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 for r in got) and {r.identity_error for r in got}.pop() < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, x) for x in ODD])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(table(spark, [(k, [k, 5.0, -k]) for k in range(4)])).collect()
    assert len(flat) == 4 and all(r.component == 1 and abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in flat)
    far = whitening.whiten(table(spark, [(k, [3e38 * (k - 1), k]) for k in range(3)])).collect()
    assert {r.component for r in far} == {1} and {r.id for r in far} == {0, 1, 2}

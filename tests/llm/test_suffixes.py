"""Shards of the suffix arrays."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from weftline.functions.lineage import shared_dir
from weftline.llm import suffixes


@pytest.mark.parametrize("dealt", [False, True])
def test_shards_of_one_anchor_are_bounded_by_bytes(monkeypatch, dealt):
    rng, length = random.Random(3), 8
    pool = [rng.randbytes(12) for _ in range(10)]
    rows = sorted((key, 0, dealt, key, k, rng.choice(pool)[rng.randrange(4) :] + rng.randbytes(8)) for key, n in ((1, 2), (2, 40), (3, 2)) for k in range(n))
    sizes, repeated = [], suffixes.repeated
    monkeypatch.setattr(suffixes, "repeated", lambda parts, length: sizes.append(sum(map(len, parts))) or repeated(parts, length))
    got = [r for b in suffixes._sort_shards(length, 1000, 100)(iter([suffixes._batch(suffixes._CONTEXT, rows)])) for r in b.to_pylist()]
    assert max(sizes) <= 100 < sum(len(r[5]) for r in rows if r[0] == 2)
    places = {}
    for _, _, _, key, k, data in rows:
        if key == 2:
            for at in range(len(data) - length + 1):
                places.setdefault(data[at : at + length], []).append((k, at))
    want = {(k, q) for found in places.values() if len(found) > 1 for k, at in found for q in range(at, at + length)}
    assert {(r["c2"], q) for r in got if r["ranges"] is not None and r["c1"] == 2 for x in r["ranges"] for q in range(x["a"], x["b"])} == want
    named = {(r["c2"], r["at"]) for r in got if r["w1"] is not None and r["c1"] == 2}
    assert bool(named) == dealt
    if dealt:
        assert {found[0] for found in places.values() if len(found) == 1} <= named


def test_tables_of_all_places_are_removed(spark):
    text = " ".join(map(str, range(300)))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, "other")], "doc_id long, text string")
    shared_dir(spark)  # the first call makes a folder, in which Spark takes one
    folder = Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    before = set(folder.glob("occurrences-*")) | set(folder.glob("word-runs-*"))
    found = {r["id"]: (r["n_bytes"], len(r["kept"]), r["passage"]) for r in suffixes.without_repeats(docs, words=suffixes.PASSAGE).collect()}
    assert found == {1: (len(text), 0, True), 2: (len(text) + 2, 2, True), 3: (5, 5, False)}
    assert set(folder.glob("occurrences-*")) | set(folder.glob("word-runs-*")) == before

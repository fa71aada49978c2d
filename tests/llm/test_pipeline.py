"""Stages of the pipeline on small tables against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
from weftline.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], COLUMNS)


def test_near_copies(spark):
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(1 << 30)}"

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    texts = []
    for group in range(6):
        base = [word() for _ in range(300)]
        texts.append((100 * group, " ".join(base)))
        for differ in range(1, 12):
            changed = {25 * k + rnd.randrange(20) for k in range(differ)}
            texts.append((100 * group + differ, " ".join(word() if k in changed else w for k, w in enumerate(base))))
    rnd.shuffle(texts)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, texts), "").collect()}
    sets = {i: shingles(t) for i, t in texts}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert got == {i for i in sets if not any(j < i and alike(i, j) for j in sets)}
    assert {i % 100 for i in got} > {0}


def test_near_copies_of_odd_rows(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    texts = [(None, a), (None, a), (None, b), (1, a), (2, c), (2, c), (2, "x y"), (3, "x y"), (4, None), (5, " ")]
    got = corpus_pipeline.near_dedup(spark, docs(spark, texts), "").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in got) == [(False, 0, a), (False, 0, b), (True, 2, c), (True, 2, "x y"), (True, 4, "")]


def test_short_lines_go(spark, tmp_path):
    texts = [(1, "Home\nAll rights reserved\none two three four five six"), (2, "Home\nAbout us\nreserved rights All"), (3, "About us\n\nHome "), (None, "Home\nfirst here"), (None, "only here\nsecond here")]
    table = docs(spark, texts)
    left = corpus_pipeline.line_dedup(spark, table, "")
    assert left.columns == table.columns
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in left.collect()) == sorted((i, t, len(t)) for i, t in [
        (0, "Home\nfirst here"), (0, "only here\nsecond here"), (1, "All rights reserved\none two three four five six"), (2, "About us"), (3, ""),
    ])
    table.where("doc_id > 0").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.removed) for r in queries.op5_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (3, ""), 2: (3, "0,2"), 3: (3, "0,2")}


def test_lines_of_null_ids(spark):
    texts = [(None, "a b c d e f\nclean line of its own here"), (None, "clean words that stand nowhere else\na b c d e f"), (1, "x y z\na b c d e f")]
    got = [r.text for r in corpus_pipeline.line_dedup(spark, docs(spark, texts), "").collect()]
    assert len(got) == 3 and "x y z" in got
    assert sum("a b c d e f" in t for t in got) == 1 and sum("clean line of its own here" in t or "clean words that stand nowhere else" in t for t in got) == 2

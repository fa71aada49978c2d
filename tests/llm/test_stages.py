"""Stages one by one, and operators on pages and conversations: empty tables, clashing names, long texts, ties, repeated rows."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from weftline.llm import chat, urls

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key int, found string, row int, removed int, ids int, decoded string, id string, overlaps int"
KEPT = [f.split()[0] for f in COLUMNS.split(", ")]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "f", 2, 3, 4, "d", "i", 5) for i, t in texts], COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    item = " ".join(f"item{k}" for k in range(40))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def prose(seed, n=120):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(n))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_each_stage(spark, folder, name, stage):
    none = stage(spark, docs(spark, []), folder)
    assert none.count() == 0
    passage = " ".join(f"item{k}" for k in range(5, 38))
    texts = [(1, prose(1)), (2, prose(2)), (2, prose(2)), (None, prose(3)), (4, prose(4) + " " + passage + " " + prose(5)), (5, prose(6, 30_000)), (6, None), (7, "")]
    got = stage(spark, docs(spark, texts), folder).collect()
    of = sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    first = [(False, 0), (True, 1), (True, 2)]
    if name == "quality rules":
        assert of == [*first, (True, 2), (True, 4), (True, 5)]
    elif name == "SimHash near-dedup":
        assert of == [*first, (True, 4), (True, 5), (True, 6)]
    elif name == "benchmark decontamination":
        assert of == [*first, (True, 2), (True, 5), (True, 6), (True, 7)]
    else:
        assert of == [*first, (True, 2), (True, 4), (True, 5), (True, 6), (True, 7)]
    if name != corpus_pipeline.STAGES[-1][0]:
        assert none.columns == KEPT and all(r.asDict() | {"n_chars": 0} in [x.asDict() | {"n_chars": 0} for x in docs(spark, texts).collect()] or name == "line dedup" for r in got)
        assert all((r.key, r.found, r.row, r.removed, r.ids, r.decoded, r.id, r.overlaps) == (1, "f", 2, 3, 4, "d", "i", 5) for r in got)
    else:
        assert {r.doc_id: r.n_tokens for r in got}[7] == 1 and max(r.n_tokens for r in got) > 30_000


def test_pages(spark):
    rules = (("allow", "org", "/"), ("block", "bad.org", "/"))
    shape = "page_id long, url string, html string, host int, rule string"
    assert urls.judge(spark.createDataFrame([], shape), rules).count() == 0
    rows = [(1, "http://A.bad.org/x", "", 1, ""), (1, "http://A.bad.org/x", "", 1, ""), (2, None, None, 1, ""), (3, "nothing", "", 1, ""), (None, "http://x.org?q", "<a href='http://bad.org/'>" * 2000, 1, "")]
    got = sorted((r.id or 0, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, shape), rules).collect())
    assert got == [(0, "x.org", "", None, "allow"), (1, "a.bad.org", "/x", "bad.org/", "block"), (1, "a.bad.org", "/x", "bad.org/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow")]


def test_conversations(spark):
    shape = "conv_id long, turn int, role string, text string, segments int, moves string"
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], shape))).count() == 0
    long = "x <|im_end|> \\ " * 20_000
    # equal turns go by role, then text; repeated rows are turns of their own; a null id is an id
    rows = [(1, 2, "user", "b", 1, ""), (1, 2, "user", "a", 1, ""), (1, 2, "assistant", "z", 1, ""), (1, 2, "assistant", "z", 1, ""), (None, 1, "user", long, 1, ""), (None, 2, "assistant", long, 1, ""), (2, None, None, None, 1, "")]
    talks = chat.format_conversations(spark.createDataFrame(rows, shape))
    text = {r.id: r.f for r in talks.select("id", chat.formatted().alias("f")).collect()}
    assert [x.split("\n", 1)[0] + ":" + x.split("\n", 1)[1][0] for x in text[1].split("<|im_start|>")[1:]] == ["assistant:z", "assistant:z", "user:a", "user:b"]
    told = {r.id: r for r in chat.digests(talks).collect()}
    assert (told[None].n_turns, told[None].loss_chars, told[None].valid, told[1].n_turns, told[1].valid, told[2].n_turns) == (2, len(long), True, 4, False, 1)

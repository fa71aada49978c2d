"""Collocations against brute force: hot pivots, blanks, repeats, odd texts, clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from weftline.llm import phrases

SHAPE = "doc_id long, text string, lang string, phrase string, n long, a int, bucket int"


def brute(rows, least=30, top=2000):
    f, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        own = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            own.update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = []
    for lang, own in f.items():
        many = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in many.items():
            for part in {p[i : i + n] for n in range(2, len(p)) for i in range(len(p) - n + 1)}:
                longer[part] = max(longer[part], a)
        told = []
        for p, a in many.items():
            if 100 * longer[p] < 80 * a:
                score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                told.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(told)[:top])]
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    weights = [1 / (k + 1) for k in range(60)]
    names = ["The", "of", "é", "ß", "Ä", "a\x00b", "x|y", " ", "�"] + [f"w{k}" for k in range(51)]
    rows = []
    for k in range(150):
        w = rnd.choices(names, weights, k=rnd.randrange(0, 90))
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w) + 1) : 0] = ["hot", "hot", "hot", "pair"] if k % 3 else ["rare", "rare", "thing", f"once{k}"]
        rows.append(("".join(x + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "\x0b"]) for x in w), ["en", "de", None][k % 3]))
    return rows + [(None, "en"), ("", "en"), (" \t\n", None), ("...", "fr"), ("one two", "xx")] + [("same words here again " * 20, "en")] * 3 + [("a" * 3000 + " b", "en")]


@pytest.mark.parametrize(("hot", "chunk", "buckets"), [(1 << 16, 1 << 22, 1 << 21), (40, 700, 1 << 21), (0, 90, 64), (200, 4000, 1)])
def test_against_brute_force(spark, hot, chunk, buckets):
    rows = corpus(1)
    sizes = phrases.Sizes(buckets, hot, chunk)
    df = spark.createDataFrame([(k, t, lang, "p", 1, 2, 3) for k, (t, lang) in enumerate(rows)], SHAPE).repartition(3)
    got = sorted(map(tuple, phrases.collocations(df, least=8, sizes=sizes).collect()))
    assert got == brute(rows, 8) and len(got) > 50
    assert sorted(map(tuple, phrases.collocations(df, top=7, sizes=sizes).collect())) == brute(rows, top=7)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], SHAPE)
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", 1, 1, 1), (2, "a b", "en", "", 1, 1, 1)], SHAPE)).count() == 0


def test_one_very_long_text(spark):
    rnd = random.Random(2)
    text = " ".join(rnd.choice(["a", "b", "c", "d."]) for _ in range(60_000)) + " " + "e " * 40_000
    df = spark.createDataFrame([(1, text, "en", "", 1, 1, 1)], SHAPE)
    assert sorted(map(tuple, phrases.collocations(df, sizes=phrases.Sizes(chunk=10_000)).collect())) == brute([(text, "en")])

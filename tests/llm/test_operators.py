"""Operators on small tables against brute force: nulls, empty and repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat, decontam, lines, pieces, pii, quality, simhash, suffixes, text, urls, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id long, text string, lang string, source string, id string, k long, text2 string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1, "y") for i, t in texts], COLUMNS)


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(1)
    words = [rnd.choice(["the", "of", "and", "w%d" % rnd.randrange(300)]) for _ in range(400)]
    base = [" ".join(words[k : k + 25]) for k in range(0, 375, 25)]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, base[0]), (3, base[0]), (None, base[1]), (5, "\n".join(base)), (6, "a" * 3000)]
    for k in range(30):
        near = base[k % 15].split()
        near[rnd.randrange(25)] = "new%d" % k
        out.append((10 + k, "\n".join([" ".join(near), rnd.choice(base), "short one"])))
    return out


def test_empty_tables(spark):
    none = docs(spark, []).where("false")
    assert quality.quality(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert lines.removed_lines(none).count() == 0
    assert suffixes.without_repeats(none).count() == 0
    assert pii.personal_data(none).count() == 0
    assert pieces.decode(spark, pieces.encode(spark, none, MODEL), MODEL).count() == 0
    assert decontam.overlaps(spark, none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_quality_counts(spark, odd_texts):
    got = quality.quality(docs(spark, odd_texts)).collect()
    assert len(got) == len(odd_texts)
    want = Counter()
    for i, t in odd_texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + d for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        want[i, len(w), sum(map(len, w)), len(hit)] += 1
    assert Counter((r.id, r.n_words, r.word_chars, r.n_repeat_words) for r in got) == want


def test_running_totals(spark):
    rnd = random.Random(2)
    rows = [(k, [rnd.randrange(50) for _ in range(n)]) for k, n in enumerate((0, 1, 2, 63, 64, 65, 128, 129, 1000))]
    got = spark.createDataFrame(rows, "k long, v array<int>").select("k", text.running(F.col("v"), F.lit(0), lambda a, x: a + x).alias("r")).collect()
    assert {r.k: r.r for r in got} == {k: [sum(v[:i]) for i in range(len(v))] for k, v in rows}


def test_pii_with_many_spans(spark, monkeypatch):
    """Tokens next to, inside and across many spans: halving gives what holding each against each gives."""
    rnd = random.Random(4)
    kinds = ["a%d@b.de", "+49 (30) 123 456%02d", "10.2.3.%d", "4111 1111 1111 1111", "token9value%dmore", "12345678%d", "word", "t%d.5.6.7.8.9", "+4930123456%02d@c.org"]
    texts = ["".join((k % rnd.randrange(90) if "%" in k else k) + rnd.choice([" ", " ", " ", "", ","]) for k in rnd.choices(kinds, k=n)) for n in (0, 5, 60, 400)]
    found = pii.entities(docs(spark, enumerate(texts))).cache()
    told = []
    for most in (10**6, -1):
        monkeypatch.setattr(pii, "MANY_SPANS", most)
        told.append(sorted((r.id, r.start, r.end, r.instance, str(r.kind), r.based) for r in pii.mentions(found).collect()))
    assert told[0] == told[1] and sum(not r[-1] for r in told[0]) > 50


def test_pii_of_a_very_long_text(spark):
    whole = " ".join(f"a{k}@b.de" if k % 7 == 0 else f"n{k}x{k % 13}" for k in range(200_000))
    got = pii.personal_data(docs(spark, [(1, whole), (2, "a0@b.de")])).orderBy("id").collect()
    assert [len(r.base) for r in got] == [28_572, 1]
    assert all(whole[s.start : s.end].endswith("@b.de") and (s.start == 0 or whole[s.start - 1] == " ") for s in got[0].base)


def test_quality_bounds_follow_the_source(spark):
    """Two sources of one language: one with symbols in two of five documents, one with hardly any."""
    rnd = random.Random(3)
    rows = []
    for k in range(600):
        source, most = ("plain", 0), ("code", 2)
        source, often = source if k % 2 else most
        words = ["w%d" % rnd.randrange(4000) + "x" * rnd.randrange(4) for _ in range(120)]
        n = rnd.randrange(25, 40) if often and k // 2 % 5 < often else 0
        words[:n] = ["|"] * n
        rnd.shuffle(words)
        rows.append((k, " ".join(words), "en", source))
    odd = [(1000, "plain"), (1001, "code")]
    for i, source in odd:
        words = ["v%d" % k for k in range(120)] + ["|"] * 40
        rnd.shuffle(words)
        rows.append((i, " ".join(words), "en", source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = quality.measures(df)
    bounds = {r.source: r for r in quality.thresholds(quality.sketches(measured)).where("level = 0").collect()}
    rules = {name: slack for name, slack, _ in quality.Rules().slack}
    assert bounds["code"].high["symbol_rate"] > 1000 and bounds["plain"].high["symbol_rate"] == rules["symbol_rate"]
    assert all(b.high["word_length"] - b.low["word_length"] > 2 * rules["word_length"] for b in bounds.values())
    kept = {r.id: r.kept for r in quality.quality(df).collect()}
    assert kept.pop(1000) is False and kept.pop(1001) and all(kept.values())


def test_quality_sketch_is_close():
    for v in [*range(300), 1000, 4095, 4096, 123_456, 10**9]:
        shift = max(v.bit_length() - 7, 0)
        b = 64 * shift + (v >> shift)
        back = max(b // 64 - 1, 0)
        least = (b - 64 * back) << back
        assert least <= v and (v - least) * 64 <= v and (v >= 128 or least == v)


def test_line_dedup(spark, odd_texts):
    got = {r.id: r.removed for r in lines.removed_lines(docs(spark, odd_texts)).collect()}
    rows = sorted({(i is not None, i or 0, k, line) for i, t in odd_texts for k, line in enumerate((t or "").split("\n"))})
    want: dict = {}
    for at, (known, i, k, line) in enumerate(rows):
        s = set(line.split())
        gone = len(line.split()) >= 5 and any(9 * len(s & (o := set(other.split()))) >= 4 * (len(s) + len(o)) and len(other.split()) >= 5 for *_, other in rows[:at])
        want.setdefault(i if known else None, []).extend([k] if gone else [])
    assert got == want
    left = lines.without_lines(docs(spark, odd_texts), lines.removed_lines(docs(spark, odd_texts)))
    assert left.columns == docs(spark, odd_texts).columns and left.count() == len(odd_texts)


def test_words_of_lines_are_numbers(spark, monkeypatch):
    monkeypatch.setattr(lines, "_CELL_BITS", 4)
    line = "b\ta  a\x0bc\x0cb\rd "
    table = spark.createDataFrame([(line, list(range(16)))], "line string, levels array<tinyint>")
    own = table.select(lines._hashed_set(F.col("line")).alias("s"), "levels")
    got = own.select("s", lines._rarest_first(F.col("s"), F.col("levels")).alias("o"))
    got = got.select("*", *(lines._parities(F.col("o"), half).alias(f"bits{half}") for half in (0, 1)))
    # null among the numbers would mean that they are sorted one object at a time
    assert not got.schema["s"].dataType.containsNull and not got.schema["o"].dataType.containsNull
    row = got.first()
    hashes = [r.h for r in spark.createDataFrame([(w,) for w in "bacd"], "w string").select(F.xxhash64("w").alias("h")).collect()]
    assert list(row.s) == hashes
    assert list(row.o) == sorted((h & 15) << 56 | h & (1 << 56) - 1 for h in hashes)
    bits = 0
    for w in row.o:
        bits ^= 1 << (w & 127)
    assert (row.bits0 & (1 << 64) - 1, row.bits1 & (1 << 64) - 1) == (bits & (1 << 64) - 1, bits >> 64)


def test_table_of_counts(spark, monkeypatch):
    # a task that collects into 128 groups begins to sort them
    assert 1 << (lines._CELL_BITS - lines._ROW_BITS) < 128
    monkeypatch.setattr(lines, "_CELL_BITS", 6)
    monkeypatch.setattr(lines, "_ROW_BITS", 4)
    # the first and the last cell of a row, a row of one cell, one without any, and hashes beyond the cells
    counts = {0: 3, 1: 1, 15: 70, 37: 2, 48: 1, 63: 8}
    hashes = spark.createDataFrame([(c + 64 * k,) for c, n in counts.items() for k in range(-1, n - 1)], "h long")
    got = lines._levels(hashes)
    # asked of each word of each line, so a look-up should not have to check
    assert not got.schema["table"].dataType.containsNull
    assert list(got.first().table) == [counts.get(c, 0).bit_length() for c in range(64)]


def test_lines_with_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(lines, "_OFTEN", 3)
    rnd, texts = random.Random(8), []
    for i in range(60):
        texts.append((i, "\n".join(rnd.choice((" ", "\t", "\x0b ", " \r")).join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 12))) for _ in range(3))))
    got = {r.id: list(r.removed) for r in lines.removed_lines(docs(spark, texts), least_words=1).collect()}
    sets = [(i, k, set(line.split())) for i, text in texts for k, line in enumerate(text.split("\n"))]
    want = {i: [] for i, _ in texts}
    for at, (i, k, words) in enumerate(sets):
        if any(5 * len(words & w) >= 4 * len(words | w) for _, _, w in sets[:at]):
            want[i].append(k)
    assert got == want and sum(map(len, want.values())) > 30


def test_simhash_components(spark, odd_texts):
    got = simhash.near_duplicates(docs(spark, odd_texts), shingle=4).collect()
    assert len(got) == len(odd_texts)
    prints = {r.fingerprint for r in got}
    group = {p: {p} for p in prints}
    for a in prints:
        for b in prints:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    least = {id(s): min((r.id for r in got if r.fingerprint in s and r.id is not None), default=None) for s in group.values()}
    assert all(r.component == least[id(group[r.fingerprint])] for r in got)


def test_anchors_meet():
    rnd = np.random.default_rng(2)
    for _ in range(40):
        a = int(rnd.integers(0, 2**64, dtype=np.uint64))
        b = a
        for bit in rnd.choice(64, rnd.integers(0, 5), replace=False):
            b ^= 1 << int(bit)
        keys, owner = simhash._replicas(np.array([a, b], np.uint64))
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


@pytest.mark.parametrize(("split", "tasks"), [(4096, 16), (3, 2)])
def test_repeated_bytes(spark, odd_texts, split, tasks):
    length = 40
    data = [(i, (t or "").encode()) for i, t in odd_texts]
    windows = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    want = Counter()
    for i, d in data:
        gone = {j for k in range(len(d) - length + 1) if windows[d[k : k + length]] > 1 for j in range(k, k + length)}
        want[i, len(d), len(gone), bytes(c for j, c in enumerate(d) if j not in gone)] += 1
    got = suffixes.without_repeats(docs(spark, odd_texts), length=length, split=split, shard_bytes=1500, task_shards=tasks).collect()
    assert Counter((r.id, r.n_bytes, sum(s.b - s.a for s in r.spans), bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("words", [9, 12])
def test_passages_of_words(spark, odd_texts, words):
    def windows(text):
        w = re.findall(r"[^ \t-\r]+", text or "")
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}

    texts = [*odd_texts, (90, "\n".join((odd_texts[6][1] or "").split()[40:90])), (91, None), (92, " ".join(f"q{k}" for k in range(60)) * 2)]
    rows = [windows(t) for _, t in texts]
    want = Counter((i, len((t or "").encode()), any(a & b for j, b in enumerate(rows) if j != k)) for k, (a, (i, t)) in enumerate(zip(rows, texts, strict=True)))
    got = suffixes.without_repeats(docs(spark, texts), length=40, words=words).collect()
    assert Counter((r.id, r.n_bytes, r.passage) for r in got) == want


def test_text_over_a_chunk(spark):
    rnd = random.Random(3)
    long = " ".join(f"w{rnd.randrange(10**9)}" for _ in range(120_000))
    assert len(long) > 1 << 20
    cut = (1 << 20) - 800  # where the first part ends
    texts = [(1, long), (2, "x " + long[cut - 400 : cut + 400] + " y"), (3, long[:399]), (4, "z")]
    got = {r.id: r for r in suffixes.without_repeats(docs(spark, texts), words=51).collect()}
    assert [(s.a, s.b) for s in got[1].spans] == [(cut - 400, cut + 400)] and [(s.a, s.b) for s in got[2].spans] == [(2, 802)]
    assert [got[k].passage for k in (1, 2, 3, 4)] == [True, True, False, False] and not got[3].spans


def test_personal_data(spark):
    texts = [(k, f"some words staffid: u{k}x@corp.example.com and more") for k in range(9)]
    texts += [(20, "other staffid: u77788x ok +1 (583) 555-8469, 10.0.0.256 10.0.0.1; 4111 1111 1111 1111"), (21, None), (None, "a@b"), (22, "x@y.z" * 2)]
    got = {r.id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    at = dict(texts)[20].index
    assert [(s.kind, s.start) for s in got[20].base] == [(3, at("+1")), (1, at("10.0.0.1;")), (2, at("4111"))]
    assert {(s.kind, s.start, s.end) for s in got[20].spans} - {(s.kind, s.start, s.end) for s in got[20].base} == {(0, 15, 22)}
    assert got[21].spans == [] and got[None].spans == [] and [(s.start, s.end) for s in got[22].base] == [(0, 6)]


def test_personal_data_bootstraps(spark):
    texts = [(100 * c + k, f"some words staffid: u{k}x@corp.example.com and more") for k in range(9) for c in range(10)]
    texts += [(2000 + k, f"then staffid: u7778{k}x went off; badge: u7778{k}x") for k in range(4)]
    texts += [(3000, "the badge: q4455z here"), (3001, "u77781x stands first and so does"), (3002, "alone: q4455z")]
    got = {r.id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    found = lambda i: {dict(texts)[i][s.start : s.end] for s in got[i].spans}
    assert found(2000) == {"u77780x"} and len(got[2000].spans) == 2
    assert found(3000) == found(3002) == {"q4455z"} and found(3001) == {"u77781x"}


def test_secrets_behind_a_pattern(spark):
    rnd = random.Random(8)
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40)) + "7a"
    texts = [(k, f'some text token = "{key()}" and on') for k in range(8)]
    texts += [(20, 'TOKEN = "shorter55" and on'), (21, f"a checksum {key()} of a file"), (22, f"words {key()} only"), (23, "the shorter55 again")]
    got = {r.id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    found = {i: [dict(texts)[i][s.start : s.end] for s in got[i].spans if s.kind == pii.SECRET] for i, _ in texts}
    assert all(len(found[k]) == 1 and len(found[k][0]) == 42 for k in range(8)) and found[20] == found[23] == ["shorter55"]
    assert found[21] == found[22] == [] and not any(got[i].base for i, _ in texts)


def test_base_patterns_are_the_plain_ones(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, found):
        d = re.sub(r"[^0-9]", "", found)
        return {"email": True, "ip": all(int(x) <= 255 for x in found.split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    rnd = random.Random(4)
    bits = ["a@b.co", "x@y", "@", ".", "1.2.3.4", "10.0.0.256", "001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (583) 555-8469", "+12", "-", " ", "9", "ü", "\U0001f600", "a.b@c.d.e@f.g", "%"]
    texts = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))) for k in range(400)]
    got = {r.id: {(s.kind, s.start, s.end) for s in r.base} for r in pii.personal_data(docs(spark, texts)).collect()}
    for i, t in texts:
        assert got[i] == {(k, m.start(), m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(plain[kind], t) if holds(kind, m.group())}, t


def test_decontamination(spark):
    rnd = random.Random(3)
    item = [f"b{rnd.randrange(50)}" for _ in range(30)]
    changed = [("zz" if k in (4, 12, 20) else w) for k, w in enumerate(item)]
    texts = [(1, " ".join(["x"] * 40 + changed + ["y"] * 9)), (2, " ".join(rnd.sample(item, 30))), (3, None), (3, "pre " + " ".join(item).upper())]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "one two three four five")], "item_id long, text string")
    for rules in (decontam.Overlap(), decontam.Overlap(block_words=4)):
        got = decontam.overlaps(spark, docs(spark, texts), benchmark, rules=rules).collect()
        assert Counter((r.doc_id, tuple(sorted({o.item_id for o in r.overlaps}))) for r in got) == Counter([(1, (7,)), (2, ()), (3, ()), (3, (7,))])


def test_substituted_passages():
    """Partial passages and short items, against all stretches of all alignments."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(1 << 30)}"

    def found(item, text):
        for shift in range(-len(item) + 1, len(text)):
            same = [0 <= k + shift < len(text) and w == text[k + shift] for k, w in enumerate(item)]
            if 5 * sum(same) >= 4 * len(item):
                return True
            inside = [k for k in range(len(item)) if 0 <= k + shift < len(text)]
            for a in inside:
                if any(5 * sum(same[a:b]) >= 4 * (b - a) for b in range(a + 13, inside[-1] + 2)):
                    return True
        return False

    cases = [(60, 16, [12]), (60, 13, [4, 8]), (60, 50, range(4, 50, 5)), (60, 15, [3, 7, 11]), (60, 13, [3, 6, 9]), (60, 12, [])]
    cases += [(60, n, rnd.sample(range(n), rnd.randint(n // 6, n // 4))) for n in range(9, 40) for _ in range(6)]
    cases += [(n, n, rnd.sample(range(n), k)) for n in range(5, 26) for k in range(n // 5 + 2) for _ in range(5)]
    cases += [(n, n, [k]) for n in range(5, 11) for k in range(n)]
    hits = 0
    for n, part, differ in cases:
        item = [word() for _ in range(n)]
        at = rnd.randint(0, n - part)
        copy = [word() if k in differ else w for k, w in enumerate(item[at : at + part])]
        text = [word() for _ in range(rnd.choice((0, 9)))] + copy + [word() for _ in range(rnd.choice((0, 9)))]
        got = decontam.Block([(7, " ".join(item))], decontam.Overlap()).find(" ".join(text))
        assert bool(got) == found(item, text), (n, part, differ)
        assert all(5 * same >= 4 * length for *_, length, same in got if length >= 13)
        hits += bool(got)
    assert 100 < hits < len(cases) - 50


def test_pieces_match_the_library(spark, odd_texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocabulary = pieces.Vocabulary.load(MODEL)
    rnd = random.Random(4)
    texts = [t or "" for _, t in odd_texts] + ["".join(rnd.choice("abcdeinorst  ▁\n.,-_0123ß²éあ😀\0") for _ in range(rnd.randint(1, 30))) for _ in range(800)]
    one = pieces.Encoder(vocabulary)
    for t in texts:
        ids = model.encode(t, add_eos=True)
        assert one.encode(t) == ids and pieces.decode_ids(ids, vocabulary) == model.decode(ids)
    for _ in range(400):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), 0, 1, 2]) for _ in range(6)]
        assert pieces.decode_ids(ids, vocabulary) == model.decode(ids)
    got = pieces.decode(spark, pieces.encode(spark, docs(spark, odd_texts), MODEL), MODEL).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter((i, tuple(x := model.encode(t or "", add_eos=True)), model.decode(x)) for i, t in odd_texts)


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "\\<|im_end|>\\\\", None, "", "a\nb", "<\\|im_end|>"]
    rows = [(k, j, r, said[(k + j) % 6]) for k in range(6) for j, r in enumerate(("system", "user", "assistant"))]
    rows += [(7, 0, "assistant", "x"), (8, None, "us\ner", "y"), (None, 0, "user", "q")]
    talks = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    told = {r.id: r for r in chat.digests(talks).collect()}
    for k in range(6):
        turns = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == k)
        loss = next(t or "" for c, _, r, t in rows if c == k and r == "assistant")
        assert told[k].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and told[k].valid
        assert told[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert [told[k].violations for k in (5, 7, 8, None)] == [0, 1, 2, 1]
    assert not told[7].valid and told[8].turns_sha256 == hashlib.sha256(b"us\ner\ny\n").hexdigest()


def test_archives(spark):
    rows = [(1, "http://A.example.org/x?y=1#z", "a" * 150), (2, "http://a.example.org/x?y=1", "a" * 150), (3, None, None), (5, "http://b.org/ü\n", "b"), (None, "http://b.org/q", "a" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    _, directory, folder = warc.archive(pages)
    got = {r.page_id: r for r in warc.read_records(warc.read_index(directory, folder), folder).collect()}
    assert (got[1].record_type, got[2].refers_to, got[None].refers_to, got[3].payload_bytes) == ("response", 1, 1, 0)
    keys = pages.where("page_id in (2, 5)").select(warc.url_key(pages.url).alias("key"))
    assert {r.page_id for r in warc.lookup(keys, directory, folder).collect()} == {1, 2, 5}


def test_lookup_over_blocks_and_files(spark):
    rows = [(k, "http://hot.org/a" if k % 3 else f"http://h{k % 7}.org/{k}", "x" * (k % 5) * 60) for k in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    captures, _, folder = warc.archive(pages)
    directory = warc.write_index(captures, folder, block_rows=2)
    assert directory.count() >= 60
    keyed = pages.select("page_id", warc.url_key(pages.url).alias("key"))
    for some in (keyed.where("page_id % 10 = 0"), keyed.where("page_id = 1"), keyed):
        keys = {r.key for r in some.collect()}
        found = warc.lookup(some, directory, folder)
        assert sorted(r.page_id for r in found.collect()) == sorted(r.page_id for r in keyed.collect() if r.key in keys)
    assert {r.page_id: r.payload_bytes for r in warc.read_records(found, folder).collect()} == {i: len(h) for i, _, h in rows}
    none = pages.where("false").withColumn("key", pages.url).withColumn("file", pages.url)
    captures, directory, folder = warc.archive(none)
    assert (captures.count(), directory.count(), warc.lookup(none, directory, folder).count()) == (0, 0, 0)


def test_url_rules(spark):
    link = '<a href="http://bad.net/x">'
    rows = [(1, "http://WWW.Example.org/es/1", link), (2, "http://x.org", None), (3, None, None), (4, "https://good.com/fr/a?b", None), (5, "ftp://bad.net/de/", None), (6, "http://near.net/q", link)]
    got = {r.id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "net", "/de/")]).collect()}
    assert (got[1].rule, got[1].verdict, got[2].rule, got[3].host, got[4].rule) == ("example.org/es/", "block", None, "", "com/fr/")
    assert (got[5].verdict, got[6].rule, got[6].verdict) == ("block", None, "block")

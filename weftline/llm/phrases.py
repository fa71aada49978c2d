"""Collocations: contiguous phrases, counted by pivot partitioning and scored by how their parts stick together.

Words are ordered by how often their hash bucket occurs, so every phrase has one rarest word, its
pivot. A text is rewritten for each pivot in it to the fragments around it that hold no rarer
word, fragments go to the partition of their pivot, and that counts the phrases its pivot owns
and no others: the first place of the pivot in a phrase is what counts it, so each occurrence is
counted once, and what a partition finds is complete and can be cut at the least frequency
there. The phrases of a very frequent pivot are summed up before they are sent and dealt by
themselves, so no pivot is a large group.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.lineage import settle

#: Words of a phrase at most, and how often it has to occur.
LONGEST, LEAST = 4, 30
#: Bytes that end a piece, and what stands for them (no UTF-8 text has it).
ENDS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
_CUT = bytes.maketrans(ENDS, END * len(ENDS))
_BLANK = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Sizes:
    """What bounds memory and groups; no result depends on it.

    ``buckets`` are the counters that the order of words comes from: more of them make blanks
    more exact. A pivot that occurs more than ``hot`` times has its phrases summed up before
    they are sent. ``chunk`` is how many bytes of text, or of fragments, are worked on together.
    """

    buckets: int = 1 << 21
    hot: int = 1 << 16
    chunk: int = 1 << 22


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, list[bytes]]]:
    """Language and words of texts put together, with ``END`` between pieces; long texts are cut between pieces."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: Counter = Counter()

    def words(parts: list[bytes]) -> list[bytes]:
        return END.join(parts).replace(END, b" " + END + b" ").split()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode().lower().translate(_CUT)
            at = 0
            while at < len(data):
                room = max(chunk - sizes[lang], 1)
                end = len(data) if len(data) - at <= room else data.find(END, at + room)
                end = len(data) if end < 0 else end
                held[lang].append(data[at:end])
                sizes[lang] += end - at
                at = end + 1
                if sizes[lang] >= chunk:
                    yield lang, words(held.pop(lang))
                    sizes[lang] = 0
    for lang, parts in held.items():
        yield lang, words(parts)


def _bucket(lang: str, words: list[bytes], buckets: int) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) % buckets for w in words), np.int64, len(words))


def word_counts(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``(lang, bucket, n)`` of ``(lang, text)``: how many words a language has (bucket -1), and a hash bucket of words of all languages (no language)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, totals = np.zeros(sizes.buckets, np.int64), Counter()
        for lang, words in _chunks(batches, sizes.chunk):
            told = Counter(words)
            told.pop(END, None)
            totals[lang] += sum(told.values())
            np.add.at(buckets, _bucket(lang, list(told), sizes.buckets), np.fromiter(told.values(), np.int64, len(told)))
        full = np.flatnonzero(buckets)
        langs = list(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*langs, *[None] * len(full)], pa.string()), pa.array(np.concatenate([np.full(len(langs), -1), full]), pa.int32()), pa.array(np.concatenate([[totals[x] for x in langs], buckets[full]]).astype(np.int64))],
            names=["lang", "bucket", "n"],
        )

    return docs.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _owned(ids: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, n_words: int, sizes: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases, a row of word numbers each, and how often they occur: those that hold a place of ``at`` and lie within ``first`` to ``last`` around it."""
    pairs, pair = np.unique(ids[:-1].astype(np.int64) * n_words + ids[1:], return_inverse=True) if len(ids) > 1 else (np.zeros(1, np.int64), np.zeros(1, np.int64))
    for n in sizes:
        starts = [at - k for k in range(n)]
        starts = np.concatenate([s[(s >= first) & (s + n - 1 <= last)] for s in starts])
        if n == 1:
            keys = ids[starts].astype(np.int64)
        elif n == 2:
            keys = pair[starts].astype(np.int64)
        elif n == 3:
            keys = pair[starts].astype(np.int64) * n_words + ids[starts + 2]
        else:
            keys = pair[starts].astype(np.int64) * len(pairs) + pair[starts + 2]
        keys, counts = np.unique(keys, return_counts=True)
        spelled = lambda p: np.stack([pairs[p] // n_words, pairs[p] % n_words], axis=1)
        if n == 1:
            yield keys[:, None], counts
        elif n == 2:
            yield spelled(keys), counts
        elif n == 3:
            yield np.concatenate([spelled(keys // n_words), (keys % n_words)[:, None]], axis=1), counts
        else:
            yield np.concatenate([spelled(keys // len(pairs)), spelled(keys % len(pairs))], axis=1), counts


def fragments(docs: DataFrame, sketch: Broadcast, least: int = LEAST, sizes: Sizes = Sizes()) -> DataFrame:
    """``(lang, pivot, salt, alone, parts)``: what each pivot needs of the ``(lang, text)`` rows.

    ``alone`` is how often it stands by itself among rarer words, ``parts`` has a line for each
    fragment. A pivot above ``sizes.hot`` has a salt from 0 and lines of counts and phrases instead.
    Words whose bucket occurs fewer than ``least`` times are blanks.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value
        for lang, tokens in _chunks(batches, sizes.chunk):
            number = {w: k for k, w in enumerate(dict.fromkeys(tokens))}
            words = list(number)
            if not words:
                continue
            ids = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
            counts = often[_bucket(lang, words, sizes.buckets)]
            counts[number.get(END, [])] = 0
            rank = np.empty(len(words), np.int32)
            rank[np.array(sorted(range(len(words)), key=lambda k: (-counts[k], words[k])))] = np.arange(len(words))
            rank[counts < least] = _BLANK
            ranks = np.full(len(ids) + 2 * LONGEST, _BLANK, np.int32)
            ranks[LONGEST:-LONGEST] = rank[ids]
            at = np.flatnonzero(ranks[LONGEST:-LONGEST] < _BLANK)
            own, left, right, more, on = rank[ids[at]], np.zeros(len(at), int), np.zeros(len(at), int), np.ones(len(at), bool), np.ones(len(at), bool)
            for k in range(1, LONGEST):
                # only frequenter words before the pivot, itself as well behind it
                more &= ranks[at + LONGEST - k] < own
                on &= ranks[at + LONGEST + k] <= own
                left, right = left + more, right + on
            hot = counts[ids[at]] > sizes.hot
            pivots, salts, alone, parts = [], [], [], []
            if hot.any():
                lines: dict[tuple[int, int], list[bytes]] = defaultdict(list)
                for phrases, n in _owned(ids, at[hot], (at - left)[hot], (at + right)[hot], len(words), range(1, LONGEST + 1)):
                    owner = phrases[np.arange(len(phrases)), rank[phrases].argmax(axis=1)]
                    for phrase, p, c in zip(phrases.tolist(), owner.tolist(), n.tolist(), strict=True):
                        text = b" ".join([words[k] for k in phrase])
                        lines[p, xxhash.xxh3_64_intdigest(text) % (int(counts[p]) // max(sizes.hot, 1) + 1)].append(b"%d %b" % (c, text))
                for (p, salt), told in lines.items():
                    pivots.append(words[p])
                    salts.append(salt)
                    alone.append(0)
                    parts.append(b"\n".join(told))
            at, left, right = at[~hot], left[~hot], right[~hot]
            single = (left == 0) & (right == 0)
            by_self = np.bincount(ids[at[single]], minlength=len(words))
            at, left, right = at[~single], left[~single], right[~single]
            order = np.argsort(ids[at], kind="stable")
            at, left, long = at[order], left[order], (left + right + 2)[order]
            ends = np.cumsum(long)
            flat = np.repeat(at - left - ends + long, long) + np.arange(long.sum())
            flat[ends - 1] = len(ids)  # the end of a line
            spelled = list(map([*words, b"\n"].__getitem__, np.append(ids, len(words))[flat].tolist()))
            of, starts = np.unique(ids[at], return_index=True)
            bounds = np.append(0, ends)[np.append(starts, len(at))].tolist()
            places = dict(zip(of.tolist(), zip(bounds[:-1], bounds[1:], strict=True), strict=True))
            for p in np.union1d(of, np.flatnonzero(by_self)).tolist():
                a, b = places.get(p, (0, 0))
                pivots.append(words[p])
                salts.append(-1)
                alone.append(int(by_self[p]))
                parts.append(b" ".join(spelled[a:b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(pivots), pa.string()), pa.array(pivots, pa.binary()), pa.array(salts, pa.int32()), pa.array(alone, pa.int64()), pa.array(parts, pa.binary())], names=["lang", "pivot", "salt", "alone", "parts"]
            )

    return docs.mapInArrow(rewrite, "lang string, pivot binary, salt int, alone long, parts binary")


def _mined(rows: list[tuple[bytes, int, bytes]], least: int) -> Iterator[tuple[bytes, int, int]]:
    """Phrase, words and occurrences for whole pivots ``(pivot, alone, fragments)``."""
    alone = Counter()
    for pivot, n, _ in rows:
        alone[pivot] += n
    tokens, own = [], []
    for pivot, _, parts in rows:
        told = parts.replace(b"\n", END).split()
        tokens += told
        own.append((pivot, len(told)))
    number = {w: k for k, w in enumerate(dict.fromkeys([END, *alone, *tokens]))}
    words, ids = list(number), np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
    once = np.zeros(len(words), np.int64)
    for pivot, n in alone.items():
        once[number[pivot]] += n
    if len(ids):
        ends = np.flatnonzero(ids == 0)
        starts = np.append(0, ends[:-1] + 1)
        # the pivot's first place in its fragment
        pivots = np.repeat(np.fromiter((number[p] for p, _ in own), np.int32, len(own)), [n for _, n in own])
        there = np.flatnonzero(ids == pivots)
        at = there[np.unique(np.searchsorted(ends, there), return_index=True)[1]]
        once += np.bincount(ids[at], minlength=len(words))
        for phrases, n in _owned(ids, at, starts, ends - 1, len(words), range(2, LONGEST + 1)):
            for phrase, c in zip(phrases[n >= least].tolist(), n[n >= least].tolist(), strict=True):
                yield b" ".join([words[k] for k in phrase]), len(phrase), c
    for k in np.flatnonzero(once >= least).tolist():
        yield words[k], 1, int(once[k])


def frequent_phrases(docs: DataFrame, sketch: Broadcast, least: int = LEAST, sizes: Sizes = Sizes()) -> DataFrame:
    """``(lang, phrase, size, f)``: every phrase of up to ``LONGEST`` words that occurs ``least`` times in its language."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(lang: str, found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
            phrase, size, f = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([p.decode() for p in phrase], pa.string()), pa.array(size, pa.int32()), pa.array(f, pa.int64())], names=["lang", "phrase", "size", "f"])

        now, held, bytes_held, sums = (None, None, None), [], 0, Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, bytes_held
            if held:
                yield told(now[0], list(_mined(held, least)))
            held, bytes_held = [], 0
            if sums:
                yield told(now[0], [(p, p.count(b" ") + 1, c) for p, c in sums.items() if c >= least])
                sums.clear()

        for batch in batches:
            for lang, pivot, salt, alone, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, pivot, salt) != now:
                    # rows are sorted: a pivot is complete when the next one comes
                    if lang != now[0] or salt >= 0 or sums or bytes_held >= sizes.chunk:
                        yield from flush()
                    now = (lang, pivot, salt)
                if salt < 0:
                    held.append((pivot, alone, parts))
                    bytes_held += len(parts) + 64
                else:
                    for line in parts.split(b"\n"):
                        c, _, phrase = line.partition(b" ")
                        sums[phrase] += int(c)
        yield from flush()

    dealt = fragments(docs, sketch, least, sizes).repartition("lang", "pivot", "salt").sortWithinPartitions("lang", "pivot", "salt")
    return dealt.mapInArrow(mine, "lang string, phrase string, size int, f long")


def _scored(grams: DataFrame) -> DataFrame:
    """``(lang, phrase, size, a, l, r, score)`` of phrases of two words or more, by the cut that scores lowest."""
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = grams.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    f = lambda phrase, name: grams.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(name))
    told = cuts.join(f("first", "l"), ["lang", "first"]).join(f("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(12,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = told.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")


def _kept(scored: DataFrame, share: int) -> DataFrame:
    """Phrases without those that lie in a longer one with ``share`` percent of their occurrences."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda s: F.array_join(F.slice(words, s, n), " "))))
    inside = scored.where("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return scored.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < share * wide("a"))).drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang: Column | str = "lang", least: int = LEAST, top: int = 2_000, share: int = 80, sizes: Sizes = Sizes()) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of 2 to ``LONGEST`` words of each language.

    Texts are lower-cased in A-Z and cut into pieces and words; a null text is empty, a null
    language ``und``. Repeated rows count again; whole texts of any length are read. A phrase
    has to occur ``least`` times, and scores by its occurrences ``a`` against those of its parts
    ``l`` and ``r`` at the cut where it scores lowest. Ties go to the more frequent phrase, then
    to the smaller one by bytes. ``n`` is the number of words of the language. An empty table,
    or one without such phrases, gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang) if isinstance(lang, str) else lang, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = settle(word_counts(rows, sizes), "word-counts")
    told = counts.where("lang is null").select("bucket", "n").toArrow()
    sketch = np.zeros(sizes.buckets, np.int64)
    sketch[told["bucket"].to_numpy()] = told["n"].to_numpy()
    grams = settle(frequent_phrases(rows, spark.sparkContext.broadcast(sketch), least, sizes), "phrases")
    ranked = _kept(settle(_scored(grams), "scored-phrases"), share)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(counts.where("bucket = -1").select("lang", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

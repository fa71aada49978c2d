"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words that looks at some of them and ignores the rest, so
that a passage with substituted words still has places where all the words that count agree. The
seeds of benchmark and training texts are joined; around each hit the two texts are laid side by
side and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.lineage import settle

#: Places that each mask looks at. Together they meet any 11 words or more of which four in five agree (tried in
#: full for 11 to 25 words; from 26 on, one half of at least 13 agrees as well).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 8, 10), (0, 1, 6, 7, 8, 9), (0, 2, 3, 4, 7, 8), (0, 1, 3, 7, 8))
#: Fixed odd multiplier of the seed hash.
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Overlap:
    """An item counts as found where at least four in five words agree, over the whole item or over
    ``least`` or more words of it in a row; items under ``shortest`` words are not looked for."""

    least: int = 13
    shortest: int = 5
    agree: tuple[int, int] = (4, 5)
    #: Words of the benchmark that one pass over the training texts holds.
    block_words: int = 1 << 21


FOUND = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("same", T.LongType()),
]))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _seed(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of each place of ``ids`` under the mask."""
    n = max(0, len(ids) - mask[-1])
    out = np.zeros(n, np.uint64)
    for at in mask:
        out = (out ^ ids[at : at + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _short_masks(n: int, differ: int) -> list[tuple[int, tuple[int, ...]]]:
    """Masks with their places in an item of ``n`` words that meet it wherever ``differ`` of them are others.

    The item is cut into two parts more than words may differ: any two parts make a mask.
    """
    count = min(n, differ + 2)
    parts = [range(n * k // count, n * (k + 1) // count) for k in range(count)]
    chosen = [sorted(at for p in some for at in p) for some in combinations(parts, count - differ)]
    return [(c[0], tuple(at - c[0] for at in c)) for c in chosen]


class Block:
    """Part of a benchmark, ready to be looked up: its words, and for each mask the sorted seeds with their places."""

    def __init__(self, items: list[tuple[int, str]], rules: Overlap) -> None:
        self.rules, self.items, self.names = rules, [], []
        self.known: dict[bytes, int] = {}
        seeds: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for name, text in items:
            words = _words(text)
            if len(words) < rules.shortest:
                continue
            ids = np.array([self.known.setdefault(w, len(self.known) + 1) for w in words], np.uint64)
            k = len(self.items)
            self.items.append(ids)
            self.names.append(name)
            if len(ids) > max(m[-1] for m in MASKS):
                for m in MASKS:
                    h = _seed(ids, m)
                    seeds.setdefault(m, []).append((h, np.full(len(h), k, np.int32), np.arange(len(h), dtype=np.int32)))
                continue
            p, q = rules.agree
            for at, m in _short_masks(len(ids), len(ids) * (q - p) // q):
                seeds.setdefault(m, []).append((_seed(ids[at:], m)[:1], np.full(1, k, np.int32), np.full(1, at, np.int32)))
        self.seeds = {}
        for m, parts in seeds.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.seeds[m] = (h[order], item[order], at[order])

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """Overlaps of a text: item, first word in the text and in the item, length, words that agree."""
        get = self.known.get
        ids = np.array([get(w, 0) for w in _words(text)], np.uint64)
        known = ids != 0
        lines = set()
        for mask, (hashes, item, at) in self.seeds.items():
            n = len(ids) - mask[-1]
            if n <= 0:
                continue
            full = known[:n].copy()
            for k in mask[1:]:
                full &= known[k : k + n]
            places = np.flatnonzero(full)
            if not len(places):
                continue
            got = np.zeros(len(places), np.uint64)
            for k in mask:
                got = (got ^ ids[places + k]) * _MIX
                got ^= got >> np.uint64(29)
            first, last = np.searchsorted(hashes, got, "left"), np.searchsorted(hashes, got, "right")
            count = last - first
            hit = np.repeat(np.arange(len(places)), count)
            where = np.repeat(first, count) + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
            lines |= set(zip(item[where].tolist(), (places[hit] - at[where]).tolist(), strict=True))
        return sorted(filter(None, (self._aligned(ids, k, shift) for k, shift in lines)))

    def _aligned(self, ids: np.ndarray, k: int, shift: int) -> tuple[int, int, int, int, int] | None:
        item, rules = self.items[k], self.rules
        lo, hi = max(0, -shift), min(len(item), len(ids) - shift)
        same = ids[lo + shift : hi + shift] == item[lo:hi]
        p, q = rules.agree
        if q * int(same.sum()) >= p * len(item):
            return self.names[k], lo + shift, lo, hi - lo, int(same.sum())
        # the longest stretch in which enough words agree: for each end, the first start with no higher score
        score = np.concatenate(([0], np.cumsum(np.where(same, q - p, -p))))
        first = np.searchsorted(-np.minimum.accumulate(score), -score)
        end = int(np.argmax(np.arange(len(score)) - first))
        start = int(first[end])
        if end - start < rules.least:
            return None
        return self.names[k], lo + shift + start, lo + start, end - start, int(same[start:end].sum())


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, rules: Overlap) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of about ``block_words`` words, by hash of the item."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // (6 * rules.block_words) + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r.id, r.text) for r in part.sort("id", "text").toLocalIterator()]


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", found_col: str = "overlaps", rules: Overlap | None = None) -> DataFrame:
    """``docs`` with ``found_col``: an array of ``(item_id, doc_word, item_word, length, same)``.

    Texts are lower-cased in A-Z and cut into words at ASCII white space. One row per row of
    ``docs``, so repeated and null ids need no rule; a null or empty text, or an empty
    benchmark, gives an empty array. All columns stay; one named like ``found_col`` is
    replaced. Each pass over the texts holds one block of the benchmark, of bounded size;
    a larger benchmark takes more passes, not more memory. Nothing is shuffled.
    """
    rules = rules or Overlap()
    empty = F.array().cast(FOUND)
    docs = docs.withColumn(found_col, empty)
    for k, items in enumerate(_blocks(benchmark, item_col, item_text_col, rules)):
        docs = _pass(spark, settle(docs, "overlaps") if k else docs, items, text_col, found_col, rules)
    return docs


def _pass(spark: SparkSession, docs: DataFrame, items: list[tuple[int, str]], text_col: str, found_col: str, rules: Overlap) -> DataFrame:
    shared = spark.sparkContext.broadcast(items)
    names = docs.columns
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in FOUND.elementType.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value, rules)
        fields = [f.name for f in FOUND.elementType.fields]
        for batch in batches:
            before = batch.column(found_col).to_pylist()
            found = [[dict(zip(fields, x, strict=True)) for x in block.find(t.as_py())] for t in batch.column(text_col)]
            column = pa.array([a + b for a, b in zip(before, found, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([column if n == found_col else batch.column(n) for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)

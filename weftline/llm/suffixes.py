"""Repeated byte strings by per-shard suffix arrays.

Every 400-byte string (a window) is assigned to its anchor, the place in it whose 32 bytes have the
smallest hash. Equal windows have equal anchors at equal distance, so only texts that share an anchor
need to be compared, and only around it. The windows of one anchor make one context; equal
contexts are kept once with their number. Contexts that share an anchor without being equal are
dealt into shards. A shard is sorted as a suffix array (Larsson-Sadakane refinement), its common
prefixes follow by Kasai's rule, and windows that share 400 bytes with a neighbour are repeats.
The contexts of a very frequent anchor fill several shards; these are merged by searching the
sorted windows of each in those of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import cut, noting, release, settle
from weftline.llm.text import whole

LENGTH, GRAM = 400, 32
#: Words of a passage: over 50.
PASSAGE = 51
#: Contexts of one anchor that go to one shard, and bytes that a shard holds; shards of so many contexts of one
#: anchor that one task merges.
SPLIT, SHARD_BYTES, TASK_SHARDS = 4096, 1 << 20, 16
_CHUNK = 1 << 20
#: Words of an anchor of word windows.
_WORD_GRAM = 8
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Fixed odd multipliers of the rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(8)
def _powers(base: int, bits: int) -> np.ndarray:
    """The first 2^bits + 1 powers, modulo 2^64."""
    out = np.full((1 << bits) + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


class _Hashes:
    """Hashes of any stretches of a sequence, from sums of its values times powers of a base."""

    def __init__(self, values: np.ndarray, base: int = _BASES[0]) -> None:
        n = len(values)
        self.bits, self.base, self.n = max(20, n.bit_length()), base, n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(base, self.bits)[:n], out=self.sums[1:])

    def rolling(self, size: int) -> np.ndarray:
        """Of the ``size`` values from each place on."""
        return _mixed((self.sums[size:] - self.sums[:-size]) * _powers(pow(self.base, -1, 1 << 64), self.bits)[: self.n - size + 1])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the values from each start to each end."""
        h = (self.sums[end] - self.sums[start]) * _powers(pow(self.base, -1, 1 << 64), self.bits)[start]
        return _mixed(h + (end - start).astype(np.uint64) * np.uint64(_BASES[1]))


def _rolling(data: np.ndarray, size: int, base: int = _BASES[0]) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on."""
    return _Hashes(data, base).rolling(size)


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    n = len(keys)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _runs(keys: np.ndarray, width: int, room: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` by the smallest of the ``width`` keys in each: first and last of every run, and that key.

    Only places with at least ``size`` left to the end of their part (``room``) start a window.
    """
    at = np.flatnonzero(room[: max(0, len(room) - size + 1)] >= size)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    least = _window_min(keys, width)[at]
    head = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return at[head], at[np.concatenate((head[1:], [len(at)])) - 1], least[head]


def _room(ends: np.ndarray) -> np.ndarray:
    """How much of its part is left from each place on."""
    return np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(ends[-1] if len(ends) else 0)


def contexts(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Start, end, anchor and two hashes of each context of several parts, given as bytes (2^20 at most) and the ends of parts.

    The windows of a context are those that start in its first ``end - start - length + 1``
    places. Every window that lies in one part belongs to exactly one.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    gram = min(GRAM, length)
    sums = _Hashes(data)
    hashes = sums.rolling(gram)
    low = np.uint64(_CHUNK - 1)
    first, last, least = _runs((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1, _room(ends), length)
    anchor = hashes[(least & low).astype(np.int64)]
    return first, last + length, anchor.view(np.int64), sums.of(first, last + length).view(np.int64), _Hashes(data, _BASES[1]).of(first, last + length).view(np.int64)


def passages(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Part, first and last window, anchor and hash of each run of word windows of several texts, then the hashes of windows of ``words`` words."""
    none = np.zeros(0, np.int64)
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[np.concatenate(([0], ends))] = True
    solid = ~blank
    begin = np.flatnonzero(solid & np.concatenate(([True], blank[:-1] | edge[1:-1])))
    end = np.flatnonzero(solid & np.concatenate((blank[1:] | edge[1:-1], [True]))) + 1
    if len(begin) < words:
        return none, none, none, none, none, none
    sums = _Hashes(_Hashes(data).of(begin, end))
    last_word = np.searchsorted(begin, ends)
    grams = sums.rolling(min(_WORD_GRAM, words))
    # equal keys in a window would tie, so the low bits tell their place
    low = np.uint64((1 << max(20, len(grams).bit_length())) - 1)
    first, last, least = _runs((grams & ~low) | np.arange(len(grams), dtype=np.uint64), words - min(_WORD_GRAM, words) + 1, _room(last_word), words)
    key = grams[(least & low).astype(np.int64)].view(np.int64)
    return np.searchsorted(last_word, first, "right"), first, last, key, sums.of(first, last + words).view(np.int64), sums.rolling(words).view(np.int64)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes (or more), and the rank of each place; equal ones share a rank.

    Larsson-Sadakane refinement: groups of suffixes with equal prefixes are split by the rank of
    what follows, twice as far in each round, and groups of one are never looked at again.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data.astype(np.uint64) + 1  # the end sorts first
    key = np.zeros(n, np.uint64)
    for k in range(7):  # nine bits to a byte
        key = key << np.uint64(9) | padded[k : k + n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    del padded, key
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    place = np.flatnonzero(head)
    rank[order] = place[np.cumsum(head) - 1]
    known = 7
    size = np.diff(np.concatenate((place, [n])))
    todo = np.flatnonzero(np.repeat(size > 1, size)).astype(np.int32)  # places in order whose group is not yet single
    while len(todo) and known < depth:
        who = order[todo]
        group = rank[who]
        after = rank[np.minimum(who + np.int32(known), n)] + 1
        sort = np.argsort(group * np.int64(n + 1) + after)
        who, group, after = who[sort], group[sort], after[sort]
        order[todo] = who
        head = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        first = np.flatnonzero(head)
        rank[who] = todo[first][np.cumsum(head) - 1]
        size = np.diff(np.concatenate((first, [len(todo)])))
        todo = todo[np.repeat(size > 1, size)]
        known *= 2
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, places: np.ndarray, limit: int) -> np.ndarray:
    """For each of ``places`` (positions in ``order``, not 0) how many bytes it shares with the suffix before it, up to ``limit``.

    Kasai's rule, for all places at once: in order of the text a suffix shares at least one
    byte less than the suffix a byte earlier, so runs of text are compared once from their start.
    """
    at, before = order[places], order[places - 1]
    # along a run in which both suffixes move on together the number falls by one with each byte
    sort = np.lexsort((at, at - before))
    a, b = at[sort], before[sort]
    n = len(data)
    fresh = np.concatenate(([True], (a[1:] - a[:-1] != 1) | (b[1:] - b[:-1] != 1))) if len(a) else np.zeros(0, bool)
    start = np.flatnonzero(fresh)
    length = np.diff(np.concatenate((start, [len(a)])))
    shared = np.zeros(len(start), np.int64)
    live, reach = np.arange(len(start)), limit + length - 1
    while len(live):  # eight bytes at a time, only for runs that still agree
        x, y = a[start[live]] + shared[live], b[start[live]] + shared[live]
        same = np.zeros(len(live), np.int64)
        going = np.ones(len(live), bool)
        for k in range(8):
            going &= (x + k < n) & (y + k < n)
            going &= data[np.minimum(x + k, n - 1)] == data[np.minimum(y + k, n - 1)]
            same += going
        shared[live] += same
        live = live[going & (shared[live] < reach[live])]
    run = np.repeat(np.arange(len(start)), length)
    out = np.zeros(len(a), np.int64)
    value = shared[run] - (np.arange(len(a)) - start[run])
    out[sort] = np.minimum(value, limit)
    return out


def repeated(parts: list[bytes], length: int = LENGTH) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of the parts occur in another place of the shard.

    Gives for each part a mask over its windows; and all windows in order: part, place in it,
    and whether the window is the first of its equals.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    inside = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.int32)
    order, _ = suffix_array(data, length)
    order = order[(inside <= sizes[owner] - length)[order]]
    shared = common_prefixes(data, order, np.arange(1, len(order)), length) >= length
    equal = np.concatenate((shared, [False])) | np.concatenate(([False], shared))
    flags = np.zeros(len(data), bool)
    flags[order[equal]] = True
    masks = [flags[b : b + n - length + 1] for b, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return masks, owner[order], inside[order], np.concatenate(([True], ~shared)) if len(order) else np.zeros(0, bool)


def ranges(mask: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Bytes that the marked windows cover, as maximal runs."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return [(int(g[0]), int(g[-1]) + length) for g in np.split(at, cut)]


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_L, _I = pa.int64(), pa.int32()
_OCCURS = pa.schema([("t1", _L), ("t2", _L), ("s", _I), ("e", _I), ("key", _L), ("c1", _L), ("c2", _L), ("n", _L)])
_CONTEXT = pa.schema([("key", _L), ("sub", _I), ("split", pa.bool_()), ("c1", _L), ("c2", _L), ("data", pa.binary())])
_FOUND = pa.schema([("c1", _L), ("c2", _L), ("ranges", pa.list_(pa.struct([("a", _I), ("b", _I)]))), ("w1", _L), ("w2", _L), ("at", _I)])
_FOUND_DDL = "c1 bigint, c2 bigint, ranges array<struct<a:int,b:int>>, w1 bigint, w2 bigint, at int"


def _chunks(batch: pa.RecordBatch, length: int, whole_texts: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, offsets in their text, ends and bytes of parts that fill about a chunk together.

    Parts of a text overlap so that each window lies in one; or texts are not cut.
    """
    step, got, room = _CHUNK - 2 * length, [], _CHUNK // 2
    for row, text in enumerate(batch.column(2)):
        data = text.as_buffer()
        parts = [(0, len(data))] if whole_texts else [(at, min(len(data), at + step + length - 1)) for at in range(0, max(1, len(data) - length + 1), step)]
        for a, b in parts:
            if got and room < b - a:
                yield _joined(got)
                got, room = [], _CHUNK // 2
            got.append((row, a, memoryview(data)[a:b]))
            room -= b - a
    if got:
        yield _joined(got)


def _joined(got: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, offsets = (np.array([g[k] for g in got], np.int64) for k in (0, 1))
    return rows, offsets, np.cumsum([len(g[2]) for g in got]), np.frombuffer(b"".join(g[2] for g in got), np.uint8)


def _occurrences(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(k).to_numpy() for k in (0, 1))
            for rows, offsets, ends, data in _chunks(batch, length):
                start, end, key, c1, c2 = contexts(data, ends, length)
                part = np.searchsorted(ends, start, "right")
                moved = offsets[part] - np.concatenate(([0], ends))[part]
                row = rows[part]
                columns = (t1[row], t2[row], start + moved, end + moved, key, c1, c2, np.ones(len(row), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if f.type == _I else c, f.type) for c, f in zip(columns, _OCCURS, strict=True)], schema=_OCCURS)

    return run


def _word_runs(words: int):
    schema = pa.schema([("key", _L), ("c", _L), ("t", _L)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(0).to_numpy()
            for rows, _, ends, data in _chunks(batch, 0, whole_texts=True):
                part, _, _, key, c, _ = passages(data, ends, words)
                yield pa.RecordBatch.from_arrays([pa.array(x, _L) for x in (key, c, t[rows[part]])], schema=schema)

    return run


def _word_windows(words: int):
    """Hashes of the word windows at the anchors that a text is asked for."""
    schema = pa.schema([("w", _L), ("t", _L)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, text, keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                _, first, last, key, _, window = passages(data, np.array([len(data)]), words)
                asked = np.isin(key, keys.values.to_numpy())
                first, count = first[asked], (last - first + 1)[asked]
                at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                w = np.unique(window[at])
                yield pa.RecordBatch.from_arrays([pa.array(w, _L), pa.array(np.full(len(w), t), _L)], schema=schema)

    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the contexts that a text is to provide."""
    for batch in batches:
        rows, size = [], 0
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            data = text.as_py().encode()
            for w in wanted.as_py():
                rows.append((w["key"], w["sub"], w["split"], w["c1"], w["c2"], data[w["s"] : w["e"]]))
                size += w["e"] - w["s"]
            if size > 1 << 24:
                yield _batch(_CONTEXT, rows)
                rows, size = [], 0
        yield _batch(_CONTEXT, rows)


def _many(w: np.ndarray) -> np.ndarray:
    """Which rows of the sorted pairs occur more than once."""
    same = (w[1:, 0] == w[:-1, 0]) & (w[1:, 1] == w[:-1, 1])
    return np.concatenate((same, [False])) | np.concatenate(([False], same))


def _sort_shards(length: int, split: int, shard_bytes: int):
    def windows(shard: list[tuple], owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        data = np.frombuffer(b"".join(g[5] for g in shard), np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(g[5]) for g in shard])))[owner] + at
        return np.stack([_rolling(data, length, b)[starts].view(np.int64) for b in _BASES], axis=1)

    def cuts(group: list[tuple]) -> list[int]:
        """Where the shards of one anchor begin."""
        begin, size = [0], 0
        for k, g in enumerate(group):
            if k > begin[-1] and (k - begin[-1] == split or size + len(g[5]) > shard_bytes):
                begin.append(k)
                size = 0
            size += len(g[5])
        return begin

    def settle_group(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Found ranges of each context. If the contexts of one anchor fill several shards, the sorted windows of
        these are merged; if they fill several tasks, their windows are given as well."""
        masks, own, at, sums = [], [], [], []
        begin = cuts(group) if group[0][:2] == group[-1][:2] else [0]
        several, dealt = len(begin) > 1, np.array([g[2] for g in group])
        for k, end in zip(begin, [*begin[1:], len(group)], strict=True):
            shard = group[k:end]
            found, owner, place, first = repeated([g[5] for g in shard], length)
            masks += [m.copy() for m in found]
            if several or dealt[k:end].any():
                pick = first if several else first & dealt[k:end][owner]
                own.append((owner[pick] + k).astype(np.int32))
                at.append(place[pick].astype(np.int32))
                sums.append(windows(shard, owner[pick], place[pick]))
        if sums:
            o, p, w = np.concatenate(own), np.concatenate(at), np.concatenate(sums)
            own, at, sums = [], [], []
            if several:
                order = np.lexsort((w[:, 1], w[:, 0]))
                o, p, w = o[order], p[order], w[order]
                for c, q in zip(o[many := _many(w)].tolist(), p[many].tolist(), strict=True):
                    masks[c][q] = True
        yield _batch(_FOUND, [(g[3], g[4], [{"a": a, "b": b} for a, b in ranges(m, length)], None, None, None) for g, m in zip(group, masks, strict=True) if m.any()])
        if dealt.any():
            c1, c2 = (np.array([g[k] for g in group], np.int64) for k in (3, 4))
            for k in range(0, len(o), _CHUNK):
                c, pair, q = o[k : k + _CHUNK], w[k : k + _CHUNK], p[k : k + _CHUNK]
                keep = dealt[c]
                c, pair, q = c[keep], pair[keep], q[keep]
                yield pa.RecordBatch.from_arrays([pa.array(c1[c]), pa.array(c2[c]), pa.nulls(len(c), _FOUND.field("ranges").type), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(q)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, start = [], 0, 0  # start: where the contexts of the last anchor begin
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:2] != group[-1][:2]:
                    if size >= shard_bytes or len(group) - start > split:
                        # the anchors before fill no more than a shard; the last may fill several
                        for part in (group[:start], group[start:]):
                            if part:
                                yield from settle_group(part)
                        group, size = [], 0
                    start = len(group)
                if not group or row[:5] != group[-1][:5]:
                    group.append(row)
                    size += len(row[5])
        for part in (group[:start], group[start:]):
            if part:
                yield from settle_group(part)

    return run


def _merge_shards(length: int):
    """Windows of several shards, sorted: each is searched among all of them."""
    schema = pa.schema([("c1", _L), ("c2", _L), ("at", _I)])

    def settled(w: np.ndarray, rest: pa.RecordBatch) -> pa.RecordBatch:
        return rest.filter(pa.array(_many(w)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.concat_batches([held, batch]) if held is not None and len(held) else batch
            w = np.stack([table.column("w1").to_numpy(), table.column("w2").to_numpy()], axis=1)
            if not len(w):
                continue
            end = int(np.searchsorted(w[:, 0], w[-1, 0]))
            held = table.slice(end)
            if end:
                yield settled(w[:end], table.slice(0, end).select(schema.names))
        if held is not None and len(held):
            yield settled(np.stack([held.column("w1").to_numpy(), held.column("w2").to_numpy()], axis=1), held.select(schema.names))

    return run


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def removed_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, split: int = SPLIT, shard_bytes: int = SHARD_BYTES, task_shards: int = TASK_SHARDS) -> DataFrame:
    """``(t1, t2, spans)`` for each distinct text of which bytes go: runs ``(a, b)`` of its UTF-8 bytes, in no order and unmerged.

    Texts are named by two hashes. ``split`` and ``shard_bytes`` bound a shard: contexts of one
    anchor are dealt to a further shard for each ``split`` of them or ``shard_bytes`` bytes, and to a further
    task for each ``split * task_shards`` of them.
    """
    texts = docs.select(whole(text_col).alias("text"))
    every = texts.select(*_hashes(F.col("text")), "text").where(F.octet_length("text") >= length).mapInArrow(_occurrences(length), "t1 bigint, t2 bigint, s int, e int, key bigint, c1 bigint, c2 bigint, n bigint")
    with noting() as used:
        every = settle(every, "occurrences")
    # added up before the shuffle, so a frequent anchor is one row of each task; the join is split where one is hot
    again = every.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key")
    places = settle(every.join(again, "key", "left_semi"), "places")
    release(docs.sparkSession, used)
    first = [F.first(c).alias(c) for c in ("t1", "t2", "s", "e")]
    kinds = settle(places.groupBy("key", "c1", "c2").agg(F.sum("n").alias("n"), *first), "contexts")
    whole_ones = kinds.where("n > 1").select("c1", "c2", F.array(F.struct(F.lit(0).alias("a"), (F.col("e") - F.col("s")).alias("b"))).alias("ranges"))
    in_task = split * task_shards
    several = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(several, "key").select("t1", "t2", F.struct("s", "e", "key", F.pmod("c1", F.ceil(F.col("kinds") / in_task)).cast("int").alias("sub"), (F.col("kinds") > in_task).alias("split"), "c1", "c2").alias("w"))
    by_text = wanted.groupBy("t1", "t2").agg(F.collect_list("w").alias("wanted"))
    distinct = texts.select(*_hashes(F.col("text")), "text").where(F.octet_length("text") >= length).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    cut_out = distinct.join(by_text, ["t1", "t2"]).select("text", "wanted").mapInArrow(_extract, "key bigint, sub int, split boolean, c1 bigint, c2 bigint, data binary")
    sorted_ = cut_out.repartition("key", "sub").sortWithinPartitions("key", "sub", "c1", "c2").mapInArrow(_sort_shards(length, split, shard_bytes), _FOUND_DDL)
    found = settle(sorted_, "found")
    windows = found.where("w1 is not null").select("w1", "w2", "c1", "c2", "at").repartition("w1").sortWithinPartitions("w1", "w2")
    merged = windows.mapInArrow(_merge_shards(length), "c1 bigint, c2 bigint, at int").groupBy("c1", "c2").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + length).alias("b"))).alias("ranges"))
    verdict = whole_ones.unionByName(found.where("ranges is not null").select("c1", "c2", "ranges")).unionByName(merged)
    moved = places.select("t1", "t2", "s", "c1", "c2").join(verdict, ["c1", "c2"]).select("t1", "t2", F.transform("ranges", lambda r: F.struct((r.a + F.col("s")).alias("a"), (r.b + F.col("s")).alias("b"))).alias("r"))
    return moved.groupBy("t1", "t2").agg(F.flatten(F.collect_list("r")).alias("spans"))


def in_passages(docs: DataFrame, text_col: str = "text", words: int = PASSAGE) -> DataFrame:
    """``(t1, t2)`` of the distinct texts with a passage of ``words`` words that another row has too, whatever parts the words.

    Windows of words are dealt by anchors like those of bytes. Equal runs of windows settle most
    texts; only what they leave open, and what shares an anchor with it, is compared window by
    window. Here texts are told apart by 64 bits.
    """
    texts = docs.select(whole(text_col).alias("text"))
    named = texts.select(*_hashes(F.col("text")), "text").where(F.octet_length("text") >= 2 * words - 1)
    with noting() as used:
        runs = settle(named.mapInArrow(_word_runs(words), "key bigint, c bigint, t bigint"), "word-runs")
    differ = lambda df, *by: df.groupBy(*by).agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select(*by)
    shared = settle(runs.join(differ(runs, "key"), "key", "left_semi"), "shared-runs")
    sure = shared.join(differ(shared, "key", "c"), ["key", "c"], "left_semi").select("t").distinct()
    copies = named.groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    long = runs.select("t").distinct()
    sure = cut(sure.unionByName(copies.where("copies > 1").select(F.col("t1").alias("t")).join(long, "t", "left_semi")).distinct())
    release(docs.sparkSession, used)
    open_ = shared.join(sure, "t", "left_anti").select("key").distinct()
    asked = shared.join(open_, "key", "left_semi").groupBy("t").agg(F.collect_set("key").alias("keys"))
    windows = cut(named.select(F.col("t1").alias("t"), "text").join(asked, "t").select("t", "text", "keys").mapInArrow(_word_windows(words), "w bigint, t bigint").distinct())
    found = windows.join(differ(windows, "w"), "w", "left_semi").select("t").distinct()
    told = sure.unionByName(found).distinct()
    return copies.join(told, F.col("t1") == F.col("t"), "left_semi").select("t1", "t2")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, split: int = SPLIT, shard_bytes: int = SHARD_BYTES, task_shards: int = TASK_SHARDS, words: int | None = None) -> DataFrame:
    """``(id, n_bytes, spans, kept)``, one row per row of ``docs``: merged byte runs that go, and the bytes that stay.

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in
    this or another row. Null and empty texts have no bytes; shorter texts stay whole; repeated
    rows are repeats of each other. Ids may be null or repeated; texts are taken whole, however
    long. With ``words``, ``passage`` tells whether the row has a passage of so many words that
    another row has too (:func:`in_passages`); this removes nothing.
    """
    spans = removed_spans(docs, text_col, length, split, shard_bytes, task_shards)
    named = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    more = []
    if words is not None:
        told = in_passages(docs, text_col, words).withColumn("spans", F.array().cast("array<struct<a:int,b:int>>")).withColumn("passage", F.lit(True))
        spans = spans.withColumn("passage", F.lit(False)).unionByName(told).groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("passage").alias("passage"))
        more = [F.coalesce("passage", F.lit(False)).alias("passage")]
    joined = named.select("id", *_hashes(F.col("text")), "text").join(spans, ["t1", "t2"], "left").select("id", "text", "spans", *more)
    kind = docs.schema[id_col].dataType.simpleString()

    def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs that the stretches from ``a`` to ``b`` cover."""
        order = np.argsort(a, kind="stable")
        a, reach = a[order], np.maximum.accumulate(b[order])
        head = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
        return a[head], reach[np.concatenate((head[1:], [len(a)])) - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, counts, runs = [], [], [], []
            listed = batch.column(2)
            offsets, flat = listed.offsets.to_numpy(), listed.values
            a, b = (flat.field(k).to_numpy() for k in (0, 1))
            for k, text in enumerate(batch.column(1)):
                data = text.as_buffer().to_pybytes()
                sizes.append(len(data))
                lo, hi = offsets[k], offsets[k + 1]
                if lo == hi:
                    counts.append(0)
                    kept.append(data)
                    continue
                start, end = merged(a[lo:hi], b[lo:hi])
                counts.append(len(start))
                runs.append((start, end))
                kept.append(b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True)))
            both = [pa.array(np.concatenate([r[k] for r in runs]) if runs else np.zeros(0), _I) for k in (0, 1)]
            gone = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), _I), pa.StructArray.from_arrays(both, names=["a", "b"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, _L), gone, pa.array(kept, pa.binary()), *batch.columns[3:]], names=["id", "n_bytes", "spans", "kept", *batch.schema.names[3:]])

    return joined.mapInArrow(run, f"id {kind}, n_bytes bigint, spans array<struct<a:int,b:int>>, kept binary" + (", passage boolean" if more else ""))

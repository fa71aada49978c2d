"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints have 64 bits, cut into blocks of 23, 23 and 18 bits. In each block the code words
of the binary Golay code (23 bits, 4,096 words, every point within distance 3 of exactly one)
are the anchors; the short block is padded with zeros. Two fingerprints that differ in at most
four bits differ in at most two bits over some two of the three blocks. For each pair of blocks
a fingerprint is therefore replicated to every pair of anchors within the covering radius plus
what remains of the threshold, and fingerprints are compared per anchor pair (3 x 2^24 anchors,
about 184 replicas of 12 bytes for each distinct fingerprint).
"""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import cut
from weftline.llm.components import connected_components

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GOLAY = 0b110001110101
RADIUS = 3
#: Lowest bit and width of the three blocks.
BLOCKS = ((0, 23), (23, 23), (46, 18))
#: Differing bits at which two fingerprints link, and what two of three blocks hold of them.
THRESHOLD, SHARE = 4, 2
_CHUNK = 1 << 19


def _hashes(text: str | None, size: int, seed: int) -> list[int]:
    parts = (text or "").encode().lower().split()
    if not parts:
        return []
    joined, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[min(size, len(parts)) - 1 :], strict=False)]


def _fold(hashes: list[int], lengths: list[int]) -> np.ndarray:
    """One fingerprint for each run of hashes: a bit is set if more than half of them have it."""
    out = np.zeros(len(lengths), np.uint64)
    sizes = np.asarray(lengths, np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    bits = np.unpackbits(np.asarray(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """``(id, fingerprint)`` of every whole text, the fingerprint as a signed 64-bit integer.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; the XXH64 of every
    shingle votes on each bit. A text with fewer words than a shingle is one shingle; a text
    without words (null, empty, blank) has fingerprint zero. Repeated rows stay repeated;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, lengths, done = batch.column(0), [], [], []
            for text in batch.column(1):
                got = _hashes(text.as_py(), shingle, seed)
                hashes += got
                lengths.append(len(got))
                if len(hashes) >= _CHUNK:
                    done.append(_fold(hashes, lengths))
                    hashes, lengths = [], []
            done.append(_fold(hashes, lengths))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(done).view(np.int64))], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint bigint")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """``(id, text)``: the distinct shingles of every text in order of their hash, each written as a word of 8 letters.

    Texts are cut as for :func:`fingerprints`. A text without words has one shingle of its own
    kind, so that such texts are alike; 48 bits of each hash are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for text in batch.column(1):
                hashes = np.unique(np.array(_hashes(text.as_py(), shingle, seed), np.uint64))
                letters = b64encode(np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]))
                told.append(" ".join(np.frombuffer(letters, "S8").astype(str).tolist()) or "-")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], names=["id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, text string")


@cache
def _anchors_near() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Remainders of all messages, and by excess over the radius the errors of each syndrome: first, count, patterns."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    message = np.array([remainder(m << 11) for m in range(1 << 12)], np.int64)
    errors: list[list[tuple[int, int]]] = [[] for _ in range(SHARE + 1)]
    for weight in range(RADIUS + SHARE + 1):
        for at in combinations(range(23), weight):
            e = sum(1 << b for b in at)
            errors[max(0, weight - RADIUS)].append((int(message[e >> 11]) ^ e & 2047, e))
    near = []
    for found in errors:
        pairs = np.array(sorted(found), np.int64)
        count = np.bincount(pairs[:, 0], minlength=2048)
        near.append((np.concatenate(([0], np.cumsum(count)[:-1])), count, pairs[:, 1]))
    return message, near


def _replicas(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys of each fingerprint (uint64), and which fingerprint each belongs to."""
    message, near = _anchors_near()
    block = [((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in BLOCKS]
    syndrome = [message[x >> 11] ^ x & 2047 for x in block]
    keys, owners = [], []
    for table, (i, j) in enumerate(combinations(range(3), 2)):
        for left in range(SHARE + 1):
            for right in range(SHARE + 1 - left):
                (first_i, count_i, error_i), (first_j, count_j, error_j) = near[left], near[right]
                n_j = count_j[syndrome[j]]
                n = count_i[syndrome[i]] * n_j
                owner = np.repeat(np.arange(len(prints)), n)
                k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                a, b = np.divmod(k, n_j[owner])
                word_i = (block[i][owner] ^ error_i[first_i[syndrome[i][owner]] + a]) >> 11
                word_j = (block[j][owner] ^ error_j[first_j[syndrome[j][owner]] + b]) >> 11
                keys.append(table << 24 | word_i << 12 | word_j)
                owners.append(owner)
    return np.concatenate(keys).astype(np.int32), np.concatenate(owners)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(all_prints), 4096):
            prints = all_prints[at : at + 4096]
            keys, owners = _replicas(prints)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[owners].view(np.int64))], names=["anchor", "fingerprint"])


def _forest(prints: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among the distinct ``prints``, at most one for each.

    Breadth first over what is not reached yet, so that a dense group costs little more than
    its size; isolated points are settled by blocks.
    """
    links, rest = [], prints
    near = lambda some, all_: np.bitwise_count(some[:, None] ^ all_[None, :]) <= threshold
    while len(rest) > 1:
        hits = near(rest[:256], rest)
        linked = hits.sum(axis=1) > 1
        if not linked.any():
            rest = rest[256:]
            continue
        seed = rest[int(np.argmax(linked))]
        # isolated points among those just compared need no second look
        rest = rest[np.concatenate((linked, np.ones(len(rest) - len(linked), bool)))]
        rest = rest[rest != seed]
        front = np.array([seed], np.uint64)
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            for at in range(0, len(front), 64):
                reached |= near(front[at : at + 64], rest).any(axis=0)
            front = rest[reached]
            rest = rest[~reached]
            links.append((np.full(len(front), seed, np.uint64), front))
    return links


def _compare(threshold: int):
    def links_of(keys: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        links = []
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(edge)
        small = np.repeat(size, size)
        for shift in range(1, 16):  # many short runs at once
            same = np.flatnonzero((small[:-shift] > shift) & (small[:-shift] <= 16) & (keys[shift:] == keys[:-shift])) if len(keys) > shift else []
            if not len(same):
                break
            hit = same[np.bitwise_count(prints[same] ^ prints[same + shift]) <= threshold]
            links.append((prints[hit], prints[hit + shift]))
        for k in np.flatnonzero(size > 16):
            links += _forest(prints[edge[k] : edge[k + 1]], threshold)
        return links

    def tidy(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([x[i] for x in links]) if links else np.zeros(0, np.uint64) for i in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_prints = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((held_keys, batch.column(0).to_numpy()))
            prints = np.concatenate((held_prints, batch.column(1).to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            end = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            held_keys, held_prints = keys[end:], prints[end:]
            if end:
                yield tidy(links_of(keys[:end], prints[:end]))
        if len(held_keys):
            yield tidy(links_of(held_keys, held_prints))

    return run


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that differ in at most ``threshold`` (up to 4) bits.

    They connect everything that is linked, but hold no more than a few links for each
    fingerprint of an anchor, however many lie close together. Nulls are ignored, repeated
    fingerprints count once, an empty table gives none.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the code covers thresholds from 0 to {THRESHOLD}")
    # a fingerprint becomes some hundred rows, so a task is to hold few; a given number is not put together again
    tasks = 4 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.select("fingerprint").where("fingerprint is not null").repartition(tasks, "fingerprint").distinct()
    spread = dealt.mapInArrow(_replicate, "anchor int, fingerprint bigint")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(threshold), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """``(id, fingerprint, component)``: one row per row of ``docs``.

    ``component`` is the smallest id that is reachable over links of at most ``threshold``
    differing bits. Documents without words share fingerprint zero and link like any other;
    rows with a null id keep a null id and never name a component unless they are alone.
    Copies are one fingerprint each, so their number costs nothing; ties need no order.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(marked.groupBy("fingerprint").agg(F.min("id").alias("least")))
    groups = connected_components(links(classes, threshold))
    named = groups.join(classes, groups.node == classes.fingerprint).select("fingerprint", "component", "least")
    smallest = named.groupBy("component").agg(F.min("least").alias("of_group"))
    linked = named.join(smallest, "component").select("fingerprint", "of_group")
    told = classes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("of_group", "least").alias("component"))
    return marked.join(told, "fingerprint").select("id", "fingerprint", "component")

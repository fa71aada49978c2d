"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Unit vectors, less their mean, are turned by rotations that are learned to keep signs stable
(iterative quantization), and the 128 signs are a vector's code. A code is cut into substrings
of 16 bits, each with a table of its own. Two codes within a Hamming radius of ``8 s + a`` differ
in at most ``s`` bits in one of the first ``a + 1`` substrings or in at most ``s - 1`` in one of the
others, so looking up these finds every code within the radius; what is found is ranked by
the vectors themselves.

The rows lie in shards of bounded size and the queries in blocks of bounded size; each block
meets each shard once, and only the best of a query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.lineage import settle
from weftline.llm.vectors import clean

BITS, PART = 128, 16
PARTS = BITS // PART
#: The fit takes so many rows at most, and so many numbers in all.
SAMPLE_ROWS, SAMPLE_NUMBERS = 10_000, 4_000_000
#: Rows of the sample that are looked up in it to learn the radius, and the share of their neighbours that has to lie within.
TRIED, SHARE = 500, 0.98
ROUNDS = 25
#: Rows of a shard and queries of a block, about.
SHARD_ROWS, BLOCK_QUERIES = 8_192, 2_048

#: All patterns of a substring by their number of ones, and how many have up to k ones.
_ONES = np.bitwise_count(np.arange(1 << PART, dtype=np.uint16))
_PATTERNS = np.argsort(_ONES, kind="stable").astype(np.uint16)
_UP_TO = np.cumsum(np.bincount(_ONES, minlength=PART + 1))


@dataclass(frozen=True)
class Codes:
    """A fit: the mean of unit vectors, rotations as columns, and the Hamming radius within which neighbours lie."""

    mean: np.ndarray
    turns: np.ndarray
    radius: int

    def of(self, v: np.ndarray) -> np.ndarray:
        """The codes of vectors as rows of 16-bit substrings."""
        return np.packbits((_units(v) - self.mean) @ self.turns > 0, axis=1, bitorder="little").view(np.uint16)


def _units(v: np.ndarray) -> np.ndarray:
    return v / _norms(v)[:, None]


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that neither squares nor sums leave the range of doubles; angles stay exactly."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _turns(x: np.ndarray) -> np.ndarray:
    """``BITS`` directions in groups of orthogonal ones, each turned until the signs of ``x`` fit its values best."""
    dims, groups = x.shape[1], []
    for k in range(-(-BITS // dims)):
        width = min(dims, BITS - k * dims)
        start = np.random.default_rng(k).normal(size=(dims, dims)) if dims <= BITS else np.linalg.svd(x, full_matrices=True)[2].T
        r = np.linalg.qr(start)[0][:, :width]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0), full_matrices=False)
            r = u @ vt
        groups.append(r)
    return np.concatenate(groups, axis=1)


def fit(rows: DataFrame, k: int = 5) -> Codes:
    """Codes learned from the ``(id, v)`` rows of the smallest hashes, ``SAMPLE_ROWS`` and ``SAMPLE_NUMBERS`` at most.

    The radius holds ``SHARE`` of the ``k`` nearest others of ``TRIED`` rows of the sample. In a
    larger table neighbours are nearer, so the radius holds more of them there.
    """
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        return Codes(np.zeros(1), np.ones((1, BITS)), BITS)
    most = max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // first["n"]))
    u = _units(_scaled(_matrix(rows.select("v").orderBy(F.xxhash64("v"), "v").limit(most).toArrow()["v"])))
    mean = u.mean(axis=0)
    codes = Codes(mean, _turns(u - mean), BITS)
    if len(u) < 2:
        return codes
    tried = np.linspace(0, len(u) - 1, min(TRIED, len(u))).astype(int)
    near = u[tried] @ u.T
    near[np.arange(len(tried)), tried] = -np.inf
    best = np.argpartition(-near, min(k, len(u) - 1) - 1, axis=1)[:, : min(k, len(u) - 1)]
    bits = codes.of(u)
    far = np.bitwise_count(bits[tried][:, None, :] ^ bits[best]).sum(axis=2, dtype=np.int64)
    return Codes(mean, codes.turns, int(np.quantile(far, SHARE, method="higher")))


def index(rows: DataFrame, codes: Codes) -> DataFrame:
    """``(row, shard, id, v, code)``: the written index of the ``(id, v)`` rows.

    ``row`` numbers the rows, with gaps. Shards take rows in turn, so equal ids or vectors
    don't make one larger; they hold about ``SHARD_ROWS``.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _scaled(_matrix(batch.column(2)))
                told = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(v), [None, pa.py_buffer(np.ascontiguousarray(codes.of(v)).tobytes())]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, told], names=["row", "id", "v", "code"])

    kind = rows.schema["id"].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    coded = settle(numbered.mapInArrow(encode, f"row long, id {kind}, v array<double>, code binary"), "codes")
    shards = -(-coded.count() // SHARD_ROWS)
    return coded.withColumn("shard", F.pmod("row", F.lit(max(shards, 1))).cast("int"))


class Tables:
    """The substring tables of a shard: where each value of each substring stands."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.parts = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, starts = np.unique(codes[order, j], return_index=True)
            slots = np.full(1 << PART, -1, np.int32)
            slots[values] = np.arange(len(values))
            self.parts.append((values, slots, order, np.append(starts, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes that differ from ``code`` in ``radius`` bits at most."""
        if radius >= BITS:
            return np.arange(len(self.codes))
        near = np.zeros(len(self.codes), bool)
        least, more = divmod(radius, PARTS)
        for j, (values, slots, order, starts) in enumerate(self.parts):
            most = least if j <= more else least - 1
            if most < 0:
                continue
            if _UP_TO[most] < len(values):  # fewer patterns to look up than values to compare
                hit = slots[_PATTERNS[: _UP_TO[most]] ^ code[j]]
                hit = hit[hit >= 0]
            else:
                hit = np.flatnonzero(_ONES[values ^ code[j]] <= most)
            sizes = starts[hit + 1] - starts[hit]
            at = np.repeat(starts[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            near[order[at]] = True
        found = np.flatnonzero(near)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=np.int64) <= radius]


def _best(queries: DataFrame, rows: DataFrame, radius: int, k: int) -> DataFrame:
    """``(q, query_id, id, score, rank)``: the ``k`` nearest rows of each query of those within a radius."""
    kind = rows.schema["id"].dataType.simpleString()

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        own, of, at, scores = [], [], [], []
        if asked.num_rows and there.num_rows:
            code = lambda t: np.frombuffer(b"".join(t["code"].to_pylist()), np.uint16).reshape(t.num_rows, PARTS)
            tables, v, numbers, ids = Tables(code(there)), _matrix(there["v"]), there["row"].to_numpy(), there["id"].combine_chunks()
            norms, mine = _norms(v), _matrix(asked["v"])
            for i, (q, c, x, norm) in enumerate(zip(asked["row"].to_pylist(), code(asked), mine, _norms(mine), strict=True)):
                near = tables.within(c, radius)
                near = near[numbers[near] != q]
                # one sum for each row, so equal vectors get equal scores wherever they stand; no minus zero
                score = (v[near] * x).sum(axis=1) / (norms[near] * norm) + 0.0
                if len(near) > k:
                    few = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                    near, score = near[few], score[few]
                    few = pc.sort_indices(pa.table({"s": score, "id": ids.take(pa.array(near))}), sort_keys=[("s", "descending"), ("id", "ascending")]).to_numpy()[:k]
                    near, score = near[few], score[few]
                of += [i] * len(near)
                own += [q] * len(near)
                at.append(near)
                scores.append(score)
            at = np.concatenate(at)
            return pa.table({"q": pa.array(own, pa.int64()), "query_id": asked["id"].combine_chunks().take(pa.array(of, pa.int64())), "id": ids.take(pa.array(at)), "score": np.concatenate(scores)})
        return pa.table({"q": pa.array([], pa.int64()), "query_id": asked["id"].slice(0, 0), "id": there["id"].slice(0, 0), "score": pa.array([], pa.float64())})

    shards = rows.agg(F.max("shard")).first()[0]
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    asked = queries.select("row", "id", "v", "code", F.explode(F.sequence(F.lit(0), F.lit(shards or 0))).alias("shard"), F.pmod("row", F.lit(blocks)).cast("int").alias("block"))
    there = rows.select("row", "id", "v", "code", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = asked.groupBy("shard", "block").cogroup(there.groupBy("shard", "block")).applyInArrow(meet, f"q long, query_id {kind}, id {kind}, score double")
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, codes: Codes, k: int = 5) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest rows of an :func:`index` for each query, which are rows of it too.

    Largest cosine first, ties to the smaller id, null ids last; a query's own row is no
    candidate, another row of its id is. Every row within the radius is looked at. A query with
    fewer than ``k`` of these is searched again at twice the radius, until it has ``k`` or all
    other rows. Vectors that occur many times are rows like others.
    """
    need, radius, found, left = min(k, rows.count() - 1), codes.radius, [], queries
    while True:
        got = settle(_best(left, rows, radius, k), "neighbours")
        if radius >= BITS or need < 1:
            found.append(got)
            break
        done = got.where(F.col("rank") == need).select("q")
        found.append(got.join(done, "q", "left_semi"))
        left = settle(left.join(done.select(F.col("q").alias("row")), "row", "left_anti"), "queries-left")
        if left.isEmpty():
            break
        radius = min(BITS, 2 * radius + 1)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "rank", "id", "score")


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest others of each row that ``is_query`` holds of, a condition on the column ``id``.

    Vectors that are null, empty, zero or hold a null or non-finite entry take no part, nor do
    those of another length than most. ``exact`` looks at every row, to measure recall against.
    """
    rows = clean(df, id_col, vec_col, zeros=False)
    codes = fit(rows, k)
    there = index(rows, codes)
    return search(there, there.where(is_query), Codes(codes.mean, codes.turns, BITS) if exact else codes, k)

"""Whitening of vectors: a Gramian over exactly centred whole numbers, its eigenvectors, and a projection.

The Gramian and the whitening matrix have the size of a vector squared, whatever the number of
rows; they are all that passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import settle
from weftline.llm.vectors import clean

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries are held within this, so that whole numbers have room.
MOST = 2.0**52
#: Variances under this part of the largest one are zero to double precision.
NOTHING = 1e-12


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` rows with the exact ``sums`` of each dimension; unit ``components`` as columns, by falling variance, with ``shares`` of all variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    shares: np.ndarray
    components: np.ndarray


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, x)`` of the vectors that count (:func:`clean`), entries as whole numbers.

    Entries beyond ``MOST`` over ``SCALE`` either way count as that bound.
    """
    x = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))) + SHIFT
    return clean(df, id_col, vec_col).select("id", F.transform("v", x).alias("x"))


def _off_mean(n: int, sums: list[int]) -> Column:
    """``n * x - S``: exact, as decimals."""
    wide = lambda c: c.cast("decimal(38,0)")
    s = F.array(*(wide(F.lit(str(v))) for v in sums))
    return F.transform("x", lambda v, i: wide(wide(v) * wide(F.lit(str(n)))) - F.get(s, i))


def _gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of an array column, put together in a tree of tasks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """``(id, d, deviation)``: ``x - S/n`` rounded once, and the exact sum of ``(n * x - S)^2`` as a decimal."""
    off = rows.select("id", _off_mean(n, sums).alias("o"))
    squares = F.aggregate("o", F.lit(0).cast("decimal(38,0)"), lambda a, o: (a + (o * o).cast("decimal(38,0)")).cast("decimal(38,0)"))
    return off.select("id", F.transform("o", lambda o: o.cast("double") / F.lit(float(n))).alias("d"), squares.alias("deviation"))


def fit(rows: DataFrame) -> tuple[Whitening, DataFrame]:
    """The whitening of the ``(id, x)`` rows and their :func:`centred` form.

    Sums are exact. Components are unit eigenvectors of the covariance with divisor n, each with
    its largest entry positive. Those without variance can't be whitened and are left out.
    """
    sums = rows.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    n, sums = int(sums[0]["n"]), [int(r["s"]) for r in sums]
    flat = settle(centred(rows, n, sums), "centred")
    cov = _gramian(flat, "d") / n
    e, w = np.linalg.eigh((cov + cov.T) / 2)
    e, w = e[::-1], w[:, ::-1]
    kept = e > max(float(e[0]), 0.0) * max(NOTHING, np.finfo(float).eps * len(e))
    w = w * np.where(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])] < 0, -1.0, 1.0)
    total = float(np.trace(cov))
    return Whitening(n, sums, e[kept], e[kept] / total if total else e[kept], w[:, kept]), flat


def whitened(flat: DataFrame, how: Whitening, most: int | None = None) -> DataFrame:
    """``(id, deviation, w)``: the centred rows projected on the first ``most`` components, each over the root of its variance.

    The matrix is sent to the tasks once; it has the size of a vector squared at most.
    """
    k = len(how.variances) if most is None else min(most, len(how.variances))
    matrix = flat.sparkSession.sparkContext.broadcast(how.components[:, :k] / np.sqrt(how.variances[:k]))

    def project(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                told = np.stack(part["d"].to_numpy()) @ matrix.value
                yield pd.DataFrame({"id": part["id"].astype(object), "deviation": part["deviation"], "w": list(told)})

    kind = flat.schema["id"].dataType.simpleString()
    return flat.mapInPandas(project, f"id {kind}, deviation decimal(38,0), w array<double>")


def identity_error(rows: DataFrame, column: str = "w") -> float:
    """Largest entry by which the covariance of whitened rows differs from the identity."""
    mean = rows.select(F.posexplode(column).alias("k", "c")).groupBy("k").agg(F.avg("c").alias("m"), F.count("*").alias("n")).orderBy("k").collect()
    if not mean:
        return 0.0
    means = F.array(*(F.lit(float(r["m"])) for r in mean))
    g = _gramian(rows.select(F.transform(column, lambda c, i: c - F.get(means, i)).alias("c")), "c") / int(mean[0]["n"])
    return float(np.abs(g - np.eye(len(g))).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 32) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` for each vector that counts and each component up to ``most``.

    The fit list is all vectors that count, copies and repeated ids included. Null vectors, and
    those with null or non-finite entries, are left out, as are ones of another length than most.
    No vectors, one vector or equal vectors have no variance and give an empty result.
    """
    rows = settle(whole_numbers(df, id_col, vec_col), "whole-numbers")
    kind = df.schema[id_col].dataType.simpleString()
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    how, flat = fit(rows)
    told = settle(whitened(flat, how, most), "whitened")
    shares = F.array(*(F.lit(float(s)) for s in how.shares[:most])) if len(how.shares) else F.array().cast("array<double>")
    each = told.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.select(
        "id", (F.col("k") + 1).alias("component"), F.lit(how.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"),
        F.lit(identity_error(told)).alias("identity_error"),
    )

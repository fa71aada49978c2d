"""Vectors in an array column: which of them count, as doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zeros: bool = True) -> DataFrame:
    """``(id, v)``: the vectors as doubles, without those that are null, empty or hold a null or a number that isn't finite.

    With ``zeros`` false, vectors of nothing but zeros go too. Vectors count if they have the
    length that most of the others have (the larger one, if two are as frequent); the rest is
    left out, as it can't be compared. Ids may be null or repeated; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.size("v") > 0)
    # nan equals nan for Spark
    far = (float("nan"), float("inf"), float("-inf"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~x.isin(*far)))
    if not zeros:
        rows = rows.where(F.exists("v", lambda x: x != 0.0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (usual[0]["n"] if usual else 0))

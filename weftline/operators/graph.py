"""Nodes, degrees, flags and packages of a graph given as an edge table.

Edges are rows ``(src, dst)``, "src depends on dst"; repeated rows are parallel edges and count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import package_of


@dataclass(frozen=True)
class Graph:
    """``nodes (id, label, package)`` and ``edges (src, dst)``."""

    nodes: DataFrame
    edges: DataFrame


def ids_of(e: DataFrame) -> DataFrame:
    """Distinct ends of the edges."""
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def build_nodes(e: DataFrame, standalone: DataFrame | None = None) -> DataFrame:
    """``(id, label, package)`` of all ends of edges and of standalone ids."""
    ids = e.select(F.explode(F.array("src", "dst")).alias("id"))
    if standalone is not None:
        ids = ids.unionByName(standalone.select("id"))
    return ids.distinct().select("id", F.col("id").alias("label"), package_of(F.col("id")).alias("package"))


def degrees(v: DataFrame, e: DataFrame) -> DataFrame:
    """``(id, in_degree, out_degree)`` with parallel edges; a self-loop counts in both."""
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    counted = ends.groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return v.select("id").join(counted, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def node_flags(v: DataFrame, e: DataFrame) -> DataFrame:
    """Degrees with ``is_root``, ``is_leaf`` and ``unique_parent``: the source if exactly one edge comes in."""
    parent = e.groupBy("dst").agg(F.min("src").alias("parent")).withColumnRenamed("dst", "id")
    return degrees(v, e).join(parent, "id", "left").select(
        "id", "in_degree", "out_degree", (F.col("in_degree") == 0).alias("is_root"), (F.col("out_degree") == 0).alias("is_leaf"),
        F.when(F.col("in_degree") == 1, F.col("parent")).alias("unique_parent"),
    )


def bridge_edges(e: DataFrame) -> DataFrame:
    """Edges whose target has no other edge coming in; of two parallel edges neither."""
    return e.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1").select("src", "dst")


def articulation_nodes(e: DataFrame) -> DataFrame:
    """Nodes with edges in and out of which every child has in-degree one."""
    coming = e.groupBy("dst").agg(F.count("*").alias("n"))
    alone = e.join(coming, "dst").groupBy("src").agg(F.bool_and(F.col("n") == 1).alias("alone")).where("alone")
    return alone.select(F.col("src").alias("id")).join(coming.select(F.col("dst").alias("id")), "id", "left_semi")


def package_stats(v: DataFrame, e: DataFrame) -> DataFrame:
    """``(package, node_count, edge_count)``; an edge counts for the package of its source."""
    nodes = v.groupBy("package").agg(F.count("*").alias("node_count"))
    edges = e.join(v.select(F.col("id").alias("src"), "package"), "src").groupBy("package").agg(F.count("*").alias("edge_count"))
    return nodes.join(edges, "package", "left").select("package", "node_count", F.coalesce("edge_count", F.lit(0).cast("long")).alias("edge_count"))


def pulled_in_by(top: DataFrame, e: DataFrame, shown: int = 3) -> DataFrame:
    """``(id, parents, more)`` of the ids in ``top``: the first parents by id, parallel edges repeated, and how many more.

    Each task keeps the first few parents it sees and a count, so a hub is a few rows of each task.
    """
    from pyspark.sql import Window as W

    near = e.join(top.select(F.col("id").alias("dst")), "dst", "left_semi")
    first = near.withColumn("k", F.row_number().over(W.partitionBy("dst").orderBy("src"))).where(F.col("k") <= shown).groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("parents"))
    counted = near.groupBy("dst").agg(F.count("*").alias("n"))
    joined = top.select("id").join(first.join(counted, "dst").withColumnRenamed("dst", "id"), "id", "left")
    return joined.select("id", F.concat_ws(", ", F.col("parents").cast("array<string>")).alias("parents"), F.greatest(F.coalesce("n", F.lit(0)) - shown, F.lit(0)).cast("long").alias("more"))

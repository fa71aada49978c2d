"""Smallest vertex cuts of many pairs at once, by augmenting a flow that is kept as rows.

Every inner node lets one unit through and edges any number, so the flow of a pair is a set of
edges and a node that is used has one edge of the flow coming in. A search step leaves a node by
an edge outside the flow: an unused node behind it is passed, a used one is entered and can only
be left against the flow, by the node before it. So the search is a walk over nodes that are left,
and reaching a used node means to be where the node before it is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import cut
from weftline.operators.fixpoint import GATHER, _union


def _steps(near: DataFrame, flow: DataFrame, ends: DataFrame) -> DataFrame:
    """``(pair_id, at, to, add, drop, arrived)``: residual steps between nodes that are left, with the edges they put into the flow and take out."""
    before = flow.select("pair_id", F.col("dst").alias("to"), F.col("src").alias("p"))
    edge = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    none = F.array().cast(f"array<struct<a:{near.schema['src'].dataType.simpleString()},b:{near.schema['src'].dataType.simpleString()}>>")
    free = near.join(flow, ["pair_id", "src", "dst"], "left_anti").select("pair_id", F.col("src").alias("at"), F.col("dst").alias("to")).join(ends, "pair_id")
    free = free.where((F.col("to") != F.col("first")) & (F.col("at") != F.col("last"))).join(before, ["pair_id", "to"], "left")
    arrived = F.col("to") == F.col("last")
    used = F.col("p").isNotNull() & ~arrived
    on = free.where(~used | (F.col("p") != F.col("first"))).select(
        "pair_id", "at", F.when(used, F.col("p")).otherwise(F.col("to")).alias("next"), F.array(edge("at", "to")).alias("add"), F.when(used, F.array(edge("p", "to"))).otherwise(none).alias("drop"), arrived.alias("arrived")
    )
    # a used node can also be left against its own flow
    back = before.withColumnRenamed("to", "at").join(ends, "pair_id").where((F.col("p") != F.col("first")) & (F.col("at") != F.col("last")))
    back = back.select("pair_id", "at", F.col("p").alias("next"), none.alias("add"), F.array(edge("p", "at")).alias("drop"), F.lit(False).alias("arrived"))
    return on.unionByName(back).withColumnRenamed("next", "to")


def smallest_cuts(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """``(pair_id, cut)``: the fewest inner nodes without which a pair's target can't be reached, sorted; those nearest to its source.

    ``pairs (pair_id, src, dst)`` are linked by no edge and have different ends; ``near
    (pair_id, src, dst)`` are the edges on their ways. Each round searches all pairs that are not
    done breadth-first. The node by which a way leaves the source claims what it reaches first,
    so ways with different first nodes are apart, and all that arrive are added to the flow
    together. A pair is done when none arrives; the nodes just outside what it still reaches are
    its cut. A pair takes as many rounds as its cut has nodes, plus one, at most; its edges are
    rows that no task has to hold.
    """
    ends = cut(pairs.select("pair_id", F.col("src").alias("first"), F.col("dst").alias("last")))
    near = cut(near.select("pair_id", "src", "dst").where("src <> dst").distinct())
    flow, left, cuts = cut(near.limit(0)), ends, []
    while not left.isEmpty():
        todo = near.join(left, "pair_id", "left_semi")
        steps = cut(_steps(todo, flow, left))
        kind = steps.schema["at"].dataType
        front = left.select("pair_id", F.col("first").alias("at"), F.lit(None).cast(kind).alias("branch"), F.array().cast(steps.schema["add"].dataType).alias("add"), F.array().cast(steps.schema["drop"].dataType).alias("drop"))
        front, seen, arrived = cut(front), [left.select("pair_id", F.col("first").alias("at"))], []
        while not front.isEmpty():
            moved = front.join(steps.withColumnsRenamed({"add": "more", "drop": "less"}), ["pair_id", "at"]).select(
                "pair_id", "to", F.coalesce("branch", "to").alias("branch"), F.concat("add", "more").alias("add"), F.concat("drop", "less").alias("drop"), "arrived"
            )
            moved = cut(moved.groupBy("pair_id", "to", "arrived", F.when(F.col("arrived"), F.col("branch")).alias("of")).agg(F.min(F.struct("branch", "add", "drop")).alias("w")))
            there = moved.where("arrived").select("pair_id", "w.branch", "w.add", "w.drop")
            arrived.append(there)
            on = moved.where("not arrived").select("pair_id", F.col("to").alias("at"), "w.branch", "w.add", "w.drop")
            # a pair with a way goes no further in this round
            on = on.join(there.select("pair_id"), "pair_id", "left_anti")
            front = cut(on.join(_union(seen), ["pair_id", "at"], "left_anti"))
            seen.append(front.select("pair_id", "at"))
            if len(seen) > GATHER:
                seen, arrived = [cut(_union(seen))], [cut(_union(arrived))]
        ways = cut(_union(arrived))
        done = cut(left.join(ways.select("pair_id"), "pair_id", "left_anti"))
        inside = _union(seen).join(done.select("pair_id"), "pair_id", "left_semi")
        rim = inside.join(near.withColumnRenamed("src", "at"), ["pair_id", "at"]).select("pair_id", F.col("dst").alias("at")).distinct()
        cuts.append(cut(rim.join(inside, ["pair_id", "at"], "left_anti").groupBy("pair_id").agg(F.array_sort(F.collect_list("at")).alias("cut"))))
        edges = lambda c: ways.select("pair_id", F.explode(c).alias("e")).select("pair_id", F.col("e.a").alias("src"), F.col("e.b").alias("dst"))
        flow = cut(flow.join(edges("drop"), ["pair_id", "src", "dst"], "left_anti").unionByName(edges("add")))
        left = cut(left.join(done.select("pair_id"), "pair_id", "left_anti"))
    none = pairs.select("pair_id", F.array("src").alias("cut")).limit(0)
    return _union(cuts or [none])

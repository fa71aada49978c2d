"""Graph fixpoints as loops of joins.

Each round joins what is new with the edges and keeps only that; rounds are cut off in the shared
checkpoint folder, and only whether anything is left reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.lineage import Pile, cut, noting, release, scratch_path, settle
from weftline.functions.numbers import numbered
from weftline.operators.graph import ids_of

#: Rounds after which what has been seen is put together.
GATHER = 8
#: What a node leads to is kept as rows rather than bits if it is no more than this, and while there is room: rows for each node and edge.
FEW, ROOM = 1_024, 16
#: Rows up to which a round is sent to the edges, rather than all edges dealt anew, and kept as it is, not in columns.
SENT = 100_000
#: Phases up to which a graph counts as shallow.
SHALLOW = 24
#: Most nodes and edges of a weak component that is counted in groups by itself, and the nodes that one group counts.
LOCAL_NODES, LOCAL_EDGES, COLUMNS = 65_536, 4_194_304, 8_192


def reverse(e: DataFrame) -> DataFrame:
    """The edges the other way round."""
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _kept(df: DataFrame, n: int) -> DataFrame:
    """A round of a loop, computed; compressed if the round before had many rows ``n``."""
    return settle(df, "round") if n > SENT else cut(df)


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SENT else df


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def reach(e: DataFrame, starts: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """``(key, id)`` of everything that each key's start nodes lead to, these included.

    ``starts`` has columns ``key`` and ``id``; keys are independent. ``blocked (key, id)`` are
    nodes that a key neither starts from nor enters.
    """
    e = settle(e.select("src", "dst").distinct(), "edges")
    bar = lambda df: df if blocked is None else df.join(blocked, ["key", "id"], "left_anti")
    new = cut(bar(starts.select("key", "id").distinct()))
    seen = Pile(new)
    while n := new.count():
        next_ = e.join(_sent(new, n), F.col("id") == F.col("src")).select("key", F.col("dst").alias("id")).distinct()
        new = _kept(bar(next_).join(seen.all(), ["key", "id"], "left_anti"), n)
        seen.add(new)
    return seen.all()


def closure(e: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Pairs ``(src, dst)``, ``dst`` reachable from ``src`` and not the same; from all nodes or those in ``sources (id)``.

    From all nodes of a shallow graph without cycles, pairs come from packed rows (:func:`packed_reach`).
    """
    ids = ids_of(e) if sources is None else sources
    if sources is None:
        ids, e = settle(ids, "nodes"), settle(e.select("src", "dst").where("src <> dst").distinct(), "edges")
        phases, all_ = _peeled(ids, reverse(e), most=SHALLOW)
        if all_ and ids.count() == phases.count():
            return _unpacked(*packed_reach(e, phases.select("id", F.col("level").alias("build_phase"))))
    return reach(e, ids.select(F.col("id").alias("key"), "id")).where("key <> id").select(F.col("key").alias("src"), F.col("id").alias("dst"))


def peel(v: DataFrame, e: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``(id, level)`` of the nodes that no cycle leads to, each the round in which the last edge into it is gone.

    A node that is taken off sends one to each node behind it, and is final itself in the one
    round in which it has got as many as edges come in. So an edge is joined once in all, and
    what a round writes are nodes that have got some, not the graph. With ``starts (id)`` a level
    is the longest way from one of these, null where none leads.
    """
    return _peeled(v, e, starts)[0]


def _peeled(v: DataFrame, e: DataFrame, starts: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, bool]:
    """:func:`peel` in ``most`` rounds at most, and whether that was all."""
    e = e.select("src", "dst").distinct()
    need = e.groupBy("dst").agg(F.count("*").alias("need"))
    with noting() as used:
        e = settle(e.join(need, "dst").select("src", "dst", "need"), "peel-edges")
    front = v.select("id").distinct().join(need.select(F.col("dst").alias("id")), "id", "left_anti")
    if starts is None:
        front = front.select("id", F.lit(0).alias("level"))
    else:
        front = front.join(starts.select("id", F.lit(0).alias("level")).distinct(), "id", "left").select("id", "level")
    front = settle(front, "front")
    waiting = front.select("id", F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("need"), "level").limit(0)
    done, level = Pile(front), 0
    while n := front.count():
        if level == most:
            break
        level += 1
        sent = e.join(_sent(front, n), F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(1).cast("long").alias("got"), "need", (F.col("level") + 1).alias("level"))
        now = _kept(waiting.unionByName(sent).groupBy("id").agg(F.sum("got").alias("got"), F.max("need").alias("need"), F.max("level").alias("level")), n)
        front, waiting = now.where("got = need").select("id", "level"), now.where("got < need")
        done.add(front)
    release(v.sparkSession, used)
    return done.all(), not n


def topo_levels(v: DataFrame, e: DataFrame) -> DataFrame:
    """``(id, level)`` in Kahn's order: the round in which all edges into a node are gone; null in and behind cycles."""
    return v.select("id").distinct().join(peel(v, e), "id", "left").select("id", "level")


def _trim(e: DataFrame, peeled: DataFrame | None = None) -> DataFrame:
    """The edges between nodes that a cycle leads to and that lead to a cycle; ``peeled`` may hand in what :func:`peel` takes off."""
    e = cut(e.select("src", "dst"))
    for turned in (False, True):
        if e.isEmpty():
            break
        # what an edge leads to from a node that stays stays too
        end = "dst" if turned else "src"
        gone = peeled if peeled is not None and not turned else peel(ids_of(e), reverse(e) if turned else e)
        e = cut(e.join(gone.select(F.col("id").alias(end)), end, "left_anti").select("src", "dst"))
    return e


def scc(v: DataFrame, e: DataFrame, peeled: DataFrame | None = None) -> DataFrame:
    """``(id, scc_id, scc_size)``: strongly connected components named by their smallest member.

    What lies on no cycle is trimmed first; ``peeled`` may hand in the result of :func:`peel`. Then the smallest id is passed on as a colour; what
    reaches a colour's own node within the colour is its component. Those go, and so on.
    """
    core, found = _trim(cut(e.select("src", "dst").distinct()), peeled), []
    while not core.isEmpty():
        colour, moved = cut(ids_of(core).select("id", F.col("id").alias("colour"))), True
        while moved:
            got = colour.join(core, colour.id == core.src).select(F.col("dst").alias("id"), "colour")
            new = cut(colour.select("id", F.col("colour").alias("old"), "colour").unionByName(got.select("id", F.lit(None).cast(dict(colour.dtypes)["colour"]).alias("old"), "colour")).groupBy("id").agg(F.max("old").alias("old"), F.min("colour").alias("colour")))
            moved = not new.where("old <> colour").isEmpty()
            colour = cut(new.select("id", "colour"))
        of = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))
        inside = cut(core.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))
        own = colour.where("id = colour").select(F.col("id").alias("key"), "id")
        part = cut(reach(reverse(inside), own).select("id", F.col("key").alias("scc_id")))
        found.append(part)
        gone = part.select("id")
        core = _trim(cut(core.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")))
    named = v.select("id").distinct()
    named = named.join(_union(found), "id", "left").select("id", F.coalesce("scc_id", "id").alias("scc_id")) if found else named.select("id", F.col("id").alias("scc_id"))
    sizes = named.groupBy("scc_id").agg(F.count("*").alias("scc_size"))
    return named.join(sizes, "scc_id").select("id", "scc_id", "scc_size")


def condense(e: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct edges ``(src, dst)`` between different components."""
    of = lambda end: parts.select(F.col("id").alias(end), F.col("scc_id").alias(f"{end}_scc"))
    return e.join(of("src"), "src").join(of("dst"), "dst").where("src_scc <> dst_scc").select(F.col("src_scc").alias("src"), F.col("dst_scc").alias("dst")).distinct()


def build_phase(v: DataFrame, e: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``(id, build_phase)``: 0 without dependencies, else one more than the highest of them; a component shares its phase."""
    if parts is None:
        levels, acyclic = _levels(v, e)
        if acyclic:
            return peel(v, reverse(e)).select("id", F.col("level").alias("build_phase"))
        parts = scc(v, e, levels)
    parts = settle(parts, "parts")
    level = peel(parts.select(F.col("scc_id").alias("id")), reverse(condense(e, parts))).select(F.col("id").alias("scc_id"), F.col("level").alias("build_phase"))
    return parts.join(level, "scc_id").select("id", "build_phase")


def depth(v: DataFrame, e: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``(id, depth)``: the longest way from a node without incoming edges, over components; 0 where none leads."""
    if parts is None:
        levels, acyclic = _levels(v, e)
        if acyclic:
            return levels.select("id", F.col("level").alias("depth"))
        parts = scc(v, e, levels)
    parts = settle(parts, "parts")
    roots = v.select("id").join(e.select(F.col("dst").alias("id")), "id", "left_anti")
    level = peel(parts.select(F.col("scc_id").alias("id")), condense(e, parts), roots).select(F.col("id").alias("scc_id"), "level")
    return parts.join(level, "scc_id").select("id", F.coalesce("level", F.lit(0)).alias("depth"))


def short_reach(v: DataFrame, e: DataFrame, most: int = FEW, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """``(key, id)`` of what each node leads to, itself included, for nodes with few of these; and ``(id)`` of all others.

    Few are up to ``most``. A node is given up in the round in which it has more; to see that,
    ``most`` edges of a node and ``most`` more nodes of a round are enough. When all rows together
    are more than ``room`` for each node and edge, nodes that are not complete are given up.
    """
    e = e.select("src", "dst").where("src <> dst").distinct()
    e = settle(e.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("dst"))).where(F.col("r") <= most).select("src", "dst"), "short-edges")
    step = cut(v.select(F.col("id").alias("key"), "id").distinct())
    n = step.count()
    seen, rows, space = Pile(step), n, room * (n + e.count())
    over = lambda: seen.all().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key")
    while n and rows <= space:
        new = step.join(over(), "key", "left_anti").join(e, F.col("id") == F.col("src")).select("key", F.col("dst").alias("id")).distinct()
        new = new.join(seen.all(), ["key", "id"], "left_anti")
        step = cut(new.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("id"))).where(F.col("r") <= most).select("key", "id"))
        seen.add(step)
        n = step.count()
        rows += n
    many = cut(over().unionByName(step.select("key")).distinct())
    return seen.all().join(many, "key", "left_anti"), many.withColumnRenamed("key", "id")


def _levels(v: DataFrame, e: DataFrame) -> tuple[DataFrame, bool]:
    """:func:`peel` and whether it takes all nodes off."""
    levels = settle(peel(v, e), "levels")
    return levels, levels.count() == v.select("id").distinct().count()


def layers(v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """:func:`depth`, :func:`build_phase` and whether there is no cycle; then both are what is peeled off from either side."""
    levels, acyclic = _levels(v, e)
    if acyclic:
        return levels.withColumnRenamed("level", "depth"), settle(peel(v, reverse(e)).withColumnRenamed("level", "build_phase"), "phases"), True
    parts = settle(scc(v, e, levels), "parts")
    return depth(v, e, parts), build_phase(v, e, parts), False


def packed_reach(e: DataFrame, phases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, block, mask)``: what each node leads to, itself included, and ``(idx, id, build_phase)`` with the numbers of the nodes.

    For a graph of few phases without cycles, ``phases (id, build_phase)``. A block is 64 numbers,
    and only those that a node leads into are rows. Numbers follow the phases and, within these,
    the lengths of ids, so what is close shares blocks. A phase is final once the phases that it
    points to are, so an edge is joined with packed rows once.
    """
    spark = e.sparkSession
    place = settle(numbered(phases.select("build_phase", F.length(F.col("id").cast("string")).alias("n"), "id"), "build_phase", "n", "id").select("idx", "id", "build_phase"), "places")
    of = lambda end, *more: place.select(F.col("id").alias(end), F.col("idx").alias(f"{end}_idx"), *more)
    edges = e.join(of("src", F.col("build_phase").alias("phase")), "src").join(of("dst", F.col("build_phase").alias("to")), "dst")
    coded = scratch_path(spark, "packed-edges")
    edges.select("phase", "to", F.col("src_idx").alias("key"), F.col("dst_idx").alias("other")).write.partitionBy("phase").parquet(coded)
    edges = spark.read.schema("key long, other long, to int, phase int").parquet(coded)
    needs: dict[int, list[int]] = {}
    for r in edges.select("phase", "to").distinct().collect():  # phases squared at most
        needs.setdefault(r.phase, []).append(r.to)
    folder, shape = scratch_path(spark, "packed-reach"), "key long, block long, mask long"
    read = lambda ps: spark.read.schema(shape).parquet(*(f"{folder}/{p}" for p in ps))
    top = phases.agg(F.max("build_phase")).first()[0] or 0
    for p in range(top + 1):
        here = place.where(F.col("build_phase") == p).select(F.col("idx").alias("key"), F.shiftright("idx", 6).alias("block"), F.expr("shiftleft(1L, CAST(idx % 64 AS INT))").alias("mask"))
        if p in needs:
            gained = edges.where(F.col("phase") == p).select(F.col("key").alias("from"), F.col("other").alias("key")).join(read(needs[p]), "key").select(F.col("from").alias("key"), "block", "mask")
            here = here.unionByName(gained).groupBy("key", "block").agg(F.bit_or("mask").alias("mask"))
        here.write.parquet(f"{folder}/{p}")
    return read(range(top + 1)), place


def _packed_counts(packed: DataFrame, place: DataFrame) -> DataFrame:
    counts = packed.groupBy("key").agg((F.sum(F.bit_count("mask")) - 1).alias("transitive_dep_count"))
    return counts.join(place.select(F.col("idx").alias("key"), "id"), "key").select("id", "transitive_dep_count")


def _unpacked(packed: DataFrame, place: DataFrame) -> DataFrame:
    """``(src, dst)`` of the rows of :func:`packed_reach`; names meet blocks, not pairs."""
    named = place.groupBy(F.shiftright("idx", 6).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "id"))).alias("there"))
    rows = packed.join(place.select(F.col("idx").alias("key"), F.col("id").alias("src")), "key").join(named.select("block", F.col("there.id").alias("there")), "block")
    bits = rows.select("key", "src", "block", "mask", F.posexplode("there").alias("at", "dst")).where("getbit(mask, at) = 1 and block * 64 + at <> key")
    return bits.select("src", "dst")


def _weak_parts(e: DataFrame) -> DataFrame:
    """``(id, part)``: the smallest node that edges in any direction join with a node."""
    both = settle(e.unionByName(reverse(e)).distinct(), "both-ways")
    part, moved = settle(ids_of(e).select("id", F.col("id").alias("part")), "parts"), True
    while moved:
        got = part.join(both, part.id == both.src).select(F.col("dst").alias("id"), F.lit(None).cast("long").alias("old"), "part")
        new = cut(part.select("id", F.col("part").alias("old"), "part").unionByName(got).groupBy("id").agg(F.max("old").alias("old"), F.min("part").alias("part")))
        moved = not new.where("old <> part").isEmpty()
        # a part that has become part of another one takes its nodes along
        part = cut(new.select("id", "part").join(new.select(F.col("id").alias("part"), F.col("part").alias("far")), "part").select("id", F.col("far").alias("part")))
    return part


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def _column_counts(column: int, src: np.ndarray, dst: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Nodes of a small graph and how many of those numbered ``columns * column`` and on each one leads to; none if there is a cycle.

    Nodes are done once all behind them are, each from the bits of these.
    """
    ids, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
    src, dst, n = ends[: len(src)], ends[len(src) :], len(ids)
    by_dst = src[np.argsort(dst, kind="stable")]
    by_src = dst[np.argsort(src, kind="stable")]
    left, coming = np.bincount(src, minlength=n), np.bincount(dst, minlength=n)
    out, out_at, in_at = left.copy(), np.cumsum(left) - left, np.cumsum(coming) - coming
    bits = np.zeros((n, columns // 64), np.uint64)
    own = np.arange(columns * column, min(n, columns * (column + 1)))
    bits[own, (own % columns) >> 6] = np.uint64(1) << (own & 63).astype(np.uint64)
    front, done = np.flatnonzero(left == 0), 0
    while len(front):
        done += len(front)
        inner = front[out[front] > 0]
        # so many nodes at a time that what is gathered stays small
        for part in np.split(inner, np.flatnonzero(np.diff(np.cumsum(out[inner]) >> 14)) + 1) if len(inner) else ():
            at = np.cumsum(out[part]) - out[part]
            bits[part] |= np.bitwise_or.reduceat(bits[by_src[_ranges(out_at[part], out[part])]], at, axis=0)
        before, times = np.unique(by_dst[_ranges(in_at[front], coming[front])], return_counts=True)
        left[before] -= times
        front = before[left[before] == 0]
    return ids, np.bitwise_count(bits).sum(axis=1, dtype=np.int64) if done == n else None


def _local_counts(e: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """``(id, n)`` of small parts ``(part, nodes, src, dst)``: how many nodes each one leads to, itself included; null if a part has a cycle.

    A group is a part and ``columns`` of its nodes, which are counted, so a larger part is several groups.
    """

    def counted(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = pd.concat(batches)
        ids, n = _column_counts(key[1], edges["src"].to_numpy(), edges["dst"].to_numpy(), columns)
        yield pd.DataFrame({"id": ids, "n": pd.array(n if n is not None else [pd.NA] * len(ids), dtype="Int64")})

    dealt = e.select("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("nodes") - 1) / columns).cast("int"))).alias("column"), "src", "dst")
    found = dealt.groupBy("part", "column").applyInPandas(counted, "id long, n long")
    return found.groupBy("id").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n"))


def transitive_dep_count(v: DataFrame, e: DataFrame, few: int = FEW, phases: DataFrame | None = None) -> DataFrame:
    """``(id, transitive_dep_count)``: how many other nodes each one leads to, others of its own component included.

    Nodes in weak components of few phases and without cycles are counted by :func:`packed_reach`.
    Where components are deep, the small ones of them are counted in groups by themselves, all at once
    rather than phase by phase. What is left, large or with cycles, is counted by :func:`_counts_by_bits`.
    ``phases (id, build_phase)`` may hand in those of a graph without cycles.
    """
    e = settle(e.select("src", "dst").where("src <> dst").distinct(), "edges")
    if phases is not None and (phases.agg(F.max("build_phase")).first()[0] or 0) < SHALLOW:
        return _packed_counts(*packed_reach(e, phases))
    low, all_ = _peeled(v, reverse(e), most=SHALLOW)
    low = settle(low.withColumnRenamed("level", "build_phase"), "low-phases")
    rest = cut(v.select("id").distinct().join(low, "id", "left_anti"))
    if rest.isEmpty():
        return _packed_counts(*packed_reach(e, low))
    deep = cut(reach(e.unionByName(reverse(e)), rest.select(F.lit(0).alias("key"), "id")).select("id"))
    low = low.join(deep, "id", "left_anti")
    out = _packed_counts(*packed_reach(e.join(deep.withColumnRenamed("id", "src"), "src", "left_anti"), low))
    e = settle(e.join(deep.withColumnRenamed("id", "src"), "src", "left_semi"), "deep-edges")
    if not all_:
        # some are deep rather than on or before cycles
        place = settle(numbered(deep, "id"), "deep-places")
        of = lambda end: place.select(F.col("id").alias(end), F.col("idx").alias(f"{end}_idx"))
        coded = settle(e.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst")), "coded-edges")
        parts = settle(_weak_parts(coded), "weak-parts")
        inside = coded.join(parts.withColumnRenamed("id", "src"), "src")
        small = parts.groupBy("part").agg(F.count("*").alias("nodes")).join(inside.groupBy("part").agg(F.count("*").alias("edges")), "part").where((F.col("nodes") <= LOCAL_NODES) & (F.col("edges") <= LOCAL_EDGES))
        counted = settle(_local_counts(inside.join(small, "part")).where("n is not null").withColumnRenamed("id", "idx").join(place, "idx").select("id", (F.col("n") - 1).alias("transitive_dep_count")), "local-counts")
        out, deep = out.unionByName(counted), cut(deep.join(counted, "id", "left_anti"))
        e = e.join(deep.withColumnRenamed("id", "src"), "src", "left_semi")
    return out if deep.isEmpty() else out.unionByName(_counts_by_bits(deep, e, few))


def _counts_by_bits(v: DataFrame, e: DataFrame, few: int) -> DataFrame:
    """:func:`transitive_dep_count` of graphs of any size and with cycles.

    A node that leads to ``few`` others at most has them as rows (:func:`short_reach`), which are
    then smaller than bits. The components of the rest hold what they lead to as bits, in blocks
    of 32,768 nodes of which only those that have any are rows. These are final phase by phase:
    each from its own nodes, the rows of nodes next to it that lead to few, and the bits of the
    components it points to, of which only the phases in question are read. Numbers follow the
    phases, so what is close shares blocks.
    """
    e = cut(e)
    short, many = short_reach(v, e, few)
    short = settle(short, "short-reach")
    counted = short.groupBy(F.col("key").alias("id")).agg((F.count("*") - 1).alias("transitive_dep_count"))
    if many.isEmpty():
        return counted
    both = lambda df: df.join(many.withColumnRenamed("id", "src"), "src", "left_semi")
    inner = cut(both(e).join(many.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    levels = cut(peel(many, inner))
    if levels.count() == many.count():
        # no cycle, so the levels do as phases the other way round
        last = levels.agg(F.max("level")).first()[0]
        parts, phases = many.select("id", F.col("id").alias("scc_id")), levels.select("id", (F.lit(last) - F.col("level")).alias("build_phase"))
    else:
        parts = cut(scc(many, inner, levels))
        phases = cut(build_phase(many, inner, parts))
    named = cut(parts.join(phases, "id").select("id", "scc_id", "build_phase"))
    place = settle(numbered(v.select("id").distinct().join(named, "id", "left").select("build_phase", "scc_id", "id"), "build_phase", "scc_id", "id").select("idx", "id"), "places")
    beside = both(e).join(many.withColumnRenamed("id", "dst"), "dst", "left_anti").join(short, F.col("dst") == F.col("key")).select("src", F.col("id").alias("there"))
    held = named.select("id", "scc_id", "build_phase").join(beside.unionByName(many.select(F.col("id").alias("src"), F.col("id").alias("there"))), F.col("id") == F.col("src")).select("build_phase", "scc_id", F.col("there").alias("id")).distinct()
    bit = F.col("idx") + 1
    own = held.join(place, "id").groupBy("build_phase", F.col("scc_id").alias("id"), F.bitmap_bucket_number(bit).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    own = settle(own.repartition("build_phase", "id"), "own-bits")
    level = lambda end: named.select(F.col("scc_id").alias(end), F.col("build_phase").alias(f"{end}_phase")).distinct()
    dag = cut(condense(inner, parts).join(level("src"), "src").join(level("dst"), "dst"))
    needs: dict[int, list[int]] = {}
    for r in dag.select("src_phase", "dst_phase").distinct().collect():  # phases squared at most
        needs.setdefault(r.src_phase, []).append(r.dst_phase)
    folder = scratch_path(v.sparkSession, "reach-bits")
    shape = own.select("id", "block", "bits").schema
    top = phases.agg(F.max("build_phase")).first()[0]
    read = lambda ps: v.sparkSession.read.schema(shape).parquet(*(f"{folder}/{p}" for p in ps))
    for p in range(top + 1):
        here = own.where(F.col("build_phase") == p).select("id", "block", "bits")
        if p in needs:
            gained = dag.where(F.col("src_phase") == p).select("src", "dst").join(read(needs[p]).withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "block", "bits")
            here = here.unionByName(gained).groupBy("id", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        here.write.parquet(f"{folder}/{p}")
    total = read(range(top + 1)).groupBy(F.col("id").alias("scc_id")).agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return counted.unionByName(parts.join(total, "scc_id").select("id", (F.col("n") - 1).alias("transitive_dep_count")))


def approx_transitive_dep_count(v: DataFrame, e: DataFrame, phases: DataFrame, lg_k: int = 12) -> DataFrame:
    """``(id, transitive_dep_count)`` estimated by HyperLogLog sketches, merged phase by phase.

    ``phases (id, build_phase)`` of a graph without cycles. Each node is final once, so the work
    is one merge for each edge and the state one sketch for each node.
    """
    edges = cut(e.select("src", "dst").distinct().join(phases.select(F.col("id").alias("src"), "build_phase"), "src"))
    top = phases.agg(F.max("build_phase")).first()[0] or 0
    own = v.select("id").groupBy("id").agg(F.hll_sketch_agg(F.col("id").cast("string"), F.lit(lg_k)).alias("s"))
    done = [cut(own.join(phases.where("build_phase = 0"), "id", "left_semi"))]
    for p in range(1, top + 1):
        gained = edges.where(F.col("build_phase") == p).join(_union(done).withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "s")
        here = own.join(phases.where(F.col("build_phase") == p), "id", "left_semi")
        done.append(cut(gained.unionByName(here).groupBy("id").agg(F.hll_union_agg("s").alias("s"))))
    return _union(done).select("id", (F.hll_sketch_estimate("s") - 1).alias("transitive_dep_count"))


def critical_chain(e: DataFrame, depths: DataFrame) -> DataFrame:
    """``(position, id)`` of the longest chain down to the deepest node; ties go to the smallest id. Empty if nothing is deep.

    Every node knows its best parent. Who knows a node 2^k steps up and takes that one's
    knowledge knows 2^(k + 1), and the part of the chain that is known doubles with it, so a chain
    of n nodes takes log n rounds.
    """
    of = lambda end: depths.select(F.col("id").alias(end), F.col("depth").alias(f"{end}_depth"))
    steps = e.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("src_depth < dst_depth")
    up = cut(steps.groupBy("dst").agg(F.min(F.struct((-F.col("src_depth")).alias("d"), "src")).alias("b")).select(F.col("dst").alias("id"), F.col("b.src").alias("far")))
    chain = cut(depths.where("depth > 0").orderBy(F.desc("depth"), "id").limit(1).select("id", F.lit(0).alias("off")))
    known = 1
    while not (more := cut(chain.join(up, "id").select(F.col("far").alias("id"), (F.col("off") + known).alias("off")))).isEmpty():
        chain = cut(chain.unionByName(more))
        up = cut(up.join(up.select(F.col("id").alias("far"), F.col("far").alias("further")), "far").select("id", F.col("further").alias("far")))
        known *= 2
    last = chain.agg(F.max("off").alias("last"))
    return chain.crossJoin(F.broadcast(last)).select((F.col("last") - F.col("off")).alias("position"), "id")


def reachable_from_roots(v: DataFrame, e: DataFrame, exclude=None) -> DataFrame:
    """``(id)`` of what the nodes without incoming edges lead to, these included, with one node blocked if given."""
    roots = v.select("id").join(e.select(F.col("dst").alias("id")), "id", "left_anti").select(F.lit(0).alias("key"), "id")
    blocked = None if exclude is None else v.sparkSession.range(1).select(F.lit(0).alias("key"), F.lit(exclude).alias("id"))
    return reach(e, roots, blocked).select("id")


def dependencies(e: DataFrame, starts: DataFrame, backward: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(start, id)`` that each start leads to (or that lead to it), and the distinct edges ``(start, src, dst)`` that leave (enter) them.

    Starts are bits of a mask, so a node is a row for each 64 starts until the end.
    """
    e = settle((reverse(e) if backward else e.select("src", "dst")).distinct(), "edges")
    place = settle(numbered(starts.select("id").distinct(), "id"), "starts")
    block, mask = F.shiftright("idx", 6).alias("block"), F.expr("shiftleft(1L, CAST(idx % 64 AS INT))").alias("mask")
    new = settle(place.select("id", block, mask), "front")
    seen = Pile(new)
    while n := new.count():
        next_ = e.join(_sent(new, n), F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id"), "block").agg(F.bit_or("mask").alias("mask"))
        before = seen.all().groupBy("id", "block").agg(F.bit_or("mask").alias("old"))
        gained = next_.join(before, ["id", "block"], "left").select("id", "block", F.expr("mask & ~coalesce(old, 0L)").alias("mask"))
        new = _kept(gained.where("mask <> 0"), n)
        seen.add(new)
    got = settle(seen.all().groupBy("id", "block").agg(F.bit_or("mask").alias("mask")), "reached")
    named = place.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("idx", "id"))).alias("there")).select("block", F.col("there.id").alias("starts"))
    told = lambda df, *columns: df.join(named, "block").select("mask", F.posexplode("starts").alias("at", "start"), *columns).where("getbit(mask, at) = 1").select("start", *columns)
    ends = ("dst", "src") if backward else ("src", "dst")
    edges = e.select(F.col("src").alias("id"), F.col("src").alias(ends[0]), F.col("dst").alias(ends[1])).join(got, "id")
    return told(got, "id"), told(edges, "src", "dst")


def rank_roots(v: DataFrame, e: DataFrame) -> DataFrame:
    """``(id, reach, rank, is_main)`` of the nodes without incoming edges, by how much they lead to; ties by id.

    What they lead to is counted, not listed.
    """
    roots = v.select("id").join(e.select(F.col("dst").alias("id")), "id", "left_anti")
    sizes = cut(transitive_dep_count(v, e).join(roots, "id", "left_semi").select("id", (F.col("transitive_dep_count") + 1).alias("reach")))
    # ranks over counts of equal reach, so that no single task sorts all roots
    per = sizes.groupBy("reach").agg(F.count("*").alias("n"))
    above = per.select("reach", (F.sum("n").over(W.orderBy(F.desc("reach"))) - F.col("n")).alias("above"))
    ranked = sizes.join(above, "reach").withColumn("rank", (F.col("above") + F.row_number().over(W.partitionBy("reach").orderBy("id"))).cast("long"))
    return ranked.select("id", "reach", "rank", (F.col("rank") == 1).alias("is_main"))

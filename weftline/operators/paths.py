"""Routes between pairs of nodes, given as a table ``pairs (pair_id, src, dst)``.

All pairs go through each loop together, keyed by their id. Equal lengths are decided by the
smallest sequence of ids, so every result is determined.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weftline.functions.lineage import Pile, cut
from weftline.operators.cuts import smallest_cuts
from weftline.operators.fixpoint import _union, reach, reverse
from weftline.operators.impact import dominator_paths


def relevant_subgraph(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """``(pair_id, src, dst)``: distinct edges that lie on some walk from a pair's source to its target."""
    ahead = reach(e, pairs.select(F.col("pair_id").alias("key"), F.col("src").alias("id")))
    behind = reach(reverse(e), pairs.select(F.col("pair_id").alias("key"), F.col("dst").alias("id")))
    nodes = cut(ahead.join(behind, ["key", "id"]))
    all_ = e.select("src", "dst").distinct()
    left = nodes.select(F.col("key").alias("pair_id"), F.col("id").alias("src")).join(all_, "src")
    return left.join(nodes.select(F.col("key").alias("pair_id"), F.col("id").alias("dst")), ["pair_id", "dst"], "left_semi").select("pair_id", "src", "dst")


def shortest_paths(pairs: DataFrame, e: DataFrame, nodes: DataFrame | None = None, blocked: DataFrame | None = None, barred: DataFrame | None = None, most: DataFrame | None = None) -> DataFrame:
    """``(pair_id, src, dst, reachable, path)``: the smallest sequence of ids among the shortest paths.

    ``blocked (pair_id, id)`` are nodes that a pair may not pass (its target still counts),
    ``barred (pair_id, src, dst)`` edges that it may not use; ``most (pair_id, most)`` says how many
    hops a pair may take, where it has a row. An unknown end or no way gives an empty path; a
    pair of one known node gives that node.
    """
    known = cut(nodes.select("id").distinct() if nodes is not None else e.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    e = cut(e.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    ends = pairs.select("pair_id", "src", "dst").distinct().join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = ends.join(most.select("pair_id", "most"), "pair_id", "left") if most is not None else ends.withColumn("most", F.lit(None).cast("int"))
    front = cut(ends.select("pair_id", "dst", "most", F.col("src").alias("at"), F.array("src").alias("path")))
    if blocked is not None:
        targets = front.select("pair_id", F.col("dst").alias("at"))
        blocked = cut(blocked.select("pair_id", F.col("id").alias("at")).distinct().join(targets, ["pair_id", "at"], "left_anti"))
    seen, done = Pile(front.select("pair_id", "at")), Pile(front.where("at = dst").select("pair_id", "path"))
    while not (left := front.where("at <> dst")).isEmpty():
        # a pair that has arrived goes no further
        on = left.join(done.all().select("pair_id"), "pair_id", "left_anti").join(e, "at").where(F.col("most").isNull() | (F.size("path") <= F.col("most")))
        if barred is not None:
            on = on.join(barred.select("pair_id", F.col("src").alias("at"), F.col("dst").alias("to")), ["pair_id", "at", "to"], "left_anti")
        on = on.select("pair_id", "dst", "most", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        if blocked is not None:
            on = on.join(blocked, ["pair_id", "at"], "left_anti")
        front = cut(on.groupBy("pair_id", "dst", "most", "at").agg(F.min("path").alias("path")).join(seen.all(), ["pair_id", "at"], "left_anti"))
        seen.add(front.select("pair_id", "at"))
        done.add(front.where("at = dst").select("pair_id", "path"))
    empty = F.array().cast(T.ArrayType(pairs.schema["src"].dataType))
    got = pairs.select("pair_id", "src", "dst").join(done.all(), "pair_id", "left")
    return got.select("pair_id", "src", "dst", F.col("path").isNotNull().alias("reachable"), F.coalesce("path", empty).alias("path"))


def k_shortest_paths(pairs: DataFrame, e: DataFrame, k: int = 30, near: DataFrame | None = None) -> DataFrame:
    """``(pair_id, rank, path, hops)``: up to ``k`` loopless paths of each pair, by hops, then by sequence.

    Where the relevant part has no cycle, only the ``k`` smallest ways of each length to each
    node are kept on the way: no other one can be part of an answer. Pairs with cycles are
    solved by deviations (:func:`_by_deviations`). ``near`` may hand in the result of
    :func:`relevant_subgraph`.
    """
    near = near if near is not None else cut(relevant_subgraph(pairs, e))
    cyclic = cut(_cyclic_pairs(near))
    ends = cut(pairs.select("pair_id", "src", "dst"))
    plain = cut(near.join(cyclic, "pair_id", "left_anti").select("pair_id", F.col("src").alias("at"), F.col("dst").alias("to")))
    targets = ends.select("pair_id", F.col("dst").alias("end"))
    known = near.select("pair_id").distinct()
    front = cut(ends.join(known, "pair_id", "left_semi").join(cyclic, "pair_id", "left_anti").select("pair_id", F.col("src").alias("at"), F.array("src").alias("path")))
    done = Pile(front.join(targets, "pair_id").where("at = end").select("pair_id", "path"))
    while not front.isEmpty():
        on = front.join(plain, ["pair_id", "at"]).select("pair_id", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        best = W.partitionBy("pair_id", "at").orderBy("path")
        front = cut(on.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"))
        done.add(front.join(targets, "pair_id").where("at = end").select("pair_id", "path"))
    found = done.all()
    if not cyclic.isEmpty():
        hard = cut(ends.join(cyclic, "pair_id", "left_semi"))
        found = found.unionByName(_by_deviations(hard, near.join(cyclic, "pair_id", "left_semi").select("src", "dst").distinct(), k))
    ranked = found.withColumn("hops", F.size("path") - 1).withColumn("rank", F.row_number().over(W.partitionBy("pair_id").orderBy("hops", "path")))
    return ranked.where(F.col("rank") <= k).select("pair_id", "rank", "path", "hops")


def _by_deviations(pairs: DataFrame, e: DataFrame, k: int) -> DataFrame:
    """``(pair_id, path)``: the ``k`` smallest loopless paths of each pair, by hops, then by sequence.

    A class of paths is a way they all begin with and the nodes they don't go to next; its smallest
    path is one search. Taking that path splits the rest of the class by the place where a path
    leaves it. In a round every pair takes its shortest paths so far, and the searches for all
    classes that come of it, of all pairs, are one loop, in which no path may get longer than
    the pair's k-th so far. Each round takes one path of a pair at least, so there are k at most.
    """
    e, kind = cut(e), pairs.schema["src"].dataType
    first = shortest_paths(pairs, e).where("reachable")
    open_ = cut(first.select("pair_id", "dst", F.array("src").alias("start"), F.array().cast(T.ArrayType(kind)).alias("barred"), "path", F.lit(False).alias("taken")))
    taken = open_.limit(0)
    order = W.partitionBy("pair_id").orderBy(F.size("path"), "path")
    while not open_.isEmpty():
        least = open_.groupBy("pair_id").agg(F.min(F.size("path")).alias("least"))
        now = cut(open_.join(least, "pair_id").where(F.size("path") == F.col("least")).drop("least"))
        rest = open_.join(least, "pair_id").where(F.size("path") > F.col("least")).drop("least")
        taken = cut(taken.unionByName(now.withColumn("taken", F.lit(True))))
        leaves = now.select("pair_id", "dst", "start", "barred", "path", F.explode(F.sequence(F.size("start"), F.size("path") - 1)).alias("n")).select(
            "pair_id", "dst", F.slice("path", F.lit(1), F.col("n")).alias("start"),
            F.concat(F.when(F.col("n") == F.size("start"), F.col("barred")).otherwise(F.array().cast(T.ArrayType(kind))), F.array(F.get("path", F.col("n")))).alias("barred"),
        )
        leaves = cut(leaves.withColumn("key", F.struct("pair_id", "start")))
        # a pair that knows k paths needs no longer ones
        kth = taken.unionByName(rest).withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("pair_id", (F.size("path") - 1).alias("kth"))
        most = leaves.join(kth, "pair_id").select(F.col("key").alias("pair_id"), (F.col("kth") - F.size("start") + 1).alias("most"))
        asked = leaves.select(F.col("key").alias("pair_id"), F.element_at("start", -1).alias("src"), "dst")
        blocked = leaves.select(F.col("key").alias("pair_id"), F.explode(F.slice("start", F.lit(1), F.size("start") - 1)).alias("id"))
        barred = leaves.select(F.col("key").alias("pair_id"), F.element_at("start", -1).alias("src"), F.explode("barred").alias("dst"))
        got = shortest_paths(asked, e, blocked=blocked, barred=barred, most=most).where("reachable").select(F.col("pair_id").alias("key"), F.col("path").alias("tail"))
        new = leaves.join(got, "key").select("pair_id", "dst", "start", "barred", F.concat(F.slice("start", F.lit(1), F.size("start") - 1), "tail").alias("path"), F.lit(False).alias("taken"))
        ranked = taken.unionByName(rest).unionByName(new).withColumn("r", F.row_number().over(order)).where((F.col("r") <= k) & ~F.col("taken"))
        open_ = cut(ranked.drop("r"))
    return taken.select("pair_id", "path")


def _cyclic_pairs(near: DataFrame) -> DataFrame:
    """``(pair_id)`` of pairs whose edges can't all be trimmed away from their sources."""
    left = cut(near)
    n = left.count()
    while n:
        left = cut(left.join(left.select("pair_id", F.col("dst").alias("src")), ["pair_id", "src"], "left_semi").select("pair_id", "src", "dst"))
        n, before = left.count(), n
        if n == before:
            break
    return left.select("pair_id").distinct()


def detour_paths(pairs: DataFrame, e: DataFrame, rounds: int | None = None, in_pairs: bool = True, shortest: DataFrame | None = None) -> DataFrame:
    """``(pair_id, path)``: shortest paths around each inner node of the shortest path and, in further rounds, of those found.

    With ``in_pairs`` also around two nodes at a time, one of them on the shortest path. All
    blocks of a round go through one loop; a block is tried once. Without a number of ``rounds``
    it ends when no new block is left. There is no clock. ``shortest`` may hand in the result of
    :func:`shortest_paths`.
    """
    base = cut((shortest if shortest is not None else shortest_paths(pairs, e)).where("reachable").select("pair_id", "src", "dst", "path"))
    inner = lambda df: df.select("pair_id", F.explode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))).alias("id")).distinct()
    on_shortest, tried, found, new = cut(inner(base)), None, [], cut(inner(base))
    for _ in count() if rounds is None else range(rounds):
        blocks = new.select("pair_id", F.array("id").alias("block"))
        if in_pairs:
            two = new.join(on_shortest.withColumnRenamed("id", "other"), "pair_id").where("id <> other")
            blocks = blocks.unionByName(two.select("pair_id", F.array_sort(F.array("id", "other")).alias("block"))).distinct()
        if tried is not None:
            blocks = blocks.join(tried, ["pair_id", "block"], "left_anti")
        blocks = cut(blocks)
        if blocks.isEmpty():
            break
        tried = blocks if tried is None else tried.unionByName(blocks)
        keyed = blocks.join(base.select("pair_id", "src", "dst"), "pair_id").select(F.struct("pair_id", "block").alias("pair_id"), "src", "dst", "block")
        got = shortest_paths(keyed, e, blocked=keyed.select("pair_id", F.explode("block").alias("id"))).where("reachable")
        got = cut(got.select("pair_id.pair_id", "path").distinct())
        found.append(got)
        new = cut(inner(got))
    empty = base.select("pair_id", "path").limit(0)
    return (_union(found) if found else empty).distinct().join(base.select("pair_id", "path"), ["pair_id", "path"], "left_anti")


def merge_paths(*sets: DataFrame) -> DataFrame:
    """``(pair_id, path, all_path_count)``: the union without repeated sequences."""
    one = _union([s.select("pair_id", "path") for s in sets]).distinct()
    counted = one.groupBy("pair_id").agg(F.count("*").alias("all_path_count"))
    return one.join(counted, "pair_id")


def suffix_dedup(paths: DataFrame) -> DataFrame:
    """``(pair_id, path)`` without paths that end with another whole path of the pair."""
    one = cut(paths.select("pair_id", "path").distinct())
    tails = one.select("pair_id", "path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("path"), F.lit(2))), lambda k: F.slice("path", k, F.size("path")))).alias("tail")).where(F.size("tail") > 0)
    longer = tails.join(one.select("pair_id", F.col("path").alias("tail")), ["pair_id", "tail"], "left_semi").select("pair_id", "path").distinct()
    return one.join(longer, ["pair_id", "path"], "left_anti")


def mandatory_waypoints(pairs: DataFrame, e: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``(pair_id, waypoints)``: inner nodes on every path, in their order; exact, by dominators."""
    near = near if near is not None else relevant_subgraph(pairs, e)
    # pairs are independent graphs: nodes carry their pair
    node = lambda c: F.struct("pair_id", F.col(c).alias("n"))
    edges = near.select(node("src").alias("src"), node("dst").alias("dst"))
    doms = dominator_paths(edges, pairs.select(F.lit(0).alias("key"), node("src").alias("id")))
    at_end = doms.join(pairs.select(node("dst").alias("id")), "id", "left_semi").select("id.pair_id", F.transform("path", lambda p: p.n).alias("p"))
    inner = at_end.select("pair_id", F.slice("p", F.lit(2), F.greatest(F.size("p") - 2, F.lit(0))).alias("w"))
    none = F.array().cast(T.ArrayType(pairs.schema["src"].dataType))
    return pairs.select("pair_id").join(inner, "pair_id", "left").select("pair_id", F.coalesce("w", none).alias("waypoints"))


def common_nodes(paths: DataFrame) -> DataFrame:
    """``(pair_id, id)``: inner nodes that all of a pair's given paths hold."""
    total = paths.groupBy("pair_id").agg(F.count("*").alias("n"))
    inner = paths.select("pair_id", F.explode(F.array_distinct(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0))))).alias("id"))
    return inner.groupBy("pair_id", "id").agg(F.count("*").alias("m")).join(total, "pair_id").where("m = n").select("pair_id", "id")


def min_vertex_cut(pairs: DataFrame, e: DataFrame, near: DataFrame | None = None, waypoints: DataFrame | None = None) -> DataFrame:
    """``(pair_id, cut_size, cut_nodes, direct_edge)``: the fewest inner nodes to take away to part a pair.

    A direct edge gives the number of relevant nodes plus one and no nodes; a pair that is not
    linked, or one node, gives 0. Pairs with a mandatory waypoint have that as their cut; the
    others get a flow (:func:`smallest_cuts`), whatever their size.
    """
    kind = pairs.schema["src"].dataType
    near = near if near is not None else cut(relevant_subgraph(pairs, e))
    nodes = near.select("pair_id", F.explode(F.array("src", "dst")).alias("n")).distinct().groupBy("pair_id").agg(F.count("*").alias("n_nodes"))
    direct = near.join(pairs.select("pair_id", "src", "dst"), ["pair_id", "src", "dst"], "left_semi").select("pair_id", F.lit(True).alias("direct"))
    way = waypoints if waypoints is not None else mandatory_waypoints(pairs, near.select("src", "dst").distinct(), near=near)
    state = cut(pairs.select("pair_id", "src", "dst").join(nodes, "pair_id", "left").join(direct, "pair_id", "left").join(way, "pair_id", "left"))
    hard = state.where(F.col("n_nodes").isNotNull() & F.col("direct").isNull() & (F.size("waypoints") == 0) & (F.col("src") != F.col("dst")))
    got = state.join(smallest_cuts(hard, near.join(hard.select("pair_id"), "pair_id", "left_semi")), "pair_id", "left")
    none, same = F.array().cast(T.ArrayType(kind)), F.col("src") == F.col("dst")
    is_direct = F.coalesce("direct", F.lit(False))
    nodes_ = F.when(same | is_direct, none).when(F.size("waypoints") > 0, F.slice("waypoints", 1, 1)).otherwise(F.coalesce("cut", none))
    size = F.when(is_direct & ~same, F.col("n_nodes") + 1).otherwise(F.size(nodes_).cast("long"))
    return got.select("pair_id", size.alias("cut_size"), nodes_.alias("cut_nodes"), is_direct.alias("direct_edge"))


def group_by_divergence(paths: DataFrame, shortest: DataFrame) -> DataFrame:
    """``(pair_id, via, n_paths, representative, paths)``: paths by the first inner node that is not on the shortest path, else by their second node.

    The paths of a group are ordered by length, then by sequence; the first one represents it.
    """
    inner = F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))
    off = F.get(F.filter(inner, lambda n: ~F.array_contains("shortest", n)), F.lit(0))
    told = paths.select("pair_id", "path").join(shortest.select("pair_id", F.col("path").alias("shortest")), "pair_id")
    via = F.coalesce(off, F.get("path", F.lit(1)), F.get("path", F.lit(0)))
    grouped = told.select("pair_id", "path", via.alias("via")).groupBy("pair_id", "via").agg(F.array_sort(F.collect_list(F.struct(F.size("path").alias("n"), "path"))).alias("all"))
    return grouped.select("pair_id", "via", F.size("all").cast("long").alias("n_paths"), F.get("all", F.lit(0)).path.alias("representative"), F.col("all.path").alias("paths"))


def path_report(pairs: DataFrame, e: DataFrame, k: int = 30, rounds: int | None = None, in_pairs: bool = True) -> DataFrame:
    """One row for each pair with all that is known of its routes.

    ``pair_id, src, dst, reachable, shortest_path, hops, all_path_count, essential_count,
    essential_paths, dominators, min_cut_size, min_cut_nodes, path_groups, n_groups, is_unique``.
    Paths are ordered by length, then by sequence; groups (``via, representative, paths``) by
    their first path's length, then by ``via``. What leads from source to target is found once
    and every part works on that.
    """
    pairs = cut(pairs.select("pair_id", "src", "dst"))
    near = cut(relevant_subgraph(pairs, e))
    inside = cut(near.select("src", "dst").distinct())
    # a pair whose ends are unknown is told apart from one that is not linked by the nodes of the whole graph
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = ends.join(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    shortest = cut(shortest_paths(pairs, inside, nodes=known))
    found = merge_paths(shortest.where("reachable"), detour_paths(pairs, inside, rounds, in_pairs, shortest), k_shortest_paths(pairs, inside, k, near=near))
    found = cut(found)
    essential = cut(suffix_dedup(found))
    listed = essential.groupBy("pair_id").agg(F.count("*").alias("essential_count"), F.array_sort(F.collect_list(F.struct(F.size("path").alias("n"), "path"))).getField("path").alias("essential_paths"))
    sizes = found.groupBy("pair_id").agg(F.max("all_path_count").alias("all_path_count")).join(listed, "pair_id")
    one = F.struct(F.size("representative").alias("n"), "via", "representative", "paths")
    groups = group_by_divergence(essential, shortest).groupBy("pair_id").agg(F.count("*").alias("n_groups"), F.array_sort(F.collect_list(one)).alias("g"))
    groups = groups.select("pair_id", "n_groups", F.transform("g", lambda g: F.struct(g.via.alias("via"), g.representative.alias("representative"), g.paths.alias("paths"))).alias("path_groups"))
    way = cut(mandatory_waypoints(pairs, inside, near))
    least = min_vertex_cut(pairs, inside, near=near, waypoints=way)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = shortest.join(sizes, "pair_id", "left").join(groups, "pair_id", "left").join(way, "pair_id", "left").join(least, "pair_id", "left")
    return joined.select(
        "pair_id", "src", "dst", "reachable", F.col("path").alias("shortest_path"), F.greatest(F.size("path") - 1, F.lit(0)).alias("hops"), zero("all_path_count"), zero("essential_count"),
        F.coalesce("essential_paths", F.array().cast(listed.schema["essential_paths"].dataType)).alias("essential_paths"), F.col("waypoints").alias("dominators"), F.col("cut_size").alias("min_cut_size"),
        F.col("cut_nodes").alias("min_cut_nodes"), F.coalesce("path_groups", F.array().cast(groups.schema["path_groups"].dataType)).alias("path_groups"), zero("n_groups"), F.coalesce(F.col("essential_count") == 1, F.lit(False)).alias("is_unique"),
    )


def annotate_paths(paths: DataFrame, shortest: DataFrame, waypoints: DataFrame, cuts: DataFrame) -> DataFrame:
    """``(pair_id, path_no, pos, id, is_from, is_to, on_all, is_cut, is_unique_part, tag)`` for every place of every path.

    ``paths (pair_id, path_no, path)``. The tag is the first that holds of from, to, cut, all, unique.
    """
    told = paths.select("pair_id", "path_no", F.size("path").alias("n"), F.posexplode("path").alias("pos", "id"))
    told = told.join(shortest.select("pair_id", F.col("path").alias("s")), "pair_id", "left").join(waypoints.select("pair_id", F.col("waypoints").alias("w")), "pair_id", "left").join(cuts.select("pair_id", F.col("cut_nodes").alias("c")), "pair_id", "left")
    has = lambda a: F.coalesce(F.array_contains(a, F.col("id")), F.lit(False))
    flags: dict[str, Column] = {"is_from": F.col("pos") == 0, "is_to": F.col("pos") == F.col("n") - 1, "on_all": has("w"), "is_cut": has("c"), "is_unique_part": ~has("s")}
    tag = F.when(flags["is_from"], "from").when(flags["is_to"], "to").when(flags["is_cut"], "cut").when(flags["on_all"], "all").when(flags["is_unique_part"], "unique").otherwise("")
    return told.select("pair_id", "path_no", "pos", "id", *(c.alias(n) for n, c in flags.items()), tag.alias("tag"))


def path_edges(paths: DataFrame) -> DataFrame:
    """``(pair_id, src, dst)``: distinct steps of the paths."""
    steps = F.arrays_zip(F.col("path").alias("src"), F.slice("path", F.lit(2), F.size("path")).alias("dst"))
    return paths.where(F.size("path") > 1).select("pair_id", F.explode(steps).alias("s")).select("pair_id", F.col("s.src").alias("src"), F.col("s.dst").alias("dst")).where("dst is not null").distinct()


#: Large counts are arrays of digits to this base, lowest first: products and sums of these fit a long.
BASE = 10**6


def _carried(digits: Column) -> Column:
    """Digits of any size brought below the base again."""
    none = F.array().cast("array<bigint>")

    def step(s: Column, d: Column) -> Column:
        total = s.rest + d
        low = F.pmod(total, F.lit(BASE))
        return F.struct(F.concat(s.out, F.array(low)).alias("out"), F.call_function("div", total - low, F.lit(BASE)).alias("rest"))

    # what is left over the last digit is three more at most: a long has 19 places
    padded = F.concat(digits, F.array(*(F.lit(0).cast("bigint") for _ in range(3))))
    out = F.aggregate(padded, F.struct(none.alias("out"), F.lit(0).cast("bigint").alias("rest")), step, lambda s: s.out)
    used = lambda d: F.array_max(F.transform(d, lambda x, i: F.when(x > 0, i + 1).otherwise(0)))
    return F.element_at(F.transform(F.array(out), lambda d: F.slice(d, F.lit(1), F.greatest(used(d), F.lit(1)))), 1)


def _times(a: str, b: str) -> Column:
    """The product of two such numbers."""
    a_, b_ = F.col(a), F.col(b)
    at = lambda k: F.aggregate(F.sequence(F.greatest(k - F.size(b_) + 1, F.lit(0)), F.least(k, F.size(a_) - 1)), F.lit(0).cast("bigint"), lambda n, i: n + F.get(a_, i) * F.get(b_, k - i))
    return _carried(F.transform(F.sequence(F.lit(0), F.size(a_) + F.size(b_) - 2), at))


def _digits(number: Column) -> Column:
    """Such a number as text."""
    spelled = F.array_join(F.transform(F.reverse(number), lambda d: F.lpad(d.cast("string"), 6, "0")), "")
    return F.regexp_replace(spelled, "^0+(?=.)", "")


def path_dag(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """``(pair_id, id, n_children, path_count, is_branch, is_merge, cyclic)`` of the relevant nodes.

    The number of paths through a node is that of ways to it times that of ways from it, exact
    whatever its size, as text. It is null for a pair with cycles, which ``cyclic`` says: there
    ways don't multiply to paths.
    """
    all_ = cut(relevant_subgraph(pairs, e))
    cyclic = cut(_cyclic_pairs(all_))
    near = cut(all_.join(cyclic, "pair_id", "left_anti"))

    def summed(df: DataFrame) -> DataFrame:
        each = df.select("pair_id", "id", F.posexplode("n").alias("k", "d")).groupBy("pair_id", "id", "k").agg(F.sum("d").alias("d"))
        whole = each.groupBy("pair_id", "id").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).getField("d").alias("n"))
        return whole.select("pair_id", "id", _carried(F.col("n")).alias("n"))

    def ways(edges: DataFrame, start: DataFrame, name: str) -> DataFrame:
        front, found = cut(start.select("pair_id", "id", F.array(F.lit(1).cast("bigint")).alias("n"))), Pile()
        found.add(front)
        while not front.isEmpty():
            moved = front.join(edges, (front.pair_id == edges.pair_id) & (front.id == edges.src)).select(front.pair_id, F.col("dst").alias("id"), "n")
            front = cut(summed(moved))
            found.add(front)
        return summed(found.all()).withColumnRenamed("n", name)

    known = near.select("pair_id").distinct()
    start = lambda c: pairs.join(known, "pair_id", "left_semi").select("pair_id", F.col(c).alias("id"))
    to, from_ = ways(near, start("src"), "to"), ways(near.select("pair_id", F.col("dst").alias("src"), F.col("src").alias("dst")), start("dst"), "from")
    nodes = all_.select("pair_id", F.explode(F.array("src", "dst")).alias("id")).distinct().join(cyclic.withColumn("cyclic", F.lit(True)), "pair_id", "left")
    children = all_.groupBy("pair_id", F.col("src").alias("id")).agg(F.count("*").alias("n_children"))
    parents = all_.groupBy("pair_id", F.col("dst").alias("id")).agg(F.count("*").alias("n_parents"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    joined = nodes
    for more in (to, from_, children, parents):
        joined = joined.join(more, ["pair_id", "id"], "left")
    return joined.select(
        "pair_id", "id", zero("n_children").alias("n_children"), F.when(F.col("to").isNotNull() & F.col("from").isNotNull(), _digits(_times("to", "from"))).alias("path_count"),
        (zero("n_children") > 1).alias("is_branch"), (zero("n_parents") > 1).alias("is_merge"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )

"""Registered queries: each operator on the derived graphs, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import ids
from weftline.functions.lineage import cut, scratch_path, settle
from weftline.jobs import graphs
from weftline.operators import fixpoint, impact, metrics, paths, search
from weftline.operators import graph as g
from weftline.sources import compact, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query under the name of its function."""
    QUERIES[f.__name__] = f
    return f


def _spelled(*columns: str):
    """Arrays as text."""
    return lambda df: df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), " -> ") for c in columns})


def _listed(paths: Column | str) -> Column:
    """Paths as text, one after the other."""
    return F.array_join(F.transform(paths, lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), " -> ")), "; ")


def _dot(spark: SparkSession, sf_dir: str, lines: str = graphs.X4) -> g.Graph:
    return text.parse_dot(graphs.table(spark, sf_dir, lines), ids.DEFAULT_EXCLUDES)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(metrics.node_metrics(*graphs.graph(spark, sf_dir, graphs.X1)), "metrics")


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cut(graphs.table(spark, sf_dir, graphs.PAIRS)), cut(graphs.table(spark, sf_dir, graphs.X2))


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.phase_table(fixpoint.build_phase(*graphs.graph(spark, sf_dir, graphs.X1)))


@query
def s1_parse_dot(spark, sf_dir):
    return _dot(spark, sf_dir).edges


@query
def s2_parse_arrows(spark, sf_dir):
    lines = graphs.table(spark, sf_dir, graphs.X4).select(F.replace("value", F.lit('"'), F.lit("")).alias("value"))
    return text.parse_arrows(lines).edges


@query
def s3_read_graph(spark, sf_dir):
    folder = scratch_path(spark, "graph-text")
    dot = graphs.table(spark, sf_dir, graphs.X4)
    dot.write.text(f"{folder}/dot")
    dot.select(F.replace("value", F.lit('"'), F.lit(""))).write.text(f"{folder}/arrows")
    return text.read_graph(spark, [f"{folder}/dot", f"{folder}/arrows"]).edges


@query
def s4_json_round_trip(spark, sf_dir):
    path = scratch_path(spark, "graph-json")
    compact.write_json(_dot(spark, sf_dir), path)
    return compact.read_json(spark, path).edges


@query
def s5_encode(spark, sf_dir):
    names, edges = compact.encode(_dot(spark, sf_dir))
    return edges.join(names.select(F.col("idx").alias("si"), F.col("id").alias("src")), "si").select("src", "si", "di")


@query
def s6_write_tables(spark, sf_dir):
    folder = scratch_path(spark, "results")
    graph = _dot(spark, sf_dir)
    compact.write_tables({"nodes": graph.nodes, "edges": graph.edges, "packages": g.package_stats(graph.nodes, graph.edges)}, folder)
    return spark.read.parquet(f"{folder}/packages")


@query
def f1_first_target(spark, sf_dir):
    lines = graphs.table(spark, sf_dir, graphs.X4).select(F.replace("value", F.lit(":p"), F.lit("\\nq")).alias("value"))
    return lines.select(ids.first_target(F.col("value")).alias("value"))


@query
def f2_exclude_noise(spark, sf_dir):
    part = graphs.table(spark, sf_dir, graphs.X4).select(F.regexp_extract("value", '"([^"]+)" ->', 1).alias("id"))
    return part.select("id", ids.is_noise(F.col("id"), ids.DEFAULT_EXCLUDES).alias("noise"), ids.is_noise(F.col("id"), ("brand1",), ("economy", "standard")).alias("noise_in")).distinct()


@query
def f3_package_of(spark, sf_dir):
    return g.build_nodes(text.parse_dot(graphs.table(spark, sf_dir, graphs.X4)).edges)


@query
def f4_short_label(spark, sf_dir):
    nodes = _dot(spark, sf_dir).nodes
    return nodes.select("id", *(ids.short_label(F.col("id"), s).alias(s) for s in ("plain", "search", "canvas")), ids.target_tag(F.col("id")).alias("tag"))


@query
def f5_filter_nodes(spark, sf_dir):
    m, out = _metrics(spark, sf_dir), None
    for mode in ("all", "roots", "leaves", "bridges", "unique"):
        part = metrics.filter_nodes(m, mode).select(F.lit(mode).alias("mode"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query
def f6_search_nodes(spark, sf_dir):
    return metrics.search_nodes(_dot(spark, sf_dir).nodes, "ECONOMY/Brand1").select("id")


@query
def f7_node_kind(spark, sf_dir):
    graph = _dot(spark, sf_dir)
    flags = g.node_flags(graph.nodes, graph.edges).join(g.articulation_nodes(graph.edges).withColumn("b", F.lit(True)), "id", "left").withColumn("is_bridge", F.coalesce("b", F.lit(False)))
    return flags.select("id", ids.node_kind(F.col("id"), "canvas").alias("canvas"), ids.node_kind(F.col("id"), "list").alias("listed"))


@query
def f8_sort_nodes(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X2_ALL)
    return metrics.sort_nodes(g.degrees(v, e), "in_degree", 50).select("id", "in_degree", "out_degree")


@query
def a1_build_nodes(spark, sf_dir):
    return _dot(spark, sf_dir).nodes


@query
def a2_degrees(spark, sf_dir):
    return g.degrees(*graphs.graph(spark, sf_dir, graphs.X1))


@query
def a3_node_flags(spark, sf_dir):
    return g.node_flags(*graphs.graph(spark, sf_dir, graphs.X1))


@query
def a4_bridge_edges(spark, sf_dir):
    return g.bridge_edges(graphs.table(spark, sf_dir, graphs.X1))


@query
def a5_articulation_nodes(spark, sf_dir):
    return g.articulation_nodes(graphs.table(spark, sf_dir, graphs.X1))


@query
def a6_package_stats(spark, sf_dir):
    graph = _dot(spark, sf_dir)
    return g.package_stats(graph.nodes, graph.edges)


@query
def a7_overview(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X1)
    depths, phases, _ = fixpoint.layers(v, e)
    return metrics.overview(e, depths, metrics.phase_bottlenecks(metrics.phase_table(phases)), g.bridge_edges(e))


@query
def a8_heaviest(spark, sf_dir):
    return metrics.heaviest(fixpoint.transitive_dep_count(*graphs.graph(spark, sf_dir, graphs.X6)))


@query
def a9_pulled_in_by(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X2_ALL)
    return g.pulled_in_by(metrics.sort_nodes(g.degrees(v, e), "in_degree", 50), e)


@query
def a10_phase_table(spark, sf_dir):
    phases = fixpoint.build_phase(*graphs.graph(spark, sf_dir, graphs.X1))
    return metrics.phase_table(cut(phases), with_nodes=True)


@query
def a11_phase_bottlenecks(spark, sf_dir):
    return metrics.phase_bottlenecks(_phases(spark, sf_dir))


@query
def a12_phase_timeline(spark, sf_dir):
    return metrics.phase_timeline(metrics.phase_bottlenecks(_phases(spark, sf_dir)))


@query
def g1_scc(spark, sf_dir):
    return fixpoint.scc(*graphs.graph(spark, sf_dir, graphs.X5))


@query
def g2_condense(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X5)
    return fixpoint.condense(e, fixpoint.scc(v, e))


@query
def g3_topo_levels(spark, sf_dir):
    return fixpoint.topo_levels(*graphs.graph(spark, sf_dir, graphs.X1))


@query
def g4_depth(spark, sf_dir):
    return fixpoint.depth(*graphs.graph(spark, sf_dir, graphs.X1))


@query
def g5_build_phase(spark, sf_dir):
    return fixpoint.build_phase(*graphs.graph(spark, sf_dir, graphs.X5))


@query
def g6_transitive_dep_count(spark, sf_dir):
    return fixpoint.transitive_dep_count(*graphs.graph(spark, sf_dir, graphs.X5))


@query
def g1_scc_large(spark, sf_dir):
    return fixpoint.scc(*graphs.graph(spark, sf_dir, graphs.X3_ALL))


@query
def g3_topo_levels_deep(spark, sf_dir):
    return fixpoint.topo_levels(*graphs.graph(spark, sf_dir, graphs.X2_ALL))


@query
def g6_transitive_dep_count_large(spark, sf_dir):
    return fixpoint.transitive_dep_count(*graphs.graph(spark, sf_dir, graphs.X3_ALL))


@query
def g6_approx_dep_count(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X2)
    return fixpoint.approx_transitive_dep_count(v, e, cut(fixpoint.build_phase(v, e)))


@query
def g7_closure(spark, sf_dir):
    return fixpoint.closure(graphs.table(spark, sf_dir, graphs.X1))


@query
def g8_critical_chain(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X2_ALL)
    return fixpoint.critical_chain(e, cut(fixpoint.depth(v, e)))


@query
def g9_reachable_from_roots(spark, sf_dir):
    return fixpoint.reachable_from_roots(*graphs.graph(spark, sf_dir, graphs.X5))


@query
def g10_dependencies(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X2_ALL)
    top = cut(metrics.sort_nodes(g.degrees(v, e), "out_degree", 20))
    return fixpoint.dependencies(e, top)[1]


@query
def g10_dependencies_orders(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X1)
    top = cut(metrics.sort_nodes(g.degrees(v, e), "out_degree", 20))
    return fixpoint.dependencies(e, top)[1]


@query
def g10_reverse_dependencies(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X1)
    top = cut(metrics.sort_nodes(g.degrees(v, e).where("out_degree > 0"), "in_degree", 20))
    return fixpoint.dependencies(e, top, backward=True)[1]


@query
def g11_removal_impact(spark, sf_dir):
    return impact.removal_impact(*graphs.graph(spark, sf_dir, graphs.X2))


@query
def g11_removal_impact_cyclic(spark, sf_dir):
    return impact.removal_impact(*graphs.graph(spark, sf_dir, graphs.X3A))


@query
def g12_simulate_removal(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X2_ALL)
    figures, orphans = impact.simulate_removal(v, e, v)
    listed = orphans.groupBy("removed_id").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ", ").alias("orphaned"))
    return figures.join(listed, "removed_id", "left").select("removed_id", F.coalesce("orphaned", F.lit("")).alias("orphaned"), *figures.columns[1:])


@query
def g12_orphans(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X2)
    return impact.simulate_removal(v, e, v)[1]


@query
def g13_rank_roots(spark, sf_dir):
    return fixpoint.rank_roots(*graphs.graph(spark, sf_dir, graphs.X6))


@query
def g14_highlight(spark, sf_dir):
    v, e = graphs.graph(spark, sf_dir, graphs.X1)
    top = fixpoint.build_phase(v, e).where("build_phase >= 4")
    return impact.highlight(e, nodes=cut(top))[1]


@query
def g14_highlight_kinds(spark, sf_dir):
    pairs, e = _pairs(spark, sf_dir)
    v = cut(g.ids_of(e))
    figures, orphans = impact.simulate_removal(v, e, v)
    most = cut(figures.orderBy(F.desc("savings"), "removed_id").limit(1).select(F.col("removed_id").alias("id")))
    gone = cut(orphans.join(most.withColumnRenamed("id", "removed_id"), "removed_id", "left_semi").select("id").unionByName(most))
    steps = paths.path_edges(paths.shortest_paths(pairs, e)).select("src", "dst")
    kinds = {"bridges": impact.highlight(e, edges=g.bridge_edges(e)), "removal": impact.highlight(e, nodes=gone), "path": impact.highlight(e, edges=steps)}
    out = None
    for kind, (nodes, edges) in kinds.items():
        part = edges.select(F.lit(kind).alias("kind"), "src", "dst").unionByName(nodes.select(F.lit(kind).alias("kind"), F.col("id").alias("src"), F.lit(None).cast(nodes.schema["id"].dataType).alias("dst")))
        out = part if out is None else out.unionByName(part)
    return out


@query
def p0_relevant_subgraph(spark, sf_dir):
    return paths.relevant_subgraph(*_pairs(spark, sf_dir))


@query
def p1_shortest_path(spark, sf_dir):
    return _spelled("path")(paths.shortest_paths(*_pairs(spark, sf_dir)))


@query
def p2_k_shortest_paths(spark, sf_dir):
    return _spelled("path")(paths.k_shortest_paths(*_pairs(spark, sf_dir)))


@query
def p3_detour_paths(spark, sf_dir):
    return _spelled("path")(paths.detour_paths(*_pairs(spark, sf_dir)))


@query
def p4_merge_paths(spark, sf_dir):
    pairs, e = _pairs(spark, sf_dir)
    return _spelled("path")(paths.merge_paths(paths.shortest_paths(pairs, e).where("reachable"), paths.k_shortest_paths(pairs, e)))


@query
def p5_suffix_dedup(spark, sf_dir):
    found = cut(paths.k_shortest_paths(*_pairs(spark, sf_dir)))
    # paths of all pairs together, where some do end with others
    return _spelled("path")(paths.suffix_dedup(found.select(F.lit(0).cast("long").alias("pair_id"), "path")))


@query
def p6_mandatory_waypoints(spark, sf_dir):
    return _spelled("waypoints")(paths.mandatory_waypoints(*_pairs(spark, sf_dir)))


@query
def p7_min_vertex_cut(spark, sf_dir):
    return _spelled("cut_nodes")(paths.min_vertex_cut(*_pairs(spark, sf_dir)))


@query
def p8_group_by_divergence(spark, sf_dir):
    pairs, e = _pairs(spark, sf_dir)
    groups = paths.group_by_divergence(paths.k_shortest_paths(pairs, e), cut(paths.shortest_paths(pairs, e)))
    return _spelled("representative")(groups.withColumn("paths", _listed("paths")))


@query
def p9_path_report(spark, sf_dir):
    report = _spelled("shortest_path", "dominators", "min_cut_nodes")(paths.path_report(*_pairs(spark, sf_dir)))
    groups = F.array_join(F.transform("path_groups", lambda g: F.concat(g.via.cast("string"), F.lit(": "), _listed(g.paths))), " | ")
    return report.withColumns({"essential_paths": _listed("essential_paths"), "path_groups": groups})


@query
def p10_annotate_paths(spark, sf_dir):
    pairs, e = _pairs(spark, sf_dir)
    near = cut(paths.relevant_subgraph(pairs, e))
    inside = cut(near.select("src", "dst").distinct())
    shortest = cut(paths.shortest_paths(pairs, inside))
    found = paths.k_shortest_paths(pairs, inside, near=near).withColumnRenamed("rank", "path_no")
    way = cut(paths.mandatory_waypoints(pairs, inside, near))
    return paths.annotate_paths(found, shortest, way, paths.min_vertex_cut(pairs, inside, near=near, waypoints=way))


@query
def p10_path_edges(spark, sf_dir):
    pairs, e = _pairs(spark, sf_dir)
    return paths.path_edges(paths.k_shortest_paths(pairs, e))


@query
def p11_path_dag(spark, sf_dir):
    return paths.path_dag(*_pairs(spark, sf_dir)).withColumn("path_count", F.col("path_count").cast("long"))


@query
def q1_default_suggestions(spark, sf_dir):
    return metrics.default_suggestions(_metrics(spark, sf_dir)).select("id", "is_root", "transitive_dep_count")


def _asked(spark, sf_dir):
    graph = _dot(spark, sf_dir)
    v, e = cut(graph.nodes), cut(graph.edges)
    m = g.node_flags(v, e).join(fixpoint.transitive_dep_count(v, e), "id")
    # the queries are package names that occur in the table
    asked = v.select(F.concat_ws(" ", F.slice(F.split(F.regexp_replace("package", "^//", ""), "[ /]"), -2, 2)).alias("query")).distinct()
    return asked, m


@query
def q2_score_match(spark, sf_dir):
    asked, m = _asked(spark, sf_dir)
    # as many as there are names of packages
    return search.all_hits(cut(search.worded(asked)), m).withColumn("ranges", F.to_json("ranges"))


@query
def q3_search_topk(spark, sf_dir):
    return search.search_topk(*_asked(spark, sf_dir)).withColumn("ranges", F.to_json("ranges"))


@query
def q4_merge_ranges(spark, sf_dir):
    spans = graphs.table(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem")
    start = F.col("l_partkey").cast("int") % 40
    ranges = spans.select("l_orderkey", start.alias("s"), (start + F.col("l_quantity").cast("int") % 9 + 1).alias("e"))
    merged = search.merge_ranges(ranges, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("m"))
    return merged.select("l_orderkey", F.array_join(F.transform("m", lambda r: F.concat_ws("-", r.s.cast("string"), r.e.cast("string"))), ",").alias("merged"))


@query
def l1_layered_layout(spark, sf_dir):
    m, out = _metrics(spark, sf_dir), None
    for kind in ("phases", "hierarchical", "radial"):
        part = metrics.layered_layout(m, kind, 1200, 800).select(F.lit(kind).alias("kind"), "id", "layer", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def l2_layer_bounds(spark, sf_dir):
    got = metrics.layer_bounds(metrics.layered_layout(_metrics(spark, sf_dir), "phases", 1200, 800))
    return got.select("layer", "n", *(F.round(c, 6).alias(c) for c in got.columns[2:]))

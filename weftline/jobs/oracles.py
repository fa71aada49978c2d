"""DuckDB SQL that gives the rows of the queries of the same name."""

from __future__ import annotations

from weftline.functions.ids import DEFAULT_EXCLUDES, SOURCE_ENDINGS
from weftline.jobs.graphs import PAIRS, X1, X2, X2_ALL, X3_ALL, X3A, X4, X5, X6

_V = "v AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e))"
_D = "d AS (SELECT DISTINCT src, dst FROM e)"
_DEG = """deg AS (SELECT v.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, i.p AS parent FROM v
  LEFT JOIN (SELECT dst AS id, count(*) AS n, min(src) AS p FROM e GROUP BY dst) i USING (id) LEFT JOIN (SELECT src AS id, count(*) AS n FROM e GROUP BY src) o USING (id))"""
_CLO = "clo(src, dst) AS (SELECT src, dst FROM d UNION SELECT clo.src, d.dst FROM clo JOIN d ON clo.dst = d.src)"
_TRANS = "tr AS (SELECT v.id, count(clo.dst) FILTER (clo.dst <> v.id) AS transitive_dep_count FROM v LEFT JOIN clo ON clo.src = v.id GROUP BY v.id)"
_DEPTH = """dl(id, l) AS (SELECT id, 0 FROM v WHERE id NOT IN (SELECT dst FROM e) UNION SELECT d.dst, l + 1 FROM dl JOIN d ON d.src = dl.id),
dep AS (SELECT id, max(l)::INT AS depth FROM dl GROUP BY id)"""
_PHASE = """pl(id, l) AS (SELECT id, 0 FROM v WHERE id NOT IN (SELECT src FROM e) UNION SELECT d.src, l + 1 FROM pl JOIN d ON d.dst = pl.id),
ph AS (SELECT id, max(l)::INT AS build_phase FROM pl GROUP BY id)"""
_ART = "art AS (SELECT src AS id FROM e JOIN deg ON deg.id = e.dst GROUP BY src HAVING bool_and(in_degree = 1) AND src IN (SELECT dst FROM e))"
_M = f"""{_V}, {_D}, {_DEG}, {_CLO}, {_TRANS}, {_DEPTH}, {_PHASE}, {_ART},
m AS (SELECT id, in_degree, out_degree, depth, build_phase, out_degree = 0 AS is_leaf, in_degree = 0 AS is_root, id IN (SELECT id FROM art) AS is_bridge,
  CASE WHEN in_degree = 1 THEN parent END AS unique_parent, transitive_dep_count FROM deg JOIN tr USING (id) JOIN dep USING (id) JOIN ph USING (id))"""
_PT = """pt AS (SELECT build_phase AS phase, count(*) AS n_nodes FROM ph GROUP BY 1),
w AS (SELECT phase, n_nodes, coalesce(sum(n_nodes) OVER (ORDER BY phase DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS waiting_behind, count(*) OVER () AS k, sum(n_nodes) OVER () AS n FROM pt),
bn AS (SELECT phase, n_nodes, waiting_behind, waiting_behind::DOUBLE / n_nodes AS blocking_ratio,
  k > 2 AND waiting_behind > 0 AND n_nodes < 0.5 * n / k AND waiting_behind::DOUBLE / n_nodes > 5 AS is_bottleneck FROM w)"""
_SCC = """back(id, other) AS (SELECT a.src, a.dst FROM clo a JOIN clo b ON a.src = b.dst AND a.dst = b.src),
sc AS (SELECT v.id, least(v.id, coalesce(min(other), v.id)) AS scc_id FROM v LEFT JOIN back USING (id) GROUP BY v.id),
scc AS (SELECT id, scc_id, count(*) OVER (PARTITION BY scc_id) AS scc_size FROM sc),
con AS (SELECT DISTINCT a.scc_id AS src, b.scc_id AS dst FROM e JOIN scc a ON a.id = e.src JOIN scc b ON b.id = e.dst WHERE a.scc_id <> b.scc_id)"""
_REMOVED = """root AS (SELECT id FROM v WHERE id NOT IN (SELECT dst FROM e)),
base AS (SELECT id FROM root UNION SELECT dst FROM clo WHERE src IN (SELECT id FROM root)),
cand AS (SELECT id AS x FROM v {where}),
rr(x, id) AS (SELECT x, id FROM cand, root WHERE id <> x UNION SELECT x, d.dst FROM rr JOIN d ON d.src = rr.id WHERE d.dst <> x),
left_ AS (SELECT cand.x, count(rr.id) AS n FROM cand LEFT JOIN rr USING (x) GROUP BY 1),
sav AS (SELECT x, (SELECT count(*) FROM base) - n AS savings FROM left_)"""


def _with(graph: str, *parts: str, then: str) -> str:
    return f"WITH RECURSIVE e AS ({graph}), {', '.join(parts)} {then}"


_NOISE = " OR ".join([f"regexp_matches({{0}}, ':[^:]*\\.({'|'.join(SOURCE_ENDINGS)})$')", *(f"contains({{0}}, '{p}')" for p in DEFAULT_EXCLUDES)])
_LINES = rf"""l AS ({X4}), raw AS (SELECT regexp_extract(value, '"([^"]+)"\s*->\s*"([^"]+)"', 1) AS src, regexp_extract(value, '"([^"]+)"\s*->\s*"([^"]+)"', 2) AS dst FROM l),
e AS (SELECT src, dst FROM raw WHERE NOT ({_NOISE.format('src')}) AND NOT ({_NOISE.format('dst')}))"""
_PACKAGE = "CASE WHEN regexp_extract({0}, '^(@[^/]+//[^:]*|//[^:]*)', 1) = '' THEN {0} ELSE regexp_extract({0}, '^(@[^/]+//[^:]*|//[^:]*)', 1) END"
_DOT = f"{_LINES}, {_V}, n AS (SELECT id, id AS label, {_PACKAGE.format('id')} AS package FROM v)"
_SEARCH = r"regexp_replace(regexp_replace(id, '^//', ''), '^@[^/]+//', '@')"

# all simple paths of the pairs inside their relevant parts
_ROUTES = f"""pairs AS ({PAIRS}), {_D}, {_CLO},
both_(pair_id, id) AS (SELECT pair_id, x.id FROM pairs, (SELECT DISTINCT id FROM (SELECT src AS id FROM d UNION ALL SELECT dst FROM d)) x
  WHERE (x.id = pairs.src OR (pairs.src, x.id) IN (SELECT src, dst FROM clo)) AND (x.id = pairs.dst OR (x.id, pairs.dst) IN (SELECT src, dst FROM clo))),
near AS (SELECT a.pair_id, d.src, d.dst FROM d JOIN both_ a ON a.id = d.src JOIN both_ b ON b.id = d.dst AND b.pair_id = a.pair_id),
walk(pair_id, stop, path) AS (SELECT pair_id, src, [src] FROM pairs UNION ALL SELECT w.pair_id, n.dst, list_append(path, n.dst) FROM walk w JOIN near n ON n.pair_id = w.pair_id AND n.src = w.stop WHERE NOT list_contains(path, n.dst)),
full_ AS (SELECT w.pair_id, path, len(path) - 1 AS hops, row_number() OVER (PARTITION BY w.pair_id ORDER BY len(path), path) AS rank FROM walk w JOIN pairs p ON p.pair_id = w.pair_id AND w.stop = p.dst),
top AS (SELECT * FROM full_ WHERE rank <= 30),
sp AS (SELECT pairs.*, path IS NOT NULL AS reachable, coalesce(path, []) AS path FROM pairs LEFT JOIN full_ ON full_.pair_id = pairs.pair_id AND rank = 1),
nodes_on AS (SELECT pair_id, unnest(path[2:-2]) AS id, count(*) OVER (PARTITION BY pair_id) AS dummy FROM full_),
must AS (SELECT pair_id, id FROM nodes_on GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM full_ f WHERE f.pair_id = nodes_on.pair_id)),
way AS (SELECT sp.pair_id, list_filter(sp.path[2:-2], lambda x: (sp.pair_id, x) IN (SELECT pair_id, id FROM must)) AS w FROM sp)"""
_WAY = "way AS (SELECT sp.pair_id, list(x.id ORDER BY list_position(sp.path, x.id)) FILTER (x.id IS NOT NULL) AS w FROM sp LEFT JOIN must x ON x.pair_id = sp.pair_id GROUP BY sp.pair_id)"
_ROUTES = _ROUTES[: _ROUTES.index("way AS")] + _WAY
_TEXT = "array_to_string({0}, ' -> ')"


def _routes(then: str) -> str:
    return _with(X2, _ROUTES, then=then)


# detours: the best way around each inner node of any path, alone or with one of the shortest path, taken up as paths are found
_BLOCKED = """inner_ AS (SELECT pair_id, unnest(path[2:-2]) AS b FROM sp),
any_ AS (SELECT DISTINCT pair_id, id AS b FROM nodes_on),
blk AS (SELECT pair_id, b, CASE WHEN false THEN b END AS s FROM any_ UNION ALL SELECT a.pair_id, a.b, i.b FROM any_ a JOIN inner_ i ON i.pair_id = a.pair_id AND i.b <> a.b),
around AS (SELECT f.pair_id, blk.b, f.path, row_number() OVER (PARTITION BY f.pair_id, blk.b, blk.s ORDER BY len(f.path), f.path) AS k
  FROM full_ f JOIN blk ON blk.pair_id = f.pair_id AND NOT list_contains(f.path, blk.b) AND (blk.s IS NULL OR NOT list_contains(f.path, blk.s))),
det_(pair_id, path) AS (SELECT pair_id, path FROM sp WHERE reachable UNION SELECT x.pair_id, a.path FROM det_ x JOIN around a ON a.pair_id = x.pair_id AND a.k = 1 AND list_contains(x.path[2:-2], a.b)),
det AS (SELECT x.pair_id, x.path FROM det_ x JOIN sp ON sp.pair_id = x.pair_id WHERE x.path <> sp.path)"""
_VIA = "coalesce(list_filter(t.path[2:-2], lambda x: NOT list_contains(sp.path, x))[1], t.path[2], t.path[1])"
# smallest cuts: sets that hit the paths one after the other, of the smallest the one that leaves the fewest nodes before it
_CUTS = """nn AS (SELECT pair_id, count(DISTINCT id) AS n FROM (SELECT pair_id, src AS id FROM near UNION ALL SELECT pair_id, dst FROM near) GROUP BY 1),
direct AS (SELECT sp.pair_id FROM sp JOIN near n ON n.pair_id = sp.pair_id AND n.src = sp.src AND n.dst = sp.dst),
hard AS (SELECT sp.pair_id FROM sp JOIN way USING (pair_id) WHERE reachable AND src <> dst AND len(coalesce(w, [])) = 0 AND sp.pair_id NOT IN (SELECT pair_id FROM direct)),
step AS (SELECT pair_id, rank, path[2:-2] AS inside, unnest(path[2:-2]) AS x FROM full_ WHERE pair_id IN (SELECT pair_id FROM hard)),
hit(pair_id, i, c) AS (SELECT pair_id, 0::BIGINT, path[1:0] FROM full_ WHERE rank = 1 AND pair_id IN (SELECT pair_id FROM hard)
  UNION SELECT h.pair_id, s.rank, CASE WHEN list_has_any(h.c, s.inside) THEN h.c ELSE list_sort(list_append(h.c, s.x)) END FROM hit h JOIN step s ON s.pair_id = h.pair_id AND s.rank = h.i + 1),
cand AS (SELECT h.pair_id, h.c FROM hit h JOIN (SELECT pair_id, max(rank) AS last FROM full_ GROUP BY 1) z ON z.pair_id = h.pair_id AND z.last = h.i),
small AS (SELECT * FROM cand QUALIFY len(c) = min(len(c)) OVER (PARTITION BY pair_id)),
ahead AS (SELECT small.pair_id, c, unnest(f.path[1:list_min(list_transform(c, lambda x: CASE WHEN list_contains(f.path, x) THEN list_position(f.path, x) ELSE len(f.path) END)) - 1]) AS x FROM small JOIN full_ f ON f.pair_id = small.pair_id),
best AS (SELECT pair_id, arg_min(c, n) AS c FROM (SELECT pair_id, c, count(DISTINCT x) AS n FROM ahead GROUP BY 1, 2) GROUP BY 1),
cuts AS (SELECT sp.pair_id, direct.pair_id IS NOT NULL AS direct_edge,
  CASE WHEN sp.src = sp.dst OR direct.pair_id IS NOT NULL OR NOT reachable THEN sp.path[1:0] WHEN len(coalesce(w, [])) > 0 THEN w[1:1] ELSE best.c END AS c, n
  FROM sp LEFT JOIN way ON way.pair_id = sp.pair_id LEFT JOIN nn ON nn.pair_id = sp.pair_id LEFT JOIN direct ON direct.pair_id = sp.pair_id LEFT JOIN best ON best.pair_id = sp.pair_id),
cut AS (SELECT cuts.pair_id, direct_edge, CASE WHEN direct_edge THEN n + 1 ELSE len(c) END AS cut_size, c FROM cuts)"""
_GROUPED = f"SELECT t.pair_id, {_VIA} AS via, count(*) AS n_paths, arg_min(t.path, [len(t.path)] || t.path) AS first_, list(t.path ORDER BY len(t.path), t.path) AS paths FROM {{0}} t JOIN sp ON sp.pair_id = t.pair_id GROUP BY 1, 2"
_LISTED = "array_to_string(list_transform({0}, lambda p: array_to_string(p, ' -> ')), '; ')"
_REPORT = f"""every AS (SELECT pair_id, path FROM sp WHERE reachable UNION SELECT pair_id, path FROM det UNION SELECT pair_id, path FROM top),
ess AS (SELECT * FROM every a WHERE NOT EXISTS (SELECT 1 FROM every b WHERE b.pair_id = a.pair_id AND len(b.path) < len(a.path) AND a.path[len(a.path) - len(b.path) + 1:] = b.path)),
gr AS ({_GROUPED.format('ess')}),
gs AS (SELECT pair_id, count(*) AS n_groups, string_agg(via || ': ' || {_LISTED.format('paths')}, ' | ' ORDER BY len(first_), via) AS path_groups FROM gr GROUP BY 1),
es AS (SELECT pair_id, count(*) AS n, list(path ORDER BY len(path), path) AS p FROM ess GROUP BY 1),
al AS (SELECT pair_id, count(*) AS n FROM every GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "s1_parse_dot": f"WITH {_LINES} SELECT src, dst FROM e",
    "s2_parse_arrows": rf"""WITH l AS ({X4}), t AS (SELECT trim(replace(value, '"', ''), ' ' || chr(9)) AS value FROM l),
e AS (SELECT regexp_extract(value, '^([^\s]+)\s*->\s*([^\s]+)', 1) AS src, regexp_extract(value, '^([^\s]+)\s*->\s*([^\s]+)', 2) AS dst FROM t)
SELECT src, dst FROM e WHERE src <> '' AND NOT regexp_matches(src, ':[^:]*\.({'|'.join(SOURCE_ENDINGS)})$') AND NOT regexp_matches(dst, ':[^:]*\.({'|'.join(SOURCE_ENDINGS)})$')""",
    "s3_read_graph": rf"""WITH l AS ({X4}), raw AS (SELECT regexp_extract(value, '"([^"]+)" -> "([^"]+)"', 1) AS src, regexp_extract(value, '"([^"]+)" -> "([^"]+)"', 2) AS dst FROM l),
e AS (SELECT * FROM raw WHERE NOT regexp_matches(src, ':[^:]*\.({'|'.join(SOURCE_ENDINGS)})$') AND NOT regexp_matches(dst, ':[^:]*\.({'|'.join(SOURCE_ENDINGS)})$'))
SELECT src, dst FROM e UNION ALL SELECT src, dst FROM e""",
    "s4_json_round_trip": f"WITH {_LINES} SELECT src, dst FROM e",
    "s5_encode": f"WITH {_DOT}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM v) SELECT src, a.i AS si, b.i AS di FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst",
    "s6_write_tables": f"WITH {_DOT} SELECT n.package, count(DISTINCT n.id) AS node_count, coalesce((SELECT count(*) FROM e JOIN n s ON s.id = e.src WHERE s.package = n.package), 0) AS edge_count FROM n GROUP BY n.package",
    "f1_first_target": rf"""WITH l AS ({X4}) SELECT regexp_replace(replace(value, ':p', '\nq'), '"([^"]*?)\\n[^"]*"', '"\1"', 'g') AS value FROM l""",
    "f2_exclude_noise": f"""WITH l AS ({X4}), i AS (SELECT DISTINCT regexp_extract(value, '"([^"]+)" ->', 1) AS id FROM l)
SELECT id, {_NOISE.format('id')} AS noise, regexp_matches(id, ':[^:]*\\.({'|'.join(SOURCE_ENDINGS)})$') OR contains(id, 'brand1') OR NOT (contains(id, 'economy') OR contains(id, 'standard')) AS noise_in FROM i""",
    "f3_package_of": f"""WITH l AS ({X4}), raw AS (SELECT regexp_extract(value, '"([^"]+)" -> "([^"]+)"', 1) AS src, regexp_extract(value, '"([^"]+)" -> "([^"]+)"', 2) AS dst FROM l),
e AS (SELECT * FROM raw WHERE NOT regexp_matches(src, ':[^:]*\\.({'|'.join(SOURCE_ENDINGS)})$') AND NOT regexp_matches(dst, ':[^:]*\\.({'|'.join(SOURCE_ENDINGS)})$')), {_V}
SELECT id, id AS label, {_PACKAGE.format('id')} AS package FROM v""",
    "f4_short_label": f"""WITH {_DOT} SELECT id, regexp_replace(id, '^//', '') AS plain, {_SEARCH} AS search,
CASE WHEN length({_SEARCH}) > 40 AND len(string_split({_SEARCH}, '/')) > 2 THEN '.../' || array_to_string(string_split({_SEARCH}, '/')[-2:], '/') ELSE {_SEARCH} END AS canvas,
string_split(string_split(regexp_replace(id, '^//', ''), '/')[-1], ':')[-1] AS tag FROM n""",
    "f5_filter_nodes": _with(X1, _M, then="""SELECT 'all' AS mode, id FROM m UNION ALL SELECT 'roots', id FROM m WHERE is_root UNION ALL SELECT 'leaves', id FROM m WHERE is_leaf
UNION ALL SELECT 'bridges', id FROM m WHERE is_bridge UNION ALL SELECT 'unique', id FROM m WHERE unique_parent IS NOT NULL"""),
    "f6_search_nodes": f"WITH {_DOT} SELECT id FROM n WHERE contains(lower(id), 'economy/brand1')",
    "f7_node_kind": f"""WITH {_DOT}, {_DEG}, {_ART} SELECT id,
CASE WHEN contains(id, 'third_party') OR starts_with(id, '@') THEN 'external' WHEN in_degree = 0 THEN 'root' WHEN out_degree = 0 THEN 'leaf' WHEN id IN (SELECT id FROM art) THEN 'bridge' ELSE 'normal' END AS canvas,
CASE WHEN in_degree = 0 THEN 'root' WHEN out_degree = 0 THEN 'leaf' WHEN starts_with(id, '@') THEN 'external' ELSE 'normal' END AS listed FROM deg""",
    "f8_sort_nodes": _with(X2_ALL, _V, _DEG, then="SELECT id, in_degree, out_degree FROM deg ORDER BY in_degree DESC, id LIMIT 50"),
    "a1_build_nodes": f"WITH {_DOT} SELECT * FROM n",
    "a2_degrees": _with(X1, _V, _DEG, then="SELECT id, in_degree, out_degree FROM deg"),
    "a3_node_flags": _with(X1, _V, _DEG, then="SELECT id, in_degree, out_degree, in_degree = 0 AS is_root, out_degree = 0 AS is_leaf, CASE WHEN in_degree = 1 THEN parent END AS unique_parent FROM deg"),
    "a4_bridge_edges": _with(X1, _V, _DEG, then="SELECT src, dst FROM e JOIN deg ON deg.id = dst WHERE in_degree = 1"),
    "a5_articulation_nodes": _with(X1, _V, _DEG, _ART, then="SELECT id FROM art"),
    "a6_package_stats": f"WITH {_DOT} SELECT n.package, count(DISTINCT n.id) AS node_count, coalesce((SELECT count(*) FROM e JOIN n s ON s.id = e.src WHERE s.package = n.package), 0) AS edge_count FROM n GROUP BY n.package",
    "a7_overview": _with(X1, _M, _PT, then="""SELECT n_nodes, n_edges, greatest(0, n_nodes - 1) AS total_deps, n_phases, max_parallel, CASE WHEN max_parallel > 50 THEN 'good' WHEN max_parallel > 10 THEN 'ok' ELSE 'bad' END AS parallel_status,
n_bottlenecks, CASE WHEN n_bottlenecks = 0 THEN 'good' ELSE 'bad' END AS bottleneck_status, chain_nodes, CASE WHEN chain_nodes < 20 THEN 'good' WHEN chain_nodes < 50 THEN 'ok' ELSE 'bad' END AS chain_status, n_bridge_edges
FROM (SELECT (SELECT count(*) FROM v) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM bn) AS n_phases, (SELECT max(n_nodes) FROM bn) AS max_parallel, (SELECT count(*) FROM bn WHERE is_bottleneck) AS n_bottlenecks,
(SELECT CASE WHEN max(depth) > 0 THEN max(depth) + 1 ELSE 0 END::BIGINT FROM dep) AS chain_nodes, (SELECT count(*) FROM e JOIN deg ON deg.id = dst WHERE in_degree = 1) AS n_bridge_edges)"""),
    "a8_heaviest": _with(X6, _V, _D, _CLO, _TRANS, then="SELECT id, transitive_dep_count, 100.0::DOUBLE * transitive_dep_count / greatest((SELECT max(transitive_dep_count) FROM tr), 1) AS pct FROM tr ORDER BY transitive_dep_count DESC, id LIMIT 20"),
    "a9_pulled_in_by": _with(X2_ALL, _V, _DEG, "t AS (SELECT id FROM deg ORDER BY in_degree DESC, id LIMIT 50)", then="SELECT t.id, coalesce(array_to_string((list(src ORDER BY src) FILTER (src IS NOT NULL))[1:3], ', '), '') AS parents, greatest(count(src) - 3, 0) AS more FROM t LEFT JOIN e ON e.dst = t.id GROUP BY t.id"),
    "a10_phase_table": _with(X1, _V, _D, _PHASE, then="SELECT build_phase AS phase, count(*) OVER (PARTITION BY build_phase) AS n_nodes, id FROM ph"),
    "a11_phase_bottlenecks": _with(X1, _V, _D, _PHASE, _PT, then="SELECT * FROM bn"),
    "a12_phase_timeline": _with(X1, _V, _D, _PHASE, _PT, then="SELECT phase, n_nodes, 100.0::DOUBLE * n_nodes / max(n_nodes) OVER () AS bar_pct, count(*) OVER () AS n_phases, max(n_nodes) OVER () AS max_parallel, (count(*) FILTER (is_bottleneck) OVER ())::BIGINT AS n_bottlenecks FROM bn"),
    "g1_scc": _with(X5, _V, _D, _CLO, _SCC, then="SELECT * FROM scc"),
    "g2_condense": _with(X5, _V, _D, _CLO, _SCC, then="SELECT * FROM con"),
    "g3_topo_levels": _with(X1, _V, _D, _DEPTH, then="SELECT id, depth AS level FROM dep"),
    "g4_depth": _with(X1, _V, _D, _DEPTH, then="SELECT id, depth FROM dep"),
    "g5_build_phase": _with(X5, _V, _D, _CLO, _SCC, "cp(id, l) AS (SELECT DISTINCT scc_id, 0 FROM scc WHERE scc_id NOT IN (SELECT src FROM con) UNION SELECT con.src, l + 1 FROM cp JOIN con ON con.dst = cp.id)", then="SELECT scc.id, max(l)::INT AS build_phase FROM scc JOIN cp ON cp.id = scc_id GROUP BY scc.id"),
    "g6_transitive_dep_count": _with(X5, _V, _D, _CLO, _TRANS, then="SELECT * FROM tr"),
    "g1_scc_large": _with(X3_ALL, _V, _D, _CLO, _SCC, then="SELECT * FROM scc"),
    "g3_topo_levels_deep": _with(X2_ALL, _V, _D, _DEPTH, then="SELECT id, depth AS level FROM dep"),
    "g6_transitive_dep_count_large": _with(X3_ALL, _V, _D, _CLO, _TRANS, then="SELECT * FROM tr"),
    "g7_closure": _with(X1, _D, _CLO, then="SELECT * FROM clo WHERE src <> dst"),
    "g8_critical_chain": _with(X2_ALL, _V, _D, _DEPTH, """par AS (SELECT d.dst, min(d.src) AS src FROM d JOIN dep a ON a.id = d.src JOIN dep b ON b.id = d.dst WHERE a.depth = b.depth - 1 GROUP BY d.dst),
ch(id, k) AS ((SELECT id, depth FROM dep WHERE depth > 0 ORDER BY depth DESC, id LIMIT 1) UNION ALL SELECT par.src, k - 1 FROM ch JOIN par ON par.dst = ch.id)""", then="SELECT k::INT AS position, id FROM ch"),
    "g9_reachable_from_roots": _with(X5, _V, _D, _CLO, then="SELECT id FROM v WHERE id NOT IN (SELECT dst FROM e) UNION SELECT dst FROM clo WHERE src NOT IN (SELECT dst FROM e)"),
    "g10_dependencies": _with(X2_ALL, _V, _D, _DEG, _CLO, "t AS (SELECT id FROM deg ORDER BY out_degree DESC, id LIMIT 20)", then="SELECT t.id AS start, d.src, d.dst FROM t JOIN d ON d.src = t.id OR (t.id, d.src) IN (SELECT src, dst FROM clo)"),
    "g10_dependencies_orders": _with(X1, _V, _D, _DEG, _CLO, "t AS (SELECT id FROM deg ORDER BY out_degree DESC, id LIMIT 20)", then="SELECT t.id AS start, d.src, d.dst FROM t JOIN d ON d.src = t.id OR (t.id, d.src) IN (SELECT src, dst FROM clo)"),
    "g10_reverse_dependencies": _with(X1, _V, _D, _DEG, "t AS (SELECT id FROM deg WHERE out_degree > 0 ORDER BY in_degree DESC, id LIMIT 20)", "up(start, id) AS (SELECT id, id FROM t UNION SELECT up.start, d.src FROM up JOIN d ON d.dst = up.id)", then="SELECT up.start, d.src, d.dst FROM up JOIN d ON d.dst = up.id"),
    "g11_removal_impact": _with(X2, _V, _D, _CLO, _REMOVED.format(where="WHERE id IN (SELECT src FROM e) AND id IN (SELECT dst FROM e)"), then="SELECT x AS id, savings - 1 AS orphaned_count, savings, 100.0::DOUBLE * savings / (SELECT count(*) FROM base) AS savings_pct FROM sav WHERE savings > 0"),
    "g11_removal_impact_cyclic": _with(X3A, _V, _D, _CLO, _REMOVED.format(where="WHERE id IN (SELECT src FROM e) AND id IN (SELECT dst FROM e)"), then="SELECT x AS id, savings - 1 AS orphaned_count, savings, 100.0::DOUBLE * savings / (SELECT count(*) FROM base) AS savings_pct FROM sav WHERE savings > 0"),
    "g12_simulate_removal": _with(X2_ALL, _V, _D, _CLO, _REMOVED.format(where=""), "orph AS (SELECT x, b.id FROM cand JOIN base b ON b.id <> x WHERE (x = b.id OR x IN (SELECT src FROM clo WHERE dst = b.id)) AND (x, b.id) NOT IN (SELECT x, id FROM rr))", then="""SELECT sav.x AS removed_id, coalesce((SELECT string_agg(id::VARCHAR, ', ' ORDER BY id) FROM orph WHERE orph.x = sav.x), '') AS orphaned, greatest(savings - 1, 0) AS orphaned_count,
(SELECT count(*) FROM e WHERE src = sav.x OR dst = sav.x) AS affected_edges, (SELECT count(*) FROM base) AS deps_before, (SELECT count(*) FROM base) - savings AS deps_after, savings, 100.0::DOUBLE * savings / (SELECT count(*) FROM base) AS savings_pct FROM sav"""),
    "g12_orphans": _with(X2, _V, _D, _CLO, _REMOVED.format(where=""), then="""SELECT x AS removed_id, b.id FROM cand JOIN base b ON b.id <> x
WHERE (x = b.id OR x IN (SELECT src FROM clo WHERE dst = b.id)) AND (x, b.id) NOT IN (SELECT x, id FROM rr)"""),
    "g13_rank_roots": _with(X6, _V, _D, _CLO, _TRANS, then="SELECT id, transitive_dep_count + 1 AS reach, row_number() OVER (ORDER BY transitive_dep_count DESC, id) AS rank, row_number() OVER (ORDER BY transitive_dep_count DESC, id) = 1 AS is_main FROM tr WHERE id NOT IN (SELECT dst FROM e)"),
    "g14_highlight": _with(X1, _V, _D, _PHASE, then="SELECT src, dst FROM d WHERE src IN (SELECT id FROM ph WHERE build_phase >= 4) OR dst IN (SELECT id FROM ph WHERE build_phase >= 4)"),
    "p0_relevant_subgraph": _routes("SELECT * FROM near"),
    "p1_shortest_path": _routes(f"SELECT pair_id, src, dst, reachable, {_TEXT.format('path')} AS path FROM sp"),
    "p2_k_shortest_paths": _routes(f"SELECT pair_id, rank::INT AS rank, {_TEXT.format('path')} AS path, hops::INT AS hops FROM top"),
    "p3_detour_paths": _with(X2, _ROUTES, _BLOCKED, then=f"SELECT pair_id, {_TEXT.format('path')} AS path FROM det"),
    "p4_merge_paths": _routes(f"SELECT pair_id, {_TEXT.format('path')} AS path, count(*) OVER (PARTITION BY pair_id) AS all_path_count FROM top"),
    "p5_suffix_dedup": _routes(f"SELECT 0::BIGINT AS pair_id, {_TEXT.format('path')} AS path FROM (SELECT DISTINCT path FROM top) a WHERE NOT EXISTS (SELECT 1 FROM top b WHERE len(b.path) < len(a.path) AND a.path[len(a.path) - len(b.path) + 1:] = b.path)"),
    "p6_mandatory_waypoints": _routes(f"SELECT pair_id, coalesce({_TEXT.format('w')}, '') AS waypoints FROM way"),
    "p7_min_vertex_cut": _with(X2, _ROUTES, _CUTS, then=f"SELECT pair_id, cut_size, {_TEXT.format('c')} AS cut_nodes, direct_edge FROM cut"),
    "p8_group_by_divergence": _routes(f"SELECT pair_id, via, n_paths, {_TEXT.format('first_')} AS representative, {_LISTED.format('paths')} AS paths FROM ({_GROUPED.format('top')})"),
    "p9_path_report": _with(X2, _ROUTES, _BLOCKED, _CUTS, _REPORT, then=f"""SELECT sp.pair_id, sp.src, sp.dst, reachable, {_TEXT.format('sp.path')} AS shortest_path, greatest(len(sp.path) - 1, 0)::INT AS hops, coalesce(al.n, 0) AS all_path_count, coalesce(es.n, 0) AS essential_count,
coalesce({_LISTED.format('es.p')}, '') AS essential_paths, coalesce({_TEXT.format('w')}, '') AS dominators, cut_size AS min_cut_size, {_TEXT.format('c')} AS min_cut_nodes, coalesce(path_groups, '') AS path_groups, coalesce(n_groups, 0) AS n_groups, coalesce(es.n, 0) = 1 AS is_unique
FROM sp JOIN way ON way.pair_id = sp.pair_id JOIN cut ON cut.pair_id = sp.pair_id LEFT JOIN al ON al.pair_id = sp.pair_id LEFT JOIN es ON es.pair_id = sp.pair_id LEFT JOIN gs ON gs.pair_id = sp.pair_id"""),
    "p10_annotate_paths": _with(X2, _ROUTES, _CUTS, then="""SELECT pair_id, path_no, pos, id, is_from, is_to, on_all, is_cut, is_unique_part,
CASE WHEN is_from THEN 'from' WHEN is_to THEN 'to' WHEN is_cut THEN 'cut' WHEN on_all THEN 'all' WHEN is_unique_part THEN 'unique' ELSE '' END AS tag
FROM (SELECT t.pair_id, t.rank::INT AS path_no, (k - 1)::INT AS pos, t.path[k] AS id, k = 1 AS is_from, k = len(t.path) AS is_to, coalesce(list_contains(w, t.path[k]), false) AS on_all, coalesce(list_contains(c, t.path[k]), false) AS is_cut, NOT list_contains(sp.path, t.path[k]) AS is_unique_part
  FROM (SELECT *, unnest(range(1, len(path) + 1)) AS k FROM top) t JOIN sp ON sp.pair_id = t.pair_id JOIN way ON way.pair_id = t.pair_id JOIN cut ON cut.pair_id = t.pair_id)"""),
    "p10_path_edges": _routes("SELECT DISTINCT pair_id, path[k] AS src, path[k + 1] AS dst FROM (SELECT *, unnest(range(1, len(path))) AS k FROM top)"),
    "p11_path_dag": _routes("""SELECT x.pair_id, x.id, coalesce(c.n, 0) AS n_children, count(*) AS path_count, coalesce(c.n, 0) > 1 AS is_branch, coalesce(p.n, 0) > 1 AS is_merge, false AS cyclic
FROM (SELECT pair_id, unnest(path) AS id FROM full_) x LEFT JOIN (SELECT pair_id, src AS id, count(*) AS n FROM near GROUP BY 1, 2) c ON c.pair_id = x.pair_id AND c.id = x.id
LEFT JOIN (SELECT pair_id, dst AS id, count(*) AS n FROM near GROUP BY 1, 2) p ON p.pair_id = x.pair_id AND p.id = x.id GROUP BY x.pair_id, x.id, c.n, p.n"""),
    "q1_default_suggestions": _with(X1, _M, then="SELECT id, is_root, transitive_dep_count FROM m ORDER BY is_root DESC, transitive_dep_count DESC, id LIMIT 30"),
    "q4_merge_ranges": """WITH s AS (SELECT l_orderkey, l_partkey::INT % 40 AS s, l_partkey::INT % 40 + l_quantity::INT % 9 + 1 AS e FROM lineitem),
o AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
m AS (SELECT l_orderkey, k, min(s) AS s, max(e) AS e FROM g GROUP BY 1, 2)
SELECT l_orderkey, string_agg(s || '-' || e, ',' ORDER BY s) AS merged FROM m GROUP BY 1""",
}

_PLACE = "row_number() OVER (PARTITION BY {0} ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY {0}) AS n, max({0}) OVER () AS most"
_LAYOUT = f"""a AS (SELECT id, build_phase AS layer, {_PLACE.format('build_phase')} FROM m), b AS (SELECT id, depth AS layer, {_PLACE.format('depth')} FROM m),
lay AS (SELECT 'phases' AS kind, id, layer, 1200.0::DOUBLE / (n + 1) * (i + 1) AS x, 800.0::DOUBLE - 800.0::DOUBLE / (most + 2) * (layer + 1) AS y FROM a
UNION ALL SELECT 'hierarchical', id, layer, 1200.0::DOUBLE / (n + 1) * (i + 1), 800.0::DOUBLE / (most + 2) * (layer + 1) FROM b
UNION ALL SELECT 'radial', id, layer, 600 + 800.0::DOUBLE / (2 * (most + 2)) * (layer + 1) * cos(2 * pi() * i / n), 400 + 800.0::DOUBLE / (2 * (most + 2)) * (layer + 1) * sin(2 * pi() * i / n) FROM b)"""
ORACLES["l1_layered_layout"] = _with(X1, _M, _LAYOUT, then="SELECT kind, id, layer, round(x, 6) AS x, round(y, 6) AS y FROM lay")
ORACLES["l2_layer_bounds"] = _with(X1, _M, _LAYOUT, then="""SELECT layer, count(*) AS n, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round((SELECT min(x) FROM lay WHERE kind = 'phases'), 6) AS all_min_x, round((SELECT max(x) FROM lay WHERE kind = 'phases'), 6) AS all_max_x,
round((SELECT min(y) FROM lay WHERE kind = 'phases'), 6) AS all_min_y, round((SELECT max(y) FROM lay WHERE kind = 'phases'), 6) AS all_max_y FROM lay WHERE kind = 'phases' GROUP BY layer""")

# scores: words are taken one after the other; a state is where to go on, what counts so far and the ranges as text
_SCORES = rf"""{_V}, n AS (SELECT id, {_PACKAGE.format('id')} AS package FROM v), {_D}, {_DEG}, {_CLO}, {_TRANS},
lab AS (SELECT id, in_degree, transitive_dep_count, lower({_SEARCH}) AS label, regexp_extract_all(lower({_SEARCH}), '[^/\-_:.@]+') AS parts FROM deg JOIN tr USING (id)),
placed AS (SELECT *, list_filter(range(1, length(label) + 1), lambda i: NOT contains('/-_:.@', label[i]) AND (i = 1 OR contains('/-_:.@', label[i - 1]))) AS begins FROM lab),
asked AS (SELECT DISTINCT p[-2] || ' ' || p[-1] AS query FROM (SELECT string_split_regex(regexp_replace(package, '^//', ''), '[ /]') AS p FROM n) WHERE len(p) > 1),
w AS (SELECT query, list_filter(string_split_regex(trim(lower(query)), '\s+'), lambda t: t <> '') AS words FROM asked),
st(query, id, k, next_, score, starts, ranges) AS (SELECT query, id, 0, 0::BIGINT, 0::DOUBLE, 0, '' FROM w JOIN placed ON len(words) > 0
  UNION ALL SELECT query, id, k + 1, CASE WHEN s IS NULL THEN next_ ELSE s + 1 END,
    score + CASE WHEN s IS NOT NULL THEN CASE WHEN s = next_ THEN 40 ELSE 20 END + CASE WHEN length(t) = 1 THEN 15 ELSE 0 END + least(15, 3 * length(t)) WHEN c IS NOT NULL THEN 5 + least(10, 2 * length(t)) ELSE 2 END,
    starts + CASE WHEN s IS NULL THEN 0 ELSE 1 END, ranges || CASE WHEN k = 0 THEN '' ELSE ',' END || '{{{{"s":' || o || ',"e":' || o + length(t) || '}}}}'
  FROM (SELECT *, CASE WHEN s IS NOT NULL THEN begins[s + 1] - 1 WHEN c IS NOT NULL THEN begins[c + 1] - 1 + strpos(parts[c + 1], t) - 1 ELSE strpos(label, t) - 1 END AS o
    FROM (SELECT st.*, t, placed.label, placed.parts, placed.begins, list_filter(range(next_, len(parts)), lambda i: starts_with(parts[i + 1], t))[1] AS s, list_filter(range(0, len(parts)), lambda i: contains(parts[i + 1], t))[1] AS c
      FROM (SELECT st.*, words[st.k + 1] AS t FROM st JOIN w ON w.query = st.query WHERE st.k < len(words)) st JOIN placed ON placed.id = st.id)) WHERE o >= 0),
sc AS (SELECT query, st.id, score + CASE WHEN starts = len(words) THEN 30 ELSE 0 END + greatest(0, 15 - len(parts))
    + list_sum(list_transform(words, lambda t: CASE WHEN starts_with(parts[-1], t) THEN 25 WHEN contains(parts[-1], t) THEN 10 ELSE 0 END))
    + least(10, 0.5::DOUBLE * in_degree) + least(5, 0.01::DOUBLE * transitive_dep_count) + CASE WHEN in_degree = 0 THEN 8 ELSE 0 END AS score, '[' || ranges || ']' AS ranges
  FROM st JOIN w USING (query) JOIN placed ON placed.id = st.id WHERE k = len(words))""".replace("{{", "{").replace("}}", "}")
ORACLES["q2_score_match"] = f"WITH RECURSIVE {_LINES}, {_SCORES} SELECT query, id, score, ranges FROM sc"
ORACLES["q3_search_topk"] = f"WITH RECURSIVE {_LINES}, {_SCORES} SELECT query, rank, id, score, ranges FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM sc) WHERE rank <= 30"

ORACLES["g14_highlight_kinds"] = _with(X2, _ROUTES, _V, _DEG, _REMOVED.format(where=""), """x AS (SELECT x FROM sav ORDER BY savings DESC, x LIMIT 1),
gone AS (SELECT x AS id FROM x UNION SELECT b.id FROM x JOIN base b ON b.id <> x.x WHERE (x.x = b.id OR x.x IN (SELECT src FROM clo WHERE dst = b.id)) AND (x.x, b.id) NOT IN (SELECT x, id FROM rr)),
he AS (SELECT DISTINCT 'bridges' AS kind, src, dst FROM e JOIN deg ON deg.id = dst WHERE in_degree = 1
  UNION ALL SELECT 'removal', src, dst FROM d WHERE src IN (SELECT id FROM gone) OR dst IN (SELECT id FROM gone)
  UNION ALL SELECT DISTINCT 'path', path[k], path[k + 1] FROM (SELECT *, unnest(range(1, len(path))) AS k FROM sp)),
hn AS (SELECT DISTINCT kind, id FROM (SELECT kind, src AS id FROM he WHERE kind <> 'removal' UNION ALL SELECT kind, dst FROM he WHERE kind <> 'removal' UNION ALL SELECT 'removal', id FROM gone))""",
    then="SELECT * FROM he UNION ALL SELECT kind, id, NULL FROM hn")

"""Graphs that are derived from the order tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.lineage import settle

#: X1, X2_ALL, X3_ALL, X4 and X6 take all rows. X2 and X3A are for routes, removals and counts of sparse graphs, whose SQL lists
#: ways or tries each node: there the larger quantities alone make links, as otherwise most parts lead to most others.
X1 = """
WITH li AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem)
SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM li)
UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM li
UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM li
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM li)
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
"""

_NEXT = """
  SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b
  FROM lineitem{where}"""
_LINKS = "SELECT greatest(a, b) AS src, least(a, b) AS dst FROM ({next}) t WHERE b IS NOT NULL AND a <> b"

X2 = _LINKS.format(next=_NEXT.format(where=" WHERE l_quantity >= 40"))
X2_ALL = _LINKS.format(next=_NEXT.format(where=""))
_TURNS = "SELECT a AS src, b AS dst FROM ({next}) t WHERE b IS NOT NULL"
#: The first has few and small components; in that of all rows one holds most nodes.
X3A = _TURNS.format(next=_NEXT.format(where=" WHERE l_quantity >= 45"))
X3_ALL = _TURNS.format(next=_NEXT.format(where=""))
#: X1 and beside it, as nodes of their own, the links of X2_ALL: many roots and long chains.
X6 = f"SELECT * FROM ({X1}) a UNION ALL SELECT 'l' || src, 'l' || dst FROM ({X2_ALL}) b"
#: All rows as well, but a part is a node for each quantity and place in an order: somewhat fewer edges than nodes, so few and small components.
_PLACED = "l_partkey * 256 + CAST(l_quantity AS BIGINT) * 4 + l_linenumber % 3"
X5 = _TURNS.format(next=_NEXT.format(where="").replace("l_partkey AS a", f"{_PLACED} AS a").replace("lead(l_partkey)", f"lead({_PLACED})"))
_DOT_LINES = """
WITH e AS ({links}),
lab AS (SELECT p_partkey AS k, CASE
    WHEN p_partkey % 29 = 0 THEN '@bazel_tools//x:p' || p_partkey
    WHEN p_partkey % 23 = 0 THEN '//' || lower(p_type) || '/' || replace(lower(p_brand), '#', '') || ':P' || p_partkey || '.java'
    WHEN p_partkey % 31 = 0 THEN '@ext//third_party/' || lower(p_type) || ':p' || p_partkey
    ELSE '//' || lower(p_type) || '/' || replace(lower(p_brand), '#', '') || ':p' || p_partkey END AS id FROM part)
SELECT CASE WHEN s.k % 3 = 0 THEN chr(9) ELSE '  ' END || '"' || s.id || '" -> "' || d.id || '"' AS value
FROM e JOIN lab s ON s.k = e.src JOIN lab d ON d.k = e.dst
"""
X4 = _DOT_LINES.format(links=X2_ALL)
#: Nodes with the most distinct dependencies, and those most depended on; every such pair.
PAIRS = """
WITH x AS (SELECT DISTINCT src, dst FROM ({x2}) g),
s AS (SELECT src, row_number() OVER (ORDER BY count(*) DESC, src) AS i FROM x GROUP BY src),
d AS (SELECT dst, row_number() OVER (ORDER BY count(*) DESC, dst) AS j FROM x GROUP BY dst)
SELECT CAST(5 * (i - 1) + j AS BIGINT) AS pair_id, src, dst FROM s JOIN d ON i <= 5 AND j <= 5
""".format(x2=X2)


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of the SQL over the tables in a folder."""
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "supplier", "nation", "part") if re.search(rf"\b{t}\b", sql)}
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in names:
        text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **names)


def graph(spark: SparkSession, sf_dir: str, sql: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id)`` and edges, computed once."""
    from weftline.operators.graph import ids_of

    e = settle(table(spark, sf_dir, sql), "links")
    return settle(ids_of(e), "nodes"), e

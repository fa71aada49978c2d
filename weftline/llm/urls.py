"""URL filters: rules for hosts and paths, and link-graph propagation for what no rule covers.

Trust flows from the hosts that rules allow along the links between hosts (personalised PageRank);
distrust flows from the hosts that rules block against the links. Both are whole numbers, so the
result is the same in any order of adding. A host is blocked if its distrust outweighs its trust.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import cut
from weftline.llm.text import whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What all seeds hold together, the percentage that flows on, and how often it does.
MASS, DAMPING, ROUNDS = 10**12, 85, 12
#: Absolute links in attributes of HTML.
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?\s*([a-z][a-z0-9+.-]*://[^\"'\s>]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path up to a query or fragment; empty for null or without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.call_function("locate", F.lit("://"), url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _ancestors(host: Column) -> Column:
    """The host and the domains above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def host_edges(pages: DataFrame, hosts: DataFrame, html_col: str = "html") -> DataFrame:
    """``(src, dst)``: distinct links between the given hosts, and both ways between a host and the nearest host above it.

    ``pages`` has a column ``host``. Links count once per pair of hosts, however many pages have
    them; they are made distinct before the shuffle.
    """
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(whole(html_col), F.lit(LINK), 1), host_of))).alias("dst")).distinct()
    known = hosts.select("host")
    linked = linked.join(known.withColumnRenamed("host", "dst"), "dst", "left_semi").select("src", "dst")
    above = known.select("host", F.posexplode(_ancestors(F.col("host"))).alias("up", "domain")).where("up > 0")
    nearest = above.join(known.withColumnRenamed("host", "domain"), "domain", "left_semi").groupBy("host").agg(F.min_by("domain", "up").alias("domain"))
    both = nearest.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("domain").alias("dst")), F.struct(F.col("domain").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.*")
    return linked.unionByName(both).where("src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """``(kind, host, score)`` after some rounds of personalised PageRank.

    ``edges`` are ``(kind, src, dst)``, ``seeds`` are ``(kind, host, base)``. A host without
    links keeps nothing back. Shares are whole numbers, rounded down.
    """
    out = edges.groupBy("kind", "src").agg(F.count("*").alias("n"))
    ways = cut(edges.join(out, ["kind", "src"]))
    seeds = cut(seeds)
    rank = seeds.select("kind", F.col("host").alias("src"), F.col("base").alias("score"))
    for k in range(rounds):
        moved = ways.join(rank, ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.expr("score div n").alias("part"))
        kept = seeds.select("kind", "host", F.expr(f"base * {100 - damping} div 100").alias("base"), F.lit(0).cast("long").alias("part"))
        rank = moved.select("kind", "host", F.lit(0).cast("long").alias("base"), "part").unionByName(kept).groupBy("kind", "host").agg((F.sum("base") + F.expr(f"sum(part) * {damping} div 100")).alias("score"))
        rank = rank.where("score > 0").select("kind", F.col("host").alias("src"), "score")
        if k % 4 == 3:
            rank = cut(rank)
    return rank.withColumnRenamed("src", "host")


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: int = 1) -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules`` are ``(verdict, host, path)`` with verdict allow or block. A rule fits its host and
    what is below it where the path starts with the rule's; the longest wins (host and path
    together; of equals the longer host). ``rule`` is null where none fits; then the host is
    blocked if its distrust is over ``ratio`` times its trust, else allowed. A host counts as
    trusted or blocked seed by what rules say of most of its pages; equal numbers say nothing.
    Null urls and urls without ``://`` have the empty host, which has no links. The list of
    rules is a policy: it is part of the plan, so meant to be of some thousands at most.
    """
    spark = pages.sparkSession
    named = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    counted = named.groupBy("host").agg(F.count("*").alias("n_pages"))
    rules = sorted({(h, p, v) for v, h, p in rules})
    listed = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(h).alias("domain"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))).alias("r")).select("r.*") if rules else spark.range(0).selectExpr("'' domain", "'' path", "'' verdict")
    size = F.struct((F.length("domain") + F.length("path")).alias("n"), F.length("domain").alias("host_n"), "domain", "path", "verdict")
    fits = counted.select("host", F.explode(_ancestors(F.col("host"))).alias("domain")).join(F.broadcast(listed), "domain").groupBy("host").agg(F.sort_array(F.collect_list(size), False).alias("rules"))
    hosts = cut(counted.join(fits, "host", "left"))
    ruled = named.join(hosts.select("host", "rules"), "host", "left").select("id", "host", "path", F.get(F.filter("rules", lambda r: F.col("path").startswith(r.path)), F.lit(0)).alias("r"))
    said = F.sum(F.when(F.col("r.verdict") == "allow", 1).when(F.col("r.verdict") == "block", -1).otherwise(0))
    leaning = ruled.groupBy("host").agg(said.alias("said")).where("said <> 0 and host <> ''")
    seeds = leaning.select(F.when(F.col("said") > 0, "trust").otherwise("distrust").alias("kind"), "host")
    sizes = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    seeds = seeds.join(sizes, "kind").select("kind", "host", F.expr(f"{MASS} div n").alias("base"))
    edges = cut(host_edges(named, hosts))
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    score = propagate(ways, seeds).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0)).alias("distrust")
    )
    blocked = score.where(F.col("distrust") > ratio * F.col("trust")).select("host", F.lit(True).alias("blocked"))
    of_host = hosts.select("host", "rules").join(blocked, "host", "left")
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r.path)), F.lit(0))
    told = named.select("id", "host", "path").join(of_host, "host", "left").select("id", "host", "path", first.alias("r"), "blocked")
    return told.select(
        "id", "host", "path", F.concat("r.domain", "r.path").alias("rule"),
        F.coalesce("r.verdict", F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")).alias("verdict"),
    )

"""Lineage: where a node comes from and what depends on it."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid import dims
from notegrid.functions import text as tx
from notegrid.tables import cut_lineage

_ROLES = {"center": 0, "upstream": 1, "downstream": 2, "bridge": 3}


class UnknownNodeError(KeyError):
    """The reference means no node."""


class AmbiguousNodeError(ValueError):
    """The reference means several nodes; `candidates` lists them."""

    def __init__(self, ref: str, candidates: list):
        super().__init__(f"{ref!r} is ambiguous")
        self.candidates = candidates


def canonical_edges(edges: DataFrame) -> DataFrame:
    """(source, target, type, mode, weight) of the lineage relations, turned so that
    the source comes first; other relations are left out."""
    modes = F.create_map(*[F.lit(x) for kv in dims.LINEAGE_MODES.items() for x in kv])
    kept = edges.withColumn("mode", modes[F.col("type")]).where(F.col("mode").isNotNull())
    turn = F.col("mode") == "target_upstream"
    return kept.select(
        F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("source"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("target"),
        "type", "mode", F.coalesce("weight", F.lit(1.0)).alias("weight"),
    )


def steps(canonical: DataFrame, role: str) -> DataFrame:
    """(a, b, weight): steps of a walk upstream or downstream; two-way relations lead both ways."""
    way = ("target", "source") if role == "upstream" else ("source", "target")
    one = F.struct(F.col(way[0]).alias("a"), F.col(way[1]).alias("b"))
    two = F.when(F.col("mode") == "bidirectional", F.array(one, F.struct(F.col(way[1]).alias("a"), F.col(way[0]).alias("b")))).otherwise(F.array(one))
    return canonical.select(F.inline(two), "weight")


def walk(canonical: DataFrame, centers: DataFrame, role: str, depth: int) -> DataFrame:
    """(center, name, depth) of everything within `depth` steps; all centers at once."""
    moves = steps(canonical, role).select("a", "b").distinct()
    reached = centers.select("center", F.col("center").alias("name")).distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for d in range(1, depth + 1):
        step = frontier.select("center", F.col("name").alias("a")).join(moves, "a").select("center", F.col("b").alias("name")).distinct()
        frontier = step.join(reached.select("center", "name"), ["center", "name"], "left_anti").withColumn("depth", F.lit(d))
        reached = reached.unionByName(frontier)
        if d > 2:
            reached = cut_lineage(reached)
            frontier = reached.where(F.col("depth") == d)
    return reached.where(F.col("depth") > 0)


def _merged(up: DataFrame | None, down: DataFrame | None, centers: DataFrame, extra: list[Column] = ()) -> DataFrame:
    tagged = [df.withColumn("role", F.lit(r)) for df, r in ((up, "upstream"), (down, "downstream")) if df is not None]
    rows = tagged[0] if len(tagged) == 1 else tagged[0].unionByName(tagged[1])
    role = F.when(F.min("role") != F.max("role"), "bridge").otherwise(F.min("role"))
    return rows.groupBy("center", "name").agg(F.min("depth").alias("depth"), role.alias("lineage_role"), *extra)


def lineage_nodes(edges: DataFrame, centers: DataFrame, depth: int = 2, direction: str = "both", types: DataFrame | None = None, keep_types: list[str] | None = None) -> DataFrame:
    """(center, name, depth, lineage_role) of the lineage of each center (column center).

    A node reached both ways is a bridge. keep_types filters after the walk and
    never the center; an empty list keeps the center alone, None everything.
    """
    if direction not in ("upstream", "downstream", "both"):
        raise ValueError("direction must be upstream, downstream or both")
    canonical = canonical_edges(edges)
    up = walk(canonical, centers, "upstream", depth) if direction != "downstream" else None
    down = walk(canonical, centers, "downstream", depth) if direction != "upstream" else None
    rows = _merged(up, down, centers)
    if keep_types is not None:
        kept = types.where(F.col("entity_type").isin(keep_types)).select("name") if keep_types else types.limit(0).select("name")
        rows = rows.join(kept, "name", "left_semi")
    own = centers.select("center", F.col("center").alias("name"), F.lit(0).alias("depth"), F.lit("center").alias("lineage_role")).distinct()
    return own.unionByName(rows.select("center", "name", "depth", "lineage_role"))


def lineage_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Canonical edges between nodes of one lineage (columns center, name)."""
    inside = nodes.select("center", "name")
    e = canonical_edges(edges).join(inside.withColumnRenamed("name", "source"), "source")
    return e.join(inside.withColumnRenamed("name", "target"), ["center", "target"], "left_semi").select("center", "source", "target", "type", "weight").distinct()


def lineage_stats(nodes: DataFrame) -> DataFrame:
    """(center, nodes, upstream, downstream, bridges, max_depth)."""
    role = F.col("lineage_role")
    return nodes.groupBy("center").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(role == "upstream").alias("upstream"), F.count_if(role == "downstream").alias("downstream"),
        F.count_if(role == "bridge").alias("bridges"), F.max("depth").alias("max_depth"),
    )


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes by depth, role and name, as a view shows them."""
    rank = F.create_map(*[F.lit(x) for kv in _ROLES.items() for x in kv])
    return nodes.orderBy("center", "depth", rank[F.col("lineage_role")], F.lower("name"), "name")


def _cheapest(center: str, moves: dict[str, list[tuple[str, float]]], depth: int) -> list[tuple[str, int, float]]:
    """Least costs (1 / weight) from the center; nodes at the last hop don't expand,
    and a node expands from its cheapest path alone, whatever its hops."""
    best, hops = {center: 0.0}, {}
    queue = [(0.0, 0, center)]
    while queue:
        cost, hop, node = heapq.heappop(queue)
        if hop >= depth or cost > best.get(node, cost):
            continue
        for other, weight in moves.get(node, ()):
            if weight <= 0:
                continue
            total = cost + 1.0 / weight
            if total < best.get(other, float("inf")):
                best[other] = total
                hops[other] = min(hops.get(other, hop + 1), hop + 1)
                heapq.heappush(queue, (total, hop + 1, other))
    return [(n, h, round(1.0 / best[n], 6)) for n, h in hops.items() if n != center]


def weighted_lineage(edges: DataFrame, centers: DataFrame, depth: int = 2, direction: str = "both") -> DataFrame:
    """(center, name, depth, lineage_role, cumulative_weight): by least cost. The part
    of the graph within `depth` steps of a center is searched in one group."""
    canonical = canonical_edges(edges)
    parts = []
    for role in ("upstream", "downstream"):
        if direction not in (role, "both"):
            continue
        near = walk(canonical, centers, role, depth).select("center", "name").unionByName(centers.select("center", F.col("center").alias("name"))).distinct()
        local = steps(canonical, role).join(near.withColumnRenamed("name", "a"), "a")

        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            moves: dict[str, list[tuple[str, float]]] = {}
            for a, b, w in sorted(zip(pdf["a"], pdf["b"], pdf["weight"])):
                moves.setdefault(a, []).append((b, w))
            center = pdf["center"].iloc[0]
            rows = [(center, *r) for r in _cheapest(center, moves, depth)]
            return pd.DataFrame(rows, columns=["center", "name", "depth", "cumulative_weight"])

        found = local.groupBy("center").applyInPandas(search, "center string, name string, depth int, cumulative_weight double")
        parts.append(found.withColumn("role", F.lit(role)))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    role = F.when(F.min("role") != F.max("role"), "bridge").otherwise(F.min("role"))
    rows = rows.groupBy("center", "name").agg(F.min("depth").alias("depth"), role.alias("lineage_role"), F.max("cumulative_weight").alias("cumulative_weight"))
    own = centers.select("center", F.col("center").alias("name"), F.lit(0).alias("depth"), F.lit("center").alias("lineage_role"), F.lit(0.0).alias("cumulative_weight")).distinct()
    return own.unionByName(rows)


def match_candidates(nodes: DataFrame, ref: str) -> DataFrame:
    """(key, match_kind, score, priority) of the nodes (key, name, path, entity_type) that ref may mean."""
    spark = nodes.sparkSession
    query = spark.range(1).select(tx.normal_ref(F.lit(ref)).alias("q")).first()[0]
    if not query:
        return nodes.limit(0).select("key", F.lit("").alias("match_kind"), F.lit(0).alias("score"), F.lit(0).alias("priority"))
    path, key, name = tx.normal_ref(F.coalesce("path", F.lit(""))), tx.normal_ref(F.col("key")), tx.normal_ref(F.coalesce("name", tx.stem(F.col("key"))))
    base_name = F.when(path != "", F.element_at(F.split(path, "/"), -1)).otherwise(F.element_at(F.split(key, "/"), -1))
    q = F.lit(query)
    pathish = lambda c: F.contains(c, F.lit("/")) & c.endswith("/" + query)
    kind = (
        F.when((key == q) | (path == q), "exact-path")
        .when((name == q) | (base_name == q), "exact-name")
        .when(pathish(key) | pathish(path), "path-suffix")
        .when(F.contains(name, q) | F.contains(base_name, q), "name-contains")
        .when(F.contains(key, q) | F.contains(path, q), "path-contains")
    )
    bases = {"exact-path": 120, "exact-name": 108, "path-suffix": 92, "name-contains": 52, "path-contains": 34}
    base = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv])[F.col("match_kind")]
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in dims.RESOLVE_PRIORITY.items() for x in kv])[F.coalesce("entity_type", F.lit("unknown"))], F.lit(1))
    stub = F.when(F.contains(path, F.lit("/stub/")), 18).otherwise(0)
    rows = nodes.withColumn("match_kind", kind).where(F.col("match_kind").isNotNull())
    return rows.select("key", "match_kind", (base + priority - stub).alias("score"), priority.alias("priority"))


def resolve_node(nodes: DataFrame, ref: str) -> str | None:
    """The key that ref means; None if nothing matches well enough, an
    AmbiguousNodeError with at most five candidates if several match alike."""
    slashes = F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))
    top = match_candidates(nodes, ref).orderBy(F.desc("score"), F.desc("priority"), slashes, F.length("key"), F.lower("key"), "key").limit(5).collect()
    if not top:
        return None
    first, second = top[0], top[1] if len(top) > 1 else None
    close = second is not None and first.score - second.score < 8
    alike = {"exact-name": {"exact-name"}, "path-suffix": {"path-suffix", "exact-name"}}
    query_length = len(ref.strip().lower())
    if first.match_kind.endswith("contains"):
        if query_length < 6 or first.score < (60 if first.match_kind == "name-contains" else 50):
            return None
        if close:
            raise AmbiguousNodeError(ref, top)
    elif first.match_kind in alike and close and second.match_kind in alike[first.match_kind]:
        raise AmbiguousNodeError(ref, top)
    return first.key

"""Graph analytics over (src, dst, type, weight) edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrid.tables import cut_lineage

#: The ways back between two nodes that meet the ways ahead in one task are about so many at most.
CYCLE_BLOCK = 256
#: Pairs of nodes that may lie on a cycle are marked in so many words of 64 bits at most.
MARK_WORDS = 1 << 20


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, in_degree, out_degree); an edge to oneself counts twice."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum(1 - F.col("o")).alias("in_degree"), F.sum("o").alias("out_degree"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, dangling nodes. nodes has name and is_dangling."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_dangling").alias("dangling"))
    m = edges.agg(F.count(F.lit(1)).alias("edges")).select("edges").scalar()
    pairs = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    return n.select("nodes", m.alias("edges"), "dangling").withColumn("density", F.when(pairs > 0, F.col("edges") / pairs).otherwise(0.0))


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """(name, rank), weighted; the rank of nodes without out-edges goes to all. Ends
    after `iterations`, or when the ranks change by less than tolerance * nodes in
    sum; with tolerance None always after `iterations`. Null weights count as 1."""
    w = F.coalesce("weight", F.lit(1.0))
    out = edges.groupBy("src").agg(F.sum(w).alias("total")).where(F.col("total") > 0)
    links = cut_lineage(edges.join(out, "src").select("src", "dst", (w / F.col("total")).alias("share")))
    n = nodes.count()
    if n == 0:
        return nodes.select("name", F.lit(0.0).alias("rank"))
    base = cut_lineage(nodes.join(out.select(F.col("src").alias("name"), F.lit(True).alias("sends")), "name", "left").select("name", F.coalesce("sends", F.lit(False)).alias("sends")))
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        lost = ranks.where(~F.col("sends")).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).select("lost").scalar()
        got = links.join(ranks.select(F.col("name").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("name")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)
        step = ranks.join(got, "name", "left").select("name", "sends", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
        step = cut_lineage(step)
        ranks = step.select("name", "sends", "rank")
        if tolerance is not None and step.agg(F.sum("change")).first()[0] < n * tolerance:
            break
    return ranks.select("name", "rank")


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(name, component): weakly connected components, named by their least node.

    Each round takes the least label among the neighbours, then jumps to the label
    of that label, so that the rounds grow as the logarithm of a path's length.
    The map side keeps one least label per node, so a hub's neighbours don't meet.
    """
    both = edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))
    both = cut_lineage(both.where(F.col("a") != F.col("b")).distinct())
    labels = cut_lineage(nodes.select("name", F.col("name").alias("component")))
    for _ in range(max_rounds):
        least = both.join(labels.select(F.col("name").alias("b"), "component"), "b").groupBy(F.col("a").alias("name")).agg(F.min("component").alias("near"))
        step = labels.join(least, "name", "left").select("name", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = step.select(F.col("name").alias("component"), F.col("component").alias("root"))
        step = step.join(jump, "component").select("name", "old", F.least("component", "root").alias("component"))
        step = cut_lineage(step)
        labels = step.select("name", "component")
        if step.where(F.col("old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError("components didn't settle")


def component_histogram(labels: DataFrame) -> DataFrame:
    """(bucket, n_components, n_nodes) by size."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    s = F.col("size")
    bucket = F.when(s <= 2, s.cast("string")).when(s <= 5, "3-5").when(s <= 10, "6-10").when(s <= 50, "11-50").when(s <= 100, "51-100").otherwise("100+")
    return sizes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_components"), F.sum("size").alias("n_nodes"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))).distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(name, distance) of everything within `hops` undirected steps of the seeds (column name)."""
    both = undirected(edges)
    reached = seeds.select("name").distinct().withColumn("distance", F.lit(0))
    frontier = reached
    for d in range(1, hops + 1):
        step = both.join(frontier.select(F.col("name").alias("a")), "a", "left_semi").select(F.col("b").alias("name")).distinct()
        frontier = step.join(reached.select("name"), "name", "left_anti").withColumn("distance", F.lit(d))
        reached = reached.unionByName(frontier)
        if d > 2:
            reached = cut_lineage(reached)
            frontier = reached.where(F.col("distance") == d)
    return reached


def neighbours(edges: DataFrame, center: str, depth: int) -> DataFrame:
    """(name, distance, relation): the direct relation, an outgoing one before an incoming one."""
    spark = edges.sparkSession
    near = k_hop(edges, spark.createDataFrame([(center,)], "name string"), depth).where(F.col("distance") > 0)
    out = edges.where(F.col("src") == center).select(F.col("dst").alias("name"), F.col("type").alias("out_type"))
    into = edges.where(F.col("dst") == center).select(F.col("src").alias("name"), F.col("type").alias("in_type"))
    return near.join(out, "name", "left").join(into, "name", "left").select("name", "distance", F.coalesce("out_type", "in_type").alias("relation"))


def induced_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges of which both ends are among the names."""
    kept = names.select("name")
    return edges.join(kept.withColumnRenamed("name", "src"), "src", "left_semi").join(kept.withColumnRenamed("name", "dst"), "dst", "left_semi")


def simple_paths(edges: DataFrame, source: str, target: str, max_edges: int = 4) -> DataFrame:
    """(path ARRAY<STRING>, length): undirected paths without repeated nodes."""
    both = undirected(edges)
    paths = edges.sparkSession.createDataFrame([(source, [source])], "a string, path array<string>")
    found = None
    for n in range(1, max_edges + 1):
        paths = paths.join(both, "a").where(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("a"), F.concat("path", F.array("b")).alias("path"))
        hit = paths.where(F.col("a") == target).select("path", F.lit(n).alias("length"))
        found = hit if found is None else found.unionByName(hit)
        paths = paths.where(F.col("a") != target)
    return found


def cyclic_links(links: DataFrame) -> DataFrame:
    """(type, src, dst) links without most of those that lie on no cycle of their type:
    a link from a node that none points at, or to one that points at none, is taken
    out, until a round takes out less than a tenth of them."""
    n = links.count()
    while n:
        begins, ends = links.select("type", F.col("dst").alias("src")).distinct(), links.select("type", F.col("src").alias("dst")).distinct()
        links = cut_lineage(links.join(begins, ["type", "src"], "left_semi").join(ends, ["type", "dst"], "left_semi"))
        before, n = n, links.count()
        if n > 0.9 * before:
            break
    return links


def cyclic_writes(log: DataFrame, relations: list[str]) -> DataFrame:
    """The writes of the log (src, dst, type, seq and others) between all pairs of nodes
    whose edge may lie on a cycle of one of the relations.

    A cycle of stored edges is one of writes as well, so the writes with these relations
    show which pairs may. They are marked by a bit of their hash, and the marks go to
    where the log is read, so that it isn't shuffled. A pair's writes stay or go together;
    pairs that share another one's mark stay.
    """
    links = log.where(F.col("type").isin(relations) & (F.col("src") != "") & (F.col("dst") != ""))
    links = cut_lineage(links.select("type", "src", "dst").distinct())
    pairs = cyclic_links(links.where(F.col("src") != F.col("dst"))).unionByName(links.where(F.col("src") == F.col("dst")))
    mark = F.xxhash64("src", "dst")
    word, bit = F.pmod(F.shiftrightunsigned(mark, 6), F.lit(MARK_WORDS)).alias("word"), F.pmod(mark, F.lit(64)).cast("int")
    marks = pairs.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return log.withColumn("word", word).join(F.broadcast(marks), "word").where(F.getbit("bits", bit) == 1).drop("word", "bits")


def _closed(ahead: DataFrame, back: DataFrame) -> DataFrame:
    """(type, path) of every way ahead and way back with the same ends and no other
    node in common. The ways back between two nodes are cut into blocks by a hash, so
    that the cycles through two hubs are spread over tasks."""
    keys = ["type", "top", "at"]
    size = F.ceil(F.count(F.lit(1)) / CYCLE_BLOCK)
    tasks = int(ahead.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ahead = ahead.join(back.groupBy(keys).agg(size.alias("blocks")), keys).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    back = back.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / CYCLE_BLOCK))
    back = back.select(*keys, F.pmod(F.xxhash64("path"), "blocks").alias("block"), F.col("path").alias("rest"))
    both = ahead.repartition(tasks, *keys, "block").join(back.repartition(tasks, *keys, "block"), [*keys, "block"])
    return both.where(~F.arrays_overlap("path", "rest")).select("type", F.concat("path", "rest").alias("path"))


def cycles(edges: DataFrame, relations: list[str], max_length: int = 4) -> DataFrame:
    """(type, cycle, length): elementary cycles of one relation, from their least node on.

    A cycle is put together at its node of the highest degree, of a way ahead and a way
    back of half its length through nodes of lower degree. So a hub's edges don't meet
    each other: m edges have some m * sqrt(m) ways of two edges at most.
    """
    kept = cut_lineage(edges.where(F.col("type").isin(relations)).select("type", "src", "dst").distinct())
    found = kept.where(F.col("src") == F.col("dst")).select("type", F.array("src").alias("cycle"), F.lit(1).alias("length"))
    if max_length < 2:
        return found
    links = cyclic_links(kept.where(F.col("src") != F.col("dst")))
    degree = links.select("type", F.explode(F.array("src", "dst")).alias("name")).groupBy("type", "name").agg(F.count(F.lit(1)).alias("degree"))
    for end, rank in (("src", "a"), ("dst", "b")):  # nodes in the order of degrees, then names
        ranked = degree.select("type", F.col("name").alias(end), F.struct("degree", "name").alias(rank))
        links = links.join(ranked, ["type", end])
    links = cut_lineage(links.select("type", "a", "b"))
    ahead = links.where(F.col("b") < F.col("a")).select("type", F.col("a").alias("top"), F.col("b").alias("at"), F.array("a.name", "b.name").alias("path"))
    back = links.where(F.col("a") < F.col("b")).select("type", F.col("b").alias("top"), F.col("a").alias("at"), F.array().cast("array<string>").alias("path"))
    for n in range(2, max_length + 1):
        if n > 2 and n % 2:
            longer = ahead.join(links.withColumnRenamed("a", "at"), ["type", "at"]).where((F.col("b") < F.col("top")) & ~F.array_contains("path", F.col("b.name")))
            ahead = longer.select("type", "top", F.col("b").alias("at"), F.concat("path", F.array("b.name")).alias("path"))
        elif n > 2:
            longer = back.join(links.withColumnRenamed("b", "at"), ["type", "at"]).where((F.col("a") < F.col("top")) & ~F.array_contains("path", F.col("a.name")))
            back = longer.select("type", "top", F.col("a").alias("at"), F.concat(F.array("at.name"), "path").alias("path"))
        first = F.array_position("path", F.array_min("path")).cast("int")
        turned = F.concat(F.slice("path", first, F.lit(n)), F.slice("path", F.lit(1), first - 1))
        found = found.unionByName(_closed(ahead, back).select("type", turned.alias("cycle"), F.lit(n).alias("length")))
    return found


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """(name, community): weighted label propagation with half of the nodes moving at
    a time, which keeps pairs from swapping labels for ever. The same edges give the
    same communities; every node has one."""
    w = F.coalesce("weight", F.lit(1.0))
    both = edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), w.alias("w")))))
    both = cut_lineage(both.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    labels = nodes.select("name", F.col("name").alias("community"))
    for i in range(rounds):
        votes = both.join(labels.select(F.col("name").alias("b"), "community"), "b").groupBy(F.col("a").alias("name"), "community").agg(F.round(F.sum("w"), 9).alias("w"))
        best = votes.groupBy("name").agg(F.max_by(F.col("community"), F.struct("w", "community")).alias("best"))
        moves = F.pmod(F.xxhash64("name"), F.lit(2)) == i % 2
        labels = labels.join(best, "name", "left").select("name", F.when(moves, F.coalesce("best", "community")).otherwise(F.col("community")).alias("community"))
        labels = cut_lineage(labels)
    return labels


def community_summary(edges: DataFrame, labels: DataFrame, types: DataFrame) -> DataFrame:
    """(community, size, hub, dominant_type, internal_edges); types is (name, entity_type)."""
    deg = degrees(edges).withColumnRenamed("node", "name")
    rows = labels.join(deg, "name", "left").join(types, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min_by("name", F.struct(-F.col("degree"), "name")).alias("hub"))
    kinds = rows.groupBy("community", F.coalesce("entity_type", F.lit("unknown")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("community").agg(F.min_by("t", F.struct(-F.col("n"), "t")).alias("dominant_type"))
    a, b = (labels.select(F.col("name").alias(end), F.col("community").alias(c)) for end, c in (("src", "ca"), ("dst", "cb")))
    inside = edges.join(a, "src").join(b, "dst").where(F.col("ca") == F.col("cb")).groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("internal_edges"))
    return top.join(kinds, "community").join(inside, "community", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))


def community_links(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, n_edges) of unordered pairs of different communities."""
    a, b = (labels.select(F.col("name").alias(end), F.col("community").alias(c)) for end, c in (("src", "ca"), ("dst", "cb")))
    pairs = edges.join(a, "src").join(b, "dst").where(F.col("ca") != F.col("cb"))
    return pairs.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count(F.lit(1)).alias("n_edges"))


def subgraph_context(edges: DataFrame, names: DataFrame, ranks: DataFrame, max_nodes: int = 30, per_node: int = 10) -> DataFrame:
    """(name, rank, connections ARRAY<STRUCT<target, type>>): the nodes of the largest
    rank with their first out-edges inside the set."""
    top = names.select("name").join(ranks, "name", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0))).orderBy(F.desc("rank"), "name").limit(max_nodes)
    inside = induced_edges(edges, names)
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    first = inside.withColumn("place", place).where(F.col("place") <= per_node)
    lists = first.groupBy(F.col("src").alias("name")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("target"), "type"))).alias("connections"))
    return top.join(lists, "name", "left")

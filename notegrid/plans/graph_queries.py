"""Queries of graph building, joins, aggregates, analytics and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegrid import dims
from notegrid.operators import analytics, enrich, graph, lineage, validate
from notegrid.plans.book import Book, with_

book = Book()
CENTERS = ["Decision Ledger", "Open Questions", "Release Calendar"]
_CENTERS = "centers AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in CENTERS) + "]) AS center)"


def _centers(v):
    return v.spark.createDataFrame([(c,) for c in CENTERS], "center string")


@book.query(f"{with_('cur', 'resolver')} SELECT link, key FROM resolver")
def jn1_link_resolver(v):
    return graph.link_resolver(v.current())


_LINKS = """links AS (SELECT c.key AS src, coalesce(r.key, c.link) AS dst FROM (SELECT key, unnest(wiki_links) AS link FROM cur) c LEFT JOIN resolver r ON r.link = c.link WHERE c.link <> '')"""


@book.query(f"{with_('cur', 'resolver', more=_LINKS)} SELECT DISTINCT src, dst, 'wiki_link' AS type, 1.0::DOUBLE AS weight FROM links")
def gb2_link_edges(v):
    return graph.last_writer_edges(graph.edge_log(v.current()))


@book.query(f"{with_('kg')} SELECT src, dst, type, weight FROM kg")
def gb3_last_writer_edges(v):
    return v.edges()


@book.query(f"{with_('kg', 'live', 'gn')} SELECT name, entity_type, is_dangling FROM gn")
def gb1_nodes(v):
    return v.nodes().select("name", "entity_type", "is_dangling")


_TAG_PAIRS = """t AS (SELECT DISTINCT key, unnest(tags) AS tag FROM cur),
    band AS (SELECT tag FROM t GROUP BY tag HAVING count(*) >= 2 AND count(*) < 100),
    k AS (SELECT * FROM t WHERE tag IN (SELECT tag FROM band)),
    p AS (SELECT a.key AS src, b.key AS dst, count(*) AS shared_tags FROM k a JOIN k b ON a.tag = b.tag AND a.key < b.key GROUP BY 1, 2 HAVING count(*) >= 2)"""


@book.query(f"""{with_('cur', 'resolver', more=_LINKS + ', ' + _TAG_PAIRS)} SELECT src, dst, 'tag_shared' AS type, least(shared_tags * 0.15::DOUBLE, 0.8::DOUBLE) AS weight, shared_tags
    FROM p ANTI JOIN links USING (src, dst)""")
def gb5_tag_edges(v):
    notes = v.current()
    return graph.tag_edges(notes, graph.last_writer_edges(graph.edge_log(notes)))


@book.query()
def gb_vault_edges(v):
    return graph.build_edges(v.current())


@book.query(f"""{with_('kg')} SELECT name, relation, weight, direction FROM (
    SELECT dst AS name, type AS relation, weight, 'out' AS direction FROM kg WHERE src = 'Tool Shelf'
    UNION SELECT src, type, weight, 'in' FROM kg WHERE dst = 'Tool Shelf') ORDER BY weight DESC NULLS LAST, name, direction LIMIT 100""")
def jn6_stored_neighbours(v):
    e = v.edges()
    out = e.where(F.col("src") == "Tool Shelf").select(F.col("dst").alias("name"), F.col("type").alias("relation"), "weight", F.lit("out").alias("direction"))
    into = e.where(F.col("dst") == "Tool Shelf").select(F.col("src").alias("name"), F.col("type").alias("relation"), "weight", F.lit("in").alias("direction"))
    return out.union(into).distinct().orderBy(F.desc_nulls_last("weight"), "name", "direction").limit(100)


@book.query(f"""{with_('cur')}, n AS (SELECT DISTINCT name FROM cur WHERE length(name) >= 5),
    h AS (SELECT c.key, n.name FROM cur c JOIN n ON contains(c.body, n.name) AND n.name <> c.name AND NOT list_contains(coalesce(c.wiki_links, []), n.name))
    SELECT key, name FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(name) DESC, name) <= 10""")
def jn10_missing_backlinks(v):
    return enrich.missing_backlinks(v.current())


@book.query(f"""{with_('cur')}, r AS (SELECT key, name, ord, list_distinct(coalesce(tags, [])) AS tags, nullif(regexp_extract(name, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS day,
      coalesce(CASE WHEN contains(path, 'Harbor') OR contains(name, 'Harbor') THEN 'Harbor' END, CASE WHEN contains(path, 'Loom') OR contains(name, 'Loom') THEN 'Loom' END,
      list_filter(list_transform(coalesce(cur.tags, []), lambda t: CASE WHEN contains(lower(t), 'harbor') THEN 'Harbor' WHEN contains(lower(t), 'loom') THEN 'Loom' END), lambda x: x IS NOT NULL)[1]) AS project FROM cur),
    t AS (SELECT key, unnest(tags) AS tag FROM r),
    c AS (SELECT a.key AS a, b.key AS b, count(*) AS p FROM t a JOIN t b ON a.tag = b.tag AND a.key <> b.key GROUP BY 1, 2 HAVING count(*) >= 2),
    s AS (SELECT a, b, sum(p) AS p FROM (SELECT * FROM c UNION ALL SELECT a.key, b.key, 2 FROM r a JOIN r b ON a.day = b.day AND a.key <> b.key) GROUP BY 1, 2),
    f AS (SELECT s.a, y.name AS related, y.ord, y.key, CAST(p + CASE WHEN x.project = y.project THEN 1 ELSE 0 END AS BIGINT) AS score FROM s JOIN r x ON x.key = s.a JOIN r y ON y.key = s.b WHERE x.name <> y.name)
    SELECT a AS key, related, score, CAST(row_number() OVER (PARTITION BY a ORDER BY ord, key) AS INT) AS place FROM f WHERE score >= 3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY ord, key) <= 5""")
def jn9_related_notes(v):
    rows = enrich.related_notes(v.current(), {"Harbor": "Harbor", "Loom": "Loom"})
    return rows.select("key", "related", F.col("score").cast("long").alias("score"), "place")


@book.query("""WITH log AS (SELECT source_name AS src, target_name AS dst, relation AS type FROM knowledge_edges)
    SELECT src, dst FROM log WHERE type = 'supports' AND src IS NOT NULL INTERSECT SELECT src, dst FROM log WHERE type = 'contradicts'""")
def va8_contradictions(v):
    return validate.contradictions(v.knowledge_edges.select(F.col("source_name").alias("src"), F.col("target_name").alias("dst"), F.col("relation").alias("type")))


@book.query(f"""{with_('kg')}, inv AS (SELECT unnest(['uses', 'used_in', 'supports', 'derived_from']) AS r, unnest(['used_in', 'uses', 'supported_by', 'derives']) AS i),
    need AS (SELECT DISTINCT dst AS node, i AS field, src AS actual FROM kg JOIN inv ON r = type)
    SELECT * FROM need ANTI JOIN (SELECT src AS node, type AS field, dst AS actual FROM kg) USING (node, field, actual)""")
def va9_missing_inverses(v):
    return validate.missing_inverses(v.edges())


@book.query(f"""{with_('kg', 'live', 'gn')}, i AS (SELECT DISTINCT dst AS name, src FROM kg WHERE dst IN (SELECT name FROM gn WHERE is_dangling))
    SELECT name, list_sort(list(src) FILTER (place <= 5)) AS referrers, count(*) AS n_referrers FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY src) AS place FROM i) GROUP BY name""")
def va7_dangling(v):
    e = v.edges()
    return validate.dangling_violations(e, graph.graph_nodes(v.live(), e))


@book.query(f"{with_('kg')} SELECT type, count(*) AS n FROM kg GROUP BY type")
def ag1_edge_types(v):
    return v.edges().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@book.query(f"{with_('kg', 'live', 'gn')} SELECT coalesce(entity_type, 'unknown') AS entity_type, count(*) AS n FROM gn GROUP BY 1")
def ag1_node_types(v):
    return v.nodes().groupBy(F.coalesce("entity_type", F.lit("unknown")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


@book.query(f"""{with_('kg', 'live', 'gn')} SELECT count(*) AS nodes, (SELECT count(*) FROM kg) AS edges, count(*) FILTER (is_dangling) AS dangling,
    (SELECT count(*) FROM kg) / (count(*)::DOUBLE * (count(*) - 1)) AS density FROM gn""")
def ag1_summary(v):
    return analytics.graph_summary(v.nodes(), v.edges())


@book.query("""SELECT entity_type, count(*) AS n FROM knowledge_nodes GROUP BY 1 ORDER BY n DESC, entity_type NULLS FIRST LIMIT 10""")
def ag3_stored_types(v):
    return v.knowledge_nodes.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("entity_type")).limit(10)


@book.query(f"""{with_('cur')} SELECT count(*) AS notes, count(*) FILTER (len(json_keys(frontmatter)) > 0) AS with_frontmatter, count(*) FILTER (len(tags) > 0) AS with_tags,
    coalesce(sum(len(wiki_links)), 0)::BIGINT AS links, max(len(wiki_links)) AS most_links, count(DISTINCT string_split(key, '/')[1]) AS folders, sum(length(body))::BIGINT AS chars FROM cur""")
def ag13_vault_profile(v):
    n = F.size(F.coalesce("wiki_links", F.array().cast("array<string>")))
    return v.current().agg(
        F.count(F.lit(1)).alias("notes"), F.count_if(F.size(F.json_object_keys("frontmatter")) > 0).alias("with_frontmatter"), F.count_if(F.size("tags") > 0).alias("with_tags"),
        F.coalesce(F.sum(n), F.lit(0)).alias("links"), F.max(F.when(F.col("wiki_links").isNotNull(), n)).alias("most_links"),
        F.countDistinct(F.split("key", "/")[0]).alias("folders"), F.sum(F.length("body")).alias("chars"),
    )


@book.query(f"""{with_('cur')} SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(frontmatter)) AS field FROM cur) GROUP BY field""")
def ag13_frontmatter_fields(v):
    return v.current().select(F.explode(F.json_object_keys("frontmatter")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@book.query(f"""{with_('kg', 'live', 'gn')} SELECT dst AS name, count(*) AS n_refs FROM kg WHERE dst IN (SELECT name FROM gn WHERE is_dangling) GROUP BY 1 ORDER BY n_refs DESC, name LIMIT 20""")
def ag15_dangling_rank(v):
    e = v.edges()
    missing = graph.graph_nodes(v.live(), e).where("is_dangling").select(F.col("name").alias("dst"))
    refs = e.join(missing, "dst", "left_semi").groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("n_refs"))
    return refs.orderBy(F.desc("n_refs"), "name").limit(20)


@book.query(f"""{with_('kg')} SELECT node, count(*) AS degree, count(*) FILTER (o = 0) AS in_degree, count(*) FILTER (o = 1) AS out_degree
    FROM (SELECT src AS node, 1 AS o FROM kg UNION ALL SELECT dst, 0 FROM kg) GROUP BY node""")
def ga1_degrees(v):
    return analytics.degrees(v.edges())


@book.query(f"""{with_('kg')} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM kg UNION ALL SELECT dst FROM kg) GROUP BY node ORDER BY degree DESC, node LIMIT 10""")
def ga1_top_hubs(v):
    return analytics.degrees(v.edges()).select("node", "degree").orderBy(F.desc("degree"), "node").limit(10)


def pagerank_ctes(k: int) -> str:
    """CTEs of k steps of PageRank over kg and gn; the last one is r{k}."""
    steps = ["r0 AS MATERIALIZED (SELECT name, 1.0::DOUBLE / (SELECT count(*) FROM gn) AS rank FROM gn)"]
    for i in range(1, k + 1):
        p = f"r{i - 1}"
        steps.append(f"""r{i} AS MATERIALIZED (SELECT g.name, 0.15::DOUBLE / (SELECT count(*) FROM gn) + 0.85::DOUBLE * (coalesce(c.got, 0)
          + (SELECT coalesce(sum(rank), 0) FROM {p} WHERE name NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM gn)) AS rank
          FROM gn g LEFT JOIN (SELECT s.dst AS name, sum({p}.rank * s.share) AS got FROM s JOIN {p} ON {p}.name = s.src GROUP BY 1) c ON c.name = g.name)""")
    o = "o AS MATERIALIZED (SELECT src, sum(coalesce(weight, 1)) AS total FROM kg GROUP BY 1 HAVING sum(coalesce(weight, 1)) > 0), s AS MATERIALIZED (SELECT kg.src, dst, coalesce(weight, 1) / total AS share FROM kg JOIN o ON o.src = kg.src)"
    return ", ".join([o, *steps])


@book.query(f"{with_('kg', 'live', 'gn', more=pagerank_ctes(5))} SELECT name, round(rank, 9) AS rank FROM r5")
def ga2_pagerank(v):
    e = v.edges()
    ranks = analytics.pagerank(e, graph.graph_nodes(v.live(), e).select("name"), iterations=5, tolerance=None)
    return ranks.select("name", F.round("rank", 9).alias("rank"))


def _components_sql(rounds: int = 14) -> str:
    """The least name within `rounds` edges of each node."""
    steps = ["c0 AS MATERIALIZED (SELECT name, name AS c FROM gn)"]
    for i in range(1, rounds + 1):
        steps.append(f"c{i} AS MATERIALIZED (SELECT x.name, least(min(x.c), coalesce(min(y.c), min(x.c))) AS c FROM c{i - 1} x LEFT JOIN u ON u.a = x.name LEFT JOIN c{i - 1} y ON y.name = u.b GROUP BY x.name)")
    return "u AS MATERIALIZED (SELECT a, b FROM und), " + ", ".join(steps)


def _components(v):
    e = v.edges()
    return analytics.components(e, graph.graph_nodes(v.live(), e).select("name"))


@book.query(f"{with_('kg', 'live', 'gn', 'und', more=_components_sql())} SELECT name, c AS component FROM c14")
def ga3_components(v):
    return _components(v)


@book.query(f"""{with_('kg', 'live', 'gn', 'und', more=_components_sql())}, z AS (SELECT c, count(*) AS size FROM c14 GROUP BY c)
    SELECT CASE WHEN size <= 2 THEN size::VARCHAR WHEN size <= 5 THEN '3-5' WHEN size <= 10 THEN '6-10' WHEN size <= 50 THEN '11-50' WHEN size <= 100 THEN '51-100' ELSE '100+' END AS bucket,
    count(*) AS n_components, sum(size)::BIGINT AS n_nodes FROM z GROUP BY 1""")
def ag12_component_sizes(v):
    return analytics.component_histogram(_components(v))


_HOPS = f"""d0 AS (SELECT center AS name FROM centers), d1 AS (SELECT DISTINCT b AS name FROM und JOIN d0 ON a = name EXCEPT SELECT name FROM d0),
    d2 AS (SELECT DISTINCT b AS name FROM und JOIN d1 ON a = name EXCEPT SELECT name FROM d1 EXCEPT SELECT name FROM d0)"""


@book.query(f"{with_('kg', 'und', more=_CENTERS + ', ' + _HOPS)} SELECT name, 0 AS distance FROM d0 UNION ALL SELECT name, 1 FROM d1 UNION ALL SELECT name, 2 FROM d2")
def ga5_two_hops(v):
    return analytics.k_hop(v.edges(), _centers(v).withColumnRenamed("center", "name"), 2)


@book.query(f"""{with_('kg', 'und', more=(_CENTERS.replace(', '.join(f"'{c}'" for c in CENTERS), "'Open Questions'") + ', ' + _HOPS))} SELECT n.name, distance, coalesce(o.type, i.type) AS relation
    FROM (SELECT name, 1 AS distance FROM d1 UNION ALL SELECT name, 2 FROM d2) n
    LEFT JOIN kg o ON o.src = 'Open Questions' AND o.dst = n.name LEFT JOIN kg i ON i.dst = 'Open Questions' AND i.src = n.name""")
def ga8_neighbours(v):
    return analytics.neighbours(v.edges(), "Open Questions", 2)


@book.query(f"""{with_('kg', 'und', more=_CENTERS + ', ' + _HOPS)}, near AS (SELECT name FROM d0 UNION SELECT name FROM d1)
    SELECT src, dst, type, weight FROM kg WHERE src IN (SELECT name FROM near) AND dst IN (SELECT name FROM near)""")
def ga10_subgraph(v):
    e = v.edges()
    near = analytics.k_hop(e, _centers(v).withColumnRenamed("center", "name"), 1)
    return analytics.induced_edges(e, near).select("src", "dst", "type", "weight")


@book.query(f"""{with_('kg')}, u AS (SELECT src AS a, dst AS b FROM kg WHERE type IN ('contradicts', 'alternatives', 'decisions', 'supports') UNION SELECT dst, src FROM kg WHERE type IN ('contradicts', 'alternatives', 'decisions', 'supports')),
    p AS (WITH RECURSIVE p(pos, path, n) AS (SELECT 'Tool Shelf', ['Tool Shelf'], 0 UNION ALL
      SELECT b, list_append(path, b), n + 1 FROM p JOIN u ON a = pos WHERE n < 3 AND pos <> 'Open Questions' AND NOT list_contains(path, b)) SELECT * FROM p)
    SELECT path, n AS length FROM p WHERE pos = 'Open Questions' AND n > 0""")
def ga7_simple_paths(v):
    e = v.edges().where(F.col("type").isin("contradicts", "alternatives", "decisions", "supports"))
    return analytics.simple_paths(e, "Tool Shelf", "Open Questions", 3)


def _cycle_sql() -> str:
    deps = ", ".join(f"'{t}'" for t in dims.DEPENDENCY_RELATIONS)
    return f"""{with_('kg')}, k AS (SELECT DISTINCT type, src, dst FROM kg WHERE type IN ({deps})),
      w AS (WITH RECURSIVE w(type, pos, path, n, done) AS (SELECT type, dst, [src, dst], 1, false FROM k WHERE src < dst UNION ALL
        SELECT w.type, k.dst, CASE WHEN k.dst = path[1] THEN path ELSE list_append(path, k.dst) END, n + 1, k.dst = path[1] FROM w JOIN k ON k.type = w.type AND k.src = pos
        WHERE NOT done AND n < 3 AND (k.dst = path[1] OR (k.dst > path[1] AND NOT list_contains(path, k.dst)))) SELECT * FROM w)
      SELECT type, path AS cycle, n AS length FROM w WHERE done UNION ALL SELECT type, [src], 1 FROM k WHERE src = dst"""


@book.query(_cycle_sql())
def ga15_cycles(v):
    log = analytics.cyclic_writes(graph.stored_log(v.knowledge_edges), dims.DEPENDENCY_RELATIONS)
    return analytics.cycles(graph.last_writer_edges(log), dims.DEPENDENCY_RELATIONS, 3)


# The whole jobs of queries above that cover less, as their SQL does.


@book.query()
def ga2_settled_pagerank(v):
    e = v.edges()
    return analytics.pagerank(e, graph.graph_nodes(v.live(), e).select("name"))


@book.query()
def ga7_all_simple_paths(v):
    return analytics.simple_paths(v.edges(), "Tool Shelf", "Open Questions")


@book.query()
def ga15_longer_cycles(v):
    return analytics.cycles(v.edges(), dims.DEPENDENCY_RELATIONS)


@book.query()
def ga11_communities(v):
    e = v.edges()
    return analytics.communities(e, graph.graph_nodes(v.live(), e).select("name"))


@book.query(f"""{with_('kg', 'live')}, l AS (SELECT name, source AS community FROM live), e AS (SELECT a.community AS ca, b.community AS cb FROM kg JOIN l a ON a.name = src JOIN l b ON b.name = dst WHERE a.community <> b.community)
    SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, count(*) AS n_edges FROM e GROUP BY 1, 2""")
def ag10_group_links(v):
    return analytics.community_links(v.edges(), v.live().select("name", F.col("source").alias("community")))


@book.query(f"""{with_('kg', 'live')}, d AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM kg UNION ALL SELECT dst FROM kg) GROUP BY 1),
    r AS (SELECT l.name, l.source AS community, coalesce(degree, 0) AS degree, coalesce(entity_type, 'unknown') AS t FROM live l LEFT JOIN d ON d.name = l.name),
    k AS (SELECT community, t FROM (SELECT community, t, count(*) AS n FROM r GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, t) = 1),
    i AS (SELECT a.source AS community, count(*) AS n FROM kg JOIN live a ON a.name = src JOIN live b ON b.name = dst WHERE a.source = b.source GROUP BY 1)
    SELECT h.community, h.size, h.hub, k.t AS dominant_type, coalesce(i.n, 0) AS internal_edges FROM (SELECT community, count(*) OVER (PARTITION BY community) AS size, name AS hub
      FROM r QUALIFY row_number() OVER (PARTITION BY community ORDER BY degree DESC, name) = 1) h JOIN k ON k.community = h.community LEFT JOIN i ON i.community = h.community""")
def ag9_group_summary(v):
    live = v.live()
    return analytics.community_summary(v.edges(), live.select("name", F.col("source").alias("community")), live.select("name", "entity_type"))


@book.query()
def jn21_tag_bridges(v):
    notes = v.current()
    edges = graph.last_writer_edges(graph.edge_log(notes)).where(F.col("src") != F.col("dst"))
    tags = notes.select(F.col("key").alias("name"), F.explode("tags").alias("tag"))
    labels = analytics.components(edges, notes.select(F.col("key").alias("name")).union(edges.select("dst")).distinct())
    return enrich.bridge_components(labels, tags)


@book.query()
def sk13_stub_notes(v):
    e = v.edges()
    return enrich.stub_notes(e, graph.graph_nodes(v.live(), e), "2026-01-01", least=2)


_MODES = " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in dims.LINEAGE_MODES.items())
_CANON = f"""can AS MATERIALIZED (SELECT CASE WHEN mode = 'target_upstream' THEN dst ELSE src END AS source, CASE WHEN mode = 'target_upstream' THEN src ELSE dst END AS target, type, mode, coalesce(weight, 1) AS weight
    FROM (SELECT *, CASE type {_MODES} END AS mode FROM kg) WHERE mode IS NOT NULL)"""


def _walk_sql(tag: str, a: str, b: str) -> str:
    return f"""{tag}m AS MATERIALIZED (SELECT {a} AS a, {b} AS b FROM can UNION SELECT {b}, {a} FROM can WHERE mode = 'bidirectional'),
      {tag}1 AS MATERIALIZED (SELECT DISTINCT center, b AS name FROM centers JOIN {tag}m ON a = center WHERE b <> center),
      {tag}2 AS MATERIALIZED (SELECT DISTINCT center, b AS name FROM {tag}1 JOIN {tag}m ON a = name WHERE b <> center EXCEPT SELECT center, name FROM {tag}1)"""


_LINEAGE = ", ".join([_CENTERS, _CANON, _walk_sql("u", "target", "source"), _walk_sql("d", "source", "target")]) + """,
    w AS (SELECT *, 1 AS depth, 'upstream' AS role FROM u1 UNION ALL SELECT *, 2, 'upstream' FROM u2 UNION ALL SELECT *, 1, 'downstream' FROM d1 UNION ALL SELECT *, 2, 'downstream' FROM d2),
    lin AS (SELECT center, center AS name, 0 AS depth, 'center' AS lineage_role FROM centers UNION ALL
      SELECT center, name, min(depth), CASE WHEN min(role) <> max(role) THEN 'bridge' ELSE min(role) END FROM w GROUP BY 1, 2)"""


@book.query(f"{with_('kg', more=_CANON)} SELECT source, target, type, mode, weight FROM can")
def ln3_canonical_edges(v):
    return lineage.canonical_edges(v.edges())


@book.query(f"{with_('kg', more=_LINEAGE)} SELECT center, name, depth, lineage_role FROM lin")
def ln6_lineage(v):
    return lineage.lineage_nodes(v.edges(), _centers(v), depth=2)


@book.query(f"{with_('kg', more=_LINEAGE)} SELECT DISTINCT a.center, source, target, type, weight FROM can JOIN lin a ON a.name = source JOIN lin b ON b.name = target AND b.center = a.center")
def ln6_lineage_edges(v):
    e = v.edges()
    return lineage.lineage_edges(e, lineage.lineage_nodes(e, _centers(v), depth=2))


@book.query(f"""{with_('kg', more=_LINEAGE)} SELECT center, count(*) AS nodes, count(*) FILTER (lineage_role = 'upstream') AS upstream, count(*) FILTER (lineage_role = 'downstream') AS downstream,
    count(*) FILTER (lineage_role = 'bridge') AS bridges, max(depth) AS max_depth FROM lin GROUP BY center""")
def ag8_lineage_stats(v):
    return lineage.lineage_stats(lineage.lineage_nodes(v.edges(), _centers(v), depth=2))


@book.query(f"{with_('kg', 'live', more=_LINEAGE)} SELECT center, name, depth, lineage_role FROM lin WHERE depth = 0 OR name IN (SELECT name FROM live WHERE entity_type IN ('tool', 'source'))")
def fl15_lineage_types(v):
    types = v.live().select("name", "entity_type")
    return lineage.lineage_nodes(v.edges(), _centers(v), depth=2, types=types, keep_types=["tool", "source"])


@book.query()
def ln7_weighted_lineage(v):
    return lineage.weighted_lineage(v.edges(), _centers(v), depth=2)


@book.query()
def ln9_hub_lineage(v):
    e = v.edges()
    hubs = analytics.degrees(e).orderBy(F.desc("degree"), "node").limit(20).select(F.col("node").alias("center"))
    return lineage.lineage_stats(lineage.lineage_nodes(e, hubs, depth=2))


@book.query()
def ln1_candidates(v):
    nodes = v.live().select(F.col("name").alias("key"), "name", F.col("source_path").alias("path"), "entity_type")
    return lineage.match_candidates(nodes, "ledger sync").select("key", "match_kind", "score")


QUERIES, ORACLE = book.queries, book.oracle

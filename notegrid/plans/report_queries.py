"""Queries of reports: coverage, plans, mentions, layouts and views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notegrid import dims
from notegrid.functions import text as tx
from notegrid.operators import analytics, enrich, graph, retrieve
from notegrid.plans.book import Book, with_
from notegrid.plans.graph_queries import pagerank_ctes
from notegrid.plans.service_queries import QUESTION, RANK_STEPS, _hybrid, stepped_ranks, weighted_ranks
from notegrid.plans.text_queries import PROJECTS, TOPICS

book = Book()


@book.query(f"""{with_('live')} SELECT count(*) AS nodes, count(*) FILTER (name IN (SELECT node_name FROM knowledge_embeddings WHERE len(embedding) > 0)) AS embedded FROM live""")
def ag2_embedding_coverage(v):
    have = v.knowledge_embeddings.where(F.size("embedding") > 0).select(F.col("node_name").alias("name"), F.lit(True).alias("has")).distinct()
    return v.live().select("name").join(have, "name", "left").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("has").alias("embedded"))


@book.query()
def ag14_plan_changes(v):
    plan = enrich.enrichment_plan(v.current(), PROJECTS).select(F.explode("changes").alias("change"))
    return plan.groupBy(F.substring_index("change", ":", 1).alias("field"), F.substring_index("change", ": ", -1).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@book.query("""SELECT target_name AS name, count(DISTINCT source_name) AS n_notes FROM knowledge_edges WHERE relation = 'participants' AND target_name <> ''
    GROUP BY 1 HAVING count(DISTINCT source_name) >= 2""")
def ag16_mention_counts(v):
    """People by the number of notes that name them, from two notes on."""
    pairs = v.knowledge_edges.where((F.col("relation") == "participants") & (F.col("target_name") != "")).select("source_name", "target_name").distinct()
    return pairs.groupBy(F.col("target_name").alias("name")).agg(F.count("source_name").alias("n_notes")).where(F.col("n_notes") >= 2)


@book.query(r"""SELECT lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS suffix, count(*) AS n, sum(length(content))::BIGINT AS chars FROM notes GROUP BY 1""")
def ag25_files_by_suffix(v):
    return v.notes.groupBy(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@book.query()
def en2_content_analysis(v):
    """Proposed topics and backlinks of notes for which there are any."""
    notes = v.current()
    topics = notes.select("key", enrich.topic_tags(F.col("body"), F.col("name"), F.col("tags"), TOPICS).alias("topics"))
    links = enrich.missing_backlinks(notes).groupBy("key").agg(F.sort_array(F.collect_list("name")).alias("backlinks"))
    return topics.join(links, "key", "left").where((F.size("topics") > 0) | F.col("backlinks").isNotNull())


_MEMORY = " + ".join(f"CASE WHEN contains(lower(name), '{w}') THEN 3.0 ELSE 0.0 END + least((length(lower(coalesce(content, ''))) - length(replace(lower(coalesce(content, '')), '{w}', ''))) / {len(w)} * 0.5::DOUBLE, 5.0)" for w in tx.keywords(QUESTION))


@book.query(f"""{with_('live')}, s AS (SELECT name, CAST({_MEMORY} AS DOUBLE) AS score FROM live WHERE source = 'memory') SELECT name, score FROM s WHERE score > 0 ORDER BY score DESC, name LIMIT 5""")
def rk7_memory_search(v):
    return _memory(v)


def _memory(v):
    name, body = F.lower("name"), F.lower(F.coalesce("content", F.lit("")))
    parts = [F.when(F.contains(name, F.lit(w)), 3.0).otherwise(0.0) + F.least(tx.occurrences(body, w) * 0.5, F.lit(5.0)) for w in tx.keywords(QUESTION)]
    scored = v.live().where(F.col("source") == "memory").select("name", sum(parts, F.lit(0.0)).alias("score"))
    return scored.where(F.col("score") > 0).orderBy(F.desc("score"), "name").limit(5)


@book.query()
def rk8_integrated_search(v):
    """Hits of the memory first, then those of the vault that aren't among them."""
    memory = _memory(v).select("name", "score", F.lit("memory").alias("origin"))
    vault = _hybrid(v, weighted_ranks(v)).select(F.col("key").alias("name"), "score", F.lit("vault").alias("origin"))
    seen = memory.select(F.lower("name").alias("low"))
    return memory.unionByName(vault.withColumn("low", F.lower("name")).join(seen, "low", "left_anti").drop("low"))


@book.query(f"""{with_('kg', 'live', 'gn', more=pagerank_ctes(RANK_STEPS))}, top AS (SELECT name FROM r{RANK_STEPS} ORDER BY round(rank, 12) DESC, name LIMIT 200)
    SELECT src, dst, type, weight FROM kg WHERE src IN (SELECT name FROM top) AND dst IN (SELECT name FROM top)""")
def so13_densest_view(v):
    """Edges among the nodes of the highest rank, after a fixed number of steps; so13_pagerank_view goes on until ranks settle."""
    top = stepped_ranks(v).orderBy(F.desc(F.round("rank", 12)), "name").limit(200)
    return analytics.induced_edges(v.edges(), top).select("src", "dst", "type", "weight")


@book.query()
def so13_pagerank_view(v):
    """so13_densest_view with ranks of up to 100 steps, until they settle."""
    top = weighted_ranks(v).orderBy(F.desc("rank"), "name").limit(200)
    return analytics.induced_edges(v.edges(), top).select("src", "dst", "type", "weight")


@book.query(f"""{with_('kg')}, d AS (SELECT name, count(*) FILTER (o = 1) AS x, count(*) FILTER (o = 0) AS y FROM (SELECT src AS name, 1 AS o FROM kg UNION ALL SELECT dst, 0 FROM kg) GROUP BY 1),
    m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM d)
    SELECT name, 1000.0::DOUBLE * (x - x0) / CASE WHEN x1 = x0 THEN 1 ELSE x1 - x0 END AS px, 1000.0::DOUBLE * (y - y0) / CASE WHEN y1 = y0 THEN 1 ELSE y1 - y0 END AS py FROM d, m""")
def px24_scaled_layout(v):
    """Two measures of a node scaled to 0..1000; a range of zero counts as one."""
    d = analytics.degrees(v.edges()).select(F.col("node").alias("name"), F.col("out_degree").alias("x"), F.col("in_degree").alias("y"))
    bounds = d.agg(F.struct(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]).alias("b")).select("b").scalar()
    d = d.withColumn("b", bounds)  # one pass for all four
    scale = lambda c: 1000.0 * (F.col(c) - F.col(f"b.{c}0")) / F.when(F.col(f"b.{c}1") == F.col(f"b.{c}0"), 1).otherwise(F.col(f"b.{c}1") - F.col(f"b.{c}0"))
    return d.select("name", scale("x").alias("px"), scale("y").alias("py"))


@book.query(f"""{with_('cur')}, t AS (SELECT string_split(key, '/')[1] AS folder, tag, count(*) AS n FROM (SELECT DISTINCT key, unnest(tags) AS tag FROM cur) WHERE tag <> '' GROUP BY 1, 2)
    SELECT folder, tag, n FROM t QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, tag) <= 5""")
def wn1_top_tags(v):
    tags = v.current().select("key", F.explode("tags").alias("tag")).where(F.col("tag") != "").distinct()
    n = tags.groupBy(F.split("key", "/")[0].alias("folder"), "tag").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("n"), "tag"))
    return n.withColumn("place", place).where(F.col("place") <= 5).drop("place")


@book.query(f"""{with_('kg')} SELECT DISTINCT src, dst, type FROM kg WHERE type NOT IN ({', '.join(f"'{t}'" for t in dims.LINEAGE_MODES)})""")
def ln3_other_relations(v):
    return v.edges().where(~F.col("type").isin(list(dims.LINEAGE_MODES))).select("src", "dst", "type").distinct()


@book.query(f"""{with_('cur')} SELECT key, name, depth FROM (SELECT key, name, length(key) - length(replace(key, '/', '')) AS depth, count(*) OVER (PARTITION BY name) AS n FROM cur) WHERE n > 1""")
def jn1_namesakes(v):
    notes = v.current()
    several = notes.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("name")
    depth = F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))
    return notes.join(several, "name", "left_semi").select("key", "name", depth.cast("long").alias("depth"))


@book.query()
def rk4_search_modes(v):
    """The same question in each mode; a mode is a triple of weights."""
    notes = graph.latest(v.current().withColumn("back", -F.col("ord")), ["name"], "back")
    docs = notes.select(F.col("name").alias("key"), "name", "body", "tags")
    ranks = weighted_ranks(v)
    q = v.knowledge_embeddings.where(F.col("id") == 1).select("embedding").first()[0]
    vectors = graph.latest(v.knowledge_embeddings.where(F.size("embedding") == len(q)), ["node_name"], "id").select(F.col("node_name").alias("key"), F.col("embedding").alias("vector"))
    modes = [retrieve.hybrid_search(docs, vectors, ranks, QUESTION, q, mode, 10).withColumn("mode", F.lit(mode)) for mode in ("hybrid", "vector", "graph")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


QUERIES, ORACLE = book.queries, book.oracle

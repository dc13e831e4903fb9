"""Queries of retrieval, validation, state, trust and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegrid import dims
from notegrid.functions import text as tx
from notegrid.operators import analytics, graph, retrieve, score, state, validate
from notegrid.plans.book import Book, with_
from notegrid.plans.graph_queries import pagerank_ctes
from notegrid.streaming import incremental

book = Book()
QUESTION = "ledger sync forge"
DOMAINS = {"example.invalid": 0.6, "github.com": 0.85, "arxiv.org": 0.95}


def _docs(v):
    return v.current().select("key", "name", "body", "tags")


def _keyword_sql(c: str = "cur") -> str:
    parts = []
    for w in tx.keywords(QUESTION):
        parts.append(f"CASE WHEN contains(lower(name), '{w}') THEN 3.0 WHEN contains(lower(key), '{w}') THEN 1.0 ELSE 0.0 END + CASE WHEN lower(name) = '{w}' THEN 5.0 ELSE 0.0 END")
        parts.append(f"least((length(lower(body)) - length(replace(lower(body), '{w}', ''))) / {len(w)} * 0.5::DOUBLE, 3.0)")
        parts.append(f"len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), '{w}'))) * 2.0")
    return f"kw AS (SELECT key, CAST({' + '.join(parts)} AS DOUBLE) AS score FROM {c})"


@book.query(f"{with_('cur', more=_keyword_sql())} SELECT key, score FROM kw WHERE score > 0 ORDER BY score DESC, key LIMIT 50")
def rk1_keyword_search(v):
    return retrieve.keyword_search(_docs(v), QUESTION, 50)


def _vectors(v):
    return v.knowledge_embeddings.where(F.col("model") == "atlas-embed-96").select(F.col("id").alias("key"), F.col("embedding").alias("vector"))


def _qvector(v) -> list[float]:
    return v.knowledge_embeddings.where(F.col("id") == 1).select("embedding").first()[0]


_COS = "CASE WHEN list_max(list_transform({e}, lambda x: abs(x))) = 0 THEN 0.0 ELSE list_cosine_similarity({e}::DOUBLE[], (SELECT embedding::DOUBLE[] FROM knowledge_embeddings WHERE id = 1)) END"
_VEC = f"vec AS (SELECT id AS key, {_COS.format(e='embedding')} AS score FROM knowledge_embeddings WHERE model = 'atlas-embed-96' AND len(embedding) = (SELECT len(embedding) FROM knowledge_embeddings WHERE id = 1))"


@book.query(f"{with_(more=_VEC)} SELECT key, round(score, 9) AS score FROM vec ORDER BY vec.score DESC, key LIMIT 20")
def vs2_vector_search(v):
    return retrieve.vector_search(_vectors(v), _qvector(v), 20, -1.0).select("key", F.round("score", 9).alias("score"))


@book.query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS key, list_cosine_similarity(a.x, b.x) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0)
    SELECT query_id, key, round(score, 9) AS score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p.score DESC, key) <= 10""")
def en11_batch_search(v):
    e = v.embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    queries = e.where(F.col("key") % 50 == 0).select(F.col("key").alias("query_id"), F.col("vector").alias("qvector"))
    return retrieve.batch_vector_search(e, queries).select("query_id", "key", F.round("score", 9).alias("score"))


#: Steps of PageRank in queries that have SQL.
RANK_STEPS = 12
_BY_NAME = "named AS (SELECT name AS key, name, body, tags FROM cur QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1)"
_HYBRID = ", ".join([
    _BY_NAME, _keyword_sql("named"),
    f"nv AS (SELECT node_name AS key, {_COS.format(e='embedding')} AS score FROM (SELECT * FROM knowledge_embeddings WHERE model = 'atlas-embed-96' AND len(embedding) = (SELECT len(embedding) FROM knowledge_embeddings WHERE id = 1) QUALIFY row_number() OVER (PARTITION BY node_name ORDER BY id DESC) = 1))",
    f"{pagerank_ctes(RANK_STEPS)}, d AS (SELECT * FROM r{RANK_STEPS})",
    "k AS MATERIALIZED (SELECT key, score AS k FROM kw WHERE score > 0 ORDER BY score DESC, key LIMIT 30)", "w AS MATERIALIZED (SELECT * FROM (SELECT key, score AS v FROM nv ORDER BY score DESC, key LIMIT 30) WHERE v >= 0)",
    """f AS (SELECT coalesce(k.key, w.key) AS key, coalesce(coalesce(k, 0) / (SELECT max(k) FROM k), 0) AS keyword_score, coalesce(coalesce(v, 0) / nullif((SELECT max(v) FROM w), 0), 0) AS vector_score FROM k FULL JOIN w ON k.key = w.key),
    g AS (SELECT f.*, coalesce(d.rank, 0) / (SELECT max(rank) FROM d) AS graph_score FROM f LEFT JOIN d ON d.name = f.key)""",
])


@book.query(f"""{with_('cur', 'kg', 'live', 'gn', more=_HYBRID)} SELECT key, round(0.5::DOUBLE * keyword_score + 0.3::DOUBLE * vector_score + 0.2::DOUBLE * graph_score, 9) AS score FROM g
    WHERE NOT starts_with(lower(key), 'untitled') ORDER BY 0.5::DOUBLE * keyword_score + 0.3::DOUBLE * vector_score + 0.2::DOUBLE * graph_score DESC, key LIMIT 10""")
def rk2_hybrid_search(v):
    """Ranks after a fixed number of steps, as SQL can say it; rk2_pagerank_search goes on until they settle."""
    return _hybrid(v, stepped_ranks(v)).select("key", F.round("score", 9).alias("score"))


@book.query()
def rk2_pagerank_search(v):
    """Ranks of up to 100 steps, until they settle."""
    return _hybrid(v, weighted_ranks(v)).select("key", F.round("score", 9).alias("score"))


def weighted_ranks(v):
    """(name, rank): weighted PageRank of the stored edges over all nodes."""
    e = v.edges()
    return analytics.pagerank(e, graph.graph_nodes(v.live(), e).select("name"))


def stepped_ranks(v):
    """weighted_ranks after RANK_STEPS steps."""
    e = v.edges()
    return analytics.pagerank(e, graph.graph_nodes(v.live(), e).select("name"), iterations=RANK_STEPS, tolerance=None)


def _hybrid(v, ranks):
    notes = graph.latest(v.current().withColumn("back", -F.col("ord")), ["name"], "back")
    docs = notes.select(F.col("name").alias("key"), "name", "body", "tags")
    own = v.knowledge_embeddings.where((F.col("model") == "atlas-embed-96") & (F.size("embedding") == len(_qvector(v))))
    vectors = graph.latest(own, ["node_name"], "id").select(F.col("node_name").alias("key"), F.col("embedding").alias("vector"))
    return retrieve.hybrid_search(docs, vectors, ranks, QUESTION, _qvector(v), "hybrid", 10)


@book.query()
def rk5_graph_context(v):
    ranks = weighted_ranks(v)
    context = retrieve.graph_context(v.edges(), ranks, _hybrid(v, ranks), hops=1)
    docs = graph.latest(v.current(), ["name"], "ord").select(F.col("name").alias("key"), "body")
    return retrieve.context_prompt(context, docs)


def _f(field: str) -> str:
    t = f"json_extract(frontmatter, '$.{field}')"
    s = f"CASE WHEN json_type(frontmatter, '$.{field}') = 'VARCHAR' THEN json_extract_string(frontmatter, '$.{field}') WHEN json_type(frontmatter, '$.{field}') = 'NULL' THEN NULL ELSE CAST({t} AS VARCHAR) END"
    return f"(CASE WHEN {s} NOT IN ('[]', '{{}}') AND trim({s}, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN {s} END)"


def _violations_sql() -> str:
    rows = []
    for field, allowed in dims.ENUM_FIELDS.items():
        ok = ", ".join(f"'{a}'" for a in allowed)
        rows.append(f"SELECT key, 'warning' AS severity, 'invalid-enum-value' AS rule, '{field}' AS field, {_f(field)} AS actual FROM cur WHERE lower(trim({_f(field)}, ' ' || chr(9) || chr(10) || chr(13))) NOT IN ({ok})")
    for field in dims.DATE_FIELDS:
        rows.append(f"SELECT key, 'error', 'invalid-date-format', '{field}', {_f(field)} FROM cur WHERE NOT regexp_matches(trim({_f(field)}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')")
    for field in dims.URL_FIELDS:
        rows.append(f"SELECT key, 'error', 'invalid-url', '{field}', {_f(field)} FROM cur WHERE NOT regexp_matches(trim({_f(field)}), '(?i)^https?://')")
    rows.append(f"SELECT key, 'warning', 'missing-explicit-type', 'type', NULL FROM cur WHERE {_f('type')} IS NULL")
    return " UNION ALL ".join(rows)


@book.query(f"{with_('cur')} {_violations_sql()}")
def va1_common_fields(v):
    notes = v.current()
    rows = validate.note_violations(notes, graph.classify_notes(notes))
    rules = ["invalid-enum-value", "invalid-date-format", "invalid-url", "missing-explicit-type"]
    return rows.where(F.col("rule").isin(rules)).select("key", "severity", "rule", "field", "actual")


@book.query()
def va4_all_violations(v):
    return validate.validate_notes(v.current())


@book.query()
def va6_cardinality(v):
    notes = v.current()
    return validate.cardinality_violations(notes, graph.classify_notes(notes))


@book.query()
def ag6_quality(v):
    notes = v.current()
    return validate.quality(notes, validate.validate_notes(notes))


@book.query("""WITH a AS (SELECT key, arg_max(checksum, ord) AS c FROM notes WHERE scanned_at < TIMESTAMP '2025-01-01' GROUP BY key), b AS (SELECT key, arg_max(checksum, ord) AS c FROM notes WHERE deleted_at IS NULL GROUP BY key)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.key = b.key WHERE a.c IS DISTINCT FROM b.c""")
def jn17_change_set(v):
    last = lambda df: df.groupBy("key").agg(F.max_by("checksum", "ord").alias("checksum"))
    old = last(v.notes.where(F.col("scanned_at") < F.lit("2025-01-01").cast("timestamp_ntz")))
    return state.change_set(old, last(v.notes.where(F.col("deleted_at").isNull())))


@book.query(f"""{with_('cur')}, done AS (SELECT key, checksum FROM notes WHERE ord % 3 = 0) SELECT key, checksum FROM cur ANTI JOIN done USING (key, checksum) WHERE length(trim(body)) >= 10""")
def jn18_notes_to_embed(v):
    return state.to_embed(v.current(), v.notes.where(F.col("ord") % 3 == 0).select("key", "checksum"))


_EDGE_STATE = "SELECT source_name, target_name, relation, weight, created_at, id FROM knowledge_edges WHERE source_name <> '' AND target_name <> ''"


@book.query(f"""WITH e AS ({_EDGE_STATE}), t AS (SELECT * FROM e WHERE id < 10000 QUALIFY row_number() OVER (PARTITION BY source_name, target_name, relation ORDER BY id DESC) = 1),
    c AS (SELECT * FROM e WHERE id >= 10000 QUALIFY row_number() OVER (PARTITION BY source_name, target_name, relation ORDER BY id DESC) = 1)
    SELECT coalesce(c.source_name, t.source_name) AS source_name, coalesce(c.target_name, t.target_name) AS target_name, coalesce(c.relation, t.relation) AS relation,
      CASE WHEN c.source_name IS NULL THEN t.weight ELSE c.weight END AS weight, coalesce(t.created_at, c.created_at) AS created_at
    FROM t FULL JOIN c ON t.source_name = c.source_name AND t.target_name = c.target_name AND t.relation = c.relation""")
def sk4_edge_upsert(v):
    keys = ["source_name", "target_name", "relation"]
    e = v.knowledge_edges.where((F.col("source_name") != "") & (F.col("target_name") != "")).select(*keys, "weight", "created_at", F.col("id").alias("seq"))
    target = graph.latest(e.where(F.col("seq") < 10_000), keys, "seq").drop("seq")
    return state.upsert(target, e.where(F.col("seq") >= 10_000), keys, keep=["created_at"])


@book.query(f"{with_('kg')} SELECT src, dst, type, weight FROM kg WHERE src NOT IN ('Inbox', 'Tool Shelf') AND dst NOT IN ('Inbox', 'Tool Shelf')")
def sk6_delete_cascade(v):
    gone = v.spark.createDataFrame([("Inbox",), ("Tool Shelf",)], "name string")
    return state.delete_nodes(v.live(), v.edges(), gone)[1].select("src", "dst", "type", "weight")


@book.query("""WITH t AS (SELECT name, min(source) AS source FROM knowledge_nodes WHERE id <= 500 AND name <> '' GROUP BY name),
    n AS (SELECT source_name AS name, min(id) AS i FROM knowledge_edges WHERE trim(source_name) <> '' GROUP BY 1)
    SELECT name, source FROM t UNION ALL SELECT name, 'import' FROM n WHERE name NOT IN (SELECT name FROM t)""")
def sk7_bulk_import(v):
    target = v.knowledge_nodes.where((F.col("id") <= 500) & (F.col("name") != "")).groupBy("name").agg(F.min("source").alias("source"))
    rows = v.knowledge_edges.select(F.col("source_name").alias("name"), F.lit("import").alias("source"), F.col("id").alias("seq"))
    return state.import_new(target, rows, ["name"])


@book.query()
def sk7_whole_import(v):
    """Into all nodes; sk7_bulk_import takes those up to id 500 as the target, as its SQL does."""
    target = v.knowledge_nodes.where(F.col("name") != "").groupBy("name").agg(F.min("source").alias("source"))
    rows = v.knowledge_edges.select(F.col("source_name").alias("name"), F.lit("import").alias("source"), F.col("id").alias("seq"))
    return state.import_new(target, rows, ["name"])


_URLS = r"u AS (SELECT doc_id, source AS topic, text AS content, rtrim(regexp_extract(text, 'https?://[^\s)>\]]+', 0), '.,;:!?') AS url FROM documents)"


@book.query(f"""{with_(more=_URLS)}, t AS (SELECT topic, CASE WHEN contains(regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1), 'example.invalid') THEN 0.6 ELSE 0.45 END AS trust, lower(content) AS c FROM u WHERE url <> '')
    SELECT topic, round(avg(CASE WHEN contains(c, 'benchmark') THEN least(trust + 0.05::DOUBLE, 1.0) ELSE trust END), 9) AS trust FROM t GROUP BY topic""")
def ag17_source_trust(v):
    rows = v.documents.select(F.col("source").alias("topic"), F.col("text").alias("content"), tx.first_url(F.col("text")).alias("url")).where(F.col("url").isNotNull())
    trust = score.source_trust(F.col("url"), F.col("content"), DOMAINS, boost=["benchmark"])
    return rows.groupBy("topic").agg(F.round(F.avg(trust), 9).alias("trust"))


@book.query(r"""SELECT source AS topic, round(least(sum(CAST(regexp_matches(text, '(?i)[0-9]+\.?[0-9]*\s*(%|percent|배|times|x)') AS INT) + CAST(regexp_matches(text, '(v?[0-9]+\.[0-9]+|20[0-9]{2})') AS INT)
    + CAST(regexp_matches(text, '(?i)(vs|compared|benchmark|outperform|대비|비교)') AS INT)) / (count(*) * 2.0::DOUBLE), 1.0), 9) AS specificity FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def ag19_specificity(v):
    rows = v.documents.where(F.col("text").isNotNull()).select(F.col("source").alias("topic"), F.col("text").alias("content"))
    return score.specificity(rows).select("topic", F.round("specificity", 9).alias("specificity"))


@book.query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def st_window_counts(v):
    out = incremental.window_counts(v.events)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@book.query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM n GROUP BY user_id, i""")
def st_sessions(v):
    return incremental.sessions(v.events).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


QUERIES, ORACLE = book.queries, book.oracle

"""Ranked retrieval: keywords, vectors, and their fusion with graph ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid import dims
from notegrid.functions import text as tx
from notegrid.functions import vectors as vx
from notegrid.operators import analytics, graph


def keyword_search(docs: DataFrame, query: str, top_k: int | None = 20) -> DataFrame:
    """(key, score) of docs (key, name, body, tags) with a positive keyword score."""
    score = tx.keyword_score(F.col("name"), F.col("key"), F.col("body"), F.col("tags"), query)
    hits = docs.select("key", score.alias("score")).where(F.col("score") > 0)
    return hits if top_k is None else hits.orderBy(F.desc("score"), "key").limit(top_k)


def vector_search(vectors: DataFrame, query: list[float], top_k: int = 10, min_score: float = 0.0) -> DataFrame:
    """(key, score): the top_k vectors (key, vector) of the query's length by cosine,
    of which those below min_score are dropped afterwards."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.size("vector") == len(query)).select("key", vx.cosine(F.col("vector"), q).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(top_k).where(F.col("score") >= min_score)


def batch_vector_search(vectors: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """(query_id, key, score) for queries (query_id, qvector). The queries, a stated
    set, are joined by length, which is the only condition of comparability."""
    v = vectors.withColumn("dim", F.size("vector"))
    q = queries.withColumn("dim", F.size("qvector"))
    scored = v.join(q, "dim").select("query_id", "key", vx.cosine(F.col("vector"), F.col("qvector")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return scored.withColumn("place", place).where(F.col("place") <= top_k).select("query_id", "key", "score")


def question_kind(query: Column) -> Column:
    """factual, relational or exploratory: the kind with most patterns found, in this order."""
    n = {k: sum((query.rlike("(?i)" + p).cast("int") for p in ps), F.lit(0)) for k, ps in dims.QUESTION_PATTERNS.items()}
    most = F.greatest(*n.values())
    return F.when(n["factual"] == most, "factual").when(n["relational"] == most, "relational").otherwise("exploratory")


def fuse(keyword: DataFrame, vector: DataFrame, ranks: DataFrame, weights: tuple[float, float, float], top_k: int = 10) -> DataFrame:
    """(key, score, keyword_score, vector_score, graph_score): each list divided by its
    own maximum (0 if that isn't positive), ranks by the maximum of all."""
    kw = keyword.select("key", F.col("score").alias("k"))
    vec = vector.select("key", F.col("score").alias("v"))
    k_max, v_max = (df.agg(F.max(c).alias("m")).select("m").scalar() for df, c in ((kw, "k"), (vec, "v")))
    r_max = ranks.agg(F.max("rank").alias("m")).select("m").scalar()
    share = lambda c, m: F.when(m > 0, F.coalesce(c, F.lit(0.0)) / m).otherwise(0.0)
    rows = kw.join(vec, "key", "full_outer").join(ranks.select(F.col("name").alias("key"), "rank"), "key", "left")
    rows = rows.select("key", share(F.col("k"), k_max).alias("keyword_score"), share(F.col("v"), v_max).alias("vector_score"), share(F.col("rank"), r_max).alias("graph_score"))
    score = weights[0] * F.col("keyword_score") + weights[1] * F.col("vector_score") + weights[2] * F.col("graph_score")
    named = rows.where(~F.lower("key").startswith("untitled")).withColumn("score", score)
    return named.orderBy(F.desc("score"), "key").limit(top_k)


def hybrid_search(docs: DataFrame, vectors: DataFrame, ranks: DataFrame, query: str, qvector: list[float], mode: str = "hybrid", top_k: int = 10) -> DataFrame:
    """Fused ranking; both lists are cut to three times top_k before."""
    return fuse(keyword_search(docs, query, 3 * top_k), vector_search(vectors, qvector, 3 * top_k), ranks, dims.MODE_WEIGHTS[mode], top_k)


def graph_context(edges: DataFrame, ranks: DataFrame, hits: DataFrame, hops: int = 2, max_nodes: int = 20) -> DataFrame:
    """Context of a retrieval: the surroundings of its hits (column key), the best
    nodes with their connections."""
    near = analytics.k_hop(edges, hits.select(F.col("key").alias("name")), hops)
    return analytics.subgraph_context(edges, near, ranks, max_nodes)


def context_prompt(context: DataFrame, docs: DataFrame, budget: int = 12_000) -> DataFrame:
    """(place, name, text): context blocks by rank while the characters used before
    leave more than 200 of the budget."""
    place = F.row_number().over(Window.orderBy(F.desc("rank"), "name"))  # at most max_nodes rows
    lines = F.transform(F.coalesce("connections", F.array().cast("array<struct<target:string,type:string>>")), lambda c: F.concat(c["type"], F.lit(": "), c["target"]))
    rows = context.join(docs.select(F.col("key").alias("name"), "body"), "name", "left").withColumn("place", place)
    text = F.concat_ws("\n", F.concat(F.lit("## "), F.col("name")), F.substring(F.coalesce("body", F.lit("")), 1, 2_000), F.array_join(lines, "\n"))
    rows = rows.select("place", "name", text.alias("text"))
    used = F.coalesce(F.sum(F.length("text")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("used", used).where(budget - F.col("used") > 200).select("place", "name", "text")


def embedding_text(notes: DataFrame, segments: tuple[str, ...] = (), max_chars: int = 2_000) -> DataFrame:
    """(key, text) to embed: title, the first of the vault's project `segments` in the
    path, tags, the typed type (the inferred one where the field is missing) and the
    stripped text, cut to max_chars. Null values leave their line out."""
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ")
    typed = F.coalesce(F.array_contains(F.json_object_keys("frontmatter"), "type"), F.lit(False))
    kind = F.nullif(F.when(typed, F.get_json_object("frontmatter", "$.type")).otherwise(graph.entity_type()), F.lit(""))
    project = F.coalesce(*[F.when(F.contains("path", F.lit(s)), s) for s in segments], F.lit(None))
    has_tags = F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0
    parts = [
        F.concat(F.lit("# "), F.col("name")), F.concat(F.lit("Project: "), project), F.when(has_tags, F.concat(F.lit("Tags: "), tags)),
        F.concat(F.lit("Type: "), kind), tx.strip(F.coalesce("body", F.lit(""))),
    ]
    return notes.select("key", F.substring(F.concat_ws("\n", *parts), 1, max_chars).alias("text"))

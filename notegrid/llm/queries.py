"""Queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.llm import bpe, canonical, cooccurrence, knn, lookalike, names, packing
from notegrid.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from a cosine of 0.85 on: such neighbours share pivots, so that few files find them."""
    vectors = table(spark, sf_dir, "knowledge_embeddings")
    return knn.similar_pairs(knn.nearest_rows(vectors, "id", "embedding", ["model"], k=10, min_cosine=0.85, per_pivot=256 / 3, prefix=6, posts=3, candidates=64))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result of problem 2: ten neighbours of every vector, whatever their cosine."""
    return knn.nearest_rows(table(spark, sf_dir, "knowledge_embeddings"), "id", "embedding", ["model"], k=10)


def p2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten neighbours of the vectors whose id is divisible by 50, among all vectors."""
    vectors = table(spark, sf_dir, "knowledge_embeddings")
    near = knn.nearest_rows(vectors, "id", "embedding", ["model"], k=10, posts=4, probes=64, queries=F.col("id") % 50 == 0)
    return near.select("id", "other")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.note_pairs(table(spark, sf_dir, "notes"), min_count=6)


def p3_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result of problem 3; p3_pairs has the pairs of 6 notes or more, as its SQL has."""
    return cooccurrence.note_pairs(table(spark, sf_dir, "notes"), min_count=1)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.above_chance(p3_pairs(spark, sf_dir), "4.7").select("field_name", "item_a", "item_b")


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_names(names.vault_names(table(spark, sf_dir, "knowledge_nodes"), table(spark, sf_dir, "knowledge_edges")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.spelling_pairs(p4_entities(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, notes, lists = (table(spark, sf_dir, t) for t in ("knowledge_nodes", "notes", "canonical_values"))
    return canonical.map_values(nodes, notes, lists).select("ref_table", "record_id", "field_name", "canon_id").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = bpe.count_tokens(docs, "doc_id", "text", "byte_bpe_50k")
    return packing.pack_items(sizes, "doc_id", "n_tokens", capacity=2_048, n_items=docs.count())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.class_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the trie decides and how many the table."""
    return lookalike.word_decisions(table(spark, sf_dir, "documents"), "text")


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.normalise_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p2_search": p2_search,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p3_all_pairs": p3_all_pairs,
    "p4_found": p4_found,
    "p4_entities": p4_entities,
    "p5_found": p5_found,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_texts": p9_texts,
    "p9_classes": p9_classes,
    "p9_words": p9_words,
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(8201) || chr(8239) || chr(8199) || chr(12288)"

_PAIRS = f"""
items AS (
  SELECT DISTINCT field_name, key, item FROM (
    SELECT 'tags' AS field_name, key, trim(regexp_replace(trim(lower(x), {_SPACES}), '^(#\\s*)+', ''), {_SPACES}) AS item
    FROM (SELECT key, unnest(tags) AS x FROM notes)
    UNION ALL
    SELECT 'wiki_links', key, trim(regexp_replace(replace(trim(lower(x), {_SPACES}), '\\', '/'), '\\.md$', ''), {_SPACES})
    FROM (SELECT key, unnest(wiki_links) AS x FROM notes)
  ) WHERE item <> '' AND key IS NOT NULL
), c AS (SELECT field_name, item, count(*) AS n FROM items GROUP BY 1, 2),
total AS (SELECT count(DISTINCT key) AS n_records FROM notes),
ab AS (
  SELECT a.field_name, a.item AS item_a, b.item AS item_b, count(*) AS n_ab
  FROM items a JOIN items b ON a.field_name = b.field_name AND a.key = b.key AND a.item < b.item
  GROUP BY 1, 2, 3 HAVING count(*) >= 6
), pairs AS (
  SELECT ab.*, ca.n AS n_a, cb.n AS n_b, n_records,
    ab.n_ab::DOUBLE * n_records / (ca.n::DOUBLE * cb.n) AS lift,
    (ab.n_ab + 0.5::DOUBLE) * (n_records - ca.n - cb.n + ab.n_ab + 0.5::DOUBLE)
      / ((ca.n - ab.n_ab + 0.5::DOUBLE) * (cb.n - ab.n_ab + 0.5::DOUBLE)) AS odds_ratio
  FROM ab JOIN c ca ON ca.field_name = ab.field_name AND ca.item = item_a
  JOIN c cb ON cb.field_name = ab.field_name AND cb.item = item_b, total
)"""

_COSINE = """
WITH v AS (
  SELECT id, model, len(embedding) AS dim, embedding::DOUBLE[] AS e FROM knowledge_embeddings
  WHERE len(embedding) > 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), s AS (
  SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS cosine
  FROM v a JOIN v b ON a.model IS NOT DISTINCT FROM b.model AND a.dim = b.dim AND a.id <> b.id
  WHERE a.id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 12) DESC, b) AS place FROM s)
SELECT a AS id, b AS other FROM r WHERE place <= 10"""

ORACLE = {
    "p2_search": _COSINE,
    "p3_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "p3_found": f"WITH {_PAIRS} SELECT field_name, item_a, item_b FROM pairs WHERE n_ab * n_records * 10 > 47 * n_a * n_b",
}

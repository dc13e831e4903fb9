"""The query modules of the core, in the order of their operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notegrid.plans import graph_queries, report_queries, service_queries, text_queries, training_queries

MODULES = [training_queries, text_queries, graph_queries, service_queries, report_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword, vector and graph ranks fused into one ranking."""
    return service_queries.QUERIES["rk2_pagerank_search"](spark, sf_dir)

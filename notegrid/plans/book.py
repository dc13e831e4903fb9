"""Registration of queries with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notegrid.operators import graph
from notegrid.tables import table

#: SQL of the inputs that many queries share.
CTES = {
    "cur": "cur AS (SELECT * FROM (SELECT * FROM notes QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord DESC) = 1) WHERE deleted_at IS NULL)",
    "kg": "kg AS MATERIALIZED (SELECT source_name AS src, target_name AS dst, relation AS type, weight FROM knowledge_edges WHERE source_name <> '' AND target_name <> '' QUALIFY row_number() OVER (PARTITION BY source_name, target_name ORDER BY id DESC) = 1)",
    "live": "live AS (SELECT * FROM (SELECT * FROM knowledge_nodes WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY id DESC) = 1) WHERE deleted_at IS NULL)",
    "gn": "gn AS (SELECT e.name, l.entity_type, l.source_path, l.source_path IS NULL AS is_dangling FROM (SELECT src AS name FROM kg UNION SELECT dst FROM kg UNION SELECT name FROM live) e LEFT JOIN live l ON l.name = e.name)",
    "und": "und AS (SELECT src AS a, dst AS b FROM kg UNION SELECT dst, src FROM kg)",
    "resolver": """resolver AS (SELECT DISTINCT key AS link, key FROM cur UNION ALL SELECT name, key FROM (
        SELECT name, key FROM cur WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(key) - length(replace(key, '/', '')), ord) = 1)
        WHERE name NOT IN (SELECT key FROM cur))""",
}


def with_(*names: str, more: str = "") -> str:
    """WITH clause of shared inputs, then own ones."""
    return "WITH " + ", ".join([CTES[n] for n in names] + ([more] if more else []))


class Vault:
    """The tables of one data folder and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def current(self) -> DataFrame:
        return graph.current_notes(self.notes)

    def edges(self) -> DataFrame:
        return graph.stored_edges(self.knowledge_edges)

    def live(self) -> DataFrame:
        return graph.live_nodes(self.knowledge_nodes)

    def nodes(self) -> DataFrame:
        return graph.graph_nodes(self.live(), self.edges())


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers f(vault) under its name."""

        def register(f):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Vault(spark, sf_dir))
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return register

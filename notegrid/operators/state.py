"""Keyed state on plain parquet: change sets, upserts, deletes and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.operators.graph import latest


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, status) added, modified or deleted between two snapshots (key, checksum)."""
    both = old.select("key", F.col("checksum").alias("a")).join(new.select("key", F.col("checksum").alias("b")), "key", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select("key", status.alias("status")).where(F.col("status").isNotNull())


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """target with the rows of changes written over it by key; of several changes to a
    key the one with the largest seq counts. Columns in `keep` stay as they were."""
    new = latest(changes, keys, "seq").drop("seq")
    if keep:
        old = target.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(old, keys, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*target.columns))


def import_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with rows appended whose key is new and not blank; of repeated ones the
    first by seq."""
    named = rows.where(F.length(F.trim(F.col(keys[0]))) > 0)
    first = named.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in target.columns if c not in keys]), "seq").alias("r"))
    rest = [F.col("r")[c].alias(c) for c in target.columns if c not in keys]
    fresh = first.select(*keys, *rest).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the named nodes and every edge at either end of them."""
    gone = names.select("name").distinct()
    left = edges.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti")
    return nodes.join(gone, "name", "left_anti"), left


def to_embed(notes: DataFrame, embedded: DataFrame, min_chars: int = 10) -> DataFrame:
    """Notes (key, checksum, body) without a vector of their present checksum (key, checksum)."""
    ready = notes.where(F.length(F.trim("body")) >= min_chars)
    return ready.join(embedded.select("key", "checksum"), ["key", "checksum"], "left_anti").select("key", "checksum")


def merge_embeddings(old: DataFrame, new: DataFrame, live: DataFrame) -> DataFrame:
    """Vectors by key: new ones win, those of notes that are gone are dropped."""
    both = old.join(new.select("key"), "key", "left_anti").unionByName(new)
    return both.join(live.select("key"), "key", "left_semi")


def write_snapshot(df: DataFrame, folder: str, version: str) -> str:
    """A table's version in a folder of its own; earlier ones stay readable."""
    path = f"{folder}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def push_in_batches(df: DataFrame, send, size: int = 500) -> None:
    """Every partition's rows handed to send(list of dicts), `size` at a time, by the executors."""

    def run(rows):
        batch = []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)

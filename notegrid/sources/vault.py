"""Scans of vault folders, external search results, and stored tables."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from notegrid import dims
from notegrid.sources.parsers import parse_document
from notegrid.tables import cut_lineage

_NOTE = "path string, name string, key string, content string, body string, frontmatter string, wiki_links array<string>, tags array<string>, headings array<string>, checksum string, modified timestamp, error string"


def in_order(df: DataFrame, by: str, out: str = "ord") -> DataFrame:
    """Adds the place of each row in the order of `by` (from 1), without bringing all
    rows together: range-partitioned rows are counted per partition and numbered."""
    rows = cut_lineage(df.repartitionByRange(by).sortWithinPartitions(by).select("*", F.spark_partition_id().alias("__part")))
    sizes = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}  # one number a partition
    start, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, start))
        start += sizes[part]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    offsets = F.create_map(*[F.lit(x) for kv in starts for x in kv]) if starts else F.create_map().cast("map<int,int>")
    return rows.withColumn(out, (offsets[F.col("__part")] + place + 1).cast("long")).drop("__part")


def parse_files(files: DataFrame, root: str) -> DataFrame:
    """Records of files (path, content, modificationTime as of binaryFile); `error` says
    why one couldn't be read. The key is the path below root without suffix."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content, modified in zip(pdf["path"], pdf["content"], pdf["modificationTime"]):
                plain = re.sub(r"^file:/*", "/", path)
                rel = os.path.relpath(plain, root) if plain.startswith(root.rstrip("/") + "/") else PurePosixPath(plain).name
                head = {"path": plain, "name": PurePosixPath(plain).stem, "key": str(PurePosixPath(rel).with_suffix("")), "modified": modified, "error": None}
                try:
                    rows.append(head | parse_document(bytes(content), plain))
                except ValueError as e:
                    rows.append(head | {"error": str(e)})
            columns = [c.split()[0] for c in _NOTE.split(", ")]
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None) if rows else pd.DataFrame(columns=columns)

    return files.select("path", "content", "modificationTime").mapInPandas(run, _NOTE)


def scan_files(spark: SparkSession, root: str, formats: Sequence[str] = (".md",), exclude: Sequence[str] = tuple(dims.EXCLUDED_FOLDERS)) -> DataFrame:
    """Files below root with one of the suffixes, without those in an excluded folder."""
    if "://" not in root and not os.path.isdir(root):
        raise FileNotFoundError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(suffix.isin([f.lower() for f in formats]) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, exclude))))


def scan_vault(spark: SparkSession, root: str, formats: Sequence[str] = (".md",), exclude: Sequence[str] = tuple(dims.EXCLUDED_FOLDERS)) -> DataFrame:
    """Notes of a folder in the order of paths; files that can't be read are left out."""
    rows = parse_files(scan_files(spark, root, formats, exclude), root)
    return in_order(rows.where(F.col("error").isNull()).drop("error"), "path")


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose path and time of change aren't in the ledger (path, modified) yet."""
    return files.join(ledger.select("path", F.col("modified").alias("modificationTime")), ["path", "modificationTime"], "left_anti")


def first_by_key(notes: DataFrame, max_files: int | None = None) -> DataFrame:
    """The first note of each key by ord; of these the first max_files."""
    ranked = notes.groupBy("key").agg(F.min_by(F.struct(*notes.columns), "ord").alias("r")).select("r.*")
    return ranked if max_files is None else ranked.orderBy("ord").limit(max_files)


def page_results(pages: DataFrame) -> DataFrame:
    """(topic, title, url) of video results inside captured pages (topic, html), which
    carry them as JSON after a marker."""
    found = F.regexp_extract("html", r"(?s)var ytInitialData = (\{.*?\});</script>", 1)
    items = F.regexp_extract_all(found, F.lit(r'"videoId":"([^"]+)"[^{}]*?\}?[^{}]*?"title":\{"runs":\[\{"text":"([^"]+)"'), 0)
    rows = pages.select("topic", F.explode(items).alias("item"))
    video = F.regexp_extract("item", r'"videoId":"([^"]+)"', 1)
    return rows.select("topic", F.regexp_extract("item", r'"text":"([^"]+)"', 1).alias("title"), F.concat(F.lit("https://www.youtube.com/watch?v="), video).alias("url"))


class SearchResults(DataSource):
    """Recorded answers of a search service: one JSON file per topic, read by name.

    spark.read.format("search_results").option("folder", ...).load() gives (topic,
    place, title, url, snippet, date); a missing or broken file gives no rows."""

    @classmethod
    def name(cls) -> str:
        return "search_results"

    def schema(self) -> str:
        return "topic string, place int, title string, url string, snippet string, date string"

    def reader(self, schema):
        return _SearchReader(self.options["folder"])


class _SearchReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [InputPartition(os.path.join(self.folder, n)) for n in sorted(os.listdir(self.folder)) if n.endswith(".json")]

    def read(self, partition):
        try:
            with open(partition.value, encoding="utf-8") as f:
                answer = json.load(f)
        except (OSError, ValueError):
            return
        results = answer.get("web", {}).get("results", answer.get("items", [])) if isinstance(answer, dict) else []
        for i, r in enumerate(results):
            yield (PurePosixPath(partition.value).stem, i, r.get("title") or r.get("full_name"), r.get("url") or r.get("html_url"), r.get("description"), r.get("age") or r.get("updated_at"))


def read_database(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database over JDBC; the driver has to be on Spark's class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def write_database(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()

"""Building of the property graph: nodes, the log of edge writes, and the edges that remain."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid import dims
from notegrid.functions import text as tx


def latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the largest seq of each key (ranked before the shuffle as well)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return df.withColumn("__place", place).where(F.col("__place") == 1).drop("__place")


def current_notes(notes: DataFrame) -> DataFrame:
    """The last scan of every note that is still there."""
    return latest(notes, ["key"], "ord").where(F.col("deleted_at").isNull())


def last_writer_edges(log: DataFrame) -> DataFrame:
    """(src, dst, type, weight): one edge per ordered pair, the write with the largest
    seq. Writes with a null or empty end are left out."""
    edges = log.where((F.col("src") != "") & (F.col("dst") != ""))
    last = edges.groupBy("src", "dst").agg(F.max_by(F.struct("type", "weight"), "seq").alias("last"))
    return last.select("src", "dst", "last.type", "last.weight")


def stored_log(knowledge_edges: DataFrame) -> DataFrame:
    """(src, dst, type, weight, seq): the stored log of edge writes, which grows by id."""
    return knowledge_edges.select(F.col("source_name").alias("src"), F.col("target_name").alias("dst"), F.col("relation").alias("type"), "weight", F.col("id").alias("seq"))


def stored_edges(knowledge_edges: DataFrame) -> DataFrame:
    """last_writer_edges of the stored log of edge writes."""
    return last_writer_edges(stored_log(knowledge_edges))


def live_nodes(knowledge_nodes: DataFrame) -> DataFrame:
    """The node of each name that was written last, unless it is deleted."""
    return latest(knowledge_nodes.where(F.col("name") != ""), ["name"], "id").where(F.col("deleted_at").isNull())


def link_resolver(notes: DataFrame) -> DataFrame:
    """(link, key): a note's key for its key, and for its name the key of the
    shallowest note of that name, the first one scanned among equals."""
    depth = F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))
    names = notes.groupBy(F.col("name").alias("link")).agg(F.min_by("key", F.struct(depth, "ord")).alias("key"))
    keys = notes.select(F.col("key").alias("link"), "key").distinct()
    return keys.unionByName(names.join(keys.select("link"), "link", "left_anti")).where(F.col("link").isNotNull())


def resolve(df: DataFrame, link: str, resolver: DataFrame, to: str) -> DataFrame:
    """Adds column `to`: what the link means, or the link itself if nothing does."""
    r = resolver.select(F.col("link").alias(link), F.col("key").alias("__key"))
    return df.join(r, link, "left").withColumn(to, F.coalesce("__key", link)).drop("__key")


def relation_rows(notes: DataFrame) -> DataFrame:
    """(ord, key, relation, rel_ord, target, tgt_ord) of the relation fields of the frontmatter."""
    fields = F.array(*[
        F.struct(F.lit(i).alias("rel_ord"), F.lit(f).alias("relation"), F.get_json_object("frontmatter", f"$.{f}").alias("text"))
        for i, f in enumerate(dims.RELATION_FIELDS)
    ])
    rows = notes.select("ord", "key", F.inline(fields)).where(F.col("text").isNotNull())
    items = F.coalesce(F.when(F.col("text").startswith("["), F.from_json("text", "array<string>")), F.array("text"))
    rows = rows.select("ord", "key", "relation", "rel_ord", F.posexplode(items).alias("tgt_ord", "target")).where(F.col("target").isNotNull())
    inner = F.regexp_extract("target", tx.WIKI_LINK, 1)
    return rows.withColumn("target", tx.strip(F.when(inner != "", inner).otherwise(F.col("target"))))


def edge_log(notes: DataFrame) -> DataFrame:
    """(src, dst, type, weight, seq): links of all notes, then relations of all notes,
    in the order of notes, fields and places. Links to oneself stay."""
    resolver = link_resolver(notes)
    seq = lambda stage, a, b: F.struct(F.lit(stage).alias("stage"), F.col("ord"), a.cast("int").alias("rel"), b.cast("int").alias("place"))
    links = notes.select("ord", "key", F.posexplode("wiki_links").alias("place", "link")).where(F.col("link") != "")
    links = links.select("key", "link", F.lit("wiki_link").alias("type"), seq(1, F.lit(0), F.col("place")).alias("seq"))
    rels = relation_rows(notes).select("key", F.col("target").alias("link"), F.col("relation").alias("type"), seq(2, F.col("rel_ord"), F.col("tgt_ord")).alias("seq"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in dims.EDGE_WEIGHTS.items() for x in kv])[F.col("type")], F.lit(dims.DEFAULT_EDGE_WEIGHT))
    log = resolve(links.unionByName(rels), "link", resolver, "dst")
    return log.select(F.col("key").alias("src"), "dst", "type", weight.alias("weight"), "seq")


def semantic_relations(notes: DataFrame, window: int = 50) -> DataFrame:
    """(key, link, type): the relation that the text around a link names.

    A place counts for a link if its target starts with the link, without regard
    to case; the first place whose surroundings match a pattern decides.
    """
    patterns = [(re.compile(p), t) for p, t in dims.SEMANTIC_PATTERNS]

    def mine(batches):
        for pdf in batches:
            out = []
            for key, body, links in zip(pdf["key"], pdf["body"], pdf["wiki_links"]):
                if body is None or links is None or "[[" not in body:
                    continue
                for link in dict.fromkeys(x for x in links if x):
                    for m in re.finditer(r"\[\[" + re.escape(link) + r"[^\]]*\]\]", body, re.IGNORECASE):
                        near = body[max(0, m.start() - window) : m.end() + window].lower()
                        kind = next((t for p, t in patterns if p.search(near)), None)
                        if kind:
                            out.append((key, link, kind))
                            break
            yield pd.DataFrame(out, columns=["key", "link", "type"])

    return notes.select("key", "body", "wiki_links").mapInPandas(mine, "key string, link string, type string")


def build_edges(notes: DataFrame) -> DataFrame:
    """(src, dst, type, weight, auto_semantic): the edges of a vault's notes. A
    relation that the text names replaces a plain link only."""
    edges = last_writer_edges(edge_log(notes))
    mined = resolve(semantic_relations(notes), "link", link_resolver(notes), "dst").where(F.col("dst") != F.col("key"))
    # several links may mean one note: the first name by order decides
    mined = mined.groupBy(F.col("key").alias("src"), "dst").agg(F.min_by("type", "link").alias("mined"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in dims.EDGE_WEIGHTS.items() for x in kv])[F.col("mined")], F.lit(dims.DEFAULT_EDGE_WEIGHT))
    both = edges.join(mined, ["src", "dst"], "left")
    replaced = F.col("mined").isNotNull() & (F.col("type") == "wiki_link")
    return both.select(
        "src", "dst", F.when(replaced, F.col("mined")).otherwise(F.col("type")).alias("type"),
        F.when(replaced, weight).otherwise(F.col("weight")).alias("weight"), replaced.alias("auto_semantic"),
    )


def tag_edges(notes: DataFrame, edges: DataFrame, least: int = 2, most: int = 100, shared: int = 2) -> DataFrame:
    """(src, dst, type, weight, shared_tags) for notes that share `shared` tags of
    `least` to fewer than `most` notes, unless src points at dst already. The band
    is part of the rule; it also bounds what a tag can contribute to the join."""
    tags = notes.select("key", F.explode("tags").alias("tag")).distinct()
    band = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("n") < most))
    kept = tags.join(band.select("tag"), "tag", "left_semi")
    a, b = kept.select("tag", F.col("key").alias("src")), kept.select("tag", F.col("key").alias("dst"))
    pairs = a.join(b, "tag").where(F.col("src") < F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared_tags"))
    new = pairs.where(F.col("shared_tags") >= shared).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return new.select("src", "dst", F.lit("tag_shared").alias("type"), F.least(F.col("shared_tags") * 0.15, F.lit(0.8)).alias("weight"), "shared_tags")


def graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All ends of edges and all nodes, with the attributes a node has, else nulls."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).union(nodes.select("name")).distinct()
    return ends.join(nodes.select("name", "entity_type", "source_path"), "name", "left").withColumn("is_dangling", F.col("source_path").isNull())


def classify_notes(notes: DataFrame, project_tags: tuple[str, ...] = ()) -> DataFrame:
    """(key, entity_type): the explicit type, else by name, by tags, by folder, else note.
    project_tags are tags that name projects of the vault."""
    return notes.select("key", entity_type(project_tags).alias("entity_type"))


def entity_type(project_tags: tuple[str, ...] = ()) -> Column:
    """The expression of classify_notes over a notes table."""
    raw = F.lower(tx.strip(F.get_json_object("frontmatter", "$.type")))
    aliases = F.create_map(*[F.lit(x) for kv in dims.TYPE_ALIASES.items() for x in kv])
    typed = F.coalesce(aliases[raw], raw)
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    scores = F.array(*[
        F.struct(F.size(F.array_intersect(F.array_distinct(tags), F.array(*map(F.lit, [*words, *(project_tags if t == "project" else ())])))).alias("score"), F.lit(-i).alias("rank"), F.lit(t).alias("type"))
        for i, (t, words) in enumerate(dims.TAG_TYPES.items())
    ])
    best = F.array_max(scores)
    folders = F.create_map(*[F.lit(x) for kv in dims.FOLDER_TYPES.items() for x in kv])
    parts = F.filter(F.transform(F.split("path", "/"), lambda p: folders[p]), lambda t: t.isNotNull())
    return F.coalesce(
        F.when(typed.isin(dims.CORE_TYPES), typed), tx.first_rule(F.col("name"), dims.NAME_TYPES),
        F.when(best["score"] > 0, best["type"]), F.try_element_at(parts, F.lit(1)), F.lit("note"),
    )


def name_equals(c: Column, value: str) -> Column:
    return F.lower(c) == value.lower()

"""Rule-driven enrichment: proposed types, projects, tags, related notes and backlinks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid import dims
from notegrid.functions import text as tx
from notegrid.operators import graph
from notegrid.tables import cut_lineage


def proposed_type(name: Column, path: Column) -> Column:
    """A type by name, else by folder; null if nothing speaks for one."""
    folder = F.coalesce(*[F.when(F.contains(path, F.lit(part)), t) for part, t in dims.PROPOSED_FOLDERS], F.lit(None))
    return F.coalesce(tx.first_rule(name, dims.PROPOSED_TYPES), folder)


def project_of(path: Column, name: Column, tags: Column, projects: dict[str, str]) -> Column:
    """The project of the first key found in path or name, else of the first tag that contains one."""
    if not projects:
        return F.lit(None).cast("string")
    direct = [F.when(F.contains(path, F.lit(k)) | F.contains(name, F.lit(k)), p) for k, p in projects.items()]
    of_tag = lambda t: F.coalesce(*[F.when(F.contains(F.lower(t), F.lit(k.lower())), p) for k, p in projects.items()])
    tagged = F.try_element_at(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), of_tag), lambda p: p.isNotNull()), F.lit(1))
    return F.coalesce(*direct, tagged)


def topic_tags(body: Column, name: Column, tags: Column, topics: dict[str, list[str]]) -> Column:
    """Topics of which a keyword occurs in text or name, unless tagged already, in the topics' order."""
    content = F.lower(F.concat_ws(" ", body, name))
    have = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    hit = lambda words: F.greatest(F.lit(False), *[F.contains(content, F.lit(w.lower())) for w in words])
    found = [F.when(hit(ws) & ~F.array_contains(have, t.lower()), F.lit(t)) for t, ws in topics.items()]
    return F.array_compact(F.array(*found))


def related_notes(notes: DataFrame, projects: dict[str, str], limit: int = 5, first: int = 1_024) -> DataFrame:
    """(key, related, score, place): notes of the same project (1), with at least two
    common tags (1 each) or of the same date in the name (2), from 3 points on; the
    first `limit` in the order of notes. All tags and dates count, however many notes
    hold them. A score of 3 needs common tags or a common date, so a common project
    is looked up for such pairs alone.

    The notes are walked in their order, `first` and then twice as many at a time.
    A note that has its `limit` leaves the walk, and so does one that can't reach 3
    points, so that the pairs of a frequent tag or date aren't all formed.
    """
    none = F.array().cast("array<string>")
    rows = notes.select("key", "name", "ord", project_of(F.col("path"), F.col("name"), F.col("tags"), projects).alias("project"), F.array_distinct(F.coalesce("tags", none)).alias("tags"), F.nullif(F.regexp_extract("name", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("day"))
    n_tags, dated, placed = F.size("tags"), F.col("day").isNotNull(), F.col("project").isNotNull()
    rows = cut_lineage(rows.where((n_tags >= 3) | ((n_tags >= 2) & (dated | placed)) | (dated & placed)))
    bounds, size, n = [], first, rows.count()
    while sum(bounds) < n:
        bounds.append(size)
        size *= 2
    ords = rows.select("ord")
    found, open_, low = None, rows, None
    for size in bounds:
        left = ords if low is None else ords.where(F.col("ord") > low)
        high = left.orderBy("ord").limit(size).agg(F.max("ord")).first()[0]
        if high is None:
            break
        part = rows.where((F.col("ord") <= high) & (F.lit(True) if low is None else F.col("ord") > low))
        end = lambda df, c: df.select(*[F.col(x).alias(f"{c}_{x}") for x in ("key", "name", "ord", "project")])
        at = lambda df, c: df.select(F.col("key").alias(c), F.explode("tags").alias("tag"))
        on = lambda df, c: df.where(F.col("day").isNotNull()).select(F.col("key").alias(c), "day")
        common = at(open_, "a").join(at(part, "b"), "tag").where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= 2)
        same_day = on(open_, "a").join(on(part, "b"), "day").where(F.col("a") != F.col("b")).select("a", "b", F.lit(2).cast("long").alias("points"))
        scores = common.unionByName(same_day).groupBy(F.col("a").alias("a_key"), F.col("b").alias("b_key")).agg(F.sum("points").alias("points"))
        full = scores.join(end(open_, "a"), "a_key").join(end(part, "b"), "b_key").where(F.col("a_name") != F.col("b_name"))
        score = F.col("points") + F.coalesce(F.col("a_project") == F.col("b_project"), F.lit(False)).cast("int")
        hits = full.withColumn("score", score).where(F.col("score") >= 3)
        place = F.row_number().over(Window.partitionBy("a_key").orderBy("b_ord", "b_key"))
        hits = hits.withColumn("place", place).where(F.col("place") <= limit).select(F.col("a_key").alias("key"), "b_key", "b_ord", F.col("b_name").alias("related"), "score")
        found = cut_lineage(hits if found is None else found.unionByName(hits))
        done = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
        open_, low = cut_lineage(rows.join(done.select("key"), "key", "left_anti")), high
    if found is None:
        return notes.sparkSession.createDataFrame([], "key string, related string, score long, place int")
    place = F.row_number().over(Window.partitionBy("key").orderBy("b_ord", "b_key"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("key", "related", "score", "place")


def mentions(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, short: int = 5, long: int = 12) -> DataFrame:
    """(id, mention) of every name (column mention, from `short` letters on) that occurs in a text.

    A mention begins with the first letters of its name, so the places of a text
    join the names on these and the whole name is compared afterwards: an equi-join
    instead of every text against every name. Names from `long` letters on join on
    as many, since many names share their first word.
    """
    known = names.where(F.length("mention") >= short).select("mention").distinct()
    size = F.when(F.length("mention") >= long, long).otherwise(short)
    prefixes = known.select(F.substr("mention", F.lit(1), size).alias("p"), "mention")
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= short)
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(n)))
    grams = rows.select("id", F.explode(F.array_distinct(F.concat(starts(short), starts(long)))).alias("p"))
    found = grams.join(prefixes, "p").select("id", "mention")
    return found.join(rows, "id").where(F.contains("text", F.col("mention"))).select("id", "mention").distinct()


def missing_backlinks(notes: DataFrame, min_length: int = 5, limit: int = 10) -> DataFrame:
    """(key, name): names of notes that a note's text mentions without a link, the longest first."""
    found = mentions(notes, notes.select(F.col("name").alias("mention")), "key", "body", min_length)
    own = notes.select(F.col("key").alias("id"), "name", F.coalesce("wiki_links", F.array().cast("array<string>")).alias("links"))
    hits = found.join(own, "id").where((F.col("mention") != F.col("name")) & ~F.array_contains("links", F.col("mention")))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.length("mention")), "mention"))
    return hits.withColumn("place", place).where(F.col("place") <= limit).select(F.col("id").alias("key"), F.col("mention").alias("name"))


def enrichment_plan(notes: DataFrame, projects: dict[str, str]) -> DataFrame:
    """(key, changes ARRAY<STRING>) for notes that lack a type or a project that can be inferred."""
    missing = lambda f: ~tx.present(F.get_json_object("frontmatter", f"$.{f}"))
    kind = proposed_type(F.col("name"), F.col("path"))
    project = project_of(F.col("path"), F.col("name"), F.col("tags"), projects)
    changes = F.array_compact(F.array(F.when(missing("type"), F.concat(F.lit("type: "), kind)), F.when(missing("project"), F.concat(F.lit("project: "), project))))
    return notes.select("key", changes.alias("changes")).where(F.size("changes") > 0)


def _field(name: str) -> Column:
    """A frontmatter field as text; objects and lists don't count."""
    text = F.get_json_object("frontmatter", f"$.{name}")
    # a typed link, as [[active]], begins like a list but isn't one
    many = text.startswith("{") | (text.startswith("[") & F.from_json(text, "array<string>").isNotNull())
    return F.when(~many, text)


def date_of_note() -> Column:
    """yyyy-MM-dd of the frontmatter's date fields, else name, key or path. A field that
    has just that form is taken as it is; else days that don't exist don't count."""
    exact = lambda c: F.when(tx.strip(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), tx.strip(c))
    fields = [F.coalesce(exact(_field(f)), tx.typed_date(tx.strip(_field(f)))) for f in dims.INFERRED_DATE_FIELDS]
    return F.coalesce(*fields, *[tx.typed_date(F.col(c)) for c in ("name", "key", "path")])


def inferred_date(notes: DataFrame) -> DataFrame:
    """(key, day) by date_of_note."""
    return notes.select("key", date_of_note().alias("day"))


def _haystack(*more: Column) -> Column:
    """What hints are looked up in: name, path, tags and the first headings, in lower case."""
    none = F.array().cast("array<string>")
    lists = [F.array_join(F.coalesce("tags", none), " "), F.array_join(F.slice(F.coalesce("headings", none), 1, 6), " ")]
    return F.lower(F.concat_ws(" ", F.col("name"), F.col("path"), *lists, *[F.coalesce(c, F.lit("")) for c in more]))


def _has(text: Column, words: list[str]) -> Column:
    return F.greatest(F.lit(False), *[F.contains(text, F.lit(w)) for w in words])


def source_kind() -> Column:
    """What a source is: its field if that is known, else by hints in name, path, tags,
    headings and addresses; null if nothing tells."""
    own = tx.slug(F.coalesce(_field("source_type"), F.lit("")))
    url, found = F.lower(F.coalesce(_field("url"), F.lit(""))), F.lower(F.coalesce(tx.first_url(F.col("body")), F.lit("")))
    text = _haystack(url, found)
    hinted = [F.when(_has(text, words), kind) for kind, words in dims.SOURCE_HINTS]
    web = F.when(url.startswith("http") | found.startswith("http") | _has(text, dims.SOURCE_WEB_HINTS), "article")
    folder = F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*map(F.lit, dims.SOURCE_NOTE_FOLDERS)))
    return F.coalesce(F.when(own.isin(dims.ENUM_FIELDS["source_type"]), own), *hinted, web, F.when(_has(text, dims.SOURCE_NOTE_HINTS) | F.coalesce(folder, F.lit(False)), "note"))


def tool_category() -> Column:
    """A tool's category: its field if that is known, else by hints; null if nothing tells."""
    own = tx.slug(F.coalesce(_field("category"), F.lit("")))
    text = _haystack(_field("url"))
    return F.coalesce(F.when(own.isin(dims.ENUM_FIELDS["category"]), own), *[F.when(_has(text, words), kind) for kind, words in dims.TOOL_HINTS], F.lit(None))


def _filled(name: str, value: Column) -> Column:
    """A field that is typed, else the value."""
    own = _field(name)
    return F.when(tx.present(F.get_json_object("frontmatter", f"$.{name}")), own).otherwise(value)


def normal_metadata(notes: DataFrame) -> DataFrame:
    """(key, type, status, confidence, event_date, decided, chosen, rationale, url,
    source_type, category): the fields of a note after normalisation. Types and statuses
    go by their aliases; a number as confidence becomes high, medium or low; a missing
    type is inferred, except for a blank note, and what a note of that type should have
    is taken from dates, labelled lines, addresses and hints. Fields that belong to no
    type of the note come out as typed; null where there is none."""
    raw = F.get_json_object("frontmatter", "$.type")
    low = F.lower(tx.strip(raw))
    alias = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    usual = F.coalesce(alias(dims.TYPE_ALIASES)[low], low)
    inferred = graph.entity_type()
    backfill = F.when((inferred != "note") | tx.present(F.col("body")), inferred)
    kind = F.when(~tx.present(raw), backfill).when(usual.isin(dims.CORE_TYPES), usual).otherwise(F.coalesce(alias(dims.EXTRA_TYPE_ALIASES)[low], raw))
    typed_status = F.get_json_object("frontmatter", "$.status")  # a list of one status counts as well
    status_key = tx.slug(typed_status)
    status = F.coalesce(alias(dims.STATUS_ALIASES)[status_key], status_key)
    status = F.when(status.isin(dims.ENUM_FIELDS["status"]) & (status != F.lower(tx.strip(typed_status))), status).otherwise(typed_status)
    number = F.expr("try_cast(trim(get_json_object(frontmatter, '$.confidence')) AS double)")
    level = F.when(number >= 0.75, "high").when(number >= 0.4, "medium").otherwise("low")
    confidence = F.when(number.isNotNull() & ~F.isnan(number), level).otherwise(_field("confidence"))
    rows = notes.select(
        "key", kind.alias("type"), status.alias("status"), confidence.alias("confidence"), F.coalesce(kind, inferred).alias("meant"),
        _field("event_date").alias("event_date"), _filled("event_date", date_of_note()).alias("event_date_"),
        _field("decided").alias("decided"), _filled("decided", date_of_note()).alias("decided_"),
        _field("chosen").alias("chosen"), _filled("chosen", tx.labelled_value(F.col("body"), dims.CHOSEN_PREFIXES)).alias("chosen_"),
        _field("rationale").alias("rationale"), _filled("rationale", tx.labelled_value(F.col("body"), dims.RATIONALE_PREFIXES)).alias("rationale_"),
        _field("url").alias("url"), _filled("url", tx.first_url(F.col("body"))).alias("url_"),
        (tx.present(F.get_json_object("frontmatter", "$.used_in")) | tx.present(F.get_json_object("frontmatter", "$.alternatives"))).alias("placed"),
        _field("source_type").alias("source_type"), F.coalesce(source_kind(), _field("source_type")).alias("source_type_"),
        _field("category").alias("category"), F.coalesce(tool_category(), _field("category")).alias("category_"),
    )
    of = lambda name, when: F.when(when, F.col(name + "_")).otherwise(F.col(name)).alias(name)
    is_ = lambda t: F.coalesce(F.col("meant") == t, F.lit(False))
    return rows.select(
        "key", "type", "status", "confidence", of("event_date", is_("event")), of("decided", is_("decision")), of("chosen", is_("decision")), of("rationale", is_("decision")),
        of("url", is_("source") | (is_("tool") & ~F.col("placed"))), of("source_type", is_("source")), of("category", is_("tool")),
    )


def unknown_kind(name: Column) -> Column:
    """A type for a node without one, by its name alone: extension, date, folder, words."""
    low = F.lower(name)
    image = F.greatest(F.lit(False), *[low.endswith(e) for e in dims.IMAGE_EXTENSIONS])
    extension = F.coalesce(*[F.when(low.endswith(e), t) for e, t in dims.EXTENSION_TYPES.items()])
    folder = (
        F.when(F.contains(low, F.lit("resource")) | F.contains(low, F.lit("03.")), "source")
        .when(F.contains(low, F.lit("project")) | F.contains(low, F.lit("01.")), "project")
        .when(F.contains(low, F.lit("daily")) | F.contains(low, F.lit("00.")), "event")
        .when(F.contains(low, F.lit("archive")) | F.contains(low, F.lit("04.")), "note")
    )
    words = F.coalesce(*[F.when(_has(low, ws), t) for ws, t in dims.UNKNOWN_KEYWORDS])
    return F.coalesce(F.when(image, "media"), extension, F.when(name.rlike(r"\d{4}-\d{2}-\d{2}"), "event"), folder, words, F.lit("note"))


def is_garbage(name: Column, is_dangling: Column) -> Column:
    """Broken references: images, code and very long names without a record, and opened brackets."""
    image = F.greatest(F.lit(False), *[F.lower(name).endswith(e) for e in [*dims.IMAGE_EXTENSIONS, ".pdf"]])
    special = F.length(name) - F.length(F.translate(name, "<>{}[]()=|&;,\"'\n\t", ""))
    return name.startswith("[") | (is_dangling & (image | (special > 3) | (F.length(name) > 200)))


def stub_notes(edges: DataFrame, nodes: DataFrame, day: str, least: int = 1) -> DataFrame:
    """(name, n_refs, content) of stubs for nodes without a record, with all referrers."""
    missing = nodes.where(F.col("is_dangling") & ~is_garbage(F.col("name"), F.lit(True))).select("name")
    into = edges.select(F.col("dst").alias("name"), "src").distinct().join(missing, "name", "left_semi")
    refs = into.groupBy("name").agg(F.count(F.lit(1)).alias("n_refs"), F.sort_array(F.collect_list("src")).alias("srcs")).where(F.col("n_refs") >= least)
    lines = F.array_join(F.transform("srcs", lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n")
    head = F.concat(F.lit(f"---\ntype: stub\ntags: [auto-generated]\ncreated: {day}\n---\n# "), F.col("name"))
    return refs.select("name", "n_refs", F.concat(head, F.lit("\n\n## References\n"), lines).alias("content"))


def bridge_components(labels: DataFrame, tags: DataFrame, shared: int = 2) -> DataFrame:
    """(src, dst, shared): for each node outside the largest component the node of it
    with most common tags, at least `shared`; among equals the least name. tags is (name, tag)."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("m")).select("m").scalar()
    marked = tags.distinct().join(labels, "name").withColumn("inside", F.col("component") == main)
    a, b = marked.where(~F.col("inside")).select("tag", F.col("name").alias("src")), marked.where("inside").select("tag", F.col("name").alias("dst"))
    pairs = a.join(b, "tag").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= shared)
    return pairs.groupBy("src").agg(F.min_by(F.struct("dst", "shared"), F.struct(-F.col("shared"), "dst")).alias("best")).select("src", "best.dst", "best.shared")


def replace_block(content: Column, marker: str, block: str) -> Column:
    """The text between <!-- AUTO:marker --> and <!-- /AUTO:marker --> replaced."""
    start, end = f"<!-- AUTO:{marker} -->", f"<!-- /AUTO:{marker} -->"
    literal = block.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(content, f"(?s)({re.escape(start)}).*?({re.escape(end)})", f"$1\n{literal}\n$2")


def patched_notes(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, content): notes with the plan's changes put in front of their frontmatter."""
    lines = F.array_join("changes", "\n")
    head, body = tx.frontmatter_text(F.col("content")), tx.body_text(F.col("content"))
    text = F.concat(F.lit("---\n"), lines, F.when(head != "", F.concat(F.lit("\n"), head)).otherwise(""), F.lit("\n---\n"), body)
    return notes.join(plan, "key").select("key", text.alias("content"))


def map_texts(df: DataFrame, key: str, text: str, f, out: str = "string") -> DataFrame:
    """(key, value): a user's function (a model, an embedder) over texts in Arrow batches."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "value": [None if t is None else f(t) for t in pdf[text]]})

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, value {out}")

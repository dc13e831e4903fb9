"""Queries of scans, projections and classifiers over notes and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegrid import dims
from notegrid.functions import text as tx
from notegrid.operators import enrich, graph, retrieve
from notegrid.plans.book import Book, with_

book = Book()

#: A vault's own rules, given to operators as parameters.
PROJECTS = {"Harbor": "Harbor", "Loom": "Loom", "Lighthouse": "Lighthouse"}
TOPICS = {
    "search": ["ranking", "reranker", "vector", "index", "색인"],
    "graph": ["ontology", "knowledge graph", "node", "edge", "그래프"],
    "ops": ["pipeline", "scheduler", "nightly", "deploy"],
    "writing": ["summary", "template", "draft", "glossary"],
}


def _cascade(c: str, rules: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{t}'" for p, t in rules)
    return f"CASE {whens} END"


_STRIP = "' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)"


@book.query(r"""SELECT ord, key, content LIKE '---%' AND regexp_matches(content, '(?s)^---\s*\n(.*?)\n---') AS has_frontmatter,
    length(regexp_replace(content, '(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)', '')) AS body_chars,
    regexp_replace(content, '(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)', '') = body AS same_body,
    length(regexp_extract(content, '(?s)^---\s*\n(.*?)\n---', 1)) AS yaml_chars FROM notes""")
def px1_frontmatter(v):
    c = F.col("content")
    body, head = tx.body_text(c), tx.frontmatter_text(c)
    return v.notes.select("ord", "key", (head != "").alias("has_frontmatter"), F.length(body).alias("body_chars"), (body == F.col("body")).alias("same_body"), F.length(head).alias("yaml_chars"))


@book.query(r"""WITH f AS (SELECT ord, regexp_extract_all(body, '\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]+?)?\]\]', 1) AS l FROM notes),
    e AS (SELECT ord, trim(unnest(l)) AS link, generate_subscripts(l, 1) AS pos FROM f),
    d AS (SELECT ord, link, min(pos) AS pos FROM e WHERE link <> '' GROUP BY 1, 2)
    SELECT ord, link, row_number() OVER (PARTITION BY ord ORDER BY pos) AS place FROM d""")
def px2_wiki_links(v):
    links = v.notes.select("ord", F.posexplode(tx.wiki_links(F.col("body"))).alias("pos", "link"))
    return links.select("ord", "link", (F.col("pos") + 1).cast("long").alias("place"))


@book.query(rf"""WITH y AS (SELECT ord, CASE json_type(frontmatter, '$.tags') WHEN 'ARRAY' THEN json_extract_string(frontmatter, '$.tags[*]')
      WHEN 'VARCHAR' THEN string_split(json_extract_string(frontmatter, '$.tags'), ',') ELSE [] END AS t, body FROM notes WHERE body IS NOT NULL),
    a AS (SELECT ord, list_concat(coalesce(list_transform(list_filter(t, lambda x: x IS NOT NULL), lambda x: ltrim(trim(x, {_STRIP}), '#')), []),
      list_filter(regexp_extract_all(body, '(?m)(?:^|\s)#([a-zA-Z가-힣][a-zA-Z0-9가-힣_/-]*)', 1), lambda x: length(x) > 1)) AS t FROM y)
    SELECT ord, list_sort(list_distinct(list_filter(t, lambda x: x <> ''))) AS tags FROM a""")
def px3_tags(v):
    return v.notes.select("ord", tx.all_tags(F.col("frontmatter"), F.col("body")).alias("tags"))


@book.query(rf"""WITH l AS (SELECT ord, list_transform(string_split(body, chr(10)), lambda s: trim(s, {_STRIP})) AS l FROM notes)
    SELECT ord, list_filter(list_transform(list_filter(l, lambda s: starts_with(s, '#') AND contains(s, ' ') AND length(s) - length(ltrim(s, '#')) <= 4),
      lambda s: trim(ltrim(s, '#'), {_STRIP})), lambda s: s <> '') AS headings FROM l""")
def px4_headings(v):
    return v.notes.select("ord", tx.headings(F.col("body")).alias("headings"))


@book.query("""SELECT ord, substr(sha256(content), 1, 16) AS checksum, substr(sha256(content), 1, 16) = checksum AS same FROM notes""")
def px6_checksum(v):
    return v.notes.select("ord", tx.checksum(F.col("content")).alias("checksum"), (tx.checksum(F.col("content")) == F.col("checksum")).alias("same"))


@book.query("SELECT doc_id, substr(text, 1, 200) AS snippet, substr(text, 1, 500) AS preview FROM documents WHERE text <> ''")
def px8_snippets(v):
    return v.documents.where(F.col("text") != "").select("doc_id", F.substring("text", 1, 200).alias("snippet"), F.substring("text", 1, 500).alias("preview"))


@book.query(r"""WITH r AS (SELECT ord, path, trim(lower(regexp_replace(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '(?i)\.md$', '')), '/') AS ref FROM (SELECT ord, url_decode(path) AS path FROM notes))
    SELECT ord, ref, string_split(ref, '/')[-1] AS stem FROM r""")
def px9_references(v):
    return v.notes.select("ord", tx.normal_ref(F.col("path")).alias("ref"), tx.stem(F.col("path")).alias("stem"))


@book.query(r"""SELECT DISTINCT name, trim(regexp_replace(lower(name), '[^a-z0-9+-]+', '-', 'g'), '-') AS slug FROM knowledge_nodes WHERE source IN ('vault', 'memory')""")
def px15_slugs(v):
    nodes = v.knowledge_nodes.where(F.col("source").isin("vault", "memory"))
    return nodes.select("name", tx.slug(F.col("name")).alias("slug")).distinct()


def _date_sql(c: str) -> str:
    """First date of this century in c, with separators, else compact; RE2 has no look-around, so the digits' guards are matched too."""
    found = [f"nullif(regexp_extract({c}, '(?:^|[^0-9])(20\\d{{2}}{sep}\\d{{2}}{sep}\\d{{2}})(?:[^0-9]|$)', 1), '')" for sep in ("[-_.]", "")]
    return "coalesce(" + ", ".join(f"strftime(try_strptime(regexp_replace({f}, '[-_.]', '', 'g'), '%Y%m%d'), '%Y-%m-%d')" for f in found) + ")"


def _exact_or_date(f: str) -> str:
    text = f"trim(json_extract_string(frontmatter, '$.{f}'), {_STRIP})"
    return f"CASE WHEN json_type(frontmatter, '$.{f}') = 'VARCHAR' THEN coalesce(CASE WHEN regexp_matches({text}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {text} END, {_date_sql(text)}) END"


_DAY = f"coalesce({', '.join(_exact_or_date(f) for f in dims.INFERRED_DATE_FIELDS)}, {', '.join(_date_sql(c) for c in ('name', 'key', 'path'))})"


@book.query(f"{with_('cur')} SELECT key, {_DAY} AS day FROM cur")
def px16_dates(v):
    return enrich.inferred_date(v.current())


@book.query(r"""WITH u AS (SELECT doc_id, rtrim(regexp_extract(text, 'https?://[^\s<>"]+', 0), '.,;:)]}"' || chr(39)) AS url FROM documents)
    SELECT doc_id, url, regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1) AS domain FROM u WHERE url <> '' """)
def px17_urls(v):
    rows = v.documents.select("doc_id", tx.first_url(F.col("text")).alias("url")).where(F.col("url").isNotNull())
    return rows.select("doc_id", "url", tx.domain(F.col("url")).alias("domain"))


def _classify_sql() -> str:
    aliases = " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in dims.TYPE_ALIASES.items())
    raw = f"lower(trim(CASE WHEN json_type(frontmatter, '$.type') = 'VARCHAR' THEN json_extract_string(frontmatter, '$.type') ELSE CAST(json_extract(frontmatter, '$.type') AS VARCHAR) END, {_STRIP}))"
    core = ", ".join(f"'{t}'" for t in dims.CORE_TYPES)
    scores = ", ".join(f"len(list_intersect(low, [{', '.join(repr(w) for w in ws)}])) AS s_{t}" for t, ws in dims.TAG_TYPES.items())
    folders = " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in dims.FOLDER_TYPES.items())
    most = f"greatest({', '.join('s_' + t for t in dims.TAG_TYPES)})"
    by_tag = " ".join(f"WHEN s_{t} = {most} THEN '{t}'" for t in dims.TAG_TYPES)
    return f"""{with_("cur")}, a AS (SELECT *, {raw} AS raw, list_distinct(list_transform(coalesce(tags, []), lambda x: lower(x))) AS low FROM cur),
      b AS (SELECT *, CASE raw {aliases} ELSE raw END AS typed, {scores} FROM a),
      c AS (SELECT key, coalesce(CASE WHEN typed IN ({core}) THEN typed END, {_cascade("name", dims.NAME_TYPES)},
        CASE WHEN {most} > 0 THEN CASE {by_tag} END END,
        list_filter(list_transform(string_split(path, '/'), lambda p: CASE p {folders} END), lambda t: t IS NOT NULL)[1], 'note') AS entity_type FROM b)"""


@book.query(_classify_sql() + " SELECT key, entity_type FROM c")
def fl1_entity_types(v):
    return graph.classify_notes(v.current())


def _f(name: str) -> str:
    return f"CASE WHEN json_type(frontmatter, '$.{name}') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN json_extract_string(frontmatter, '$.{name}') END"


_TYPED = "CASE WHEN json_type(frontmatter, '$.type') = 'VARCHAR' THEN json_extract_string(frontmatter, '$.type') WHEN json_type(frontmatter, '$.type') <> 'NULL' THEN CAST(json_extract(frontmatter, '$.type') AS VARCHAR) END"
SEGMENTS = ("Harbor", "Loom")


@book.query(f"""{_classify_sql()}, e AS (SELECT cur.*, entity_type, coalesce(list_contains(json_keys(frontmatter), 'type'), false) AS typed FROM cur JOIN c ON c.key = cur.key)
    SELECT key, substr(concat_ws(chr(10), '# ' || name, 'Project: ' || CASE WHEN contains(path, 'Harbor') THEN 'Harbor' WHEN contains(path, 'Loom') THEN 'Loom' END,
      CASE WHEN len(coalesce(tags, [])) > 0 THEN 'Tags: ' || coalesce(array_to_string(tags, ', '), '') END, 'Type: ' || nullif(CASE WHEN typed THEN {_TYPED} ELSE entity_type END, ''), trim(coalesce(body, ''), {_STRIP})), 1, 2000) AS text FROM e""")
def px7_embedding_text(v):
    return retrieve.embedding_text(v.current(), SEGMENTS)


@book.query(f"""{with_("cur")}, q AS (SELECT key, name AS question,
    {", ".join("(" + " + ".join(f"CAST(regexp_matches(name, '(?i){p}') AS INT)" for p in ps) + f") AS {k}" for k, ps in dims.QUESTION_PATTERNS.items())} FROM cur)
    SELECT key, CASE WHEN factual >= greatest(relational, exploratory) THEN 'factual' WHEN relational >= exploratory THEN 'relational' ELSE 'exploratory' END AS kind FROM q""")
def fl3_question_kinds(v):
    return v.current().select("key", retrieve.question_kind(F.col("name")).alias("kind"))


@book.query(f"""{with_("cur")} SELECT key, coalesce({_cascade("name", dims.PROPOSED_TYPES)},
    {", ".join(f"CASE WHEN contains(path, '{p}') THEN '{t}' END" for p, t in dims.PROPOSED_FOLDERS)}) AS proposed FROM cur""")
def fl5_proposed_types(v):
    return v.current().select("key", enrich.proposed_type(F.col("name"), F.col("path")).alias("proposed"))


@book.query(f"""{with_("cur")} SELECT key, coalesce({", ".join(f"CASE WHEN contains(path, '{k}') OR contains(name, '{k}') THEN '{p}' END" for k, p in PROJECTS.items())},
    list_filter(list_transform(coalesce(tags, []), lambda t: CASE {" ".join(f"WHEN contains(lower(t), '{k.lower()}') THEN '{p}'" for k, p in PROJECTS.items())} END), lambda x: x IS NOT NULL)[1]) AS project FROM cur
""")
def fl6_projects(v):
    return v.current().select("key", enrich.project_of(F.col("path"), F.col("name"), F.col("tags"), PROJECTS).alias("project"))


@book.query(f"""{with_("cur")}, a AS (SELECT key, lower(concat_ws(' ', body, name)) AS c, list_transform(coalesce(tags, []), lambda x: lower(x)) AS have FROM cur)
    SELECT key, list_filter([{", ".join("CASE WHEN (" + " OR ".join(f"contains(c, '{w}')" for w in ws) + f") AND NOT list_contains(have, '{t}') THEN '{t}' END" for t, ws in TOPICS.items())}],
      lambda x: x IS NOT NULL) AS topics FROM a""")
def fl7_topics(v):
    return v.current().select("key", enrich.topic_tags(F.col("body"), F.col("name"), F.col("tags"), TOPICS).alias("topics"))


@book.query(f"""{with_("kg", "live", "gn")} SELECT name, CASE WHEN {" OR ".join(f"lower(name) LIKE '%{e}'" for e in dims.IMAGE_EXTENSIONS)} THEN 'media'
    {" ".join(f"WHEN lower(name) LIKE '%{e}' THEN '{t}'" for e, t in dims.EXTENSION_TYPES.items())}
    WHEN regexp_matches(name, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'event' WHEN lower(name) LIKE '%resource%' OR lower(name) LIKE '%03.%' THEN 'source'
    WHEN lower(name) LIKE '%project%' OR lower(name) LIKE '%01.%' THEN 'project' WHEN lower(name) LIKE '%daily%' OR lower(name) LIKE '%00.%' THEN 'event'
    WHEN lower(name) LIKE '%archive%' OR lower(name) LIKE '%04.%' THEN 'note'
    {" ".join("WHEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in ws) + f" THEN '{t}'" for ws, t in dims.UNKNOWN_KEYWORDS)} ELSE 'note' END AS kind
    FROM gn WHERE entity_type IS NULL""")
def fl11_unknown_nodes(v):
    return v.nodes().where(F.col("entity_type").isNull()).select("name", enrich.unknown_kind(F.col("name")).alias("kind"))


@book.query(f"""{with_("kg", "live", "gn")} SELECT name FROM gn WHERE starts_with(name, '[') OR (is_dangling AND (
    {" OR ".join(f"lower(name) LIKE '%{e}'" for e in [*dims.IMAGE_EXTENSIONS, ".pdf"])}
    OR length(name) - length(translate(name, '<>{{}}[]()=|&;,"''' || chr(10) || chr(9), '')) > 3 OR length(name) > 200))""")
def fl12_garbage_nodes(v):
    return v.nodes().where(enrich.is_garbage(F.col("name"), F.col("is_dangling"))).select("name")


@book.query(f"""{with_("live")} SELECT name, entity_type FROM live WHERE contains(lower(name), 'ledger') ORDER BY name LIMIT 10""")
def fl24_lookup(v):
    return v.live().where(F.contains(F.lower("name"), F.lit("ledger"))).select("name", "entity_type").orderBy("name").limit(10)


@book.query("""SELECT id, name, CASE WHEN name ILIKE '%forge%' THEN 0 ELSE 1 END AS place FROM knowledge_nodes
    WHERE name ILIKE '%forge%' OR content ILIKE '%forge%' ORDER BY place, updated_at DESC NULLS LAST, id, name LIMIT 50""")
def fl25_keyword_rows(v):
    hit = F.ilike(F.col("name"), F.lit("%forge%"))
    rows = v.knowledge_nodes.where(hit | F.ilike(F.col("content"), F.lit("%forge%")))
    place = F.when(hit, 0).otherwise(1)
    return rows.orderBy(place, F.desc_nulls_last("updated_at"), "id", "name").limit(50).select("id", "name", place.alias("place"))


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _slug_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(trim({c}, {_STRIP})), '[^a-z0-9+-]+', '-', 'g'), '-')"


_URL = "nullif(rtrim(regexp_extract(body, 'https?://[^\\s<>\"]+', 0), '.,;:)]}\"' || chr(39)), '')"
_ALIAS = lambda d, c: " ".join(f"WHEN {c} = '{a}' THEN '{t}'" for a, t in d.items())
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_HAY = "lower(concat_ws(' ', name, path, array_to_string(coalesce(tags, []), ' '), array_to_string(coalesce(headings, [])[1:6], ' ')))"
_KINDS = f"""n0 AS (SELECT cur.*, entity_type, {_URL} AS found, lower(coalesce({_f('url')}, '')) AS own_url, {_HAY} AS hay FROM cur JOIN c ON c.key = cur.key),
    n1 AS (SELECT *, concat_ws(' ', hay, own_url, lower(coalesce(found, ''))) AS s, concat_ws(' ', hay, own_url) AS t,
      {_slug_sql(f"coalesce({_f('source_type')}, '')")} AS own_kind, {_slug_sql(f"coalesce({_f('category')}, '')")} AS own_category FROM n0),
    n2 AS (SELECT *, CASE WHEN own_kind IN {_IN(dims.ENUM_FIELDS["source_type"])} THEN own_kind {" ".join(f"WHEN {_any('s', ws)} THEN '{k}'" for k, ws in dims.SOURCE_HINTS)}
        WHEN own_url LIKE 'http%' OR found IS NOT NULL OR {_any("s", dims.SOURCE_WEB_HINTS)} THEN 'article'
        WHEN {_any("s", dims.SOURCE_NOTE_HINTS)} OR list_has_any(string_split(lower(path), '/'), {dims.SOURCE_NOTE_FOLDERS}) THEN 'note' END AS source_kind,
      CASE WHEN own_category IN {_IN(dims.ENUM_FIELDS["category"])} THEN own_category {" ".join(f"WHEN {_any('t', ws)} THEN '{k}'" for k, ws in dims.TOOL_HINTS)} END AS tool_category FROM n1)"""


@book.query(f"{_classify_sql()}, {_KINDS} SELECT key, source_kind, tool_category FROM n2")
def fl9_source_and_tool_kinds(v):
    return v.current().select("key", enrich.source_kind().alias("source_kind"), enrich.tool_category().alias("tool_category"))


def _label_sql(prefixes: list[str]) -> str:
    lines = f"list_transform(string_split_regex(coalesce(body, ''), '\\r\\n|\\r|\\n'), lambda l: trim(l, {_STRIP}))"
    hit = " OR ".join(f"starts_with(lower(l), '{p}')" for p in prefixes)
    size = "CASE " + " ".join(f"WHEN starts_with(lower(l), '{p}') THEN {len(p)}" for p in prefixes) + " END"
    return f"nullif(list_transform(list_filter({lines}, lambda l: {hit}), lambda l: trim(substr(l, {size} + 1), ' -:'))[1], '')"


@book.query(f"{with_('cur')} SELECT key, {_label_sql(dims.CHOSEN_PREFIXES)} AS chosen, {_label_sql(dims.RATIONALE_PREFIXES)} AS rationale FROM cur")
def px18_labelled_values(v):
    body = F.col("body")
    return v.current().select("key", tx.labelled_value(body, dims.CHOSEN_PREFIXES).alias("chosen"), tx.labelled_value(body, dims.RATIONALE_PREFIXES).alias("rationale"))


_HAVE = lambda f: f"coalesce(trim(CASE WHEN json_type(frontmatter, '$.{f}') = 'VARCHAR' THEN json_extract_string(frontmatter, '$.{f}') WHEN json_type(frontmatter, '$.{f}') <> 'NULL' THEN CAST(json_extract(frontmatter, '$.{f}') AS VARCHAR) END, {_STRIP}) <> '', false)"
_FILL = lambda f, x: f"CASE WHEN {_HAVE(f)} THEN {_f(f)} ELSE {x} END"
_STATUS = _TYPED.replace("$.type", "$.status")
_NORMAL = f"""n3 AS (SELECT *, {_TYPED} AS raw, lower(trim({_TYPED}, {_STRIP})) AS low, {_slug_sql(_STATUS)} AS sk, TRY_CAST(trim({_f("confidence")}) AS DOUBLE) AS num FROM n2),
    n4 AS (SELECT *, CASE {_ALIAS(dims.TYPE_ALIASES, "low")} ELSE low END AS usual, CASE {_ALIAS(dims.STATUS_ALIASES, "sk")} ELSE sk END AS st FROM n3),
    n5 AS (SELECT *, CASE WHEN NOT {_HAVE("type")} THEN CASE WHEN entity_type <> 'note' OR trim(coalesce(body, ''), {_STRIP}) <> '' THEN entity_type END
        WHEN usual IN {_IN(dims.CORE_TYPES)} THEN usual ELSE CASE {_ALIAS(dims.EXTRA_TYPE_ALIASES, "low")} ELSE raw END END AS kind FROM n4),
    n6 AS (SELECT *, coalesce(kind, entity_type) AS meant FROM n5)"""


@book.query(f"""{_classify_sql()}, {_KINDS}, {_NORMAL} SELECT key, kind AS type, CASE WHEN st IN {_IN(dims.ENUM_FIELDS["status"])} AND st <> lower(trim({_STATUS}, {_STRIP})) THEN st ELSE {_STATUS} END AS status,
    CASE WHEN num >= 0.75 THEN 'high' WHEN num >= 0.4 THEN 'medium' WHEN num IS NOT NULL THEN 'low' ELSE {_f("confidence")} END AS confidence,
    CASE WHEN meant = 'event' THEN {_FILL("event_date", _DAY)} ELSE {_f("event_date")} END AS event_date, CASE WHEN meant = 'decision' THEN {_FILL("decided", _DAY)} ELSE {_f("decided")} END AS decided,
    CASE WHEN meant = 'decision' THEN {_FILL("chosen", _label_sql(dims.CHOSEN_PREFIXES))} ELSE {_f("chosen")} END AS chosen,
    CASE WHEN meant = 'decision' THEN {_FILL("rationale", _label_sql(dims.RATIONALE_PREFIXES))} ELSE {_f("rationale")} END AS rationale,
    CASE WHEN meant = 'source' OR (meant = 'tool' AND NOT {_HAVE("used_in")} AND NOT {_HAVE("alternatives")}) THEN {_FILL("url", "found")} ELSE {_f("url")} END AS url,
    CASE WHEN meant = 'source' THEN coalesce(source_kind, {_f("source_type")}) ELSE {_f("source_type")} END AS source_type,
    CASE WHEN meant = 'tool' THEN coalesce(tool_category, {_f("category")}) ELSE {_f("category")} END AS category FROM n6""")
def va11_normal_metadata(v):
    return enrich.normal_metadata(v.current())


@book.query(f"""{with_("cur")}, p AS (SELECT key, coalesce({_cascade("name", dims.PROPOSED_TYPES)}, {", ".join(f"CASE WHEN contains(path, '{p}') THEN '{t}' END" for p, t in dims.PROPOSED_FOLDERS)}) AS proposed
    FROM cur WHERE coalesce(trim(CAST(json_extract(frontmatter, '$.type') AS VARCHAR)) IN ('', 'null', '""'), TRUE)) SELECT key, 'type: ' || proposed AS change FROM p WHERE proposed IS NOT NULL""")
def en1_type_plan(v):
    plan = enrich.enrichment_plan(v.current(), {})
    return plan.select("key", F.explode("changes").alias("change"))


@book.query()
def en1_patched_notes(v):
    notes = v.current()
    return enrich.patched_notes(notes, enrich.enrichment_plan(notes, PROJECTS))


@book.query()
def gb4_semantic_relations(v):
    return graph.semantic_relations(v.current())


QUERIES, ORACLE = book.queries, book.oracle

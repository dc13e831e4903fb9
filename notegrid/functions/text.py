"""Column expressions over note texts. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIKI_LINK = r"\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]+?)?\]\]"
INLINE_TAG = r"(?m)(?:^|\s)#([a-zA-Z가-힣][a-zA-Z0-9가-힣_/-]*)"
FRONTMATTER = r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)"
FRONTMATTER_LOOSE = r"(?s)^---\s*\n(.*?)\n---"
BLANKS = " \t\r\n\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def frontmatter_text(content: Column) -> Column:
    """The YAML between the first pair of fences, '' if there is none."""
    strict = F.regexp_extract(content, FRONTMATTER, 1)
    return F.when(content.rlike(FRONTMATTER), strict).otherwise(F.regexp_extract(content, FRONTMATTER_LOOSE, 1))


def body_text(content: Column) -> Column:
    """The text after the frontmatter; a closing fence that ends no line counts too."""
    loose = F.regexp_replace(content, FRONTMATTER_LOOSE, "")
    return F.when(content.rlike(FRONTMATTER), F.regexp_replace(content, FRONTMATTER, "")).otherwise(loose)


def wiki_links(body: Column) -> Column:
    """Distinct link targets in order, without anchor and alias."""
    found = F.transform(F.regexp_extract_all(body, F.lit(WIKI_LINK), 1), strip)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def json_texts(json: Column, field: str) -> Column:
    """A field of a JSON object as an array of texts: a text is split at commas, other values give none."""
    text = F.get_json_object(json, f"$.{field}")
    items = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.when(items.isNotNull(), items).when(text.isNotNull(), F.split(text, ",")).otherwise(F.array().cast("array<string>"))


def all_tags(frontmatter: Column, body: Column) -> Column:
    """Sorted distinct tags of the frontmatter and of the text (of more than one letter)."""
    typed = F.transform(F.filter(json_texts(frontmatter, "tags"), lambda t: t.isNotNull()), lambda t: F.ltrim(strip(t), F.lit("#")))
    inline = F.filter(F.regexp_extract_all(body, F.lit(INLINE_TAG), 1), lambda t: F.length(t) > 1)
    return F.array_sort(F.array_distinct(F.filter(F.concat(typed, inline), lambda t: t != "")))


def headings(body: Column) -> Column:
    """Markdown headings of levels 1 to 4."""
    lines = F.transform(F.split(body, "\n"), strip)
    level = lambda s: F.length(s) - F.length(F.ltrim(s, F.lit("#")))
    kept = F.filter(lines, lambda s: s.startswith("#") & s.contains(" ") & (level(s) <= 4))
    return F.filter(F.transform(kept, lambda s: strip(F.ltrim(s, F.lit("#")))), lambda s: s != "")


def checksum(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def normal_ref(c: Column) -> Column:
    """A reference for comparison: unquoted, slashed, without .md, lower case. A plus stays a plus."""
    plain = strip(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c))
    slashed = F.regexp_replace(F.translate(plain, "\\", "/"), "/+", "/")
    return F.btrim(F.lower(F.regexp_replace(slashed, r"(?i)\.md$", "")), F.lit("/"))


def stem(c: Column) -> Column:
    return F.element_at(F.split(normal_ref(c), "/"), -1)


def slug(c: Column) -> Column:
    """Lower case; letters, digits, plus and minus stay, what is between becomes one minus."""
    return F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9+-]+", "-"), F.lit("-"))


def unwrap_link(c: Column) -> Column:
    """The target of a text that is one link, else the text."""
    inner = F.regexp_extract(strip(c), r"^\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]+?)?\]\]$", 1)
    return F.when(inner != "", strip(inner)).otherwise(strip(c))


def first_url(c: Column) -> Column:
    """The first http(s) address without trailing punctuation; null if there is none."""
    found = F.rtrim(F.regexp_extract(c, r"https?://[^\s<>\"]+", 0), F.lit(".,;:)]}\"'"))
    return F.when(found != "", found)


def domain(url: Column) -> Column:
    return F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1)


def typed_date(c: Column) -> Column:
    """The first date of this century in a text that exists, as yyyy-MM-dd: with
    separators, else compact, not inside a longer number; null if there is none."""
    apart = [F.regexp_extract(c, rf"(?<!\d)(20\d{{2}}){sep}(\d{{2}}){sep}(\d{{2}})(?!\d)", 0) for sep in ("[-_.]", "")]
    day = lambda t: F.date_format(F.try_to_date(F.regexp_replace(t, r"[-_.]", ""), "yyyyMMdd"), "yyyy-MM-dd")
    return F.coalesce(*[day(t) for t in apart])


def labelled_value(body: Column, prefixes: list[str]) -> Column:
    """What follows the first line that begins with one of the prefixes, without regard to case; null if nothing does."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"), strip)
    starts = lambda s: F.greatest(F.lit(False), *[F.lower(s).startswith(p) for p in prefixes])
    size = lambda s: F.coalesce(*[F.when(F.lower(s).startswith(p), len(p)) for p in prefixes])
    rest = F.transform(F.filter(lines, starts), lambda s: F.btrim(F.substring(s, size(s) + 1, F.length(s)), F.lit(" -:")))
    return F.nullif(F.try_element_at(rest, F.lit(1)), F.lit(""))


def present(c: Column) -> Column:
    """A value that is neither null nor blank."""
    return F.coalesce(strip(c) != "", F.lit(False))


def keywords(query: str) -> list[str]:
    """Words of a query of more than one letter; repeated ones count again."""
    return [w for w in query.lower().replace(",", " ").split() if len(w) > 1]


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word, metacharacters being literal."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))


def _contains(word: Column):
    return lambda t: F.contains(F.lower(t), word)


def keyword_score(name: Column, key: Column, body: Column, tags: Column, query: str) -> Column:
    """Sum over the query's words: in the name 3, being the name 5 more, in the key
    alone 1, in the text 0.5 each up to 3, and in each tag 2."""
    name, key, body = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, key, body))
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    total = F.lit(0.0)
    for word in keywords(query):
        w = F.lit(word)
        total = total + F.when(F.contains(name, w), 3.0).when(F.contains(key, w), 1.0).otherwise(0.0)
        total = total + F.when(name == w, 5.0).otherwise(0.0)
        total = total + F.least(occurrences(body, word) * 0.5, F.lit(3.0))
        total = total + F.size(F.filter(tags, _contains(w))) * 2.0
    return total


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The result of the first pattern that is found in c, without regard to case; null if none is."""
    return F.coalesce(*[F.when(c.rlike("(?i)" + pattern), F.lit(to)) for pattern, to in rules], F.lit(None))

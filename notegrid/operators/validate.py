"""Shape constraints over notes and graphs, as rows of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid import dims
from notegrid.functions import text as tx
from notegrid.operators import analytics, graph

_VIOLATION = "struct<severity:string,rule:string,field:string,actual:string>"


_FIELDS = sorted({
    "type", "local_path", *dims.ENUM_FIELDS, *dims.DATE_FIELDS, *dims.URL_FIELDS, *(f for fs in dims.REQUIRED_FIELDS.values() for f in fs),
    *(f for fs in dims.ANY_OF_FIELDS.values() for f in fs), *(f for _, fs, _ in dims.CARDINALITY for f in fs),
})


def _parsed(notes: DataFrame) -> DataFrame:
    """Notes with the checked fields of the frontmatter in a column `fm`, parsed once."""
    return notes.withColumn("fm", F.from_json("frontmatter", ", ".join(f"`{f}` string" for f in _FIELDS)))


def _field(name: str) -> Column:
    """A frontmatter field as text; an empty list or object is no value."""
    text = F.col("fm")[name]
    return F.when(~text.isin("[]", "{}") & tx.present(text), text)


def _violation(when: Column, severity: str, rule: str, field: str, actual: Column | None = None) -> Column:
    row = F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(field).alias("field"), (F.lit(None) if actual is None else actual).cast("string").alias("actual"))
    return F.when(when, row.cast(_VIOLATION))


def note_violations(notes: DataFrame, types: DataFrame) -> DataFrame:
    """(key, entity_type, severity, rule, field, actual) of the checks that need one
    note alone: its type, closed lists, dates, addresses, required fields."""
    rows = _parsed(notes).join(types, "key")
    raw = _field("type")
    plain = F.lower(tx.strip(raw))
    aliases = F.create_map(*[F.lit(x) for kv in dims.TYPE_ALIASES.items() for x in kv])
    kind = F.coalesce(aliases[plain], plain)
    checks = [
        _violation(raw.isNull(), "warning", "missing-explicit-type", "type"),
        _violation(~kind.isin(dims.CORE_TYPES), "warning", "invalid-type", "type", raw),
        _violation(kind.isin(dims.CORE_TYPES) & (plain != kind), "warning", "type-alias-used", "type", raw),
    ]
    for field, allowed in dims.ENUM_FIELDS.items():
        v = _field(field)
        checks.append(_violation(~F.lower(tx.strip(v)).isin(allowed), "warning", "invalid-enum-value", field, v))
    for field in dims.DATE_FIELDS:
        v = _field(field)
        checks.append(_violation(~tx.strip(v).rlike(r"^\d{4}-\d{2}-\d{2}$"), "error", "invalid-date-format", field, v))
    for field in dims.URL_FIELDS:
        v = _field(field)
        checks.append(_violation(~tx.strip(v).rlike("(?i)^https?://"), "error", "invalid-url", field, v))
    path = _field("local_path")
    checks.append(_violation(~path.rlike(r"^(?:[A-Za-z]:\\|/|~)\S+"), "warning", "invalid-local-path", "local_path", path))
    for t, fields in dims.REQUIRED_FIELDS.items():
        checks += [_violation((F.col("entity_type") == t) & _field(f).isNull(), "warning", "missing-required-field", f) for f in fields]
    for t, fields in dims.ANY_OF_FIELDS.items():
        none = F.coalesce(*[_field(f) for f in fields]).isNull()
        checks.append(_violation((F.col("entity_type") == t) & none, "warning", "missing-supporting-context", ", ".join(fields)))
    return rows.select("key", "entity_type", F.inline(F.array_compact(F.array(*checks))))


def relation_violations(relations: DataFrame, types: DataFrame, names: DataFrame) -> DataFrame:
    """The same columns for relations (key, relation, target): unusual owners, and
    targets of unknown or unfit type. names is (name, key); keys win over names."""
    owners, targets = (F.create_map(*[x for r, ts in table.items() for x in (F.lit(r), F.array(*map(F.lit, ts)))]) for table in (dims.RELATION_OWNERS, dims.RELATION_TARGETS))
    rows = relations.join(types, "key").withColumn("target_name", tx.unwrap_link(F.col("target")))
    owner = rows.select("key", "entity_type", "relation").distinct().where(~F.array_contains(owners[F.col("relation")], F.col("entity_type")))
    owner = owner.select("key", "entity_type", F.lit("warning").alias("severity"), F.lit("relation-owner-mismatch").alias("rule"), F.col("relation").alias("field"), F.col("entity_type").alias("actual"))
    typed = types.withColumnRenamed("entity_type", "t")
    by_name = names.join(typed, "key").groupBy(F.col("name").alias("target_name")).agg(F.min_by("t", "key").alias("by_name"))
    by_key = typed.select(F.col("key").alias("target_name"), F.col("t").alias("by_key"))
    found = rows.join(by_key, "target_name", "left").join(by_name, "target_name", "left").withColumn("t", F.coalesce("by_key", "by_name", F.lit("unknown")))
    allowed = targets[F.col("relation")]
    unknown = F.col("t") == "unknown"
    bad = found.where(allowed.isNotNull() & (unknown | ~F.array_contains(allowed, F.col("t"))))
    bad = bad.select(
        "key", "entity_type", F.when(unknown, "warning").otherwise("error").alias("severity"),
        F.when(unknown, "relation-target-unknown").otherwise("relation-target-mismatch").alias("rule"), F.col("relation").alias("field"),
        F.when(unknown, F.col("target_name")).otherwise(F.format_string("%s (%s)", "target_name", "t")).alias("actual"),
    )
    return owner.unionByName(bad)


def cardinality_violations(notes: DataFrame, types: DataFrame) -> DataFrame:
    """Types that need at least so many of several fields."""
    rows = _parsed(notes).join(types, "key")
    checks = []
    for t, fields, least in dims.CARDINALITY:
        n = sum((_field(f).isNotNull().cast("int") for f in fields), F.lit(0))
        checks.append(_violation((F.col("entity_type") == t) & (n < least), "warning", "cardinality-violation", ", ".join(fields), F.concat(n.cast("string"), F.lit(f"/{least}"))))
    return rows.select("key", "entity_type", F.inline(F.array_compact(F.array(*checks))))


def dangling_violations(edges: DataFrame, nodes: DataFrame, shown: int = 5) -> DataFrame:
    """(name, referrers, n_referrers) of nodes without a record that edges point at."""
    missing = nodes.where("is_dangling").select("name")
    into = edges.select(F.col("dst").alias("name"), "src").distinct().join(missing, "name", "left_semi")
    place = F.row_number().over(Window.partitionBy("name").orderBy("src"))
    first = into.withColumn("place", place).where(F.col("place") <= shown).groupBy("name").agg(F.sort_array(F.collect_list("src")).alias("referrers"))
    return first.join(into.groupBy("name").agg(F.count(F.lit(1)).alias("n_referrers")), "name")


def contradictions(log: DataFrame) -> DataFrame:
    """(src, dst): pairs that the log of edge writes says both support and contradict."""
    kinds = log.where(F.col("type").isin("supports", "contradicts")).groupBy("src", "dst").agg(F.min("type").alias("a"), F.max("type").alias("b"))
    return kinds.where(F.col("a") != F.col("b")).select("src", "dst")


def missing_inverses(edges: DataFrame) -> DataFrame:
    """(node, field, actual): edges whose inverse relation isn't stated at the other end."""
    inverse = F.create_map(*[F.lit(x) for kv in dims.INVERSE_RELATIONS.items() for x in kv])
    need = edges.select(F.col("dst").alias("node"), inverse[F.col("type")].alias("field"), F.col("src").alias("actual")).where(F.col("field").isNotNull()).distinct()
    have = edges.select(F.col("src").alias("node"), F.col("type").alias("field"), F.col("dst").alias("actual"))
    return need.join(have, ["node", "field", "actual"], "left_anti")


def dependency_cycles(edges: DataFrame, max_length: int = 4) -> DataFrame:
    """(node, relation): one row for every node of every cycle of a dependency."""
    return analytics.cycles(edges, dims.DEPENDENCY_RELATIONS, max_length).select(F.explode("cycle").alias("node"), F.col("type").alias("relation"), "length")


def validate_notes(notes: DataFrame) -> DataFrame:
    """All violations of a vault's notes."""
    types = graph.classify_notes(notes)
    relations = graph.relation_rows(notes).select("key", "relation", "target")
    return note_violations(notes, types).unionByName(relation_violations(relations, types, notes.select("name", "key")))


def quality(notes: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: notes, passed, warnings, errors and the quality score (0 to 100)."""
    worst = violations.groupBy("key").agg(F.max((F.col("severity") == "error").cast("int")).alias("error"))
    totals = violations.agg(F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "error").alias("errors"))
    marked = notes.select("key").join(worst, "key", "left").agg(
        F.count(F.lit(1)).alias("notes"), F.count_if(F.col("error").isNull()).alias("passed"),
        F.count_if(F.col("error") == 0).alias("warned"), F.count_if(F.col("error") == 1).alias("failed"),
    )
    loss = (0.7 * F.col("failed") + 0.3 * F.col("warned")) / F.greatest(F.col("notes"), F.lit(1))
    both = marked.select("*", totals.select("warnings").scalar().alias("warnings"), totals.select("errors").scalar().alias("errors"))
    return both.withColumn("quality", F.greatest(F.lit(0.0), 100 * (1 - loss)))

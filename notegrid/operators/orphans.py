"""References to records that do not exist, were deleted, or came later.

Parent and child keys go into one long table, tagged, and are grouped by parent
table and key: a group says whether the key has a parent, whether one is alive,
and when the first parent and the first reference appeared. Only the few groups
in which a reference can be an orphan go back to the references, as a join whose
skew Spark's adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that may surround a typed reference.
OUTER_SPACE = " \t\r\n\u00a0\u3000"


def reference_key(c: Column) -> Column:
    """The form in which two references are equal: letter case, outer spaces,
    backslashes for slashes and a final .md do not count. Null stays null."""
    slashed = F.translate(F.lower(F.btrim(c, F.lit(OUTER_SPACE))), "\\", "/")
    return F.regexp_replace(slashed, r"\.md$", "")


def orphan_references(parents: DataFrame, children: DataFrame) -> DataFrame:
    """References without a parent, as (ref_table, ref_month, record_id, ref_target, reason).

    parents: (ref_table, parent_name, parent_time, parent_gone BOOLEAN), all rows
    that a reference of ref_table may mean. children: (ref_table, record_id,
    ref_target, ref_time). reason is missing (no parent has the key), deleted
    (every parent is gone) or late (the first parent came after the reference);
    a reference without time is never late and has the month 'unknown'. Null and
    blank references are left out, repeated rows come out once. Without parents
    every reference is missing; without children nothing comes out.
    """
    refs = children.select(
        "ref_table", "record_id", "ref_target", "ref_time", reference_key(F.col("ref_target")).alias("k")
    ).where(F.length(F.btrim("ref_target", F.lit(OUTER_SPACE))) > 0)
    tagged_children = refs.select(
        "ref_table", "k", F.lit(False).alias("is_parent"), F.lit(False).alias("alive"),
        F.lit(None).cast("timestamp_ntz").alias("p_time"), F.col("ref_time").cast("timestamp_ntz").alias("c_time"),
    )
    tagged_parents = parents.select(
        "ref_table", reference_key(F.col("parent_name")).alias("k"), F.lit(True).alias("is_parent"),
        (~F.coalesce("parent_gone", F.lit(False))).alias("alive"),
        F.col("parent_time").cast("timestamp_ntz").alias("p_time"), F.lit(None).cast("timestamp_ntz").alias("c_time"),
    ).where(F.col("k").isNotNull())
    groups = tagged_children.unionByName(tagged_parents).groupBy("ref_table", "k").agg(
        F.max("is_parent").alias("has_parent"),
        F.min("is_parent").alias("only_parents"),
        F.max("alive").alias("alive"),
        F.min("p_time").alias("first_parent"),
        F.min("c_time").alias("first_child"),
    )
    suspects = groups.where(
        ~F.col("only_parents")
        & (~F.col("has_parent") | ~F.col("alive") | F.coalesce(F.col("first_child") < F.col("first_parent"), F.lit(False)))
    ).select("ref_table", "k", "has_parent", "alive", "first_parent")
    reason = (
        F.when(~F.col("has_parent"), "missing")
        .when(~F.col("alive"), "deleted")
        .when(F.col("first_parent") > F.col("ref_time").cast("timestamp_ntz"), "late")
    )
    found = refs.join(suspects, ["ref_table", "k"]).withColumn("reason", reason).where(F.col("reason").isNotNull())
    month = F.coalesce(F.date_format("ref_time", "yyyy-MM"), F.lit("unknown"))
    return found.select("ref_table", month.alias("ref_month"), "record_id", "ref_target", "reason").distinct()


def vault_orphans(notes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """orphan_references of a vault: edge targets against node names, and the
    links of notes against the names and keys of notes."""
    links = notes.select(
        F.lit("notes").alias("ref_table"), F.col("ord").alias("record_id"),
        F.explode("wiki_links").alias("ref_target"), F.col("scanned_at").alias("ref_time"),
    )
    targets = edges.select(
        F.lit("knowledge_edges").alias("ref_table"), F.col("id").alias("record_id"),
        F.col("target_name").alias("ref_target"), F.col("created_at").alias("ref_time"),
    )
    node_names = nodes.select(
        F.lit("knowledge_edges").alias("ref_table"), F.col("name").alias("parent_name"),
        F.col("created_at").alias("parent_time"), F.col("deleted_at").isNotNull().alias("parent_gone"),
    )
    note_names = notes.select(
        F.lit("notes").alias("ref_table"), F.explode(F.array("name", "key")).alias("parent_name"),
        F.col("scanned_at").alias("parent_time"), F.col("deleted_at").isNotNull().alias("parent_gone"),
    )
    return orphan_references(node_names.unionByName(note_names), targets.unionByName(links))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, month and reason."""
    return orphans.groupBy("ref_table", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_refs"))

"""Typed values mapped to the entries of reference lists, by a BK-tree.

The distinct typed values of a field are looked up once, in a BK-tree of the
field's reference entries under a true edit metric; abbreviations, which no edit
radius can reach, are compared word by word. The reference is broadcast up to
SHARD_ENTRIES entries; a longer one is cut into shards, each value meets every
shard, and the winners of the shards merge.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.edit import BKTree, abbreviates

#: Entries of one BK-tree; the bound of what is broadcast.
SHARD_ENTRIES = 20_000
#: Words before and after an entry that leave its meaning as it is (fixed values).
LEADING_WORDS = {"a", "an", "the", "is", "type", "lead"}
TRAILING_WORDS = {"city"}
#: Fields of a note's frontmatter and the reference lists they belong to.
NOTE_FIELDS = {"type": "entity_type", "status": "status", "category": "category", "role": "role", "location": "location"}


def words_of(value: str) -> list[str]:
    """Lower-case words without accents, width, punctuation and letter case."""
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", value).casefold())
    text = "".join(ch for ch in text if unicodedata.category(ch) != "Mn")
    return re.findall(r"[^\W_]+", text)


def readings(value: str) -> list[list[str]]:
    """The ways a typed value can be read as an entry, the plainest first."""
    plain = words_of(value)
    out = [plain]
    core = re.split(r"\s/\s", re.sub(r"\(.*?\)", " ", value))[0]
    if "," in core:
        head, _, tail = core.partition(",")
        out += [words_of(tail) + words_of(head), words_of(head)]
    out.append(words_of(core))
    for words in list(out):
        cut = list(words)
        while len(cut) > 1 and cut[0] in LEADING_WORDS:
            cut = cut[1:]
        while len(cut) > 1 and cut[-1] in TRAILING_WORDS:
            cut = cut[:-1]
        out += [cut]
    return [w for i, w in enumerate(out) if w and w not in out[:i]]


def radius_of(compact: str) -> int:
    """Edits that a spelling may be away from an entry."""
    return 0 if len(compact) < 4 else 1 if len(compact) < 7 else 2


class Reference:
    """The entries (canon_id, canon_value) of one field."""

    def __init__(self, entries: list[tuple[int, str]]):
        self.tree = BKTree()
        self.phrases = []
        self.exact: dict[str, int] = {}
        for canon_id, value in sorted(entries):
            words = words_of(value)
            self.tree.add("".join(words), canon_id)
            self.phrases.append((words, canon_id))
            self.exact.setdefault("".join(words), canon_id)

    def find(self, value: str) -> tuple[int, int]:
        """(canon_id, cost) of the entry meant, or (-1, large). Edits come before
        abbreviations; among equals the reading that needs fewer edits wins, then
        the smaller canon_id."""
        best = (1_000, -1)
        for step, words in enumerate(readings(value)):
            if "".join(words) in self.exact:
                return self.exact["".join(words)], step
        for step, words in enumerate(readings(value)):
            compact = "".join(words)
            # a plural s is an edit that short entries allow as well
            radius = max(radius_of(compact), int(compact.endswith("s") and len(compact) > 3))
            for d, entry, canon_id in self.tree.within(compact, radius):
                if d <= max(radius_of(entry), int(compact == entry + "s")):
                    best = min(best, (d * 10 + step, canon_id))
        if best[1] < 0:
            for step, words in enumerate(readings(value)):
                for phrase, canon_id in self.phrases:
                    cost = self._abbreviation(words, phrase)
                    if cost is not None:
                        best = min(best, (100 + cost * 10 + step, canon_id))
        return best[1], best[0]

    @staticmethod
    def _abbreviation(words: list[str], phrase: list[str]) -> int | None:
        if len(words) != len(phrase):
            return None
        if len(words) == 1 and len(words[0]) < 3:
            return None
        costs = [abbreviates(a, b) for a, b in zip(words, phrase)]
        if None in costs or len(words) > 1 and max(map(len, words)) < 3:
            return None
        return sum(costs)


def typed_values(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """(ref_table, record_id, field_name, value) of all typed values that aren't
    null or blank. A list of one element counts as its element; other lists and
    non-text values stand as their JSON text."""
    of_nodes = nodes.select(
        F.lit("knowledge_nodes").alias("ref_table"), F.col("id").alias("record_id"),
        F.lit("entity_type").alias("field_name"), F.col("entity_type").alias("value"),
    )
    schema = ", ".join(f"`{f}` string" for f in NOTE_FIELDS)
    parsed = notes.select("ord", F.from_json("frontmatter", schema).alias("f"))
    fields = F.array(*[F.struct(F.lit(to).alias("field_name"), F.col(f"f.{f}").alias("text")) for f, to in NOTE_FIELDS.items()])
    of_notes = parsed.select(F.lit("notes").alias("ref_table"), F.col("ord").alias("record_id"), F.inline(fields)).where(F.col("text").isNotNull())
    # a list's JSON text starts with [" or [" after from_json; a typed [[x]] isn't JSON
    items = F.when(F.col("text").startswith("["), F.from_json("text", "array<string>"))
    value = F.when(F.size(items) == 1, items[0]).otherwise(F.col("text"))
    of_notes = of_notes.select("ref_table", "record_id", "field_name", value.alias("value"))
    blank = F.regexp_replace("value", r"(?U)\s+", "") == ""
    return of_nodes.unionByName(of_notes).where(F.col("value").isNotNull() & ~blank)


def match_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(field_name, value, canon_id) for distinct typed values; -1 if none is meant.

    values: distinct (field_name, value), reference: (canon_id, field_name,
    canon_value). Fields without a reference list map to -1. Rows of the
    reference with a null are left out.
    """
    spark = values.sparkSession
    entries = reference.select("canon_id", "field_name", "canon_value").dropna()
    n_shards = -(-entries.count() // SHARD_ENTRIES)
    out = "field_name string, value string, canon_id long, cost long"

    def search(trees: dict[str, Reference], pdf: pd.DataFrame) -> pd.DataFrame:
        hits = [trees[f].find(v) if f in trees else (-1, 1_000) for f, v in zip(pdf.field_name, pdf.value)]
        return pdf[["field_name", "value"]].assign(canon_id=[h[0] for h in hits], cost=[h[1] for h in hits])

    def trees_of(rows) -> dict[str, Reference]:
        lists: dict[str, list] = {}
        for canon_id, field, value in rows:
            lists.setdefault(field, []).append((canon_id, value))
        return {f: Reference(e) for f, e in lists.items()}

    if n_shards <= 1:
        rows = spark.sparkContext.broadcast([tuple(r) for r in entries.collect()])  # at most SHARD_ENTRIES

        def whole(batches):
            trees = trees_of(rows.value)
            for pdf in batches:
                yield search(trees, pdf)

        # by number: adaptive execution would put small rows that take long in one task
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return values.repartition(tasks, F.xxhash64("field_name", "value")).mapInPandas(whole, out).drop("cost")

    def shard(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search(trees_of(right[["canon_id", "field_name", "canon_value"]].itertuples(index=False)), left)

    # every block of values meets every shard of the reference
    blocks = max(1, values.rdd.getNumPartitions())
    spread = values.withColumn("block", F.pmod(F.xxhash64("field_name", "value"), F.lit(blocks)))
    spread = spread.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    shards = entries.withColumn("shard", F.pmod(F.xxhash64("canon_id"), F.lit(n_shards)).cast("int"))
    shards = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    hits = spread.groupBy("shard", "block").cogroup(shards.groupBy("shard", "block")).applyInPandas(shard, out)
    best = F.row_number().over(Window.partitionBy("field_name", "value").orderBy("cost", "canon_id"))
    return hits.withColumn("place", best).where(F.col("place") == 1).select("field_name", "value", "canon_id")


def map_values(nodes: DataFrame, notes: DataFrame, reference: DataFrame) -> DataFrame:
    """(ref_table, record_id, field_name, value, canon_id) of the typed values that
    equal no entry of their field exactly; canon_id is -1 if no entry is meant.
    Repeated rows come out once; empty tables give no rows."""
    typed = typed_values(nodes, notes)
    exact = reference.select("field_name", F.col("canon_value").alias("value"))
    typed = typed.join(exact, ["field_name", "value"], "left_anti")
    found = match_values(typed.select("field_name", "value").distinct(), reference)
    return typed.join(found, ["field_name", "value"]).select("ref_table", "record_id", "field_name", "value", "canon_id").distinct()

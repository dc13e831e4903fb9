"""Items that appear together: counts of pairs by an external sort of packed codes.

Items get 32-bit numbers and a pair of a record becomes one 64-bit code. Each
task sorts its codes in runs of fixed size and run-length counts them; the runs
are partitioned by code and merged by Spark's external sorter, which spills
sorted runs and merges them, and one pass over the merged order adds up the run
lengths. Odds ratios with continuity correction are applied to the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes sorted at a time in a task: 16 MB.
RUN_CODES = 1 << 21
#: A longer record is cut into blocks of so many items, whose pairs are spread over tasks.
BLOCK_ITEMS = 2_048
#: Numbers are given within so many buckets of a hash, without a global order.
BUCKETS = 1_024

_SPACE = r"(?U)^\s+|\s+$"


def tag_item(c: Column) -> Column:
    """A tag in lower case without outer white space and leading number signs."""
    plain = F.regexp_replace(F.lower(c), _SPACE, "")
    return F.regexp_replace(plain, r"(?U)^(#\s*)+", "")


def link_item(c: Column) -> Column:
    """A link in lower case without outer white space, with slashes and no final .md."""
    plain = F.translate(F.regexp_replace(F.lower(c), _SPACE, ""), "\\", "/")
    return F.regexp_replace(F.regexp_replace(plain, r"\.md$", ""), _SPACE, "")


def note_items(notes: DataFrame) -> DataFrame:
    """Distinct (field_name, record, item) of the tags and links of notes.

    Written without lambda functions: a plan that has them isn't seen to equal
    itself, and the items would be formed and shuffled once for each use.
    """
    fields = F.array(F.struct(F.lit("tags").alias("field_name"), F.col("tags").alias("xs")), F.struct(F.lit("wiki_links").alias("field_name"), F.col("wiki_links").alias("xs")))
    typed = notes.where(F.col("key").isNotNull()).select(F.col("key").alias("record"), F.inline(fields)).select("field_name", "record", F.explode("xs").alias("x"))
    item = F.when(F.col("field_name") == "tags", tag_item(F.col("x"))).otherwise(link_item(F.col("x")))
    return typed.select("field_name", "record", item.alias("item")).where(F.col("item") != "").distinct()


def _runs(codes: np.ndarray) -> pa.RecordBatch:
    codes, counts = np.unique(codes, return_counts=True)
    return pa.record_batch([pa.array(codes), pa.array(counts.astype(np.int64))], names=["code", "n"])


def _pair_codes(batches):
    """Sorted, counted runs of the codes of all pairs of each row's two blocks."""
    held, size = [], 0
    for batch in batches:
        left, right = batch.column("a"), batch.column("b")
        for i in range(len(batch)):
            a = left[i].values.to_numpy().astype(np.int64)
            same = right[i].as_py() is None
            b = a if same else right[i].values.to_numpy().astype(np.int64)
            step = max(1, RUN_CODES // max(1, len(b)))
            for at in range(0, len(a), step):
                part = a[at : at + step, None]
                lo, hi = np.minimum(part, b), np.maximum(part, b)
                codes = (lo << 32) | hi
                codes = codes[part < b] if same else codes.ravel()
                held.append(codes)
                size += len(codes)
                if size >= RUN_CODES:
                    yield _runs(np.concatenate(held))
                    held, size = [], 0
    if size:
        yield _runs(np.concatenate(held))


def _merge_runs(batches):
    """Run lengths added up over codes that arrive in order."""
    last, total = None, 0
    for batch in batches:
        codes, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
        if not len(codes):
            continue
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        heads, sums = codes[starts], np.add.reduceat(n, starts)
        if last is not None and heads[0] == last:
            sums[0] += total
        elif last is not None:
            heads, sums = np.r_[last, heads], np.r_[total, sums]
        last, total = int(heads[-1]), int(sums[-1])
        if len(heads) > 1:
            yield pa.record_batch([pa.array(heads[:-1]), pa.array(sums[:-1])], names=["code", "n"])
    if last is not None:
        yield pa.record_batch([pa.array([last], pa.int64()), pa.array([total], pa.int64())], names=["code", "n"])


def record_blocks(items: DataFrame) -> DataFrame:
    """(a, b): blocks of at most BLOCK_ITEMS numbers whose pairs are to be coded; b is
    null where the pairs within a are meant. items: (field_name, record, num).

    A record is never held as a whole: its items are numbered by a streaming
    window and collected by block. Records of one block are coded where they are;
    of longer ones every two blocks meet by a shuffle on the record and the two
    block numbers, so that the block pairs of one long record are spread.
    """
    record = ["field_name", "record"]
    block = F.floor((F.row_number().over(Window.partitionBy(*record).orderBy("num")) - 1) / BLOCK_ITEMS).cast("int")
    blocks = items.withColumn("block", block).groupBy(*record, "block").agg(F.collect_list("num").alias("nums"))
    blocks = blocks.withColumn("last", F.max("block").over(Window.partitionBy(*record)))
    none = F.lit(None).cast("array<int>")
    own = blocks.where(F.size("nums") > 1).select(F.col("nums").alias("a"), none.alias("b"))
    # a block goes once to each other block of its record
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    met = blocks.where(F.col("last") > 0).select(*record, "block", "nums", other.alias("other")).where(F.col("block") != F.col("other"))
    lo, hi = F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    two = met.select(*record, lo, hi, "nums").groupBy(*record, "lo", "hi").agg(F.min("nums").alias("a"), F.max("nums").alias("b"))
    return own.union(two.select("a", "b"))


def cooccurring_pairs(items: DataFrame, n_records: DataFrame, min_count: int = 1) -> DataFrame:
    """(field_name, item_a, item_b, n_ab, n_a, n_b, n_records, lift, odds_ratio), item_a < item_b.

    items: distinct (field_name, record, item). n_records: one row, column
    n_records. Pairs in at least min_count records come out, each once; items in
    fewer records cannot be part of one and are left out before pairs are formed.
    lift is n_ab * n_records / (n_a * n_b); the odds ratio has 0.5 added to each
    of the four counts, so that it is defined for all pairs. An empty table, or
    records with a single item, give no pairs.
    """
    counts = items.groupBy("field_name", "item").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_count)
    bucket = F.pmod(F.xxhash64("field_name", "item"), F.lit(BUCKETS)).cast("int")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("field_name", "item"))
    numbered = counts.withColumn("bucket", bucket).withColumn("num", ((place - 1) * BUCKETS + F.col("bucket")).cast("int")).drop("bucket")
    blocks = record_blocks(items.join(numbered.select("field_name", "item", "num"), ["field_name", "item"]))
    runs = blocks.mapInArrow(_pair_codes, "code long, n long")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge_runs, "code long, n long")
    pairs = merged.where(F.col("n") >= min_count).select(
        F.shiftright("code", 32).cast("int").alias("num_a"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("num_b"), F.col("n").alias("n_ab")
    )
    a = numbered.select(F.col("num").alias("num_a"), "field_name", F.col("item").alias("x"), F.col("c").alias("n_x"))
    b = numbered.select(F.col("num").alias("num_b"), F.col("item").alias("y"), F.col("c").alias("n_y"))
    total = n_records.select("n_records").scalar()
    named = pairs.join(a, "num_a").join(b, "num_b")
    turned = F.col("x") < F.col("y")
    named = named.select(
        "field_name", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n_ab",
        F.when(turned, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"),
        F.when(turned, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"), total.alias("n_records"),
    )
    half = lambda c: c.cast("double") + 0.5
    n11, n10, n01 = F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    n00 = F.col("n_records") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    return named.withColumns(
        {
            "lift": F.col("n_ab").cast("double") * F.col("n_records") / (F.col("n_a").cast("double") * F.col("n_b")),
            "odds_ratio": half(n11) * half(n00) / (half(n10) * half(n01)),
        }
    )


def note_pairs(notes: DataFrame, min_count: int) -> DataFrame:
    """cooccurring_pairs of the tags and links of notes; a record is a distinct key."""
    keys = notes.select("key").where(F.col("key").isNotNull()).distinct().agg(F.count(F.lit(1)).alias("n_records"))
    return cooccurring_pairs(note_items(notes), keys, min_count)


def above_chance(pairs: DataFrame, ratio: str) -> DataFrame:
    """Pairs more frequent than `ratio` (a decimal number) times the chance, decided without rounding."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    digits = len(ratio.partition(".")[2])
    scaled = F.lit(int(ratio.replace(".", ""))).cast("decimal(9,0)")
    seen = (big("n_ab") * big("n_records")).cast("decimal(38,0)") * F.lit(10**digits)
    return pairs.where(seen > (big("n_a") * big("n_b")).cast("decimal(38,0)") * scaled)

"""Per-key results when a few keys hold most rows: multi-level tree aggregation.

The input is cut into chunks of CHUNK_ROWS rows as it is read. A local round
combines the chunks of a task (the map side of the first aggregation); the
states of a key then merge in rounds of fan-in: the grouping key carries the
number of the chunk divided by a power of `fan_in`, so a node of the tree meets
about `fan_in` states of a key and no reducer receives all partial states of a
hot one. The number of rounds is the logarithm of the number of chunks, two at
least.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk.
CHUNK_ROWS = 65_536

#: How a state of each kind starts from a value and merges with others.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_START = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def fan_in_rounds(chunks: int, fan_in: int) -> int:
    """Rounds in which `chunks` states become one, fan_in at a time; two at least,
    so that small tables take the same way as large ones."""
    rounds, reach = 1, fan_in
    while reach < chunks:
        rounds, reach = rounds + 1, reach * fan_in
    return max(2, rounds)


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    aggs: dict[str, tuple[str, Column | str]],
    fan_in: int = 16,
    n_rows: int | None = None,
) -> DataFrame:
    """One row per distinct `keys` with the named aggregates.

    aggs maps an output name to (kind, column); kinds are count (of non-null
    values), sum, min and max. Null keys form a group of their own, as in SQL.
    No rows give no groups. Other columns of df are not read, so extra or
    clashing names do no harm. Every row is used; nothing is sampled. n_rows is
    the number of rows if the caller knows it (an upper bound does); otherwise
    they are counted. It sets the shape of the tree, never the result.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    unknown = {kind for kind, _ in aggs.values()} - set(_MERGE)
    if unknown:
        raise ValueError(f"unknown aggregates: {sorted(unknown)}")
    chunks = max(1, math.ceil((df.count() if n_rows is None else n_rows) / CHUNK_ROWS))
    rounds = fan_in_rounds(chunks, fan_in)
    value = {n: (F.col(c) if isinstance(c, str) else c) for n, (_, c) in aggs.items()}
    # the id holds the number of the split above bit 33 and the row's number in it below:
    # the chunks of a split have consecutive numbers, those of different splits may share one
    row = F.monotonically_increasing_id()
    chunk = F.pmod(F.shiftright(row, 33) * fan_in + F.floor(row.bitwiseAND((1 << 33) - 1) / CHUNK_ROWS), F.lit(fan_in**rounds))
    states = df.select(*[F.col(k) for k in keys], *[value[n].alias(f"__{n}") for n in aggs], chunk.alias("__chunk"))
    call = _START
    for level in range(rounds - 1, -1, -1):
        states = states.withColumn("__chunk", F.floor(F.col("__chunk") / fan_in))
        by = keys + (["__chunk"] if level else [])
        states = states.groupBy(*by).agg(*[call[kind](f"__{n}").alias(f"__{n}") for n, (kind, _) in aggs.items()])
        call = _MERGE
    return states.select(*keys, *[F.col(f"__{n}").alias(n) for n in aggs])


def edge_ends(edges: DataFrame, *columns: Column) -> DataFrame:
    """Both ends of every edge as (side, name, other name); the scan is read once."""
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.lit("source_name").alias("side"), F.col("source_name").alias("name"), F.col("target_name").alias("other")),
                F.struct(F.lit("target_name").alias("side"), F.col("target_name").alias("name"), F.col("source_name").alias("other")),
            )
        ),
        *columns,
    )


def heavy_names(edges: DataFrame, share: float = 0.02, fan_in: int = 16) -> DataFrame:
    """(side, name, edges) of the names that hold at least `share` of all rows.

    All rows count, those with a null or empty name too, but such names are not
    returned. An empty table gives no names.
    """
    total = edges.count()
    counts = tree_aggregate(edge_ends(edges), ["side", "name"], {"edges": ("count", F.lit(1))}, fan_in, 2 * total)
    return counts.where((F.col("name") != "") & (F.col("edges") >= F.lit(share) * total))


def name_stats(edges: DataFrame, fan_in: int = 16) -> DataFrame:
    """(side, name, edges, weight_sum, neighbours) for every name that is not null or empty.

    weight_sum adds the weights in millionths, so that the order of rows cannot
    change it; null weights add nothing and a name with none but nulls has a
    null sum. neighbours counts distinct names at the other end, null and empty
    ones left out. Distinct (source, target) pairs are formed first, once for
    both sides, by a hash of both names with map-side combining, which spreads a
    hub's neighbours over all tasks.
    """
    weight = F.round(F.col("weight") * 1_000_000).cast("bigint")
    pairs = edges.groupBy("source_name", "target_name").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    stats = tree_aggregate(
        edge_ends(pairs, F.col("n"), F.col("w")).where(F.col("name") != ""),
        ["side", "name"],
        {"edges": ("sum", "n"), "weight": ("sum", "w"), "neighbours": ("count", F.when(F.col("other") != "", F.lit(1)))},
        fan_in,
        2 * edges.count(),
    )
    return stats.select("side", "name", "edges", (F.col("weight") / 1_000_000).alias("weight_sum"), "neighbours")

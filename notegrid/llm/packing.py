"""Items of varying length packed into containers of fixed capacity.

Items are spread by a hash over shards of a few thousand; each shard is packed
by itself, by Karmarkar-Karp multiway differencing: every item starts as a
partition of windows of which one holds it, and the two partitions with the
largest imbalance merge, the fullest window of one with the emptiest of the
other, until one is left, whose windows are nearly equal. If one of them exceeds
the capacity, the number of windows rises and the shard is packed again.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a shard: enough that its last, partly filled window hardly counts.
SHARD_ITEMS = 4_096


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, sums of windows) by multiway differencing."""
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, dtype=np.int64), np.array([sizes.sum()] * windows)
    # a node is an item or the union of two nodes; each window holds one node or none (-1)
    left, right = np.full(2 * n, -1, dtype=np.int64), np.full(2 * n, -1, dtype=np.int64)
    used = n
    heap = [(-int(s), i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]  # only filled windows, fullest first
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        if len(s1) < len(s2):
            s1, n1, s2, n2 = s2, n2, s1, n1
        # the fullest windows of the second meet the emptiest of the first
        free = windows - len(s1)
        if len(s2) <= free:
            sums, nodes = np.concatenate([s1, s2]), np.concatenate([n1, n2])
        else:
            meet = len(s2) - free
            at = len(s1) - meet
            new = np.arange(used, used + meet)
            # what is left of the second, emptiest first, meets the first's emptiest, fullest first
            a_sum, a_node = s1[at:], n1[at:]
            b_sum, b_node = s2[free:][::-1], n2[free:][::-1]
            left[new], right[new] = a_node, b_node
            used += meet
            sums = np.concatenate([s1[:at], a_sum + b_sum, s2[:free]])
            nodes = np.concatenate([n1[:at], new, n2[:free]])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        least = sums[-1] if len(sums) == windows else 0
        serial += 1
        heapq.heappush(heap, (-int(sums[0] - least), serial, sums, nodes))
    _, _, sums, nodes = heap[0]
    window = np.zeros(n, dtype=np.int64)
    for w, top in enumerate(nodes):
        stack = [int(top)]
        while stack:
            node = stack.pop()
            if node < n:
                window[node] = w
            else:
                stack += [int(left[node]), int(right[node])]
    return window, np.concatenate([sums, np.zeros(windows - len(sums), dtype=sums.dtype)])


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; no container exceeds the capacity. Items of the
    full capacity have one of their own, empty ones share those of the others."""
    sizes = np.asarray(sizes, dtype=np.int64)
    if len(sizes) and (sizes.max() > capacity or sizes.min() < 0):
        raise ValueError("an item doesn't fit")
    out = np.zeros(len(sizes), dtype=np.int64)
    full, open_, empty = (np.flatnonzero(m) for m in (sizes == capacity, (sizes > 0) & (sizes < capacity), sizes == 0))
    out[full] = np.arange(len(full))
    windows = math.ceil(sizes[open_].sum() / capacity)
    while len(open_):
        window, sums = difference(sizes[open_], windows)
        if sums.max() <= capacity:
            out[open_] = len(full) + window
            break
        windows += 1
    used = max(1, len(full) + (windows if len(open_) else 0))
    out[empty] = np.arange(len(empty)) % used
    return out


def pack_items(items: DataFrame, id_col: str, size_col: str, capacity: int, shard_items: int = SHARD_ITEMS, n_items: int | None = None) -> DataFrame:
    """(id, part, part_start, part_size, container_id, container_size).

    Each row is an item; an item larger than the capacity, and only such, is
    split into parts of the capacity and a rest. Null sizes count as 0, and an
    item of size 0 is placed like any other. Ids should be unique: repeated ones
    are items of their own. An empty table gives no rows. n_items, about the
    number of rows, saves counting them.
    """
    shards = max(1, math.ceil((items.count() if n_items is None else n_items) / shard_items))
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("id"), size.alias("size"))
    n_parts = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1))
    rows = rows.select("id", "size", F.explode(F.sequence(F.lit(0), (n_parts - 1).cast("int"))).alias("part"))
    start = F.col("part").cast("long") * capacity
    rows = rows.select("id", "part", start.alias("part_start"), F.least(F.col("size") - start, F.lit(capacity)).alias("part_size"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "part"), F.lit(shards)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part_size", "id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        container = pack(pdf.part_size.to_numpy(), capacity)
        total = np.bincount(container, weights=pdf.part_size).astype(np.int64)
        return pdf.assign(container_id=(int(pdf.shard[0]) << 24) + container, container_size=total[container]).drop(columns="shard")

    # by number: adaptive execution would put small rows that take long in one task
    packed = rows.repartition(min(shards, 10_000), "shard").groupBy("shard").applyInPandas(
        fill, f"id {kind}, part int, part_start long, part_size long, container_id long, container_size long"
    )
    return packed.withColumnRenamed("id", id_col)

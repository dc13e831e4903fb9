"""The k most similar vectors of every vector, by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted, with
that prefix, in the inverted files of its first pivots and looks for neighbours
in those of its first pivots; inside a file the entries are ranked by footrule
distance of the prefixes, and the best candidates are reranked by exact cosine
in double precision.

Pivots are a bounded sample of the distinct vectors, so dense regions get more
of them and the files stay of one size. A file that is longer than BLOCK all the
same is cut into blocks that meet two by two in groups of their own, so that no
task holds or searches it alone. Exact copies are one entry of the index and
their rows are brought back at the end, so that a vector that holds a third of
all rows is posted once per input split.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound of all pivots together, which are broadcast; with fewer pivots than asked for, files are longer.
PIVOT_BYTES = 64 << 20
#: Above so many pivots of a group the nearest ones are searched in two levels.
FLAT_PIVOTS = 4_096
#: Longest file, or block of one, that is searched at a time.
BLOCK = 4_096
#: Posted rows for each task of the search.
TASK_ROWS = 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Pivots:
    """Pivots of one group; nearest(x) gives the ordered nearest ones of each row."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = _unit(vectors.astype(np.float64)).astype(np.float32)
        self.members: list[np.ndarray] = []
        if len(self.vectors) > FLAT_PIVOTS:
            self.heads = self.vectors[:: int(math.sqrt(len(self.vectors)))]
            home = np.argmax(self.vectors @ self.heads.T, axis=1)
            self.members = [np.flatnonzero(home == h) for h in range(len(self.heads))]

    def nearest(self, x: np.ndarray, prefix: int, block: int = 1024) -> np.ndarray:
        prefix = min(prefix, len(self.vectors))
        out = np.empty((len(x), prefix), dtype=np.int32)
        for i in range(0, len(x), block):
            rows = x[i : i + block]
            if not self.members:
                out[i : i + block] = self._order(rows @ self.vectors.T, None, prefix)
            else:
                out[i : i + block] = self._two_level(rows, prefix)
        return out

    def _two_level(self, rows: np.ndarray, prefix: int) -> np.ndarray:
        heads = min(len(self.heads) - 1, 8 + prefix)
        first = np.argpartition(-(rows @ self.heads.T), heads, axis=1)[:, :heads]
        best = np.full((len(rows), prefix), -2.0, dtype=np.float32)
        ids = np.zeros((len(rows), prefix), dtype=np.int64)
        for h in np.unique(first):
            who = np.flatnonzero((first == h).any(axis=1))
            pool = self.members[h]
            sims = np.hstack([best[who], rows[who] @ self.vectors[pool].T])
            names = np.hstack([ids[who], np.broadcast_to(pool, (len(who), len(pool)))])
            top = np.argpartition(-sims, prefix - 1, axis=1)[:, :prefix]
            best[who] = np.take_along_axis(sims, top, 1)
            ids[who] = np.take_along_axis(names, top, 1)
        return self._order(best, ids, prefix)

    @staticmethod
    def _order(sims: np.ndarray, ids: np.ndarray | None, prefix: int) -> np.ndarray:
        top = np.argpartition(-sims, prefix - 1, axis=1)[:, :prefix]
        order = np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
        return top if ids is None else np.take_along_axis(ids, top, 1)


def footrule_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much two prefixes have in common: for prefixes of length L the footrule
    distance (an absent pivot stands at place L) is L*(L+1) minus twice this. A pivot
    at places i and j adds L - max(i, j), which is the lesser of L - i and L - j."""
    length = a.shape[1]
    pivots, local = np.unique(b, return_inverse=True)
    local = local.reshape(b.shape)
    at = np.searchsorted(pivots, a).clip(max=len(pivots) - 1)
    known = pivots[at] == a
    weight = np.zeros((len(a), len(pivots)), dtype=np.int16)
    for i in range(length):
        rows = np.flatnonzero(known[:, i])
        weight[rows, at[rows, i]] = length - i
    score = np.zeros((len(a), len(b)), dtype=np.int16)
    for j in range(length):
        score += np.minimum(weight[:, local[:, j]], np.int16(length - j))
    return score


def _matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=dtype).reshape(len(parts), -1)


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, unit vectors, prefixes) of the distinct vectors of a table."""
    keys = np.stack([table["h1"].to_numpy(), table["h2"].to_numpy()], axis=1)
    keys, first = np.unique(keys, axis=0, return_index=True)
    return keys, _unit(_matrix(table["vec"], np.float32)[first].astype(np.float64)), _matrix(table["prefix"], np.int32)[first]


def search_list(table: pa.Table, k: int, candidates: int, min_cosine: float, rows_at_once: int = 512) -> pa.Table:
    """Reranked neighbours of the queries of one file, or of two of its blocks."""
    blocks = pc.unique(table["block"]).to_pylist()
    if len(blocks) == 1:
        pairs = [(table.filter(table["query"]), table.filter(table["data"]))]
    else:
        parts = [table.filter(pc.equal(table["block"], b)) for b in blocks]
        pairs = [(parts[0].filter(parts[0]["query"]), parts[1]), (parts[1].filter(parts[1]["query"]), parts[0])]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for asked, known in pairs:
        if not asked.num_rows or not known.num_rows:
            continue
        q_keys, q, q_prefix = _side(asked)
        d_keys, x, prefix = _side(known)
        # the keys of both sides are sorted: a query's place among the entries is its own entry
        both = np.concatenate([d_keys, q_keys])
        _, number = np.unique(both, axis=0, return_inverse=True)
        number = number.reshape(-1)
        own = np.full(number.max() + 1, -1)
        own[number[: len(d_keys)]] = np.arange(len(d_keys))
        own = own[number[len(d_keys) :]]
        for i in range(0, len(q), rows_at_once):
            part = slice(i, i + rows_at_once)
            cosine = q[part] @ x.T
            me = own[part]
            mine = np.flatnonzero(me >= 0)
            cosine[mine, me[mine]] = -2.0
            pool = None
            if len(x) - 1 > candidates and prefix.shape[1]:
                rank = footrule_overlap(q_prefix[part], prefix)
                rank[mine, me[mine]] = -1
                pool = np.argpartition(-rank, candidates - 1, axis=1)[:, :candidates]
                cosine = np.take_along_axis(cosine, pool, 1)
            if cosine.shape[1] > k:
                top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                cosine = np.take_along_axis(cosine, top, 1)
                pool = top if pool is None else np.take_along_axis(pool, top, 1)
            r, c = np.nonzero(cosine >= max(min_cosine - 1e-9, -1.5))
            found.append((q_keys[i + r], d_keys[c if pool is None else pool[r, c]], cosine[r, c]))
    a, b, cos = (np.concatenate(p) for p in zip(*found)) if found else (np.empty((0, 2), int), np.empty((0, 2), int), np.empty(0))
    return pa.table({"a1": a[:, 0], "a2": a[:, 1], "b1": b[:, 0], "b2": b[:, 1], "cosine": np.minimum(cos, 1.0)}).cast(_PAIRS)


_PAIRS = pa.schema([(c, pa.int64()) for c in ("a1", "a2", "b1", "b2")] + [("cosine", pa.float64())])
_POSTS = pa.schema(
    [("grp", pa.string()), ("list", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("block", pa.int32()), ("query", pa.bool_()), ("data", pa.bool_()),
     ("h1", pa.int64()), ("h2", pa.int64()), ("prefix", pa.binary()), ("vec", pa.binary())]
)
_POSTS_DDL = "grp string, list int, lo int, hi int, block int, query boolean, data boolean, h1 long, h2 long, prefix binary, vec binary"


def _entries(df: DataFrame, id_col: str, vec_col: str, group_cols: list[str], queries: Column | None) -> DataFrame:
    """(id, query, h1, h2, grp, vec) of the rows that can be compared."""
    v = F.col(vec_col).cast("array<float>")
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), asked.alias("query"), *[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(group_cols)], v.alias("vec"))
    names = [F.coalesce(F.concat(F.lit("="), F.col(f"g{i}")), F.lit("-")) for i in range(len(group_cols))]
    usable = (
        (F.size("vec") > 0)
        & (F.size(F.array_compact("vec")) == F.size("vec"))
        & ((F.array_max("vec") != 0) | (F.array_min("vec") != 0))
        & (F.array_max("vec") < float("inf"))
        & (F.array_min("vec") > float("-inf"))
    )
    grp = F.concat_ws("\x1f", *names, F.size("vec").cast("string"))
    return rows.where(usable).select(
        "id", "query", F.xxhash64(grp, "vec").alias("h1"), F.xxhash64(F.lit(1), "vec", grp).alias("h2"), grp.alias("grp"), "vec"
    )


def choose_pivots(entries: DataFrame, sizes: dict[str, int], per_pivot: float) -> dict[str, Pivots]:
    """Pivots of the groups in `sizes`: one for per_pivot rows, PIVOT_BYTES in all,
    sampled by a hash of the vector."""
    if not sizes:
        return {}
    length = {g: int(g.rsplit("\x1f", 1)[-1]) for g in sizes}
    asked = {g: n / per_pivot for g, n in sizes.items()}
    room = min(1.0, PIVOT_BYTES / sum(w * 4 * length[g] for g, w in asked.items()))
    want = {g: max(2, math.ceil(w * room)) for g, w in asked.items()}
    spark = entries.sparkSession
    scale = 1 << 40
    shares = spark.createDataFrame([(g, min(scale, int(scale * 1.2 * w / sizes[g]) + 1), w) for g, w in want.items()], "grp string, share long, want int")
    drawn = (
        entries.join(F.broadcast(shares), "grp")  # groups of `sizes`, see nearest_rows
        .withColumn("r", F.pmod(F.xxhash64("h1", F.lit(17)), F.lit(scale)))
        .where(F.col("r") < F.col("share"))
        .groupBy("grp", "r", "h2", "want")
        .agg(F.first("vec").alias("vec"))
    )
    place = F.row_number().over(Window.partitionBy("grp").orderBy("r", "h2"))
    sample = drawn.withColumn("place", place).where(F.col("place") <= F.col("want")).select("grp", "place", "vec").toArrow()
    out = {}
    for g in want:
        own = sample.filter(pc.equal(sample["grp"], g)).sort_by("place")
        if len(own) > 1:
            out[g] = Pivots(own["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1))
    return out


def _assigned(batches, pivots: dict[str, Pivots], prefix: int):
    """(group, rows of the batch, vectors, prefixes), each distinct vector of a task once
    as an entry and once more if a later copy of it is the first to be a query."""
    seen: dict[tuple[int, int], bool] = {}
    for batch in batches:
        h1, h2, query = batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), batch.column("query").to_pylist()
        keep, fresh = [], []
        for i, key in enumerate(zip(h1.tolist(), h2.tolist())):
            known = seen.get(key)
            if known is None or (query[i] and not known):
                seen[key] = query[i]
                keep.append(i)
                fresh.append(known is None)
        batch = batch.take(pa.array(keep, pa.int64())).append_column("data", pa.array(fresh, pa.bool_()))
        groups = batch.column("grp").dictionary_encode()
        codes = groups.indices.to_numpy()
        for code, g in enumerate(groups.dictionary.to_pylist()):
            part = batch.take(pa.array(np.flatnonzero(codes == code)))
            n = part.num_rows
            raw = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(n, -1)
            own = pivots.get(g)
            near = np.zeros((n, 0), dtype=np.int32) if own is None else own.nearest(_unit(raw.astype(np.float64)).astype(np.float32), prefix)
            yield g, part, raw, near


def _files(near: np.ndarray, n: int) -> np.ndarray:
    """The first n files of each row; file 0 for a group without pivots."""
    return near[:, :n] if near.shape[1] else np.zeros((len(near), 1), dtype=np.int32)


def long_files(entries: DataFrame, pivots, posts: int) -> dict[tuple[str, int], int]:
    """Number of blocks of every file that needs more than one. There are at most as many as pivots and groups."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for g, part, _, near in _assigned(batches, pivots.value, posts):
            own = pivots.value.get(g)
            size = total.setdefault(g, np.zeros(len(own.vectors) if own else 1, dtype=np.int64))
            size += np.bincount(_files(near, posts)[part.column("data").to_numpy(zero_copy_only=False)].ravel(), minlength=len(size))
        for g, size in total.items():
            held = np.flatnonzero(size)
            yield pa.record_batch([pa.array([g] * len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(size[held])], names=["grp", "list", "n"])

    sizes = entries.select("h1", "h2", "grp", "vec", "query").mapInArrow(count, "grp string, list int, n long")
    long = sizes.groupBy("grp", "list").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    return {(r.grp, r.list): -(-r.n // BLOCK) for r in long.collect()}


def nearest_rows(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    group_cols: list[str],
    k: int = 10,
    min_cosine: float = -1.0,
    per_pivot: float = 128,
    prefix: int = 12,
    posts: int = 12,
    probes: int | None = None,
    candidates: int = 2_048,
    queries: Column | None = None,
) -> DataFrame:
    """(id, other, cosine): for every row the k rows of its group most similar by cosine.

    Rows are compared if all group_cols (null equals null) and the number of
    elements agree. Null, empty and all-zero vectors and those with null or
    non-finite elements are not compared. Equal cosines are ordered by id.
    min_cosine leaves out weaker neighbours. queries is a condition on the rows
    that look for neighbours, among all rows; without it all do.

    per_pivot, prefix, posts, probes and candidates are the index's parameters:
    the rows for each pivot, the pivots kept of a permutation, the files a vector
    is posted in (so a file has posts * per_pivot entries), the files a query
    looks in (those it is posted in by default), and the entries of a file that
    are reranked. Every row is indexed.
    """
    spark = df.sparkSession
    entries = _entries(df, id_col, vec_col, group_cols, queries)
    both = queries is None and (probes is None or probes == posts)
    probes = posts if probes is None else probes
    reach = max(prefix, posts, probes)
    # groups of fewer rows are one file; only so many can have more
    counted = entries.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    n_rows = counted.agg(F.sum("n")).first()[0] or 0
    most = max(1, PIVOT_BYTES // 1024)
    sizes = {r.grp: r.n for r in counted.where(F.col("n") > 2 * per_pivot).orderBy(F.desc("n"), "grp").limit(most).collect()}
    pivots = spark.sparkContext.broadcast(choose_pivots(entries, sizes, per_pivot))
    cut = spark.sparkContext.broadcast(long_files(entries, pivots, posts))

    def rows_of(g, files, h1, meet_all: bool):
        """(row, file, lo, hi, block) of the posts of a batch; a file of several blocks
        is met in each block (by a query), in the own one, or in every two with it."""
        row = np.repeat(np.arange(len(files)), files.shape[1])
        file = files.ravel()
        many = np.array([cut.value.get((g, f), 1) for f in file.tolist()]) if cut.value else np.ones(len(file), dtype=np.int64)
        block = h1[row] % many
        if meet_all or both:
            again = np.repeat(np.arange(len(row)), many)
            first = np.repeat(np.cumsum(many) - many, many)
            other = np.arange(len(again)) - first
            row, file, block = row[again], file[again], block[again]
            if both:
                return row, file, np.minimum(block, other), np.maximum(block, other), block
            return row, file, other, other, other
        return row, file, block, block, block

    def post(batches):
        for g, part, raw, near in _assigned(batches, pivots.value, reach):
            h1 = part.column("h1").to_numpy()
            data = part.column("data").to_numpy(zero_copy_only=False)
            query = part.column("query").to_numpy(zero_copy_only=False)
            if both:
                modes = [(np.flatnonzero(data), posts, True, True)]
            else:
                modes = [(np.flatnonzero(data), posts, False, True), (np.flatnonzero(query), probes, True, False)]
            prefixes, vectors = [p.tobytes() for p in near[:, :prefix].astype(np.int32)], [v.tobytes() for v in raw]
            for who, n, asks, holds in modes:
                if not len(who):
                    continue
                row, file, lo, hi, block = rows_of(g, _files(near[who], n), h1[who], asks)
                row = who[row]
                count = len(row)
                taken = part.take(pa.array(row))
                yield pa.record_batch(
                    [
                        pa.array([g] * count, pa.string()), pa.array(file.astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(block.astype(np.int32)),
                        pa.array(np.full(count, asks)), pa.array(np.full(count, holds)), taken.column("h1"), taken.column("h2"),
                        pa.array([prefixes[i] for i in row], pa.binary()), pa.array([vectors[i] for i in row], pa.binary()),
                    ],
                    schema=_POSTS,
                )

    posted = entries.select("h1", "h2", "grp", "vec", "query").mapInArrow(post, _POSTS_DDL)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n_rows * posts / TASK_ROWS))
    pairs = (
        posted.repartition(tasks, "grp", "list", "lo", "hi")
        .groupBy("grp", "list", "lo", "hi")
        .applyInArrow(lambda t: search_list(t, k, candidates, min_cosine), "a1 long, a2 long, b1 long, b2 long, cosine double")
    )
    merged = pairs.groupBy("a1", "a2", "b1", "b2").agg(F.max("cosine").alias("cosine"))
    by_vector = Window.partitionBy("a1", "a2").orderBy(F.desc("cosine"), "b1", "b2")
    vectors = merged.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k).drop("place")

    # from vectors back to rows: of each set of copies the k + 1 first rows can be neighbours
    rows = entries.select("id", "h1", "h2", "query")
    firsts = rows.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("place") <= k + 1)
    others = vectors.join(firsts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("id").alias("other")), ["b1", "b2"])
    best = Window.partitionBy("a1", "a2").orderBy(F.desc("cosine"), "other")
    others = others.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    copied = firsts.where(F.col("place") == 2).select("h1", "h2")
    copies = firsts.join(copied, ["h1", "h2"], "left_semi").select(
        F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("id").alias("other"), F.lit(1.0).alias("cosine")
    )
    # both kinds of neighbours of a vector as one list of at most 2k + 1, which its rows then share
    known = others.select("a1", "a2", "other", "cosine").unionByName(copies)
    shared = rows.where("query").join(known, (rows.h1 == known.a1) & (rows.h2 == known.a2)).where(F.col("id") != F.col("other"))
    final = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return (
        shared.withColumn("place", F.row_number().over(final))
        .where((F.col("place") <= k) & (F.col("cosine") >= min_cosine))
        .select("id", "other", "cosine")
    )


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Distinct unordered pairs (id_a < id_b) of a neighbour table."""
    return neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()

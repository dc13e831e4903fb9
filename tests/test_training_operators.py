"""Hot keys and orphan references against plain Python."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from notegrid.operators import tree_agg
from notegrid.operators.orphans import orphan_references, orphan_report, vault_orphans
from notegrid.operators.tree_agg import fan_in_rounds, heavy_names, name_stats, tree_aggregate

EDGE = "id long, source_name string, target_name string, relation string, weight double, metadata string, created_at timestamp_ntz, side string"


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, "uses", w, None, None, "x") for i, (a, b, w) in enumerate(pairs)], EDGE)


def test_tree_rounds_agree(spark, rows, monkeypatch):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 8 + list("abcdef") + [None]), rng.randint(0, 9)) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, v int").repartition(24)
    want = defaultdict(list)
    for k, v in data:
        want[k].append(v)
    expect = sorted(((k, len(v), sum(v), min(v), max(v)) for k, v in want.items()), key=repr)
    for n_rows in (None, 100_000, 10_000_000):
        got = tree_aggregate(df, ["k"], {"n": ("count", F.lit(1)), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, 3, n_rows)
        assert rows(got) == expect
    monkeypatch.setattr(tree_agg, "CHUNK_ROWS", 7)
    assert rows(tree_aggregate(df, ["k"], {"n": ("count", F.lit(1)), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, 2)) == expect


def test_tree_has_two_rounds_at_least(spark):
    assert [fan_in_rounds(c, 16) for c in (0, 1, 16, 17, 256, 257, 5000)] == [2, 2, 2, 2, 2, 3, 4]
    plan = heavy_names(edges(spark, [("a", "b", 1.0)] * 9))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_name_stats(spark, rows):
    data = [("a", "b", 0.1)] * 3 + [("a", "c", None), ("a", None, 0.2), (None, "b", 1.0), ("", "b", 1.0), ("b", "", 0.5)]
    got = {r[:2]: r[2:] for r in rows(name_stats(edges(spark, data)))}
    assert got[("source_name", "a")] == (5, 0.5, 2)
    assert got[("source_name", "b")] == (1, 0.5, 0)
    assert got[("target_name", "b")] == (5, 2.3, 1)
    assert ("source_name", "") not in got and ("source_name", None) not in got


def test_heavy_names_share_of_all_rows(spark, rows):
    data = [("hot", f"t{i}", 1.0) for i in range(40)] + [(None, "x", 1.0)] * 60
    assert rows(heavy_names(edges(spark, data), 0.4), "side", "name") == [("source_name", "hot"), ("target_name", "x")]
    assert rows(heavy_names(edges(spark, data), 0.41), "side", "name") == [("target_name", "x")]
    assert rows(heavy_names(edges(spark, []), 0.02)) == []


def when(s):
    return __import__("datetime").datetime.fromisoformat(s)


def test_orphans(spark, rows):
    parents = spark.createDataFrame(
        [("t", "Alive", when("2024-01-01"), False), ("t", "gone", when("2024-01-01"), True), ("t", "Half", when("2024-03-01"), True),
         ("t", "half.md", when("2024-02-01"), None), ("t", None, None, None), ("u", "other", when("2024-01-01"), False)],
        "ref_table string, parent_name string, parent_time timestamp_ntz, parent_gone boolean",
    )
    refs = [
        (1, " alive.MD", "2024-05-01"), (2, "gone", "2024-05-01"), (3, "half", "2024-01-15"), (4, "half", "2024-02-15"), (5, "half", None),
        (6, "nobody", None), (6, "nobody", None), (7, "", "2024-05-01"), (8, "  ", "2024-05-01"), (9, None, "2024-05-01"), (10, "other", "2024-05-01"), (11, "a\\b", "2024-06-01"),
    ]
    children = spark.createDataFrame([("t", i, x, t and when(t)) for i, x, t in refs], "ref_table string, record_id long, ref_target string, ref_time timestamp_ntz")
    got = rows(orphan_references(parents, children), "record_id", "ref_month", "reason")
    assert got == [(10, "2024-05", "missing"), (11, "2024-06", "missing"), (2, "2024-05", "deleted"), (3, "2024-01", "late"), (6, "unknown", "missing")]
    assert rows(orphan_report(orphan_references(parents, children)), "n_refs") == [(1,)] * 5
    assert rows(orphan_references(parents.limit(0), children), "reason") == [("missing",)] * 8
    assert rows(orphan_references(parents, children.limit(0))) == []


def test_vault_orphans_of_a_hot_name(spark, rows):
    notes = spark.createDataFrame([("n", "d/n", 1, ["x", "N", None], None, None)], "name string, key string, ord long, wiki_links array<string>, scanned_at timestamp_ntz, deleted_at timestamp_ntz")
    nodes = spark.createDataFrame([("n", None, None)], "name string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    es = edges(spark, [("a", "missing", 1.0)] * 500 + [("a", "n", 1.0)] * 500)
    got = Counter(r[0] for r in rows(vault_orphans(notes, nodes, es), "ref_table"))
    assert got == {"knowledge_edges": 500, "notes": 1}

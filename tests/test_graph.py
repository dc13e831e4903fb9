"""Rules of graph building, analytics, lineage and resolution on small graphs."""

import pytest
from pyspark.sql import functions as F

from notegrid import dims
from notegrid.operators import analytics, graph, lineage
from notegrid.plans import graph_queries, service_queries
from notegrid.plans.book import Vault

NOTE = "path string, name string, key string, content string, body string, frontmatter string, wiki_links array<string>, tags array<string>, ord long, deleted_at timestamp"


def notes(spark, *items):
    out = []
    for i, n in enumerate(items):
        key = n["key"]
        name = n.get("name", key.rsplit("/", 1)[-1])
        out.append((n.get("path", f"/v/{key}.md"), name, key, n.get("body", ""), n.get("body", ""), n.get("front"), n.get("links"), n.get("tags"), i, None))
    return spark.createDataFrame(out, NOTE)


def graph_of(spark, *edges):
    return spark.createDataFrame([(a, b, t, float(w)) for a, b, t, w in edges], "src string, dst string, type string, weight double")


def names(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "name string")


def test_resolver_prefers_shallow_then_first(spark, rows):
    n = notes(spark, {"key": "a/b/x"}, {"key": "a/x"}, {"key": "c/x"}, {"key": "y"})
    got = dict(rows(graph.link_resolver(n)))
    assert got["x"] == "a/x" and got["a/b/x"] == "a/b/x" and got["y"] == "y"


def test_last_write_wins_and_relations_follow_links(spark, rows):
    n = notes(spark, {"key": "a", "links": ["b", "zz"], "front": '{"uses": ["[[b|B]]"], "supports": "b", "related": null}'}, {"key": "b", "links": ["b"]})
    got = {(r[0], r[1]): r[2:] for r in rows(graph.last_writer_edges(graph.edge_log(n)))}
    assert got[("a", "b")] == ("supports", 0.6)
    assert got[("a", "zz")] == ("wiki_link", 1.0)
    assert got[("b", "b")] == ("wiki_link", 1.0)


def test_semantic_relation_replaces_links_only(spark, rows):
    n = notes(spark, {"key": "a", "links": ["b", "c"], "body": "based on [[b]] here", "front": '{"related": ["c"]}'}, {"key": "c"}, {"key": "b"})
    got = {(r[0], r[1]): (r[2], r[4]) for r in rows(graph.build_edges(n))}
    assert got == {("a", "b"): ("uses", True), ("a", "c"): ("related", False)}
    far = notes(spark, {"key": "a", "links": ["b"], "body": "based on" + " " * 60 + "[[b]]"})
    assert rows(graph.semantic_relations(far)) == []


def test_tag_edges_need_two_shared_and_no_link(spark, rows):
    n = notes(spark, {"key": "a", "tags": ["x", "y"], "links": ["c"]}, {"key": "b", "tags": ["x", "y"]}, {"key": "c", "tags": ["x", "y", "z"]})
    e = graph.last_writer_edges(graph.edge_log(n))
    assert rows(graph.tag_edges(n, e), "src", "dst", "weight") == [("a", "b", 0.3), ("b", "c", 0.3)]


def test_classification_order(spark, rows):
    n = notes(
        spark, {"key": "k1", "front": '{"type": "Meeting"}'}, {"key": "A001-x", "tags": ["tool"]}, {"key": "k3", "tags": ["Docker", "git", "idea"]},
        {"key": "01.PROJECT/k4", "path": "/v/01.PROJECT/k4.md"}, {"key": "k5"}, {"key": "k6", "front": "broken"},
    )
    assert dict(rows(graph.classify_notes(n))) == {"k1": "event", "A001-x": "source", "k3": "tool", "01.PROJECT/k4": "project", "k5": "note", "k6": "note"}


def test_pagerank_sums_to_one_and_is_uniform_on_a_ring(spark):
    ring = graph_of(spark, ("a", "b", "r", 1), ("b", "c", "r", 1), ("c", "a", "r", 1))
    ranks = {r.name: r.rank for r in analytics.pagerank(ring, names(spark, "a", "b", "c")).collect()}
    assert all(abs(x - 1 / 3) < 1e-6 for x in ranks.values())
    star = graph_of(spark, ("a", "h", "r", 1), ("b", "h", "r", 3))
    ranks = {r.name: r.rank for r in analytics.pagerank(star, names(spark, "a", "b", "h"), tolerance=1e-3).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["h"] > ranks["a"]


def test_components_of_a_long_path(spark, rows):
    path = graph_of(spark, *[(f"n{i:02}", f"n{i + 1:02}", "r", 1) for i in range(40)], ("x", "x", "r", 1))
    all_names = names(spark, *[f"n{i:02}" for i in range(41)], "x", "alone")
    got = dict(rows(analytics.components(path, all_names)))
    assert {got[f"n{i:02}"] for i in range(41)} == {"n00"} and got["x"] == "x" and got["alone"] == "alone"
    assert rows(analytics.component_histogram(analytics.components(path, all_names))) == [("1", 2, 2), ("11-50", 1, 41)]


def test_hops_paths_and_cycles(spark, rows):
    g = graph_of(spark, ("a", "b", "uses", 1), ("b", "c", "uses", 1), ("c", "a", "uses", 1), ("c", "d", "related", 1), ("d", "c", "uses", 1))
    assert rows(analytics.k_hop(g, names(spark, "a"), 2)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(analytics.neighbours(g, "c", 1)) == [("a", 1, "uses"), ("b", 1, "uses"), ("d", 1, "related")]
    assert [r[0] for r in rows(analytics.simple_paths(g, "a", "d", 3))] == [["a", "b", "c", "d"], ["a", "c", "d"]]
    assert rows(analytics.cycles(g, ["uses"], 4)) == [("uses", ["a", "b", "c"], 3)]


def shuffled(spark, run):
    """The result of run() and the records that its stages wrote to shuffles, as on tables too large for broadcasts."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(60_000)
        listed = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {listed.apply(i).stageId(): listed.apply(i).shuffleWriteRecords() for i in range(listed.size())}

    before = max(stages(), default=-1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return result, sum(n for i, n in stages().items() if i > before)


def test_cycles_of_four_through_a_hub(spark, rows):
    # every way into the hub closes one cycle, of the 400 * 400 pairs of ways in and out; two other hubs close 30 * 30
    loops = [(a, b, "uses", 1) for i in range(400) for a, b in ((f"a{i:03}", "hub"), ("hub", f"y{i:03}"), (f"y{i:03}", f"z{i:03}"), (f"z{i:03}", f"a{i:03}"))]
    two = [(a, b, "uses", 1) for i in range(30) for a, b in (("p", f"u{i:02}"), (f"u{i:02}", "q"), ("q", f"v{i:02}"), (f"v{i:02}", "p"))]
    got, records = shuffled(spark, lambda: rows(analytics.cycles(graph_of(spark, *loops, *two), ["uses"])))
    want = [("uses", [f"a{i:03}", "hub", f"y{i:03}", f"z{i:03}"], 4) for i in range(400)]
    want += [("uses", ["p", f"u{i:02}", "q", f"v{j:02}"], 4) for i in range(30) for j in range(30)]
    assert got == sorted(want, key=repr)
    assert records < 100_000, records


def test_cycles_of_three_beside_dead_ends(spark, rows):
    # 400 cycles through a hub that as many dead ends point at, and that points at as many
    loops = [(a, b, "uses", 1) for i in range(400) for a, b in ((f"a{i:03}", "hub"), ("hub", f"z{i:03}"), (f"z{i:03}", f"a{i:03}"), (f"b{i:03}", "hub"), ("hub", f"x{i:03}"))]
    more = [("hub", "hub", "uses", 1), ("hub", "pair", "uses", 1), ("pair", "hub", "uses", 1), ("pair", "a000", "supports", 1)]
    got, records = shuffled(spark, lambda: rows(analytics.cycles(graph_of(spark, *loops, *more), ["uses", "supports"], 3)))
    want = [("uses", [f"a{i:03}", "hub", f"z{i:03}"], 3) for i in range(400)] + [("uses", ["hub"], 1), ("uses", ["hub", "pair"], 2)]
    assert got == sorted(want, key=repr)
    assert records < 100_000, records


@pytest.mark.parametrize("words", [analytics.MARK_WORDS, 1])
def test_cycles_of_a_log_whose_writes_mostly_lie_on_none(spark, tmp_path, rows, monkeypatch, words):
    monkeypatch.setattr(analytics, "MARK_WORDS", words)  # with one word, pairs share marks
    log = [(f"n{i:05}", f"m{i % 7}", "related") for i in range(12_000)] + [("hub", f"n{i:05}", "uses") for i in range(3_000)]
    log += [("hub", "a", "related"), ("a", "b", "uses"), ("b", "hub", "uses"), ("hub", "a", "uses"), ("a", "a", "supports")]  # written as related first
    log += [("c", "d", "uses"), ("d", "c", "uses"), ("d", "c", "wiki_link"), ("e", "e", "uses"), ("e", "e", "related")]  # written as something else last
    log += [("f", "g", "uses"), ("g", "f", "supports"), ("f", "", "uses"), ("", "f", "uses"), (None, "f", "uses"), ("f", None, "uses")]
    log += [("p", "q", "uses"), ("q", "p", "supports"), ("q", "p", None), ("q", "p", "uses"), ("p", "q", "uses")]
    spark.createDataFrame([(i, a, b, t, 1.0) for i, (a, b, t) in enumerate(log)], "id long, source_name string, target_name string, relation string, weight double").write.parquet(str(tmp_path / "knowledge_edges.parquet"))
    got, records = shuffled(spark, lambda: rows(graph_queries.ga15_cycles(Vault(spark, str(tmp_path)))))
    assert got == sorted([("uses", ["a", "b", "hub"], 3), ("uses", ["p", "q"], 2), ("supports", ["a"], 1)], key=repr)
    assert words == 1 or records < 18_000, records


def test_communities_cover_all_and_repeat(spark, rows):
    clique = [(a, b, "r", 1) for s in ("abcd", "wxyz") for a in s for b in s if a < b]
    g = graph_of(spark, *clique, ("d", "w", "r", 0.1))
    labels = rows(analytics.communities(g, names(spark, *"abcdwxyz", "q")))
    assert labels == rows(analytics.communities(g, names(spark, *"abcdwxyz", "q")))
    by = dict(labels)
    assert len({by[x] for x in "abcd"}) == 1 and by["a"] != by["z"] and by["q"] == "q"


def centers(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "center string")


SIMPLE = [("A", "B", "source", 1), ("A", "C", "derived_from", 1), ("A", "D", "used_in", 1), ("D", "E", "applied_to", 1)]


def test_lineage_roles_and_filter(spark, rows):
    g = graph_of(spark, *SIMPLE)
    got = {r[1]: r[2:] for r in rows(lineage.lineage_nodes(g, centers(spark, "A")))}
    assert got == {"A": (0, "center"), "B": (1, "upstream"), "C": (1, "upstream"), "D": (1, "downstream"), "E": (2, "downstream")}
    types = spark.createDataFrame([("A", "concept"), ("B", "source"), ("C", "project"), ("D", "tool"), ("E", "concept")], "name string, entity_type string")
    keep = lambda *t: [r[1] for r in rows(lineage.lineage_nodes(g, centers(spark, "A"), types=types, keep_types=list(t)))]
    assert keep("source") == ["A", "B"] and keep() == ["A"]
    assert rows(lineage.lineage_stats(lineage.lineage_nodes(g, centers(spark, "A")))) == [("A", 5, 2, 2, 0, 2)]


def test_lineage_two_way_relations_bridge(spark, rows):
    g = graph_of(spark, ("c", "x", "contradicts", 1), ("c", "y", "tag_shared", 1), ("s", "c", "related", 1))
    got = {r[1]: r[3] for r in rows(lineage.lineage_nodes(g, centers(spark, "c")))}
    assert got == {"c": "center", "x": "bridge", "s": "bridge"}
    assert rows(lineage.lineage_edges(g, lineage.lineage_nodes(g, centers(spark, "c"))), "source", "target") == [("c", "x"), ("s", "c")]
    with pytest.raises(ValueError):
        lineage.lineage_nodes(g, centers(spark, "c"), direction="sideways")


def test_weighted_lineage(spark, rows):
    g = graph_of(spark, ("root", "strong", "source", 10), ("root", "weak", "source", 0.1), ("strong", "deep_strong", "uses", 5), ("weak", "deep_weak", "uses", 5), ("root", "never", "source", 0))
    got = {r[1]: r[2:] for r in rows(lineage.weighted_lineage(g, centers(spark, "root")))}
    assert got["strong"] == (1, "upstream", 10.0) and got["weak"][2] == 0.1 and "never" not in got
    assert got["deep_strong"] == (2, "upstream", round(1 / 0.3, 6)) and got["root"] == (0, "center", 0.0)
    uniform = graph_of(spark, ("A", "B", "source", 1), ("B", "C", "source", 1), ("A", "D", "derived_from", 1))
    plain = {r[1] for r in rows(lineage.lineage_nodes(uniform, centers(spark, "A"), 3))}
    assert plain == {r[1] for r in rows(lineage.weighted_lineage(uniform, centers(spark, "A"), 3))}


def test_resolve_node(spark):
    nodes = spark.createDataFrame(
        [("10/K", "K", "/v/10/K.md", "concept"), ("stub/K", "K", "/v/stub/K.md", "concept"), ("a/Release Plan", "Release Plan", "/v/a/Release Plan.md", "concept"),
         ("b/Release Plan", "Release Plan", "/v/b/Release Plan.md", "concept"), ("g/Graph Search", "Graph Search", None, "concept")],
        "key string, name string, path string, entity_type string",
    )
    assert lineage.resolve_node(nodes, "10\\K.md") == "10/K" and lineage.resolve_node(nodes, "K") == "10/K"
    assert lineage.resolve_node(nodes, "Graph") is None and lineage.resolve_node(nodes, "graph se") == "g/Graph Search"
    assert lineage.resolve_node(nodes, "") is None and lineage.resolve_node(nodes, "nothing") is None
    with pytest.raises(lineage.AmbiguousNodeError) as e:
        lineage.resolve_node(nodes, "Release Plan")
    assert len(e.value.candidates) == 2


def test_degrees_count_own_edges_twice(spark, rows):
    assert rows(analytics.degrees(graph_of(spark, ("a", "a", "r", 1), ("a", "b", "r", 1)))) == [("a", 3, 1, 2), ("b", 1, 1, 0)]
    assert analytics.graph_summary(names(spark, "a").withColumn("is_dangling", F.lit(False)), graph_of(spark).limit(0)).first().density == 0.0


def test_ranks_of_searches_are_weighted_pagerank(spark, tmp_path):
    log = [(i, f"s{i}", "busy", 0.01) for i in range(8)] + [(100 + i, f"s{i}", "rich", 1.0) for i in range(7)] + [(200 + i, "busy", f"s{i}", 1.0) for i in range(8)]
    spark.createDataFrame([(i, a, b, "uses", w) for i, a, b, w in log], "id long, source_name string, target_name string, relation string, weight double").write.parquet(str(tmp_path / "knowledge_edges.parquet"))
    spark.createDataFrame([(1, "alone", None, None, None)], "id long, name string, entity_type string, source_path string, deleted_at timestamp").write.parquet(str(tmp_path / "knowledge_nodes.parquet"))
    got = {r["name"]: r["rank"] for r in service_queries.weighted_ranks(Vault(spark, str(tmp_path))).collect()}
    names_ = sorted(got)
    out = {n: {} for n in names_}
    for _, a, b, w in log:
        out[a][b] = w
    rank = dict.fromkeys(names_, 1 / len(names_))
    for _ in range(200):
        lost = sum(rank[n] for n in names_ if not out[n])
        new = dict.fromkeys(names_, 0.15 / len(names_) + 0.85 * lost / len(names_))
        for a in names_:
            for b, w in out[a].items():
                new[b] += 0.85 * rank[a] * w / sum(out[a].values())
        rank = new
    assert "alone" in got and all(abs(got[n] - rank[n]) < 1e-4 for n in names_)
    assert got["rich"] > got["busy"]  # the degree has it the other way round


def test_whole_graph_queries(spark, tmp_path, rows):
    dep = dims.DEPENDENCY_RELATIONS[0]
    ends = [("Tool Shelf", "a", "wiki_link"), ("a", "b", "related"), ("b", "c", "uses"), ("c", "Open Questions", "wiki_link")]
    ends += [(f"l{i}", f"l{(i + 1) % 4}", dep) for i in range(4)]
    spark.createDataFrame([(i, a, b, t, 1.0) for i, (a, b, t) in enumerate(ends)], "id long, source_name string, target_name string, relation string, weight double").write.parquet(str(tmp_path / "knowledge_edges.parquet"))
    nodes = [(1, "alone"), (900, "a")]
    spark.createDataFrame([(i, n, None, "vault", None, None) for i, n in nodes], "id long, name string, entity_type string, source string, source_path string, deleted_at timestamp").write.parquet(str(tmp_path / "knowledge_nodes.parquet"))
    run = lambda name: {**graph_queries.QUERIES, **service_queries.QUERIES}[name](spark, str(tmp_path))
    path = ["Tool Shelf", "a", "b", "c", "Open Questions"]
    loop = [f"l{i}" for i in range(4)]
    assert rows(run("ga3_components"), "name", "component") == sorted([(n, "Open Questions") for n in path] + [(n, "l0") for n in loop] + [("alone", "alone")])
    assert rows(run("ag12_component_sizes"), "bucket", "n_components", "n_nodes") == [("1", 1, 1), ("3-5", 2, 9)]
    assert rows(run("ga7_all_simple_paths"), "path", "length") == [(path, 4)]
    assert rows(run("ga15_longer_cycles"), "cycle", "length") == [(loop, 4)]
    ranks = dict(rows(run("ga2_settled_pagerank"), "name", "rank"))
    assert sum(ranks.values()) == pytest.approx(1) and ranks["l0"] == pytest.approx(ranks["l3"], rel=1e-3)
    assert ("a", "vault") in rows(run("sk7_whole_import"), "name", "source")

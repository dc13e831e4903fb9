"""Validation, retrieval, enrichment, state, trust and streaming on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from notegrid.functions import text as tx
from notegrid.operators import enrich, graph, retrieve, score, state, validate
from notegrid.streaming import incremental
from tests.test_graph import graph_of, names, notes


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text_functions(spark):
    lit = F.lit
    assert value(spark, tx.normal_ref(lit("A\\\\b//C%20d+e.MD"))) == "a/b/c d+e"
    assert value(spark, tx.normal_ref(lit("50% of"))) == "50% of"
    assert value(spark, tx.slug(lit(" Hello, 세계!  C++ x-y "))) == "hello-c++-x-y"
    assert value(spark, tx.unwrap_link(lit(" [[a#h|b]] "))) == "a" and value(spark, tx.unwrap_link(lit("a [[b]]"))) == "a [[b]]"
    days = {"x 2026-03_14_Review": "2026-03-14", "2026-02-31": None, "a20260314b": "2026-03-14", "120260314": None, "1999-01-01": None, "2026-13-01 20260102": "2026-01-02"}
    assert {d: value(spark, tx.typed_date(lit(d))) for d in days} == days
    assert value(spark, tx.labelled_value(lit("a\r\n  Chosen: - the one:\nselected: x"), ["chosen:", "selected:"])) == "the one"
    assert value(spark, tx.first_url(lit("see https://www.a.b/c?x=1."))) == "https://www.a.b/c?x=1" and value(spark, tx.domain(lit("https://www.a.b/c"))) == "a.b"
    assert value(spark, tx.body_text(lit("---\na: 1\n---\nbody"))) == "body" and value(spark, tx.body_text(lit("---\na: 1\n---x"))) == "x"
    assert value(spark, tx.body_text(lit("no front"))) == "no front" and value(spark, tx.wiki_links(lit("[[b]] [[a#x|y]] [[b]] [[ ]]"))) == ["b", "a"]
    assert value(spark, tx.all_tags(lit('{"tags": "#x, y"}'), lit("#zz #q\n#한글 a#b"))) == ["x", "y", "zz", "한글"]
    assert value(spark, tx.headings(lit("# A\n##### no\n#B\n ## C d"))) == ["A", "C d"]


def test_keyword_score(spark):
    s = lambda name, key, body, tags, q: value(spark, tx.keyword_score(F.lit(name), F.lit(key), F.lit(body), F.array(*map(F.lit, tags)).cast("array<string>"), q))
    assert s("Graph", "k", "", [], "graph") == 8.0
    assert s("x", "graph/x", "graph graph", ["GraphRAG"], "graph") == 1 + 1 + 2
    assert s("x", "k", "a.b " * 20, [], "a.b") == 3.0 and s("x", "k", "axb", [], "a.b") == 0.0
    assert s("go", "k", "", [], "go go") == 16.0 and s("a", "a", "a", [], "a") == 0.0


def test_fusion_with_zero_vectors(spark, rows):
    kw = spark.createDataFrame([("a", 4.0), ("b", 2.0)], "key string, score double")
    vec = spark.createDataFrame([("b", 0.0), ("untitled 1", 0.0)], "key string, score double")
    ranks = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, rank double")
    got = [tuple(r) for r in retrieve.fuse(kw, vec, ranks, (0.5, 0.3, 0.2)).select("key", "score").collect()]
    assert got == [("a", pytest.approx(0.6)), ("b", pytest.approx(0.45))]
    empty = kw.limit(0)
    assert rows(retrieve.fuse(empty, empty, ranks, (0.5, 0.3, 0.2))) == []


def test_vector_search(spark, rows):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", [-1.0, 0.0]), ("d", [1.0]), ("x", None)], "key string, vector array<float>")
    assert rows(retrieve.vector_search(v, [2.0, 0.0], 3)) == [("a", 1.0), ("z", 0.0)]


def test_question_kinds(spark):
    kind = lambda q: value(spark, retrieve.question_kind(F.lit(q)))
    assert [kind("설치 방법"), kind("link between x with y"), kind("최신 트렌드 비교"), kind("zzz")] == ["factual", "relational", "exploratory", "factual"]


def test_shapes(spark, rows):
    n = notes(
        spark, {"key": "e", "front": '{"type": "event", "event_date": "14-03-2026", "decisions": "[[Python]]"}'}, {"key": "Python", "front": '{"type": "tool", "category": "language", "used_in": "p"}'},
        {"key": "p", "front": '{"type": "project", "github": "https://x.y", "uses": ["Python"]}'}, {"key": "t", "tags": ["x"]},
    )
    got = {(r.key, r.rule) for r in validate.validate_notes(n).collect()}
    assert got == {("e", "invalid-date-format"), ("e", "relation-target-mismatch"), ("t", "missing-explicit-type")}
    q = validate.quality(n, validate.validate_notes(n)).first()
    assert (q.notes, q.passed, q.warned, q.failed) == (4, 2, 1, 1) and q.quality == pytest.approx(75.0)
    d = notes(spark, {"key": "d", "front": '{"type": "decision", "chosen": "x"}'}, {"key": "m", "front": '{"type": "person"}'})
    assert rows(validate.cardinality_violations(d, graph.classify_notes(d)), "key", "actual") == [("d", "1/2"), ("m", "0/1")]


def test_graph_checks(spark, rows):
    log = graph_of(spark, ("a", "b", "supports", 1), ("a", "b", "contradicts", 1), ("b", "a", "supports", 1), ("x", "y", "uses", 1), ("y", "x", "used_in", 1))
    assert rows(validate.contradictions(log)) == [("a", "b")]
    assert rows(validate.missing_inverses(log)) == [("a", "supported_by", "b"), ("b", "supported_by", "a")]
    cyc = graph_of(spark, ("A", "B", "derived_from", 1), ("B", "A", "derived_from", 1), ("A", "C", "related", 1), ("C", "A", "related", 1))
    assert rows(validate.dependency_cycles(cyc)) == [("A", "derived_from", 2), ("B", "derived_from", 2)]


def test_enrichment(spark, rows):
    n = notes(
        spark, {"key": "2024-01-02 Alpha", "body": "speaks of Gamma Delta and Gamma", "tags": ["t1", "t2", "t3"]}, {"key": "2024-01-02 Beta", "tags": ["t1", "t2", "t3"]},
        {"key": "Gamma", "body": ""}, {"key": "Gamma Delta", "body": "[[Gamma]] Gamma", "links": ["Gamma"]},
    )
    assert rows(enrich.missing_backlinks(n)) == [("2024-01-02 Alpha", "Gamma Delta"), ("2024-01-02 Alpha", "Gamma")]
    assert rows(enrich.related_notes(n, {}), "key", "related", "score") == [("2024-01-02 Alpha", "2024-01-02 Beta", 5), ("2024-01-02 Beta", "2024-01-02 Alpha", 5)]
    assert rows(enrich.enrichment_plan(n, {"Gam": "G"}).limit(9), "key", "changes")[2:] == [("Gamma Delta", ["project: G"]), ("Gamma", ["project: G"])]
    assert value(spark, enrich.replace_block(F.lit("a <!-- AUTO:x -->old<!-- /AUTO:x --> b"), "x", "$1 \\ new")) == "a <!-- AUTO:x -->\n$1 \\ new\n<!-- /AUTO:x --> b"
    assert value(spark, enrich.is_garbage(F.lit("[x"), F.lit(False))) and not value(spark, enrich.is_garbage(F.lit("a.png"), F.lit(False)))
    text = rows(enrich.map_texts(n, "key", "body", len, "int"), "value")
    assert (0,) in text


def test_bridges_take_the_best_node_of_the_main_part(spark, rows):
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("z", "z")], "name string, component string")
    tags = spark.createDataFrame([(x, t) for x, ts in {"a": "12", "b": "123", "z": "123"}.items() for t in ts], "name string, tag string")
    assert rows(enrich.bridge_components(labels, tags)) == [("z", "b", 3)]


def test_state(spark, rows):
    snap = lambda *r: spark.createDataFrame(list(r), "key string, checksum string")
    assert rows(state.change_set(snap(("a", "1"), ("b", "1"), ("c", "1")), snap(("a", "1"), ("b", "2"), ("d", "1")))) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    t = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "k string, v int, made string")
    ch = spark.createDataFrame([("a", 2, "new", 1), ("a", 3, "new", 2), ("c", 9, "new", 1)], "k string, v int, made string, seq int")
    assert rows(state.upsert(t, ch, ["k"], keep=["made"])) == [("a", 3, "old"), ("b", 1, "old"), ("c", 9, "new")]
    assert rows(state.import_new(t, ch.withColumn("k", F.when(F.col("k") == "c", " ").otherwise(F.col("k"))), ["k"])) == [("a", 1, "old"), ("b", 1, "old")]
    assert rows(state.delete_nodes(names(spark, "a", "b"), graph_of(spark, ("a", "b", "r", 1), ("c", "d", "r", 1)), names(spark, "b"))[1], "src") == [("c",)]


def test_trust(spark, rows):
    r = spark.createDataFrame([("t", 1, "https://arxiv.org/x", "benchmark 3x", "2026-01-01"), ("t", 2, "https://b.c/", "nothing", "2 years"), ("s", 3, "https://b.c/", "", None)], "topic string, result_id long, url string, content string, date string")
    t = score.source_trust(F.col("url"), F.col("content"), {"arxiv.org": 0.95}, boost=["benchmark", "3x"])
    assert sorted(x[0] for x in r.select(t).collect()) == [0.45, 0.45, 1.0]
    assert rows(score.freshness(r, "2026-02-01")) == [("s", 0.5), ("t", 1.0)]
    assert rows(score.specificity(r)) == [("s", 0.0), ("t", 0.5)]
    assert rows(score.agreement(r, F.split("content", " ")))[0] == ("s", 0.3)
    assert value(spark, score.grade(F.lit(0.6))) == "B"


def test_streamed_upserts(spark, tmp_path, rows):
    schema = "k string, v int, seq int"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], schema).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([], "k string, v int").write.parquet(str(tmp_path / "out/0"))
    last = [0]

    def load():
        return spark.read.parquet(str(tmp_path / f"out/{last[0]}"))

    def store(df, number):
        df.write.mode("overwrite").parquet(str(tmp_path / f"out/{number + 1}"))
        last[0] = number + 1

    run = lambda: incremental.upsert_stream(incremental.read_stream(spark, str(tmp_path / "in/*"), schema), load, store, ["k"], str(tmp_path / "cp")).awaitTermination()
    run()
    assert rows(load()) == [("a", 2)]
    spark.createDataFrame([("b", 5, 3)], schema).write.parquet(str(tmp_path / "in/2"))
    run()
    assert rows(load()) == [("a", 2), ("b", 5)]


def test_windows(spark, rows):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    ev = spark.createDataFrame([(1, at(0), "x", 1.0), (1, at(20), "x", 2.0), (1, at(70), "y", 3.0)], "user_id long, ts timestamp, event_type string, value double")
    assert [r[2] for r in rows(incremental.window_counts(ev))] == [2, 1]
    assert [r[2] for r in rows(incremental.sessions(ev))] == [2, 1]


def test_related_by_frequent_tags_and_days(spark, rows):
    data = [(f"n{i}", f"2024-01-05 n{i}", f"Harbor/n{i}.md", i, ["x", "y", "z"]) for i in range(120)] + [("d1", "2024-01-05 p", "Harbor/p.md", 500, None), ("q", "q", "q.md", 501, ["x", "y"])]
    notes = spark.createDataFrame(data, "key string, name string, path string, ord long, tags array<string>")
    want = [("d1", f"2024-01-05 n{i}", 3, i + 1) for i in range(5)] + [("n3", f"2024-01-05 n{i}", 6, p) for p, i in enumerate((0, 1, 2, 4, 5), 1)]
    for first in (2, 1_024):
        got = enrich.related_notes(notes, {"Harbor": "H"}, first=first)
        assert rows(got.where("key IN ('d1', 'n3', 'q')"), "key", "related", "score", "place") == want


def test_metadata_is_normalised(spark):
    """What a note of its type should have is filled in; typed values stay."""
    schema = "key string, name string, path string, body string, frontmatter string, tags array<string>, headings array<string>, type string"
    data = [
        ("explicit", "Tool config Setup", "a/Setup.md", "text", '{"type": "note"}', None, None, "clash"),
        ("source", "Paper clip", "a/s.md", "see https://example.invalid/x).", '{"type": "Reference", "url": ""}', ["web"], None, ""),
        ("article", "Words", "a/w.md", "see https://example.invalid/x.", '{"type": "newsletter"}', None, None, ""),
        ("event", "2026-03_14_Review", "a/e.md", "", '{"type": "meeting", "status": "Done"}', None, None, ""),
        ("tool", "docker", "a/t.md", "https://example.invalid/d", '{"type": "tool", "confidence": "0.5"}', None, None, ""),
        ("decision", "Choice", "a/d.md", "Chosen: left\nBecause: near", '{"type": "decision", "decided": "2026-01-02", "confidence": "sure"}', None, None, ""),
        ("plain", "Anything", "a/p.md", "words", "{}", None, None, ""),
        ("blank", "Anything", "a/b.md", " ", None, None, None, ""),
        ("odd", "Anything", "a/o.md", None, '{"type": "thing", "status": ["active"]}', None, None, ""),
    ]
    got = {r.key: {c: v for c, v in r.asDict().items() if v is not None and c != "key"} for r in enrich.normal_metadata(spark.createDataFrame(data, schema)).collect()}
    assert got == {
        "explicit": {"type": "note"},
        "source": {"type": "source", "url": "https://example.invalid/x", "source_type": "paper"},
        "article": {"type": "source", "url": "https://example.invalid/x", "source_type": "article"},
        "event": {"type": "event", "status": "completed", "event_date": "2026-03-14"},
        "tool": {"type": "tool", "confidence": "medium", "url": "https://example.invalid/d", "category": "platform"},
        "decision": {"type": "decision", "confidence": "sure", "decided": "2026-01-02", "chosen": "left", "rationale": "near"},
        "plain": {"type": "note"},
        "blank": {},
        "odd": {"type": "thing", "status": "active"},
    }
    assert enrich.normal_metadata(spark.createDataFrame([], schema)).collect() == []

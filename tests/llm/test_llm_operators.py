"""The operators for training data against brute force, on small fixtures."""

import base64
import itertools
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notegrid.llm import bpe, canonical, cooccurrence, edit, knn, lookalike, names, packing, queries

DATA = "/root/testdata/sf0.1"
VECTORS = "id long, embedding array<float>, model string, grp string, cosine double"


def vectors(spark, items):
    return spark.createDataFrame([(i, v, m, "clash", 0.0) for i, v, m in items], VECTORS)


def brute_neighbours(items, k, least):
    groups = defaultdict(list)
    for i, v, m in items:
        if v and None not in v and any(v):
            x = np.array(v, np.float32).astype(float)
            groups[m, len(v)].append((i, x / np.linalg.norm(x)))
    out = set()
    for members in groups.values():
        x = np.stack([v for _, v in members])
        c = x @ x.T
        np.fill_diagonal(c, -2)
        for r, (i, _) in enumerate(members):
            order = sorted(range(len(members)), key=lambda j: (-round(c[r, j], 12), members[j][0]))
            out |= {(i, members[j][0]) for j in order[:k] if j != r and c[r, j] >= least}
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 48))
    x = np.concatenate([base + 0.25 * rng.normal(size=base.shape) for _ in range(6)])
    items = [(i, v.tolist(), "m") for i, v in enumerate(x)]
    want = brute_neighbours(items, 5, 0.8)
    got = {(r.id, r.other) for r in knn.nearest_rows(vectors(spark, items), "id", "embedding", ["model"], k=5, min_cosine=0.8, per_pivot=43, posts=3, candidates=64).collect()}
    assert len(want) > 3000 and len(got & want) / len(want) >= 0.95 and len(got - want) <= len(want - got) + 5


def exact_search(folder, every):
    """{id: its 10 nearest ids} by brute force, for the ids divisible by `every`."""
    t = pq.read_table(f"{folder}/knowledge_embeddings.parquet").to_pydict()
    groups = defaultdict(list)
    for i, m, v in zip(t["id"], t["model"], t["embedding"]):
        if v and None not in v and any(v):
            groups[m, len(v)].append((i, v))
    out = {}
    for members in groups.values():
        members.sort()
        ids = np.array([i for i, _ in members])
        x = np.array([v for _, v in members], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for at in np.flatnonzero(ids % every == 0):
            c = np.round(x @ x[at], 12)
            c[at] = -2
            out[int(ids[at])] = [int(j) for j in ids[np.argsort(-c, kind="stable")[:10]] if j != ids[at]]
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize(("name", "flat", "block"), [("p2_search", 4096, 4096), ("p2_neighbours", 4096, 4096), ("p2_neighbours", 64, 600), ("p2_search", 64, 600)])
def test_recall_without_a_least_cosine(spark, monkeypatch, name, flat, block):
    """At least 0.9 of the 10 nearest of every id divisible by 50, also with pivots in two levels and files in blocks."""
    monkeypatch.setattr(knn, "FLAT_PIVOTS", flat)
    monkeypatch.setattr(knn, "BLOCK", block)
    found = queries.QUERIES[name](spark, DATA).where(F.col("id") % 50 == 0).select("id", "other").collect()
    want = {(i, j) for i, near in exact_search(DATA, 50).items() for j in near}
    got = {tuple(r) for r in found}
    assert len(want) > 3500 and len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_a_query_among_copies_of_others(spark):
    items = [(i, [float(i % 3 + 1), 1.0, 0.5], "m") for i in range(30)]
    found = knn.nearest_rows(vectors(spark, items), "id", "embedding", ["model"], k=2, posts=2, probes=4, queries=F.col("id") == 7).collect()
    assert {(r.id, r.other) for r in found} == {(7, 1), (7, 4)}


def test_every_vector_has_ten_neighbours(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(60, 24))
    items = [(i, v.tolist(), "m") for i, v in enumerate(x)]
    vectors(spark, items).write.parquet(str(tmp_path / "knowledge_embeddings.parquet"))
    got = {(r.id, r.other) for r in queries.QUERIES["p2_neighbours"](spark, str(tmp_path)).collect()}
    assert len(got) == 600 and got == brute_neighbours(items, 10, -1)


def test_neighbours_of_odd_vectors(spark, rows):
    items = [
        (1, [1.0, 0.0], "m"), (2, [2.0, 0.0], "m"), (3, [1.0, 0.0], "n"), (4, [1.0, 0.0, 0.0], "m"), (5, None, "m"), (6, [], "m"), (7, [0.0, 0.0], "m"), (8, [0.0, 0.0], "m"),
        (9, [1.0, None], "m"), (10, [float("nan"), 1.0], "m"), (11, [1.0, 0.1], None), (12, [1.0, 0.1], None), (13, [-1.0, 0.0], "m"),
    ]
    got = rows(knn.nearest_rows(vectors(spark, items), "id", "embedding", ["model"], k=2, min_cosine=0.5), "id", "other")
    assert got == [(1, 2), (11, 12), (12, 11), (2, 1)]
    assert rows(knn.nearest_rows(vectors(spark, []), "id", "embedding", ["model"])) == []


def test_neighbours_among_many_copies(spark):
    items = [(i, [1.0, 2.0, 3.0], "m") for i in range(400)] + [(1000, [1.0, 2.0, 3.1], "m"), (1001, [1.0, 0.0, 0.0], "m")]
    got = defaultdict(list)
    for r in knn.nearest_rows(vectors(spark, items), "id", "embedding", ["model"], k=3, min_cosine=0.9, per_pivot=10, posts=3).collect():
        got[r.id].append(r.other)
    assert sorted(got[0]) == [1, 2, 3] and sorted(got[399]) == [0, 1, 2] and sorted(got[1000]) == [0, 1, 2] and 1001 not in got
    pairs = knn.similar_pairs(knn.nearest_rows(vectors(spark, items), "id", "embedding", ["model"], k=3, min_cosine=0.9)).collect()
    assert all(r.id_a < r.id_b for r in pairs) and len(pairs) == len(set(pairs))


def test_two_level_pivots_find_the_nearest():
    rng = np.random.default_rng(2)
    pivots = knn.Pivots(rng.normal(size=(6000, 16)))
    assert pivots.members
    x = (lambda a: a / np.linalg.norm(a, axis=1, keepdims=True))(rng.normal(size=(200, 16))).astype(np.float32)
    near = pivots.nearest(x, 4)
    exact = np.argsort(-(x @ pivots.vectors.T), axis=1)[:, :4]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(near.tolist(), exact.tolist())]) > 3.2


def test_footrule():
    a, b = np.array([[1, 2, 3]], np.uint16), np.array([[1, 2, 3], [3, 2, 1], [7, 8, 9], [9, 1, 2]], np.uint16)

    def distance(p, q):
        place = lambda s, x: s.index(x) if x in s else len(s)
        return sum(abs(place(p, x) - place(q, x)) for x in {*p, *q})

    got = [3 * 4 - 2 * int(s) for s in knn.footrule_overlap(a, b)[0]]
    assert got == [distance(a[0].tolist(), q) for q in b.tolist()]


NOTES = "key string, tags array<string>, wiki_links array<string>, item string, num int"


def brute_pairs(data, least):
    sets = defaultdict(set)
    for k, t in data:
        if k is not None:
            sets[k] |= {x.lower().strip().lstrip("#").strip() for x in t or [] if x} - {""}
    pairs = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    return {p: n for p, n in pairs.items() if n >= least}, len(sets)


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    data = [(f"k{rng.randint(0, 300)}", [rng.choice(["a", "B", "# c", "d ", "##e", "f", "", None, "한"]) for _ in range(rng.randint(0, 5))]) for _ in range(600)]
    data += [(None, ["a", "b"]), ("n", None), ("big", [f"x{i}" for i in range(150)]), ("big2", [f"X{i}" for i in range(150)])]
    df = spark.createDataFrame([(k, t, None, "clash", 1) for k, t in data], NOTES)
    for least in (1, 2, 6):
        want, n = brute_pairs(data, least)
        got = {(r.item_a, r.item_b): r for r in cooccurrence.note_pairs(df, least).collect()}
        assert {p: r.n_ab for p, r in got.items()} == want and all(r.n_records == n for r in got.values())
    r = got[("a", "b")]
    assert r.lift == pytest.approx(r.n_ab * n / (r.n_a * r.n_b))
    assert r.odds_ratio == pytest.approx((r.n_ab + 0.5) * (n - r.n_a - r.n_b + r.n_ab + 0.5) / ((r.n_a - r.n_ab + 0.5) * (r.n_b - r.n_ab + 0.5)))
    assert cooccurrence.note_pairs(df.limit(0), 1).collect() == []


def test_all_pairs_has_rare_ones(spark, tmp_path):
    data = [(f"k{i}", ["a", "b"] if i < 6 else ["a", f"t{i}"]) for i in range(9)]
    spark.createDataFrame([(k, t, None, "clash", 1) for k, t in data], NOTES).write.parquet(str(tmp_path / "notes.parquet"))
    got = {(r.item_a, r.item_b): r.n_ab for r in queries.QUERIES["p3_all_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): 6, ("a", "t6"): 1, ("a", "t7"): 1, ("a", "t8"): 1}
    assert [(r.item_a, r.item_b) for r in queries.QUERIES["p3_pairs"](spark, str(tmp_path)).collect()] == [("a", "b")]


def test_long_records_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK_ITEMS", 7)
    df = spark.createDataFrame([("a", [f"t{i}" for i in range(40)], ["L.md", "l", "x\\y"], "", 0)], NOTES)
    got = cooccurrence.note_pairs(df, 1).collect()
    tags = {(r.item_a, r.item_b) for r in got if r.field_name == "tags"}
    assert len(tags) == 40 * 39 // 2 == sum(r.field_name == "tags" for r in got)
    assert [(r.item_a, r.item_b) for r in got if r.field_name == "wiki_links"] == [("l", "x/y")]


def test_one_very_long_record(spark):
    """The pairs of 100,000 items of one record are counted as they stream by; none is kept."""
    items = spark.range(100_000).selectExpr("'tags' AS field_name", "'r' AS record", "CAST(id AS INT) AS num")
    blocks = cooccurrence.record_blocks(items)
    pairs = F.when(F.col("b").isNull(), F.size("a") * (F.size("a") - 1) / 2).otherwise(F.size("a") * F.size("b"))
    n, total, widest = blocks.select(F.size("a").alias("n"), pairs.cast("long").alias("p")).agg(F.count("n"), F.sum("p"), F.max("n")).first()
    assert (n, total, widest) == (49 * 50 // 2, 100_000 * 99_999 // 2, cooccurrence.BLOCK_ITEMS)
    assert cooccurrence.record_blocks(items.limit(0)).collect() == []


def test_above_chance_is_exact(spark, rows):
    df = spark.createDataFrame([(10, 47, 10, 10), (10, 47, 10, 11)], "n_ab long, n_records long, n_a long, n_b long")
    assert rows(cooccurrence.above_chance(df, "4.7"), "n_b") == [] and rows(cooccurrence.above_chance(df, "4.69"), "n_b") == [(10,)]


@settings(max_examples=150, deadline=None)
@given(*[st.text("abcd", max_size=6)] * 3)
def test_edit_distance_is_a_metric(a, b, c):
    d = edit.edit_distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_edit_distance_and_tree():
    d = edit.edit_distance
    assert [d("ca", "abc"), d("abcd", "acbd"), d("", "ab"), d("gouumxby", "goumruxby")] == [2, 1, 2, 2]
    tree, words = edit.BKTree(), ["".join(w) for n in (2, 3, 4) for w in itertools.product("abc", repeat=n)]
    for i, w in enumerate(words):
        tree.add(w, i)
    for q in ("ab", "cabb", "zz"):
        for r in (0, 1, 2):
            assert {w for _, w, _ in tree.within(q, r)} == {w for w in words if d(q, w) <= r}
    assert [edit.abbreviates(*p) for p in (("mgr", "manager"), ("eng", "engineer"), ("xy", "xay"), ("b", "ab"), ("ab", "ab"))] == [2, 1, 2, None, 0]


def test_radius_join_is_exact():
    rng = random.Random(9)
    cores = list({"".join(rng.choice("abcdef") for _ in range(rng.randint(3, 10))) for _ in range(150)})
    cores += ["a" * 29, "a" * 30, "a" * 31, "a" * 33, "a" * 30 + "bb", "ca", "cabbage", "abcbage", "cababge"]
    got = {(i, j) for i, j, _ in names.radius_pairs(cores, block=16)}
    assert got == {(i, j) for i, j, _ in names.radius_pairs(cores, letters=6)}
    want = {(i, j) for i in range(len(cores)) for j in range(i + 1, len(cores)) if edit.edit_distance(cores[i], cores[j]) <= names.core_radius(min(len(cores[i]), len(cores[j])))}
    assert got == want


def linked(spark, items):
    df = spark.createDataFrame([(x, "clash") for x in items], "name string, entity string")
    groups = defaultdict(set)
    for r in names.link_names(df).collect():
        groups[r.entity].add(r["name"])
    return {frozenset(g) for g in groups.values()}


def test_spellings_of_one_name(spark):
    person = ["Harold Bimgrankreim", "BIMGRANKREIM, Harold", "Bimgrankreim Harold", "Dr. Harold Bimgránkreim", "@harold.bimgrankreim", "HaroldBimgrankrein", "H. Bimgrankreim", "Hal Bimgrankreim", "hbimgrankreim", "Harlod J. Bimgrankreim (PM)", "Harold_Bimgrankreim", "harold-bimgrankreim", "Harold Bimgrankreim 님"]
    other = ["Quentin Bimgrankreim"]
    org = ["Kuxnil Energy LLC", "kuxnil energy llc", "Kuxnil Energy L.L.C.", "Kuxnil Enrg", "The Kuxnil Energy (HQ)", "Energy, Kuxnil", "Kuxnill Energy, LLC"]
    trade = ["Kuxnil Insurance LLC"]
    more = [f"{g} {s}" for g in ("Harold", "Quentin") for s in ("Wombol", "Trixnard", "Sollumdir")] + [f"{s} {t} Inc." for s in ("Abxo", "Troumi", "Zelga") for t in ("Energy", "Insurance")]
    groups = linked(spark, person + other + org + trade + more + person)
    assert frozenset(person) in groups and frozenset(other) in groups and frozenset(org) in groups and frozenset(trade) in groups
    assert all(frozenset([m]) in groups for m in more)


def test_abbreviation_of_many_trades(spark):
    trades = ["Cargo", "Catering", "Ceramics", "Chemicals", "Clothing", "Construction"]
    more = [f"{s} {t} Inc." for s in ("Abxomir", "Troumixel", "Zelgaduro") for t in trades]
    groups = linked(spark, [*more, "Kuxnilbor Construction LLC", "Kuxnilbor C. LLC"])
    assert frozenset(["Kuxnilbor Construction LLC", "Kuxnilbor C. LLC"]) in groups and all(frozenset([m]) in groups for m in more)


def test_rare_given_names(spark):
    """A given name that stands with one surname only has no cell of an established name."""
    rare = ["Zorblax Hendricksen", "Zorblxa Hendricksen", "Zorblaxx Hendricksen", "Hendricksen Zorblax", "Hendricksen, Zorblax", "Z. Hendricksen"]
    more = [f"{g} {s}" for g in ("Harold", "Quentin", "John") for s in ("Wombolmir", "Trixnardel", "Sollumdir", "Hendricksen")]
    groups = linked(spark, [*rare, *more, "Joan Hendricksen", "Zorblax Wombolmir", "Jonh Hendricksen"])
    assert frozenset(rare) in groups and {frozenset(["John Hendricksen", "Jonh Hendricksen"]), frozenset(["Joan Hendricksen"]), frozenset(["Zorblax Wombolmir"])} <= groups
    assert all(frozenset([m]) in groups for m in more if m != "John Hendricksen")


def test_misspelt_words_are_not_established():
    words = [("harold", 600), ("harlod", 20), ("john", 500), ("joan", 90), ("zed", 3), ("christopher", 100), ("cristopher", 4)]
    assert names.established(words) == ["harold", "john", "christopher", "joan", "zed"]
    trades = [("construction", 90), ("constr", 9), ("pharma", 20), ("pharmaceuticals", 30)]
    assert names.established(trades, shortened=True) == ["construction", "pharmaceuticals", "pharma"]


def test_cells_by_the_triangle_inequality():
    """Any two anchors within the radius meet in the home cell of either."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(300)})
    space = names.AnchorSpace(words[::7])
    for x, y in itertools.combinations(words, 2):
        if abs(len(x) - len(y)) <= 2 and edit.edit_distance(x, y) <= names.anchor_radius(min(len(x), len(y))):
            assert space.cells(x)[0] in space.cells(y) and space.cells(y)[0] in space.cells(x)


@pytest.mark.parametrize("size", [16_384, 5])
def test_large_cells_are_cut(spark, monkeypatch, size):
    monkeypatch.setattr(names, "CELL_NODES", size)
    rng = random.Random(8)
    surnames = sorted({"".join(rng.choice("abcdefghiklmnoprstu") for _ in range(9)) for _ in range(40)})
    spellings = [[f"Harold {s.title()}", f"Harold {s[:4]}x{s[4:]}", f"{s.title()}, Harold", f"H. {s.title()}"] for s in surnames]
    assert linked(spark, [n for g in spellings for n in g]) == {frozenset(g) for g in spellings}


def test_a_cell_of_many_names(spark):
    """100,000 names of one given name: the cell is cut in blocks and every misspelling finds its name."""
    names_of = spark.range(100_000).select(F.concat(F.lit("Harold "), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 14), "0123456789", "ghijklmnop")).alias("name"))
    typed = names_of.where(F.pmod(F.xxhash64("name"), F.lit(100)) == 0).select(F.concat(F.expr("substr(name, 1, 12)"), F.lit("zz"), F.expr("substr(name, 13)")).alias("name"))
    got = names.link_names(names_of.union(typed)).groupBy("entity").agg(F.count("name").alias("n"), F.max(F.col("name").contains("zz")).alias("typed"))
    sizes = {(r.n, r.typed): r["count"] for r in got.groupBy("n", "typed").count().collect()}
    assert sizes == {(1, False): 100_000 - typed.count(), (2, True): typed.count()}


def test_unclear_and_odd_names(spark, rows):
    groups = linked(spark, ["Barbara Foxmuldir", "Bernard Foxmuldir", "B. Foxmuldir", "-", " ", "", None, "x" * 5000, "Barbara Foxmuldir"])
    assert groups == {frozenset([x]) for x in ("Barbara Foxmuldir", "Bernard Foxmuldir", "B. Foxmuldir", "-", "x" * 5000)}
    assert linked(spark, []) == set()
    pairs = spark.createDataFrame([("e", "b"), ("e", "a"), ("f", "c")], "entity string, name string")
    assert rows(names.spelling_pairs(pairs)) == [("a", "b")]


REFERENCE = [(1, "role", "Data Engineer"), (2, "role", "Senior Data Engineer"), (3, "role", "Product Manager"), (4, "status", "active"), (5, "location", "Sánkt Rimpua"), (6, "status", "archived"), (7, "role", "Security Engineer"), (8, "role", "Search Engineer")]


def test_values_by_tree():
    role = canonical.Reference([(i, v) for i, f, v in REFERENCE if f == "role"])
    cases = {
        "data engineer": 1, "DataEngineer": 1, "Engineer, Data": 1, "[[Data Engineer]]": 1, "Dats Engiener": 1, "Data Eng.": 1, "sr. data eng": 2, "Lead Data Engineer": 1, "Seniior Data Engineer": 2,
        "Ｄａｔａ　Ｅｎｇｉｎｅｅｒ": 1, "prod mgr": 3, "Sec. Eng.": 7, "Pilot": -1, "x": -1, "???": -1, "-": -1, "Senior Data Engineer (lead)": 2, "d" * 20_000: -1,
    }
    assert {v: role.find(v)[0] for v in cases} == cases
    assert canonical.Reference([]).find("x") == (-1, 1_000)


@pytest.mark.parametrize("shard", [20_000, 2])
def test_mapped_values(spark, rows, monkeypatch, shard):
    monkeypatch.setattr(canonical, "SHARD_ENTRIES", shard)
    ref = spark.createDataFrame([(*r, "clash") for r in REFERENCE], "canon_id long, field_name string, canon_value string, value string")
    nodes = spark.createDataFrame([(1, "activ"), (2, None), (3, " ")], "id long, entity_type string")
    front = ['{"status": "activ", "role": null}', '{"status": ["ACTIVE"]}', '{"status": "active"}', None, "", "no json", '{"location": "Rimpua, Sankt", "role": ["a", "b"], "status": "[[archived]]"}', '{"status": " "}', '{"status": 7}']
    notes = spark.createDataFrame(list(enumerate(front)), "ord long, frontmatter string")
    got = rows(canonical.map_values(nodes, notes, ref), "ref_table", "record_id", "field_name", "canon_id")
    assert got == sorted([
        ("knowledge_nodes", 1, "entity_type", -1), ("notes", 0, "status", 4), ("notes", 1, "status", 4), ("notes", 6, "location", 5), ("notes", 6, "status", 6), ("notes", 6, "role", -1), ("notes", 8, "status", -1),
    ], key=repr)
    none = rows(canonical.map_values(nodes, notes.limit(0), ref.limit(0)), "canon_id")
    assert none == [(-1,)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary_model())


@pytest.fixture(scope="module")
def tiktoken_encode():
    import tiktoken

    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_ids_of_any_text(encoder, tiktoken_encode, text):
    ids = encoder.encode(text)
    assert ids == tiktoken_encode(text) and encoder.decode(ids) == text


def test_ids_of_special_texts(spark, encoder, tiktoken_encode, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SIZE", 3)
    texts = [None, "", " ", "<|endoftext|>", "x" * 50_000, "▁ a", "한글 테스트", "don't  stop\r\n\t", "👩‍💻", "\x00​"]
    for t in texts * 2:
        assert encoder.encode(t) == (tiktoken_encode(t) if t else [])
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: tiktoken_encode(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, "doc_id", "text").collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").collect() == []


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(0, 64), max_size=80))
def test_packing_fits(sizes):
    box = packing.pack(np.array(sizes, dtype=np.int64), 64)
    total = np.bincount(box, weights=sizes) if sizes else np.zeros(0)
    assert len(box) == len(sizes) and (total <= 64).all()


def test_differencing_is_even():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 700, 3000)
    box = packing.pack(sizes, 2048)
    used = len(np.unique(box))
    assert np.bincount(box, weights=sizes).max() <= 2048 and sizes.sum() / (used * 2048) > 0.99
    window, sums = packing.difference(np.array([4, 5, 6, 7, 8]), 2)
    assert sorted(sums) == [14, 16] and sorted(np.bincount(window, weights=[4, 5, 6, 7, 8])) == [14, 16]


def test_packed_items(spark):
    sizes = [0, None, 5000, 2048, 2049, 1, 700, 700, 700, 4096] * 30
    df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)], "id long, n int, container_id int")
    rows = packing.pack_items(df, "id", "n", 2048, shard_items=64).collect()
    per_box, per_item = Counter(), defaultdict(list)
    for r in rows:
        per_box[r.container_id] += r.part_size
        per_item[r.id].append((r.part, r.part_start, r.part_size))
    assert max(per_box.values()) <= 2048 and all(per_box[r.container_id] == r.container_size for r in rows)
    for i, s in enumerate(sizes):
        parts = sorted(per_item[i])
        assert sum(p[2] for p in parts) == (s or 0) and (len(parts) == 1) == ((s or 0) <= 2048)
        assert [p[1] for p in parts] == [2048 * k for k in range(len(parts))]
    assert packing.pack_items(df.limit(0), "id", "n", 2048).collect() == []


def test_look_alike_pairs(spark, rows):
    base = "The café vault-index\nnotes one"
    same = ["Thе cаfé vault-index\nnotes οne", "The café vault‑index\r\nnotes one", "Ｔｈｅ café vault－index\nnotes　one", "The café va​ult-in­dex\nnotes one", "﻿The café vault-index\nnotes one"]
    different = ["The cafe vault-index\nnotes one", "the café vault-index\nnotes one", "The café vault-index notes one", "The café vault-index\nnotes ¹"]
    texts = [base, *same, *different, base, None, "", " ", "​", "ﬁn", "fin", "👩‍💻", "👩💻", "क्‍ष", "क्ष", "각", "\u1100\u1161\u11a8", "x²", "x2", "µ", "μ"]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, id string, x int")
    got = set(rows(lookalike.lookalike_pairs(df, "doc_id", "text")))
    twins = {i for i, t in enumerate(texts) if t == base or t in same}
    want = {(a, b) for a in twins for b in twins if a < b and texts[a] != texts[b]}
    at = texts.index("ﬁn")
    want |= {(at, at + 1), (at + 6, at + 7), (at + 10, at + 11)}
    assert got == want
    forms = {r.doc_id: r.text for r in lookalike.normalise_texts(df, "doc_id", "text").collect()}
    assert {forms[i] for i in twins} == {base} and forms[texts.index(None)] is None
    assert lookalike.lookalike_pairs(df.limit(0), "doc_id", "text").collect() == []


def test_many_copies_of_two_texts(spark):
    data = [(i, "vault", "clash") for i in range(120)] + [(500 + i, "vаult", "clash") for i in range(30)] + [(900, "vau​lt", ""), (901, "other", ""), (902, "other", ""), (903, " ", ""), (904, None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string, blocks string")
    got = lookalike.lookalike_pairs(df, "doc_id", "text", block=16).collect()
    assert len(got) == len(set(got)) == 120 * 30 + 120 + 30 and all(r.doc_id_a < r.doc_id_b for r in got)
    classes = {r.doc_id: tuple(r)[1:] for r in lookalike.class_rows(df, "doc_id", "text").collect()}
    assert classes == {i: (0, 151, 3) for i in [*range(120), *range(500, 530), 900]} | {901: (901, 2, 1), 902: (901, 2, 1)}
    words = {r.decided_by: (r.n_words, r.n_changed) for r in lookalike.word_decisions(df, "text").collect()}
    assert words == {"spelling": (153, 31), "table": (0, 0)}
    assert lookalike.class_rows(df.limit(0), "doc_id", "text").collect() == []


def test_automaton_weighs_edits():
    trie = lookalike.SpellingTrie([("vault", 3), ("café", 2), ("fin", 1), ("fan", 4)])
    typed = {"vаult": "vault", "ｖａｕｌｔ": "vault", "va​ult": "vault", "café": "café", "ﬁn": "fin", "vaul": None, "cafe": None, "": None}
    assert {w: trie.find(w) for w in typed} == typed
    assert [trie.walk(w, 1) for w in ("vaul", "vaultt", "vоult", "fon", "f", "cafe")] == [(1, "vault"), (1, "vault"), (1, "vault"), (1, "fan"), None, (1, "café")]
    form = lookalike.Normaliser([("сор", 9), ("cop", 3)])
    assert form.text("cop cоp сор cops") == "сор сор сор cops" and form.text("cop") == "сор"


def test_canonical_spelling_is_the_frequent_one():
    form = lookalike.Normaliser([("сок", 5), ("cop", 3), ("vault", 9)])
    assert form.text("coк сoк") == "сок сок" and form.text("vаult") == "vault" and form.text("ѕaw") == "saw"
    assert form.text("cор") == "cop" and form.trie.find("nothing") is None
    assert not lookalike.plain_spelling("vаult") and not lookalike.plain_spelling("ｖ") and lookalike.plain_spelling("сок") and lookalike.plain_spelling("café")
    assert form.text("a" * 200_000 + "​") == "a" * 200_000


@settings(max_examples=150, deadline=None)
@given(st.text("aаеeο​  \nfiﬁé́Ａ-‑", max_size=20))
def test_forms_are_stable(text):
    form = lookalike.Normaliser([("afe", 3), ("fi", 2)])
    once = form.text(text)
    assert form.text(once) == once

"""Shards, store passes and the desk against stated examples and plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tests.test_text import one
from tomeloom.functions.udfs import split_authors
from tomeloom.operators import desk, passes, seed


def test_surnames(spark):
    names = {"Ricardo Baeza-Yates": "Baeza-Yates", "Baeza-Yates, R.": "Baeza-Yates", "Grandmaster Flash Jr.": "Flash", "Plato": None, "van Gogh, Vincent": None, "Li": None}
    assert one(spark, seed.surname(F.col("a")), *[(n,) for n in names]) == list(names.values())
    usable = {"Baeza-Yates": True, "Page": False, "Li": False, "young": False, "Data-Smith": False, "Knuth": True}
    assert one(spark, seed.usable_surname(F.col("a")), *[(n,) for n in usable]) == list(usable.values())
    bare = {"R. Baeza-Yates": "Baeza-Yates", "Baeza-Yates ranking": None, "knuth": None, "Knuth, D.": "Knuth"}
    assert one(spark, seed.bare_surname(F.col("a")), *[(n,) for n in bare]) == list(bare.values())
    lines = {"Ann Lee, Bob Ray": True, "we show that it works": False, "mail me at a@b.c": False, "": False}
    assert one(spark, seed.is_byline(F.col("a"), split_authors(F.col("a"))), *[(n,) for n in lines]) == list(lines.values())


def test_concepts_and_authors(spark):
    authors = spark.createDataFrame([("b", "Ricardo Baeza-Yates"), ("b", "Ann Knuth"), ("b", "Bo Knuth")], "book_key string, name string")
    found = spark.createDataFrame(
        [
            ("b", 1, "Baeza-Yates", 33, [3, 1], "k1", None, ""), ("b", 2, "IR systems", 5, [2], "k2", "topic", "Systems."), ("b", 3, "IR system", 5, [4], "k2", None, "Other."), ("b", 4, "IR system", 2, [9], "", None, ""),
            ("b", 5, "Knuth", 4, [1], "k3", None, ""), ("b", 6, "Ricardo Baeza-Yates", 1, [7], "k4", None, ""), ("b", 7, "!!", 9, [1], "k5", None, ""), ("b", 8, "late", 1, [1], "k6", None, ""),
        ],
        "book_key string, seq long, label string, freq long, pages array<int>, stat_key string, kind string, gloss string",
    )
    nodes, edges = seed.upsert_concepts(found, authors, most=2)
    got = {r.id: (r.kind, r.weight, r.pages, r.gloss) for r in nodes.collect()}
    assert got["n:ricardo baeza yates"] == ("person", 35.0, [1, 3, 7], None)  # the surname is the author
    assert got["n:ir system"] == ("topic", 7.0, [2, 4, 9], "Systems.")  # one count once
    assert got["n:knuth"] == ("term", 4.0, [1], None)  # two authors: nobody's
    assert set(got) == {"n:ricardo baeza yates", "n:ann knuth", "n:bo knuth", "n:ir system", "n:knuth"}  # "late" is beyond the bound
    by = {(r.a, r.b, r.rel, r.weight) for r in edges.collect()}
    assert ("b:b", "n:ricardo baeza yates", "mentions", 34.0) in by and ("n:ann knuth", "b:b", "by", 1.0) in by and len(by) == 6


def test_terms_are_translated_once_they_pass(spark):
    rows = [("b", "wolf", ""), ("b", "NATO", ""), ("b", "river", ""), ("b", "stone", "")]
    terms = spark.createDataFrame(rows, "book_key string, term string, sample string")
    first = {"wolf": "loup.", "river": "What do you mean?", "stone": "a very long story about some stone that goes on and on and never comes to an end"}
    again = {"river": 'The word "river" means "rivière"', "stone": "?"}
    out = passes.translate_terms(terms, lambda ts: [first[t] for t in ts], lambda ts: [again[t] for t in ts])
    assert {(r.term, r.tr) for r in out.collect()} == {("NATO", "NATO"), ("wolf", "loup"), ("river", "rivière")}


def test_validation_keeps_a_users_line(spark):
    rows = [("b", "red ring", 3, [1], "mined", "A ring."), ("b", "red rings", 5, [2, 1], "user", "Rings."), ("b", "blue bolt", 2, [3], "mined", "Bolt."), ("b", "blue bolts", 1, [4], "mined", None), ("b", "gear", 1, [1], "mined", "Bad.")]
    records = spark.createDataFrame(rows, "book_key string, term string, freq long, pages array<int>, source string, definition string")
    out = passes.validate(records, lambda xs: ["yes :: " + ("red ring" if "red" in x else "blue bolts") for x in xs], lambda ts: [f"{t} :: {'no' if t == 'gear' else 'yes'}" for t in ts])
    got = {r.term: (r.freq, r.pages, r.definition, r.aliases) for r in out.collect()}
    assert got == {"red rings": (8, [1, 2], "Rings.", ["red ring"]), "blue bolt": (3, [3, 4], "Bolt.", ["blue bolts"]), "gear": (1, [1], None, [])}


def test_selection(spark):
    assert one(spark, desk.selection(F.col("a")), ("infor-\n mation  re­\ntrieval\n x",)) == ["information retrieval x"]
    text = 'First one. "Is it the second?" Then the third sentence here. Last'
    cases = {"third sentence": "Then the third sentence here.", "Last": None, "one": "First one.", "absent": None}
    assert one(spark, desk.sentence_around(F.lit(text), F.col("a")), *[(c,) for c in cases]) == list(cases.values())
    long_text = "a" * 3000 + " pick " + "b" * 3000
    got = one(spark, desk.context_window(F.lit(long_text), F.col("a")), ("pick",), ("none",))
    assert all(len(g) == 2202 and g[0] == g[-1] == "…" for g in got) and got[0].count("pick") == 1


def test_lines_against_plain(spark):
    r = np.random.default_rng(4)
    rows = [(n, 0, 0, float(t), float(x), float(x) + 5) for n in range(30) for t, x in zip(r.integers(0, 60, 12), r.integers(0, 300, 12))]
    got = desk.line_boxes(spark.createDataFrame(rows, "book_key long, page long, idx long, top double, left double, right double"), 10.0)
    want = []
    for n in range(30):
        lines = []
        for t, x, y in sorted(row[3:] for row in rows if row[0] == n):
            if lines and abs(t - lines[-1][0]) < 5:
                lines[-1][1:] = [min(lines[-1][1], x), max(lines[-1][2], y)]
            else:
                lines.append([t, x, y])
        want += [(n, i, *line) for i, line in enumerate(lines)]
    assert sorted((x.book_key, x.line, x.top, x.left, x.right) for x in got.collect()) == want


def test_pictures_follow_the_stack_of_transforms(spark):
    ops = [("save", None), ("transform", [100.0, 0, 0, 50.0, 10.0, 20.0]), ("image", None), ("restore", None), ("form_begin", [2.0, 0, 0, 2.0, 0, 0]), ("transform", [0.0, 30.0, -30.0, 0.0, 50.0, 5.0]), ("image", None), ("form_end", None), ("image", None)]
    rows = spark.createDataFrame([("b", 1, n, op, a and [float(x) for x in a]) for n, (op, a) in enumerate(ops)], "book_key string, page long, seq int, op string, args array<double>")
    views = spark.createDataFrame([("b", 1, [1.0, 0.0, 0.0, -1.0, 0.0, 800.0])], "book_key string, page long, view array<double>")
    got = [tuple(r)[2:] for r in desk.image_boxes(rows, views).collect()]
    assert got == [(10.0, 730.0, 100.0, 50.0), (40.0, 730.0, 60.0, 60.0), (0.0, 799.0, 1.0, 1.0)]


def test_shapes(spark):
    code = {"SELECT ?x WHERE": True, "the wolf ran over the hill": False, '{ "a": "b" }': True, "?x foaf:name ?y the of": True}
    assert one(spark, desk.code_shaped(F.col("a")), *[(c,) for c in code]) == list(code.values())
    captions = {"Figure 3: A wolf": True, "Figure 3 shows a wolf": False, "Table 2.1 Results": True, "Tables": False}
    assert one(spark, desk.is_caption(F.col("a")), *[(c,) for c in captions]) == list(captions.values())


def test_pictures_of_many_pages_are_read_in_order_without_a_group_each(spark):
    def op(k, n, name, args):
        return (f"b{k}", 1, n, name, args)

    rows = [op(k, *x) for k in range(300) for x in ((3, "image", None), (1, "save", None), (2, "transform", [1.0 + k, 0.0, 0.0, 2.0, 3.0, 4.0]), (2, "unknown", None), (4, "restore", None), (5, "image", None), (6, "transform", [1.0]), (7, "image", [1.0]))]
    rows = spark.createDataFrame(rows + [op("x", 1, "image", None)], "book_key string, page long, seq int, op string, args array<double>").repartition(7)
    views = spark.createDataFrame([(f"b{k}", 1, [1.0, 0.0, 0.0, -1.0, 0.0, 800.0]) for k in range(300)], "book_key string, page long, view array<double>")
    out = desk.image_boxes(rows, views)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "Join" not in plan
    want = sorted(x for k in range(300) for x in ((f"b{k}", 1, 3.0, 794.0, 1.0 + k, 2.0), (f"b{k}", 1, 0.0, 799.0, 1.0, 1.0), (f"b{k}", 1, 0.0, 799.0, 1.0, 1.0)))
    assert sorted(map(tuple, out.collect())) == want
    same = [("b", 1, 1, o, a) for o, a in (("transform", [2.0, 0.0, 0.0, 2.0, 0.0, 0.0]), ("image", None))]  # one seq
    view = views.limit(1).selectExpr("'b' AS book_key", "page", "view")
    for order in (same, same[::-1]):
        assert [r.w for r in desk.image_boxes(spark.createDataFrame(order, rows.schema), view).collect()] == [1.0]

"""Operators on small inputs with known answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tomeloom.operators import glossary, graph, language, layout, mining, pagekinds, search, translation
from tomeloom.sources import readers, sinks


def book(spark, texts, key="b"):
    return spark.createDataFrame([(key, i + 1, t) for i, t in enumerate(texts)], "book_key string, page long, text string")


def test_mining_finds_terms_and_forms(spark):
    texts = [f"We study inverted index number {i}. The inverted index and BM25 matter. We (precision and recall) see; precision is high, recall is low. Near Li we met." for i in range(8)]
    terms = {r.key: r for r in mining.mine_terms(book(spark, texts), cap=50, min_freq=5, min_pages=2, with_pages=True, with_sample=True).collect()}
    assert terms["inverted index"].term == "inverted index" and terms["inverted index"].pages == list(range(1, 9))
    assert terms["bm25"].term == "BM25"
    assert "li" not in terms and "the" not in terms
    assert "precision and recall" not in terms and {"precision", "recall"} <= set(terms)
    assert "inverted index" in terms["inverted index"].sample.lower()


def test_mining_does_not_depend_on_partitions(spark):
    texts = [f"alpha beta gamma delta {i % 3}. Alpha beta again; gamma delta once more." for i in range(20)]
    a = mining.mine_terms(book(spark, texts).coalesce(1), min_freq=3).collect()
    b = mining.mine_terms(book(spark, texts).repartition(7), min_freq=3).collect()
    assert sorted(a) == sorted(b)


def test_auto_stopwords(spark):
    texts = [f"der Hund und der Baum {'xyz' * (i % 5)} sieht der Mond und" for i in range(40)]
    counts = mining.gram_counts(book(spark, texts), ())
    totals = book(spark, texts).groupBy("book_key").agg(F.count_distinct("page").alias("pages"))
    found = {r.token for r in mining.auto_stopwords(counts, totals, 5, 2).collect()}
    assert found and found <= {"der", "und", "sieht"}
    assert mining.auto_stopwords(counts, totals.withColumn("pages", F.lit(10)), 5, 2).count() == 0


def test_language(spark):
    en = "the cat is on the mat and it was not for us to be with that which is from this or at the house of the king " * 8
    de = "der Hund und die Katze sind nicht auf dem Tisch mit einem Ball für das Kind und es ist auch von der Frau " * 8
    rows = book(spark, [en], "en").unionByName(book(spark, [de], "de")).unionByName(book(spark, ["1 2 3 x = y"], "none")).unionByName(book(spark, ["これは日本語の文章です。" * 30], "ja")).unionByName(book(spark, [""], "empty"))
    got = {r.book_key: r.lang for r in language.detect_language(rows).collect()}
    assert got == {"en": "en", "de": "de", "none": "und", "ja": "ja", "empty": "und"}


def test_pages_and_provenance(spark):
    refs = [f"[{i}] Wu, A. Title of {1990 + i} and {1991 + i}. https://x.org" for i in range(8)]
    index = ["alpha, 12", "beta, 13, 14", "gamma, 5–7", "delta, 99", "epsilon, 3"] * 3
    paras = spark.createDataFrame([("b", 1, i, t) for i, t in enumerate(refs)] + [("b", 2, 0, "just one line of plain text between")] + [("b", 3, i, t) for i, t in enumerate(index)], "book_key string, page long, idx int, text string")
    got = {r.page: r for r in pagekinds.classify_pages(paras).collect()}
    assert got[1].is_ref and got[3].is_index and not got[2].is_ref and got[2].ref_page
    docs = spark.createDataFrame([("a", 10, "arXiv:2101.00001 Abstract"), ("b", 10, "arXiv:2101.00001 No part of this book may be reproduced"), ("c", 500, "Abstract — x. doi: 10.1145/12345 submitted to X a@b.org"), ("d", 0, "")], "book_key string, pages int, front string").withColumn("back", F.lit(""))
    got = {r.book_key: r for r in pagekinds.classify_provenance(docs).collect()}
    assert got["a"].prov == "article" and got["a"].confidence == 0.75
    assert got["b"].prov != "article" and got["c"].prov != "article" and got["d"].prov == "unknown"


def test_shares_and_degree(spark):
    rows = [(b, f"n:{b}{i}", 1.0) for b in "xy" for i in range(26)] + [(b, f"n:c{i}", 2.0) for b in "xy" for i in range(4)]
    nodes = spark.createDataFrame(rows, "book_key string, id string, weight double")
    assert [round(r.sim, 3) for r in graph.share_candidates(nodes).collect()] == [0.071]
    assert graph.share_candidates(nodes.filter("id <> 'n:c0'").unionByName(spark.createDataFrame([("x", "n:q", 1.0), ("y", "n:r", 1.0)], nodes.schema))).count() == 0
    r = np.random.default_rng(1)
    pairs = {(f"{a:02d}", f"{b:02d}"): float(s) for a, b, s in zip(r.integers(0, 15, 200), r.integers(15, 30, 200), r.integers(1, 50, 200) / 50, strict=True)}
    got = {(x.a, x.b) for x in graph.cap_degree(spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a string, b string, sim double")).collect()}
    degree, want = {}, set()
    for (a, b), _ in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
        if degree.get(a, 0) < 6 and degree.get(b, 0) < 6:
            want.add((a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    assert got == want


def test_lookup(spark):
    nodes = spark.createDataFrame([("n:inverted index", "term", "Inverted index", 10.0, ["x"]), ("n:tree", "term", "Tree", 5.0, ["y"])], "id string, kind string, label string, weight double, books array<string>")
    q = spark.createDataFrame([(1, "inverted indexes"), (2, "zzz")], "q_id int, q string")
    got = graph.graph_lookup(q, nodes).collect()
    assert [(r.q_id, r.id) for r in got] == [(1, "n:inverted index")]
    exact = graph.graph_lookup(spark.createDataFrame([(1, "inverted index")], "q_id int, q string"), nodes).collect()
    assert round(exact[0].score, 2) == 11.51


def test_glossary_grammar_and_merge(spark):
    given = ["BM25 = BM25 :: метрика", "полнота :: метрика :: доля", "term = ?", "std::vector", "#include", "# x", "P = NP", "t ::  :: d", "", "a :: b :: c :: d"]
    lines = spark.createDataFrame([("b", i, t) for i, t in enumerate(given)], "book_key string, line_no int, line string")
    got = {r.line_no: (r.term, r.translation, r.category, r.definition) for r in glossary.parse_glossary(lines).collect()}
    assert got == {
        0: ("BM25", "BM25", "метрика", None), 1: ("полнота", None, "метрика", "доля"), 2: ("term", None, None, None), 3: ("std::vector", None, None, None),
        4: ("#include", None, None, None), 6: ("P", "NP", None, None), 7: ("t", None, None, "d"), 9: ("a", None, "b", "c :: d"),
    }
    again = glossary.parse_glossary(glossary.format_glossary(glossary.parse_glossary(lines)))
    assert {r.line_no: (r.term, r.translation, r.category, r.definition) for r in again.collect()} == got
    base = spark.createDataFrame([("b", 1, "# BM25 — ask"), ("b", 2, "BM25"), ("b", 3, "полнота"), ("b", 4, "# gone")], "book_key string, line_no int, line string")
    new = spark.createDataFrame([("b", 1, "BM25", None, "metric", None), ("b", 2, "gone", None, None, None), ("b", 3, "fresh", "t", None, None)], "book_key string, seq int, term string, translation string, category string, definition string")
    merged = glossary.merge_records(base, new)
    assert [r.line for r in merged.orderBy("line_no").collect()] == ["# BM25 — ask", "BM25 :: metric", "полнота", "# gone", "fresh = t"]
    twice = glossary.merge_records(merged.select("book_key", F.col("line_no").cast("int").alias("line_no"), "line"), new)
    assert {r.change for r in twice.collect()} == {"kept"}


def test_word_match_and_duplicates(spark):
    texts = spark.createDataFrame([("1", "applications quality online click literature"), ("2", "the F1-score, (MRR) and Li.")], "text_id string, text string")
    terms = spark.createDataFrame([("Li",), ("F1-score",), ("MRR",)], "term string")
    assert {(r.text_id, r.term) for r in glossary.match_glossary(texts, terms).collect()} == {("2", "Li"), ("2", "F1-score"), ("2", "MRR")}
    records = spark.createDataFrame([("b", t) for t in ("inverted index", "inverted indexes", "neural net", "neural nets", "tree")], "book_key string, term string")
    got = {(r.term, r.cluster) for r in glossary.cluster_duplicates(records).collect()}
    assert got == {("inverted index",) * 2, ("inverted indexes", "inverted index"), ("neural net",) * 2, ("neural nets", "neural net")}


def test_sidecar_round_trip(spark):
    raw = spark.createDataFrame([("b", '{"v":2,"lang":"EN","target":"?","terms":{"Tree":{"kind":"bad","aliases":["tree","Trees",""],"pages":[3,0,1,3],"freq":4,"source":"user"}}}'), ("c", "{"), ("d", '{"v":1}')], "book_key string, json string")
    got = glossary.parse_sidecar(raw).collect()
    assert [(r.lang, r.target, r.key, r.kind, r.aliases, r.pages, r.freq, r.source) for r in got] == [("en", "und", "tree", None, ["Trees"], [1, 3], 4, "user")]
    again = glossary.parse_sidecar(glossary.format_sidecar(glossary.parse_sidecar(raw)))
    assert again.collect() == got


def test_search(spark):
    pages = book(spark, ["a Foo\nBar foobar", "none", "foo  bar"])
    got = [(r.page, r.start, r.end) for r in search.find(pages, "foo bar").orderBy("page", "hit").collect()]
    assert got == [(1, 2, 9), (1, 10, 16), (3, 0, 8)]
    slices = spark.createDataFrame([(f"n{i}", float(i)) for i in range(1, 8)], "name string, v double")
    assert [(r.label, r.v) for r in search.pie_slices(slices, [], "name", "v").orderBy("slot").collect()] == [("n7", 7.0), ("n6", 6.0), ("n5", 5.0), ("n4", 4.0), ("other", 6.0)]
    assert search.pie_slices(slices.limit(5), [], "name", "v").count() == 5


def test_carry_over_uses_each_row_once(spark):
    old = spark.createDataFrame([("b", 1, 0, "Same  text", "t1"), ("b", 2, 0, "same text", "t2"), ("b", 3, 0, "Head", "Kopf 13")], "book_key string, page int, idx int, text string, tr string")
    todo = spark.createDataFrame([("b", 5, i, "SAME text") for i in range(3)] + [("b", 6, 0, "Head")], "book_key string, page int, idx int, text string")
    got = [r.tr for r in translation.carry_over(todo, old, 50).orderBy("page", "idx").collect()]
    assert got == ["t1", "t2", None, None]
    plan = translation.translation_plan(todo, todo.limit(0), todo.limit(0), old, 50)
    assert {r.tr for r in translation.run_plan(plan, lambda t: "X" + t).collect()} == {"t1", "t2", "XSAME text", "XHead"}


def test_learned_offset(spark):
    votes = spark.createDataFrame([("a", 13)] * 3 + [("a", 5)] + [("b", 13)] * 3 + [("b", 5)] * 2 + [("c", 13)] * 2, "k string, o int")
    assert [(r.k, r.o) for r in translation.learned_offset(votes, ["k"], "o").collect()] == [("a", 13)]


def items(lines, size=10.0):
    return [(i, text, [size, 0.0, 0.0, size, float(x), float(y)], size * 0.5 * len(text)) for i, (text, x, y) in enumerate(lines)]


def test_layout(spark):
    page = items([("The first line of a para-", 50, 700), ("graph that goes on here", 50, 688), ("and it ends with a word.", 50, 676), ("Another block is far below and it is for us.", 50, 600)])
    df = pd.DataFrame(page, columns=["item_no", "str", "transform", "width"])
    out = layout.page_paragraphs(df, np.array([1, 0, 0, -1, 0, 800.0]))
    assert out["text"].to_list() == ["The first line of a paragraph that goes on here and it ends with a word.", "Another block is far below and it is for us."]
    assert out["kind"].to_list() == ["prose", "prose"]
    rows = spark.createDataFrame([("b", 1, *p) for p in page], "book_key string, page int, item_no int, str string, transform array<double>, width double")
    view = spark.createDataFrame([("b", 1, [1.0, 0.0, 0.0, -1.0, 0.0, 800.0])], "book_key string, page int, view array<double>")
    assert layout.cluster_paragraphs(rows, view).count() == 2
    merged = layout.merge_regions(np.array([[0, 0, 10, 10], [5, 12, 10, 10], [100, 0, 5, 5]]), 5)
    assert sorted(map(tuple, merged.tolist())) == [(0, 0, 15, 22), (100, 0, 5, 5)]
    heads = [("b", p, 0, 50.0, 20.0, 100.0, 10.0, f"Chapter One {p}", 10.0, "prose") for p in range(1, 5)] + [("b", p, 1, 50.0, 100.0, 300.0, 400.0, "long body text " * 20, 10.0, "prose") for p in range(1, 5)]
    paras = spark.createDataFrame(heads, "book_key string, page int, idx int, x double, y double, w double, h double, text string, fh double, kind string")
    assert {(r.page, r.idx) for r in layout.mark_furniture(paras).filter("kind = 'furniture'").collect()} == {(2, 0), (3, 0), (4, 0)}


def test_readers_are_lenient(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version":1,"gen":2,"key":"k","title":"T","nodes":[{"id":"n:systems","kind":"odd","label":"Systems","weight":2},{"id":"","label":"x"}],"edges":[{"a":"b:k","b":"n:systems","rel":"mentions"},{"a":"n:systems","b":"n:system","rel":"mentions"},{"a":"x","b":"y","rel":"odd"}]}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"version":9,"key":"z"}')
    shards = readers.read_shards(spark, str(tmp_path / "*.json"))
    nodes = readers.shard_nodes(shards)
    assert [(r.id, r.kind, r.weight) for r in nodes.collect()] == [("n:system", "term", 2.0)]
    assert [(r.a, r.b) for r in readers.shard_edges(shards, nodes).collect()] == [("b:k", "n:system")]
    specs = spark.createDataFrame([("1", '{"type":"Pie","x":"n","series":["v"],"data":[{"n":"a","v":"12,5 %"},{"n":"b","v":"?"}]}'), ("2", "nope"), ("3", '{"type":"pie"}')], "spec_id string, code string")
    assert [(r.spec_id, r.name, r.value) for r in readers.chart_specs(specs).collect()] == [("1", "a", 12.5), ("1", "b", None)]
    sse = spark.createDataFrame([("s", 1, 'data: {"choices":[{"delta":{"content":"Hi"}}]}'), ("s", 2, "data: [DONE]"), ("s", 3, 'data: {"choices":[{"delta":{"content":"no"}}]}'), ("s", 0, ": ping")], "stream_id string, seq long, line string")
    assert [r.token for r in readers.sse_tokens(sse).collect()] == ["Hi"]
    out = str(tmp_path / "shards")
    sinks.write_shards(nodes.select("book_key", "id"), out)
    sinks.write_shards(nodes.select("book_key", F.lit("other").alias("id")), out)
    assert [r.id for r in spark.read.parquet(out).collect()] == ["other"]


def test_lookup_meets_all_that_can_score(spark):
    """Phrases, words, and texts inside each other: none is lost by meeting on keys."""
    nodes = [("n:old gizmo", "term"), ("n:ir", "term"), ("n:red anvil", "person"), ("n:ring theory", "topic"), ("n:wolf", "term"), ("n:unrelated", "term")]
    rows = spark.createDataFrame([(i, k, i[2:], 50.0, ["x"]) for i, k in nodes], "id string, kind string, label string, weight double, books array<string>")
    asked = {1: "cold gizmos", 2: "what of ir and wolves", 3: "ring", 4: "red anv", 5: "in", 6: "theory of rings"}
    got = {(r.q_id, r.id[2:]) for r in graph.graph_lookup(spark.createDataFrame(list(asked.items()), "q_id int, q string"), rows, 100).collect()}
    assert got == {(1, "old gizmo"), (2, "ir"), (2, "wolf"), (3, "ring theory"), (4, "red anvil"), (5, "ring theory"), (6, "ring theory")} - {(2, "wolf")} | {(1, "old gizmo")}


def test_orders_without_one_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tomeloom.operators import ordered

    monkeypatch.setattr(ordered, "STRETCH", 5)
    rows = spark.createDataFrame([(b, p, (p * 7 + b) % 11) for b in range(3) for p in range(0, 60, b + 1)], "b long, p long, v long").repartition(7)
    got = {(r.b, r.p): (r.s, r.before, r.after) for r in ordered.with_neighbours(ordered.running_before(rows, "b", "p", F.col("v"), "s"), "b", "p", "v").collect()}
    for b in range(3):
        places = list(range(0, 60, b + 1))
        v = [(p * 7 + b) % 11 for p in places]
        for i, p in enumerate(places):
            assert got[b, p] == (sum(v[:i]), v[i - 1] if i else None, v[i + 1] if i + 1 < len(v) else None)
    ranked = {(r.b, r.p): r.place for r in ordered.placed(rows, ["v", "b", "p"]).collect()}
    want = sorted(((p * 7 + b) % 11, b, p) for b, p in got)
    assert ranked == {(b, p): n for n, (_, b, p) in enumerate(want, 1)}
    pairs = spark.createDataFrame([("k", f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("j", "001", "000"), ("k", "900", "901")], "key string, a string, b string")
    assert {(r.key, r.node): r.least for r in ordered.connected(pairs, "key").collect()} == {**{("k", f"{i:03d}"): "000" for i in range(41)}, ("j", "000"): "000", ("j", "001"): "000", ("k", "900"): "900", ("k", "901"): "900"}


def test_glossary_texts_are_not_repeated(spark):
    """Texts stand in no exchange with their words, and long lists give what short ones do."""
    from tomeloom.operators import glossary

    texts = spark.createDataFrame([("a", "The wolf, and the river."), ("b", "wolves"), ("c", "of a kind F1x f1"), ("c", "und die")], "text_id string, text string")
    terms = ["the", "wolf", "of a", "F1", "und die", "wolv"]
    short = glossary.match_glossary(texts, spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {("a", "the"), ("a", "wolf"), ("c", "of a"), ("c", "F1"), ("c", "und die")}
    assert {tuple(r) for r in short.collect()} == want
    assert "Join" not in short._jdf.queryExecution().executedPlan().toString()
    long = glossary.match_glossary(texts, spark.createDataFrame([(t,) for t in [*terms, *(f"x{i}" for i in range(99))]], "term string"))
    assert {tuple(r) for r in long.collect()} == want
    assert glossary.match_glossary(texts, spark.createDataFrame([], "term string")).count() == 0


def test_lookup_pairs_do_not_carry_all_books(spark):
    """A concept of many books: pairs carry two of them, hits nine, and the block is as before."""
    from pyspark.sql import functions as F

    from tomeloom.operators import graph

    books = [f"b{i:04d}" for i in range(300)]
    nodes = spark.createDataFrame([("n:red wolf", "term", "Red wolf", "Told.", 50.0, books, {b: [1, 2] for b in books})], "id string, kind string, label string, gloss string, weight double, books array<string>, pages map<string,array<int>>")
    questions = spark.createDataFrame([(1, "What is the red wolf?", "b0001"), (2, "What is the red wolf?", "other")], "q_id int, q string, open_book string")
    hits = graph.graph_lookup(questions, nodes)
    assert "slice(array_distinct(books" in hits._jdf.queryExecution().optimizedPlan().toString()
    assert hits.count() == 2
    table = spark.createDataFrame([(b, b.upper(), "p", "book") for b in books], "book_key string, title string, path string, prov string")
    shares = spark.createDataFrame([], "a string, b string, weight double")
    blocks = {r.q_id: r.block for r in graph.lookup_block(hits, nodes, table, shares, questions.select("q_id", "open_book")).collect()}
    assert "«B0000»" in blocks[1] and "«B0001»" not in blocks[1].split("In: ")[1] and "«B0001»" in blocks[2] and "Told" in blocks[1] and "Told" not in blocks[2]


def test_outline_compares_equal_texts_once(spark):
    """Two texts are compared once, whatever the number of pages and rows that have them."""
    from tomeloom.operators import translation

    outline = spark.createDataFrame([("b", i, i % 5, "Red wolves") for i in range(40)], "book_key string, id int, page int, title string")
    heads = spark.createDataFrame([("b", i % 5, i, "Red wolves." if i < 20 else "Else", f"t{i}") for i in range(40)], "book_key string, page int, idx int, text string, tr string")
    out = translation.match_outline(outline, heads)
    assert "keys=[t#" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.tr) for r in out.collect()} == {(i, f"t{i % 5}") for i in range(40)}


def test_prompts_are_put_together_where_their_texts_are(spark):
    texts = spark.createDataFrame([(1, "The Cat, and the dog"), (2, "nothing"), (3, None), (4, "Dogs and cat")], "text_id int, text string")
    terms = spark.createDataFrame([("the", "le", 2), ("cat", "chat", 1), ("cat", "chatte", 1), ("dog", None, 0), ("--", "x", 0)], "term string, translation string, seq int")
    prompts = glossary.build_prompts(texts, terms, "French")
    plan = prompts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    ask = "Translate the following segment into French, without additional explanation.\n\n"
    got = {r["text_id"]: r["prompt"] for r in prompts.collect()}
    assert got == {1: f"Use these translations:\ndog\ncat = chat\ncat = chatte\nthe = le\n\n{ask}The Cat, and the dog", 2: f"{ask}nothing", 3: None, 4: f"Use these translations:\ncat = chat\ncat = chatte\n\n{ask}Dogs and cat"}
    many = terms.unionByName(spark.range(glossary.LISTED).selectExpr("concat('w', id) AS term", "'x' AS translation", "9 AS seq"))
    assert {r["text_id"]: r["prompt"] for r in glossary.build_prompts(texts, many, "French").collect()} == got


def test_streamed_counts_come_in_three_batches_that_keep_all_cores_busy(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from tomeloom.plans import incremental as plans
    from tomeloom.streaming import incremental

    spark.createDataFrame([(i, "Red wolves run.", "en", "a", 15) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    asked = {}

    def stream_pages(spark, path, files=1):
        asked.update(files=files, there=len(list(Path(path.removeprefix("file://")).glob("part-*"))))

    def run_to_end(frame, checkpoint, each, mode):
        each(spark.createDataFrame([("a", "run", 1, 2, 1), ("a", "red", 1, 3, 1)], "book_key string, key string, n int, freq long, non_init long"), 0)

    monkeypatch.setattr(incremental, "stream_pages", stream_pages)
    monkeypatch.setattr(incremental, "stream_ngram_counts", lambda pages, func: None)
    monkeypatch.setattr(incremental, "run_to_end", run_to_end)
    out = plans.stream_term_counts(spark, str(tmp_path))
    cores = spark.sparkContext.defaultParallelism
    assert asked["files"] >= cores and asked["there"] == 3 * asked["files"]
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.key for r in out.collect()] == ["red"]


def test_many_pages_are_laid_out_without_a_group_each(spark):
    rows = [(f"b{k % 3}", k, *p) for k in range(200) for p in items([(f"Page {k} has a line with a well-", 50, 700), ("known word.", 50, 688), ("", 50, 676)])]
    rows = spark.createDataFrame(rows + [("none", 1, *items([("lost", 1, 1)])[0])], "book_key string, page int, item_no int, str string, transform array<double>, width double")
    views = spark.createDataFrame([(f"b{k % 3}", k, [1.0, 0.0, 0.0, -1.0, 0.0, 800.0]) for k in range(200)], "book_key string, page int, view array<double>")
    out = layout.cluster_paragraphs(rows.repartition(5), views, spark.createDataFrame([("b1", "well-known")], "book_key string, word string"))
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {(f"b{k % 3}", k, 0, f"Page {k} has a line with a {'well-known' if k % 3 == 1 else 'wellknown'} word.") for k in range(200)}
    assert {(r.book_key, r.page, r.idx, r.text) for r in out.collect()} == want
    flat = pd.DataFrame([(0, "word", [10.0, 0.0, 0.0, 10.0, 5.0, 5.0], None)], columns=["item_no", "str", "transform", "width"])
    assert layout.page_paragraphs(flat, np.array([1, 0, 0, -1, 0, 800.0]))["text"].to_list() == ["word"]  # no width


def test_pages_of_items_hold_all_words_of_their_documents(spark, tmp_path):
    from tomeloom.plans import seeds as plans

    texts = {1: "\n".join(" ".join(f"w{i}x{k}" for k in range(3 + i % 30)) for i in range(40)), 2: " ".join(f"one{k}" for k in range(250))}
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = {i: [] for i in texts}
    for r in plans.paragraphs_of_items(spark, str(tmp_path)).collect():
        found[r.page] += r.text.split()
    assert {i: sorted(w) for i, w in found.items()} == {i: sorted(t.split()) for i, t in texts.items()}


def test_neighbours_against_plain():
    r = np.random.default_rng(3)
    for n in (1, 2, 30, 700):
        left, top = r.integers(0, 400, n).astype(float), r.integers(0, 60, n) * r.choice([0.4, 1.0, 7.0])
        right = left + r.integers(0, 60, n)
        got = layout._neighbours(left, right, top)
        for sign in (1, -1):
            for a in range(n):
                beside = [b for b in range(n) if min(right[a], right[b]) > max(left[a], left[b]) and sign * (top[b] - top[a]) > 1]
                assert got[sign][a] == min(beside, key=lambda b: (sign * top[b], b), default=-1)


def test_samples_against_plain_and_without_dealing_out_ngrams(spark, monkeypatch):
    """The first prose sentence of a key, else its first; only what is asked about leaves its task."""
    short, prose = "Red wolves run.", "Here the red wolves run over the hills and far away again."
    texts = {1: f"{short} {prose} Late red wolves.", 2: f"{short} {short}", 3: f"Nothing. {prose.replace('Here', 'There')}", 4: "word " * 3000 + "grey owls."}
    pages = spark.createDataFrame([("a" if p < 4 else "b", p, t) for p, t in texts.items()], "book_key string, page long, text string").repartition(3)
    only = spark.createDataFrame([("a", "red wolves"), ("a", "nothing"), ("b", "grey owls"), ("b", "red wolves")], "book_key string, key string")
    plans, keep = [], mining.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(mining, "written", written)
    found = {(r.book_key, r.key): r["sample"] for r in mining.samples(pages, (), only).collect()}
    assert found == {("a", "red wolves"): prose, ("a", "nothing"): "Nothing.", ("b", "grey owls"): texts[4].strip()}
    assert "BroadcastHashJoin" in plans[0] and "SortAggregate" not in plans[0]
    monkeypatch.setattr(mining, "SENT", 1)
    assert {(r.book_key, r.key): r["sample"] for r in mining.samples(pages, (), only).collect()} == found


def test_streamed_counts_add_up_without_a_state(spark, tmp_path):
    from pathlib import Path

    from tomeloom.plans import incremental as plans
    from tomeloom.sources.tables import shared_dir

    texts = [f"Red wolves run. Grey owls {'sleep' if i % 5 else 'wake'}, red wolves {i}." for i in range(60)]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    at = Path(shared_dir(spark).removeprefix("file://"))
    before = set(at.glob("stream-*"))
    got = {tuple(r) for r in plans.stream_term_counts(spark, str(tmp_path)).collect()}
    want = mining.gram_counts(plans.table(spark, str(tmp_path), "documents").selectExpr("source book_key", "doc_id page", "text"), plans.STOP.func, 3)
    assert got == {tuple(r) for r in want.select("book_key", "key", "n", "freq", "non_init").collect()} and len(got) > 10
    (own,) = set(at.glob("stream-*")) - before
    assert not (own / "checkpoint" / "state").exists() and len(list((own / "checkpoint" / "commits").glob("[0-9]*"))) == 3


def test_a_long_clause_is_not_copied_for_each_of_its_tokens(spark):
    text = " ".join(f"word{chr(97 + i % 26)}" for i in range(2000))
    found = mining.grams(spark.createDataFrame([("a", 1, text)], "book_key string, page long, text string"), ())
    assert found.count() == sum(2000 - n for n in range(4))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("low" not in line for line in plan.splitlines() if "posexplode" in line.lower() and "arrays_zip" not in line.lower()) and "arrays_zip" in plan

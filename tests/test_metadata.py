"""Titles, years, tags and model replies on stated examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeloom.operators import metadata, replies
from tomeloom.operators.mining import StopLists


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r.x for r in rows.select("i", build(F.col("c")).alias("x")).orderBy("i").collect()]


def test_usable_titles(spark):
    given = ["  Modern \n Retrieval ", "thesis.PDF", "Microsoft Word - a.doc", "untitled", "C:\\docs\\a.tex x", "12", "ab", "main", "Main ideas", "a/b testing", None, "x" * 201, "без названия"]
    assert column(spark, given, metadata.usable_title) == ["Modern Retrieval", None, None, None, None, None, None, None, "Main ideas", "a/b testing", None, None, None]


def test_title_ladder(spark):
    books = spark.createDataFrame([("a", "Own title", "/x/a.pdf"), ("b", "b.pdf", "/x/b.pdf"), ("c", None, "/x/c.v1.pdf")], "book_key string, title string, path string")
    paragraphs = spark.createDataFrame(
        [("b", 1, 0, "small", "prose", 9.0), ("b", 1, 1, "Big  one", "heading", 20.0), ("b", 1, 2, "Big two", None, 20.0), ("b", 1, 3, "ISBN", "other", 30.0), ("b", 2, 0, "Bigger", "heading", 40.0), ("c", 1, 0, "12", "prose", 9.0)],
        "book_key string, page int, idx int, text string, kind string, fh double",
    )
    assert {r.book_key: r.title for r in metadata.titles(books, paragraphs).collect()} == {"a": "Own title", "b": "Big one", "c": "c.v1"}


def test_years(spark):
    rows = spark.createDataFrame(
        [(0, "© A 2001", "", "t 1999", "D:2010"), (1, "no", "Издательство X, 1987", None, None), (2, None, None, "On 1984", "D:2010"), (3, "", "", "t", "D:20101231"), (4, "Copyright 2090", "", "t", "20101231"), (5, "", "", "", "yesterday")],
        "i int, front string, back string, title string, made string",
    )
    none = F.lit(None).cast("string")
    year = metadata.publication_year(F.col("front"), F.col("back"), F.col("title"), none, none, F.col("made"), 2027)
    assert [r.y for r in rows.select("i", year.alias("y")).orderBy("i").collect()] == [2001, 1987, 1984, 2010, 2010, None]


def test_tags(spark):
    given = ["Keywords: search engines; Search engine, Publisher: ACM Press;doi:10.1000/1", "Ключевые слова: поиск, ранжирование", "of the;association rule mining;Association for Computing", "12345; a b c d e f; x", None, ",".join(f"tag {chr(97 + i)}q" for i in range(20))]
    got = column(spark, given, metadata.tags)
    assert got[:5] == [["search engines"], ["поиск", "ранжирование"], ["association rule mining"], [], []] and len(got[5]) == 12


def test_reply_gates(spark):
    term = F.lit("inverted index")
    gloss = ["«A list of places.»", "- Maps words to the documents. They hold them.", "Inverted indexes", "слова", "a :: b", "", "é" * 5 + "z" * 200, "一二三四五 ok"]
    assert column(spark, gloss, lambda c: replies.clean_gloss(c, term, "en")) == ["A list of places.", "Maps words to the documents.", None, None, None, None, None, None]
    assert column(spark, ["data structure.", "term", "a b c d e", "Inverted index"], lambda c: replies.clean_category(c, term, "en")) == ["data structure", None, None, None]
    assert column(spark, ["the list of words", "another thing"], lambda c: replies.clean_definition(c, term, "en", F.lit("See the list of words here"))) == [None, "another thing"]
    assert column(spark, ["\n «индекс». \nx", "index.", "索引。"], lambda c: replies.clean_translation(c, term)) == ["«индекс»", "index", "索引"]
    assert column(spark, ["BM25", "TF-IDF", "Bm25", "25"], replies.keep_as_is) == [True, True, False, False]
    assert column(spark, ['It is "a" or «b c»', "plain"], replies.last_quoted) == ["b c", "plain"]
    assert column(spark, ["да", "Yes, it is", "нетривиально", "no"], replies.verdict) == [True, True, None, False]
    rejected = ["", "a :: b", "no separator", "x" * 600 + "::", "一二 :: 三 a", "Write nothing but :: x"]
    assert column(spark, rejected, lambda c: replies.reply_rejected(c, 1, 100, "en", echoes=["Write nothing but"])) == [True, False, True, True, True, True]
    assert column(spark, ["? what", "index", "a word of the index that", "***"], lambda c: replies.junky(c, F.lit("index"), F.lit("A word of the index that we see"))) == [True, False, True, True]


def test_name_guard(spark):
    stop = StopLists()
    assert column(spark, ["Gerard Salton", "recommender", "BM25", "The System", "  "], lambda c: replies.name_shaped(c, stop)) == [True, False, False, False, False]
    kinds = [("person", "Salton"), ("person", "search"), ("work", "Salton"), ("work", "search"), ("topic", "search")]
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "i int, k string, l string")
    assert [r.x for r in rows.orderBy("i").select(replies.guarded_kind(F.col("k"), F.col("l"), stop).alias("x")).collect()] == ["person", "term", "topic", "term", "topic"]


def test_reply_parsers(spark):
    asked = spark.createDataFrame([("b", "IR system", "an IR system is"), ("b", "recall", "recall"), ("b", "Gerard Salton", None), ("b", "unasked reply", None)], "book_key string, term string, sample string")

    def reply(text):
        return spark.createDataFrame([("b", text)], "book_key string, reply string")

    typed = reply("Sure:\r\n1. IR systems :: Topic :: They find documents.\n- recall :: person :: Share of what was found.\nIR system :: term :: late\nGerard Salton :: person\nghost :: term :: x")
    got = {r.term: (r.kind, r.gloss) for r in replies.parse_typed(asked, typed, "en").collect()}
    assert got == {"IR system": ("topic", "They find documents."), "recall": ("term", "Share of what was found."), "Gerard Salton": ("person", None)}
    rich = reply("IR system :: topic :: software :: Finds documents :: by words.\nrecall :: measure\nGerard Salton :: A man who built the first vector model of documents.")
    got = {r.term: (r.kind, r.category, r.definition) for r in replies.parse_enriched(asked, rich, "en").collect()}
    assert got == {"IR system": ("topic", "software", None), "recall": (None, "measure", None), "Gerard Salton": (None, None, "A man who built the first vector model of documents.")}
    said = reply("IR systems :: maybe\nIR system :: yes\nrecall :: нет, не то\nrecall :: yes")
    assert {r.term: r.verdict for r in replies.parse_verdicts(asked, said).collect()} == {"IR system": True, "recall": False}
    clusters = spark.createDataFrame([("b", c, t) for c, t in (("1", "IR system"), ("1", "IR systems x"), ("2", "recall"), ("2", "recalls"), ("3", "q"), ("4", "m"))], "book_key string, cluster string, term string")
    verdicts = spark.createDataFrame([("b", "1", "Well\n- yes :: IR Systems X"), ("b", "2", "да"), ("b", "3", "no :: q")], "book_key string, cluster string, reply string")
    assert {r.cluster: r.lead for r in replies.parse_duplicates(clusters, verdicts).collect()} == {"1": "IR systems x", "2": "recall", "3": None, "4": None}
    head = ["TOPICS: search, ranking\nSUMMARY: It tells how engines\nrank pages.\n\nmore", "ТЕМЫ： поиск", "SUMMARY: too short"]
    assert column(spark, head, replies.head_tags) == [["search", "ranking"], ["поиск"], []]
    assert column(spark, head, lambda c: replies.head_summary(c, "en")) == ["It tells how engines rank pages.", None, None]
    assert replies.parse_typed(asked.limit(0), typed, "en").count() == 0

"""The library graph: merging books' nodes and edges, similarity edges, ranked lookup.

nodes: (book_key, id, kind, label, gloss, weight, pages array<int>); edges: (book_key, a, b,
rel, weight); books: (book_key, title, path, pages, prov).  ``seq`` orders nodes of a book.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.functions.words import QUESTION_WORDS

# Fixed values.
SHARE_TOP, SHARE_FLOOR, SHARE_DEGREE, SHARE_CARRIERS = 30, 0.06, 6, 120
PER_PAGE, PAIR_TOP, MAX_PAGES = 24, 200, 8
MIN_SUBSTRING, DRAWN = 5, 700
SCORE_FLOOR, MAX_CONCEPTS, MAX_BOOKS, PAGES_SHOWN, NEARBY, BLOCK, NEARBY_ROOM = 0.35, 8, 3, 5, 3, 1400, 160


def label_vote(nodes: DataFrame) -> DataFrame:
    """(id, label): the spelling of most books, then weight, then length, then the alphabet."""
    votes = nodes.groupBy("id", "label").agg(F.count(F.lit(1)).alias("votes"), F.sum("weight").alias("w"))
    best = F.max_by("label", F.struct(F.col("votes"), F.col("w"), F.length("label"), F.col("rank")))
    # the alphabet decides last and upwards, so labels are ranked downwards within equals
    down = F.row_number().over(Window.partitionBy("id", "votes", "w", F.length("label")).orderBy(F.desc("label")))
    return votes.withColumn("rank", down).groupBy("id").agg(best.alias("label"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: kind (first book's), label (by vote), gloss (longest), weight (summed),
    books (sorted), pages (map from book to its first eight pages)."""
    place = F.struct("book_key", "seq") if "seq" in nodes.columns else F.struct("book_key", "label")
    gloss = F.trim(F.coalesce("gloss", F.lit("")))
    whole = nodes.groupBy("id").agg(
        F.min_by("kind", place).alias("kind"),
        F.max_by(gloss, F.struct(F.length(gloss), gloss)).alias("gloss"),
        F.sum("weight").alias("weight"),
        F.array_sort(F.collect_set("book_key")).alias("books"),
    )
    paged = nodes.select("id", "book_key", F.explode("pages").alias("p")).filter("p >= 1").distinct()
    paged = paged.withColumn("r", F.row_number().over(Window.partitionBy("id", "book_key").orderBy("p"))).filter(F.col("r") <= MAX_PAGES)
    paged = paged.groupBy("id", "book_key").agg(F.array_sort(F.collect_list("p")).alias("ps")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("book_key", "ps")))).alias("pages"))
    return whole.join(label_vote(nodes), "id").join(paged, "id", "left").select("id", "kind", "label", F.nullif("gloss", F.lit("")).alias("gloss"), "weight", "books", "pages")


def book_nodes(books: DataFrame) -> DataFrame:
    """A node for each book: weight is pages / 100 between 0.5 and 6."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.element_at(F.split("path", "[/\\\\]"), -1))
    return books.select(F.concat(F.lit("b:"), F.col("book_key")).alias("id"), F.lit("book").alias("kind"), title.alias("label"), F.greatest(F.lit(0.5), F.least(F.lit(6.0), F.col("pages") / 100.0)).alias("weight"), F.array("book_key").alias("books"), "prov", "path")


def edge_ends() -> tuple[Column, Column]:
    """Ends in the order that names an edge: similarity has no direction."""
    swap = (F.col("rel") == "shares") & (F.col("a") > F.col("b"))
    return F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))


def merge_edges(edges: DataFrame) -> DataFrame:
    a, b = edge_ends()
    return edges.select(a.alias("a"), b.alias("b"), "rel", "weight").groupBy("a", "b", "rel").agg(F.sum("weight").alias("weight"))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    ids = nodes.select(F.col("id").alias("nid"))
    return edges.join(ids, edges["a"] == F.col("nid"), "left_semi").join(ids, edges["b"] == F.col("nid"), "left_semi")


def top_concepts(nodes: DataFrame, top: int = SHARE_TOP) -> DataFrame:
    """(book_key, id): a book's heaviest concepts; ties by first place, then id."""
    seq = F.min("seq") if "seq" in nodes.columns else F.min(F.lit(0))
    sums = nodes.groupBy("book_key", "id").agg(F.sum("weight").alias("w"), seq.alias("s"))
    rank = F.row_number().over(Window.partitionBy("book_key").orderBy(F.desc("w"), "s", "id"))
    return sums.withColumn("r", rank).filter(F.col("r") <= top).select("book_key", "id")


def share_candidates(nodes: DataFrame, top: int = SHARE_TOP, floor: float = SHARE_FLOOR, carriers: int = SHARE_CARRIERS) -> DataFrame:
    """(a, b, n, sim): books by the Jaccard similarity of their top concepts.

    The self-join runs over an inverted list whose length per concept the definition bounds
    (2 to 120 books), so it is linear in books.
    """
    tops = top_concepts(nodes, top)
    sizes = tops.groupBy("book_key").agg(F.count(F.lit(1)).alias("size"))
    rare = tops.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c").between(2, carriers)).select("id")
    held = tops.join(rare, "id")
    pairs = held.alias("x").join(held.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.book_key") < F.col("y.book_key")))
    counts = pairs.groupBy(F.col("x.book_key").alias("a"), F.col("y.book_key").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.join(sizes.select(F.col("book_key").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("book_key").alias("b"), F.col("size").alias("sb")), "b")
    out = out.withColumn("sim", F.col("n") / (F.col("sa") + F.col("sb") - F.col("n")))
    return out.filter(F.col("sim") >= floor).select("a", "b", "n", "sim")


def cap_degree(pairs: DataFrame, degree: int = SHARE_DEGREE) -> DataFrame:
    """(a, b, weight): pairs in order of similarity, each taken while both ends have room.

    Greedy by definition, but only among pairs that share an end: a pair is decided once
    every better pair at its ends is.  Each round decides all pairs that lead at both ends,
    so the rounds follow the chains of the order, not the count of pairs.
    """
    from tomeloom.sources.tables import written

    order = [F.desc("sim"), "a", "b"]
    left = written(pairs.select("a", "b", "sim"), "pairs")
    taken = None
    while left.limit(1).count():
        ends = left.select("a", "b", "sim", F.explode(F.array("a", "b")).alias("end"))
        if taken is not None:
            used = taken.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("used"))
            ends = ends.join(used, "end", "left").withColumn("room", degree - F.coalesce("used", F.lit(0)))
        else:
            ends = ends.withColumn("room", F.lit(degree))
        ends = ends.withColumn("r", F.row_number().over(Window.partitionBy("end").orderBy(*order)))
        # within the room that is left at both ends, nothing better can push a pair out
        judged = ends.groupBy("a", "b", "sim").agg(F.min("room").alias("room"), F.max(F.col("r") - F.col("room")).alias("over"))
        new = judged.filter("room > 0 and over <= 0").select("a", "b", "sim")
        rest = judged.filter("room > 0 and over > 0").select("a", "b", "sim")
        taken = written(new if taken is None else taken.unionByName(new), "taken")
        left = written(rest, "pairs")
    if taken is None:
        return pairs.select("a", "b", F.lit(0.0).alias("weight")).limit(0)
    return taken.select("a", "b", F.round("sim", 3).alias("weight"))


def co_occurrence(nodes: DataFrame, per_page: int = PER_PAGE, top: int = PAIR_TOP) -> DataFrame:
    """(book_key, a, b, weight): concepts on the same page, the heaviest 24 of a page paired."""
    rows = nodes.select("book_key", "id", "weight", F.explode("pages").alias("page")).distinct()
    rank = F.row_number().over(Window.partitionBy("book_key", "page").orderBy(F.desc("weight"), "id"))
    rows = rows.withColumn("r", rank).filter(F.col("r") <= per_page).select("book_key", "page", "id")
    pairs = rows.alias("x").join(rows.alias("y"), ["book_key", "page"]).filter(F.col("x.id") < F.col("y.id"))
    counts = pairs.groupBy("book_key", F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    best = F.row_number().over(Window.partitionBy("book_key").orderBy(F.desc("weight"), "a", "b"))
    return counts.withColumn("r", best).filter(F.col("r") <= top).drop("r")


def merge_graph(nodes: DataFrame, edges: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the library: merged concepts, a node a book, similarity edges added."""
    concepts = merge_nodes(nodes)
    titles = book_nodes(books)
    every = concepts.select("id", "kind", "label", "weight", "books", "gloss", "pages").unionByName(titles.select("id", "kind", "label", "weight", "books"), allowMissingColumns=True)
    shares = cap_degree(share_candidates(nodes)).select(F.concat(F.lit("b:"), F.col("a")).alias("a"), F.concat(F.lit("b:"), F.col("b")).alias("b"), F.lit("shares").alias("rel"), "weight")
    kept = edges.filter("a <> b and rel in ('mentions', 'by', 'shares')")
    return every, with_endpoints(merge_edges(kept.select("a", "b", "rel", "weight").unionByName(shares)), every)


def asked_words(c: Column) -> Column:
    """A question's words of three letters or more that ask for something, and their singulars."""
    words = F.filter(F.split(T.norm_id(c), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*QUESTION_WORDS))
    return F.array_union(words, F.filter(F.transform(words, T.fold_token), lambda w: F.length(w) >= 3))


def graph_lookup(questions: DataFrame, nodes: DataFrame, top: int = MAX_CONCEPTS) -> DataFrame:
    """(q_id, rank, id, score) from questions (q_id, q[, quote, open_book]) and merged nodes.

    Whatever can score shares a key: a word asked for, the five letters that a concept in the
    question begins with, or those that a question in a concept begins with.  So questions and
    concepts meet by an equi-join, and scores are of what met.
    """
    quote = F.coalesce("quote", F.lit("")) if "quote" in questions.columns else F.lit("")
    opened = F.col("open_book") if "open_book" in questions.columns else F.lit(None).cast("string")
    asked = F.concat_ws(" ", "q", quote)
    qs = questions.select("q_id", opened.alias("open"), T.norm_id(asked).alias("nq"), asked_words(asked).alias("asked")).filter("nq <> ''")
    qs = qs.withColumn("fq", F.array_join(F.transform(F.split("nq", " "), T.fold_token), " "))
    concepts = nodes.filter("kind <> 'book'")
    nid = F.when(F.col("id").startswith("n:"), F.expr("substring(id, 3)")).otherwise(T.norm_id(F.col("label")))
    # of two different books one at least is not the open one, so a concept's pairs carry no more
    concepts = concepts.select("id", nid.alias("nid"), F.col("kind").isin("term", "topic").alias("folded"), "weight", F.slice(F.array_distinct("books"), 1, 2).alias("books")).filter("nid <> ''")
    concepts = concepts.withColumn("parts", F.filter(F.split("nid", " "), lambda w: (F.length(w) >= 3) & ~w.isin(*QUESTION_WORDS)))

    def tagged(tag: str, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.concat(F.lit(tag), t))

    both = F.array("nq", "fq")
    long_nid = F.length("nid") >= MIN_SUBSTRING
    # w: a word; b: how a concept found in a question begins; i: how a question found in a concept begins
    q_keys = F.concat(
        tagged("w", F.col("asked")), tagged("w", F.split("nq", " ")), tagged("w", F.split("fq", " ")), tagged("b", F.flatten(F.transform(both, lambda t: _pieces(t)))), tagged("i", F.transform(both, lambda t: F.substring(t, 1, MIN_SUBSTRING))),
    )
    inner = F.flatten(F.array(_pieces(F.col("nid")), *[_pieces(F.col("nid"), n) for n in range(1, MIN_SUBSTRING)])) if _any_short(qs) else _pieces(F.col("nid"))
    none = F.array().cast("array<string>")
    c_keys = F.concat(tagged("w", F.col("parts")), tagged("w", F.slice(F.split("nid", " "), 1, 1)), F.when(long_nid, F.array(F.concat(F.lit("b"), F.substring("nid", 1, MIN_SUBSTRING)))).otherwise(none), F.when(long_nid, tagged("i", inner)).otherwise(none))
    q_side = qs.select("q_id", F.explode(F.array_distinct(q_keys)).alias("key"))
    c_side = concepts.select("id", F.explode(F.array_distinct(c_keys)).alias("key"))
    met = q_side.join(c_side, "key").select("q_id", "id").distinct()
    pairs = met.join(qs, "q_id").join(concepts, "id")
    hits = []
    for text, needs_fold in (("nq", False), ("fq", True)):
        q = F.col(text)
        hit = F.when(F.col("nid") == q, 3.0).when(F.concat(F.lit(" "), q, F.lit(" ")).contains(F.concat(F.lit(" "), F.col("nid"), F.lit(" "))), 2.2)
        hit = hit.when((F.length("nid") >= MIN_SUBSTRING) & (q.contains(F.col("nid")) | F.col("nid").contains(q)), 1.6).otherwise(0.0)
        hits.append(F.when(F.col("folded"), hit).otherwise(0.0) if needs_fold else hit)
    hit = F.greatest(*hits)
    met = F.size(F.filter("parts", lambda w: F.array_contains("asked", w)))
    base = F.when(hit > 0, hit).when((F.size("parts") > 0) & (met > 0), met / F.size("parts")).otherwise(0.0)
    elsewhere = F.col("open").isNull() | F.exists("books", lambda b: b != F.col("open"))
    score = base * F.log1p(F.greatest(F.lit(0.0), F.col("weight"))) * F.when(elsewhere, 1.6).otherwise(0.6)
    rows = pairs.select("q_id", "id", score.alias("score")).filter(F.col("score") >= SCORE_FLOOR)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("q_id", "rank", "id", F.round("score", 6).alias("score"))


def _pieces(c: Column, size: int = MIN_SUBSTRING) -> Column:
    """All stretches of ``size`` characters."""
    n = F.length(c) - size + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))))


def _any_short(qs: DataFrame) -> bool:
    """Whether a question is too short to begin with MIN_SUBSTRING letters."""
    return bool(qs.filter((F.length("nq") < MIN_SUBSTRING) | (F.length("fq") < MIN_SUBSTRING)).limit(1).count())


def neighbours(shares: DataFrame, top: int = NEARBY) -> DataFrame:
    """(book, rank, other, weight): the most similar books of each."""
    both = shares.select(F.col("a").alias("book"), F.col("b").alias("other"), "weight").unionByName(shares.select(F.col("b").alias("book"), F.col("a").alias("other"), "weight"))
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("weight"), "other"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= top)


def lookup_block(hits: DataFrame, nodes: DataFrame, books: DataFrame, shares: DataFrame, open_books: DataFrame) -> DataFrame:
    """(q_id, block): the prompt text of a lookup: concepts with where they stand, books nearby.

    A question has at most eight hits, so its block is put together by one ordered fold.  A hit
    carries the books that may be shown; what all of its books say is asked of them by keys.
    """
    titles = books.select(F.col("book_key").alias("bk"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), "path").alias("title"), "prov")
    # the open book stands behind the others, so one book more than are shown is enough
    first = F.transform(F.slice("books", 1, MAX_BOOKS + 1), lambda b, i: F.struct(i.alias("bo"), b.alias("bk"), F.slice(F.coalesce(F.try_element_at("pages", b), F.array().cast("array<int>")), 1, PAGES_SHOWN).alias("ps")))
    asked = hits.join(open_books, "q_id", "left")
    held = nodes.join(hits.select("id").distinct(), "id", "left_semi").select("id", F.explode("books").alias("bk"))
    own = asked.join(held.withColumnRenamed("bk", "open_book"), ["id", "open_book"]).select("q_id", "id").distinct().withColumn("own_told", F.lit(True))
    article = held.join(titles.filter("prov = 'article'").select("bk").distinct(), "bk", "left_semi").select("id").distinct().withColumn("article_told", F.lit(True))
    rows = asked.join(nodes.select("id", "label", "gloss", first.alias("first")), "id").join(own, ["q_id", "id"], "left").join(article, "id", "left")
    rows = rows.select("*", F.explode_outer("first").alias("b")).select("*", "b.bo", "b.bk", "b.ps").drop("first", "b").join(titles, "bk", "left")
    place = F.struct((F.col("bk") == F.col("open_book")).cast("int").alias("own"), F.col("bo"), F.col("bk"), F.coalesce("title", "bk").alias("title"), F.coalesce("ps", F.array().cast("array<int>")).alias("ps"))
    told = F.max(F.coalesce("own_told", "article_told", F.lit(False)))
    rows = rows.groupBy("q_id", "rank", "label", "gloss").agg(F.slice(F.array_sort(F.collect_list(place)), 1, MAX_BOOKS).alias("where"), told.alias("told"))
    where = F.array_join(F.transform("where", lambda w: F.concat(F.lit("«"), w["title"], F.lit("»"), F.when(F.size(w["ps"]) > 0, F.concat(F.lit(" (p. "), F.array_join(F.transform(w["ps"], lambda p: p.cast("string")), ", "), F.lit(")"))).otherwise(""))), ", ")
    gloss = F.when(F.col("told") & (F.coalesce("gloss", F.lit("")) != ""), F.concat(F.lit(" — "), T.flat(F.col("gloss")))).otherwise("")
    line = F.concat(F.lit("• "), F.col("label"), gloss, F.when(where != "", F.concat(F.lit(". In: "), where)).otherwise(""), F.lit("."))
    rows = rows.withColumn("line", line).groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    room = BLOCK - NEARBY_ROOM
    start = F.struct(F.lit("In the library:").alias("text"), F.lit(True).alias("open"))
    fold = F.aggregate("lines", start, lambda s, x: F.struct(F.when(s["open"] & (F.length(s["text"]) + F.length(x) + 1 <= room), F.concat(s["text"], F.lit("\n"), x)).otherwise(s["text"]).alias("text"), (s["open"] & (F.length(s["text"]) + F.length(x) + 1 <= room)).alias("open")))
    near = neighbours(shares).join(titles.select(F.concat(F.lit("b:"), F.col("bk")).alias("other"), "title"), "other")
    near = open_books.select("q_id", F.concat(F.lit("b:"), F.col("open_book")).alias("book")).join(near, "book").groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: F.concat(F.lit("«"), x["title"], F.lit("»"))), ", ").alias("near"))
    out = rows.select("q_id", fold["text"].alias("text")).filter("text <> 'In the library:'").join(near, "q_id", "left")
    tail = F.concat(F.lit("\nNearby: "), F.col("near"))
    return out.select("q_id", F.when(F.col("near").isNotNull() & (F.length("text") + F.length(tail) <= BLOCK), F.concat("text", tail)).otherwise(F.col("text")).alias("block"))


def graph_stats(nodes: DataFrame) -> DataFrame:
    """(books, concepts) of a merged graph."""
    return nodes.agg(F.count_if(F.col("kind") == "book").alias("books"), F.count_if(F.col("kind") != "book").alias("concepts"))


def heaviest(nodes: DataFrame, top: int = DRAWN) -> DataFrame:
    """The concepts that are drawn."""
    return nodes.filter("kind <> 'book'").orderBy(F.desc("weight"), "id").limit(top)


def search_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """(id, label, rank_score): labels that contain the query; prefixes and books lead."""
    q, low = F.lit(query.strip().lower()), F.lower("label")
    score = F.when(low.startswith(q), 1000.0).otherwise(0.0) + F.when(F.col("kind") == "book", 500.0).otherwise(0.0) + F.log1p("weight")
    return nodes.filter(low.contains(q)).select("id", "label", F.round(score, 6).alias("rank_score"))


def seed_positions(nodes: DataFrame, width: float, height: float, gap: float = 14.0) -> DataFrame:
    """(id, x, y): a sunflower spiral by weight, the heaviest at the centre."""
    i = F.row_number().over(Window.orderBy(F.desc("weight"), "id")) - 1
    rows = nodes.orderBy(F.desc("weight"), "id").limit(700).withColumn("i", i)
    angle, radius = F.col("i") * 2.399963229728653, gap * F.sqrt(F.col("i") + 0.5)
    return rows.select("id", (width / 2 + radius * F.cos(angle)).alias("x"), (height / 2 + radius * F.sin(angle)).alias("y"))


def layout(positions: DataFrame, edges: DataFrame, ticks: int = 50) -> DataFrame:
    """(id, x, y) after force steps: repulsion in grid cells, springs along edges, centring.

    A drawing has at most DRAWN nodes (``heaviest`` gives them), which one task moves.
    """
    import numpy as np

    if positions.limit(DRAWN + 1).count() > DRAWN:
        raise ValueError(f"a drawing has at most {DRAWN} nodes")
    near = edges.join(positions.select(F.col("id").alias("a")), "a", "left_semi").join(positions.select(F.col("id").alias("b")), "b", "left_semi")
    links = near.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("to"))
    rows = positions.join(links, "id", "left")

    def move(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if not held:
            return
        df = pd.concat(held).sort_values("id", ignore_index=True)
        xy, place = df[["x", "y"]].to_numpy(float), {k: i for i, k in enumerate(df["id"])}
        pairs = np.array([(i, place[t]) for i, ts in enumerate(df["to"]) if ts is not None for t in ts if t in place], int).reshape(-1, 2)
        speed, alpha = np.zeros_like(xy), 1.0
        for _ in range(ticks):
            delta = xy[:, None] - xy[None, :]
            gap = np.maximum((delta**2).sum(-1), 25.0)
            push = np.where((gap < 192.0**2)[..., None], delta / gap[..., None], 0.0).sum(1) * 300.0
            np.add.at(push, pairs[:, 0], (xy[pairs[:, 1]] - xy[pairs[:, 0]]) * 0.06)
            np.add.at(push, pairs[:, 1], (xy[pairs[:, 0]] - xy[pairs[:, 1]]) * 0.06)
            push -= (xy - xy.mean(0)) * 0.01
            speed = (speed + alpha * push) * 0.6
            xy = xy + speed
            alpha *= 0.97
        yield pd.DataFrame({"id": df["id"], "x": xy[:, 0], "y": xy[:, 1]})

    return rows.coalesce(1).mapInPandas(move, "id string, x double, y double")


def nearest(positions: DataFrame, x: float, y: float, reach: float = 24.0) -> DataFrame:
    """(id): the node under a point, if one is within reach."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return positions.withColumn("d", d).filter(F.col("d") <= reach).agg(F.min_by("id", F.struct("d", "id")).alias("id")).filter("id is not null")

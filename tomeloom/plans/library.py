"""Queries over keys, pages, graph, glossary and search, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.functions import words as W
from tomeloom.operators import glossary, graph, pagekinds, search, translation
from tomeloom.plans.corpus import lines, pages, table
from tomeloom.plans.terms import _list

# --- the star schema as shards: a supplier is a book, a part a concept, an order a page --------


def _concepts(spark, sf_dir):
    """(book_key, id, kind, label, gloss, weight, pages, seq) from line items."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"), F.slice(F.array_sort(F.collect_set((F.col("l_orderkey") % 50 + 1).cast("int"))), 1, 8).alias("pages"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"])
    return rows.select(
        F.col("l_suppkey").cast("string").alias("book_key"), F.concat(F.lit("n:"), (F.col("l_partkey") % 400).cast("string")).alias("id"), F.lit("term").alias("kind"),
        F.col("p_name").alias("label"), F.when(F.col("l_partkey") % 3 == 0, F.col("p_name")).alias("gloss"), F.col("weight").cast("double").alias("weight"), "pages", F.col("l_partkey").alias("seq"),
    )


_CONCEPTS = """concepts_ AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS book_key, 'n:' || (l_partkey % 400) AS id, p_name AS label, CASE WHEN l_partkey % 3 = 0 THEN p_name END AS gloss,
         CAST(weight AS DOUBLE) AS weight, pages, l_partkey AS seq
  FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS weight, list_sort(list(DISTINCT l_orderkey % 50 + 1))[1:8] AS pages FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = l_partkey)"""
_TOPS = """tops_ AS (SELECT book_key, id FROM (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY w DESC, s, id) AS r FROM
  (SELECT book_key, id, sum(weight) AS w, min(seq) AS s FROM concepts_ GROUP BY ALL)) WHERE r <= 30),
sizes_ AS (SELECT book_key, count(*) AS size FROM tops_ GROUP BY ALL),
held_ AS (SELECT t.* FROM tops_ t JOIN (SELECT id FROM tops_ GROUP BY id HAVING count(*) BETWEEN 2 AND 120) USING (id)),
shares_ AS (SELECT x.book_key AS a, y.book_key AS b, count(*) AS n FROM held_ x JOIN held_ y ON x.id = y.id AND x.book_key < y.book_key GROUP BY ALL),
sims_ AS (SELECT a, b, n, n / (p.size + q.size - n) AS sim FROM shares_ JOIN sizes_ p ON p.book_key = a JOIN sizes_ q ON q.book_key = b)"""


def shares_jaccard(spark, sf_dir):
    """JN08, WIN02: books by the similarity of their top concepts."""
    return graph.share_candidates(_concepts(spark, sf_dir)).withColumn("sim", F.round("sim", 9))


def shares_degree_capped(spark, sf_dir):
    """WIN03: at most six neighbours a book, the most similar first (rows only: greedy order)."""
    return graph.cap_degree(graph.share_candidates(_concepts(spark, sf_dir)))


def merge_nodes(spark, sf_dir):
    """AGG10, WIN11: concepts of all books as one node each."""
    out = graph.merge_nodes(_concepts(spark, sf_dir))
    return out.select("id", "label", "gloss", F.round("weight", 6).alias("weight"), F.size("books").cast("long").alias("books"), F.aggregate(F.map_values("pages"), F.lit(0).cast("long"), lambda s, p: s + F.size(p)).alias("pages"))


def label_vote(spark, sf_dir):
    """AGG11: the label that most books use."""
    return graph.label_vote(_concepts(spark, sf_dir))


def merge_edges(spark, sf_dir):
    """AGG12, JN10: edges added up, ends that are no nodes dropped."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("b:"), F.col("l_suppkey")).alias("a"), F.concat(F.lit("n:"), F.col("l_partkey")).alias("b"), F.when(F.col("l_linenumber") % 2 == 0, "shares").otherwise("mentions").alias("rel"), F.col("l_quantity").cast("double").alias("weight"))
    nodes = table(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("n:"), F.col("p_partkey")).alias("id")).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("b:"), F.col("s_suppkey")).alias("id")))
    return graph.with_endpoints(graph.merge_edges(rows), nodes)


def book_nodes(spark, sf_dir):
    """AGG13: a node a book."""
    books = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("book_key"), F.col("s_name").alias("title"), F.col("s_name").alias("path"), (F.col("s_suppkey") * 7).alias("pages"), F.lit("book").alias("prov"))
    return graph.book_nodes(books).select("id", "label", "weight")


def co_occurrence(spark, sf_dir):
    """JN09: concepts on the same page."""
    return graph.co_occurrence(_concepts(spark, sf_dir).groupBy("book_key", "id").agg(F.sum("weight").alias("weight"), F.flatten(F.collect_list("pages")).alias("pages")), top=20)


def graph_lookup(spark, sf_dir):
    """JN07, SE07: concepts that a question names; a question for every twentieth part."""
    # a node a label: weights are those of the part, so that the choice among equals is plain
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.concat(F.lit("n:"), T.concept_id(F.col("p_name"))).alias("id"), F.lit("term").alias("kind"), F.col("p_name").alias("label"), F.col("p_size").cast("double").alias("weight"), F.array(F.lit("x")).alias("books"))
    nodes = nodes.groupBy("id", "kind").agg(F.max("weight").alias("weight"), F.first("books").alias("books"), F.min("label").alias("label"))
    questions = part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("q_id"), F.concat(F.lit("What is the "), F.col("p_name"), F.lit(" about?")).alias("q"))
    return graph.graph_lookup(questions, nodes)


def concept_ids(spark, sf_dir):
    """FN01-FN04: identity keys of part names (ASCII)."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.initcap("p_name"), F.lit("s' "), F.col("p_type"), F.lit(" Boxes"))
    return part.select("p_partkey", T.norm_id(name).alias("norm_id"), T.concept_id(name).alias("concept_id"), T.term_key(name).alias("term_key"), T.carry_key(name).alias("carry_key"), T.out_norm(name).alias("out_norm"))


def plural_fold(spark, sf_dir):
    """FN02: the words of documents with their singulars."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(T.tokens(F.lower("text"))).alias("w")).distinct()
    return words.select("w", T.fold_token(F.col("w")).alias("folded")).filter("w <> folded")


def content_keys(spark, sf_dir):
    """FN07: content keys and hashes of part names."""
    return table(spark, sf_dir, "part").select("p_partkey", T.content_key(F.col("p_name").cast("binary")).alias("content_key"), T.djb2(F.col("p_name")).alias("djb2"))


def composed_ids(spark, sf_dir):
    """FN01, FN03, FN04: identity keys of labels with ligatures, full-width forms and loose accents."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("\ufb01ne "), F.col("p_name"), F.lit(" \uff21\uff11 cafe\u0301 \u2460"), F.col("p_type"), F.lit(" \u0401\u0436 \u210cands"))
    return part.select("p_partkey", T.norm_id(name).alias("norm_id"), T.concept_id(name).alias("concept_id"), T.term_key(name).alias("term_key"))


def dice_pairs(spark, sf_dir):
    """FN05, FN06: how alike a part's name and its type with its brand are, by their bigrams."""
    part = table(spark, sf_dir, "part").select("p_partkey", T.out_norm(F.col("p_name")).alias("a"), T.out_norm(F.concat_ws(" ", "p_type", "p_brand")).alias("b"))
    return part.select("p_partkey", F.round(T.dice(F.col("a"), F.col("b")), 9).alias("sim"))


def duplicate_clusters(spark, sf_dir):
    """JN19, GR01: part names that are variants of each other, clustered by brand."""
    records = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_key"), F.col("p_name").alias("term"))
    return glossary.cluster_duplicates(records, 0.85)


def page_classes(spark, sf_dir):
    """CLS02-CLS04, CLS06: page classes of documents, a line a paragraph."""
    return pagekinds.classify_pages(lines(spark, sf_dir))


def citation_density(spark, sf_dir):
    """CLS01: citation markers."""
    rows = pages(spark, sf_dir)
    return rows.select("page", T.cite_marks(F.col("text")).cast("long").alias("marks"), pagekinds.is_citation_page(F.col("text")).alias("citation_page"))


def provenance_verdict(spark, sf_dir):
    """CLS07: articles and books by weighted evidence (rows only: patterns beyond SQL)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_key"), (F.col("n_chars") / 100).alias("pages"), F.col("text").alias("front"), F.col("text").alias("back"))
    out = pagekinds.classify_provenance(docs)
    return out.withColumn("evidence", F.array_join("evidence", " | "))


def find_hits(spark, sf_dir):
    """SE01: occurrences of a phrase with their offsets."""
    return search.find(pages(spark, sf_dir), "of the")


def find_wrap_order(spark, sf_dir):
    """SE03: hits in the order of a reader at page 500."""
    docs = pages(spark, sf_dir)
    totals = docs.groupBy("book_key").agg((F.max("page") + 1).alias("pages"))
    return search.from_page(search.find(docs, "and the"), totals, 500).select("book_key", "page", "hit", "turn")


def fuzzy_rank(spark, sf_dir):
    """SE04: part names by fuzzy score (rows only)."""
    return table(spark, sf_dir, "part").select("p_partkey", T.fuzzy_score(F.lit("rin"), F.col("p_name")).alias("score")).filter("score is not null")


def library_order(spark, sf_dir):
    """WIN06, CLS14: customers as books in reading order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").alias("name"), F.lit("").alias("title"), (F.col("c_custkey") % 5 / 4).alias("progress"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("last_opened"))
    return search.library_order(c).select("path", "place")


def asof_section(spark, sf_dir):
    """JN15: each purchase's last view before it."""
    e = table(spark, sf_dir, "events")
    views = e.filter("event_type = 'view'").select(F.col("user_id").alias("book_key"), F.col("ts").alias("page"), F.col("event_id").alias("id"))
    buys = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("book_key"), F.col("ts").alias("at")).distinct()
    return search.current_section(views, buys).filter("id is not null").select("book_key", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "id")


def repetition_window(spark, sf_dir):
    """WIN07: rows that repeat at a like height within the eight places before."""
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.withColumn("place", place).select(F.col("user_id"), "event_type", "place", F.col("value").cast("double").alias("y"))
    return search.repeated_within(rows, ["user_id", "event_type"], "place", "y", 5.0, 8).filter("again").select("user_id", "place")


def gap_islands(spark, sf_dir):
    """WIN08: runs of neighbouring orders that are not fulfilled."""
    o = table(spark, sf_dir, "orders").select(F.lit(1).alias("book_key"), F.col("o_orderkey").alias("page"), "o_orderstatus")
    return translation.gap_runs(o, F.col("o_orderstatus") != "F")


def catch_up_list(spark, sf_dir):
    """JN16: customers whose newest order is missing, open or old."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.max("o_orderstatus").alias("s"), F.count(F.lit(1)).alias("gen"))
    return search.catch_up(c, o.select("path", F.when(F.col("s") == "P", "seed").otherwise("deep").alias("stage"), "gen"), 10)


def prune_list(spark, sf_dir):
    """JN17: customers without orders."""
    return search.prune(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path")).distinct(), table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("path")))


def weighted_medians(spark, sf_dir):
    """AGG06-AGG08: medians and modes of quantity by supplier."""
    li = table(spark, sf_dir, "lineitem")
    keys = ["l_suppkey"]
    med = translation.weighted_median(li, keys, "l_quantity", "l_extendedprice").withColumnRenamed("l_quantity", "median")
    mode = translation.weighted_mode(li, keys, "l_quantity", "l_linenumber").withColumnRenamed("l_quantity", "mode")
    upper = translation.upper_median(li.groupBy("l_suppkey", "l_quantity").agg(F.count(F.lit(1)).alias("c")), keys, "l_quantity", "c").withColumnRenamed("l_quantity", "upper")
    return med.join(mode, keys).join(upper, keys)


def learned_offset(spark, sf_dir):
    """AGG09: the offset most pages agree on."""
    votes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey"), (F.col("l_quantity") % 3).cast("int").alias("offset"))
    return translation.learned_offset(votes, ["l_partkey"], "offset")


def pie_tail_fold(spark, sf_dir):
    """AGG16: nations' customers by size, the tail as one."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.sum("c_acctbal").alias("v"))
    return search.pie_slices(rows, [], "n_name", "v").select("slot", "label", F.round("v", 2).alias("v"))


def moving_eta(spark, sf_dir):
    """AGG18: time left by the mean of the last five pages."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_key"), F.col("o_orderkey").alias("page"), F.col("o_totalprice").cast("double").alias("seconds"))
    return translation.eta(o).withColumn("eta", F.round("eta", 4))


def carry_over_plan(spark, sf_dir):
    """JN13: lines of a new edition, and of the old one those that end a sentence, each used once."""
    rows = lines(spark, sf_dir)
    old = rows.filter("text rlike '[.!?]$'").withColumn("tr", F.concat(F.lit("t:"), F.col("page"), F.lit(":"), F.col("idx")))
    return translation.carry_over(rows, old, 100).select("book_key", "page", "idx", "tr")


def stale_translations(spark, sf_dir):
    """CLS11, FN29: headings whose translation carries a foreign page number."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("2.2 Text "), F.col("l_quantity").cast("int")).alias("text"), F.concat(F.lit("Texte "), F.col("l_linenumber") * 13).alias("tr"))
    return li.filter(T.looks_stale(F.col("text"), F.col("tr"), F.lit(60))).select("l_orderkey", "l_linenumber")


def glossary_word_match(spark, sf_dir):
    """JN06: which words of a list occur in which turns."""
    g = spark.createDataFrame([(w,) for w in ("the", "and", "of a", "is", "und die", "F1", "re")], "term string")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("text_id"), "text").filter("text is not null")
    return glossary.match_glossary(c, g)


def glossary_parse(spark, sf_dir):
    """FN20: lines of a term store."""
    return glossary.parse_glossary(_store(spark, sf_dir))


def _store(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kinds = [F.col("p_name"), F.concat("p_name", F.lit(" = "), "p_type"), F.concat("p_name", F.lit(" :: "), "p_brand"), F.concat("p_name", F.lit(" -> "), "p_type", F.lit(" :: "), "p_brand", F.lit(" :: "), "p_type", F.lit(" :: more")), F.concat(F.lit("# "), "p_name"), F.lit("  ")]
    line = F.coalesce(*[F.when(F.col("p_partkey") % 6 == i, k) for i, k in enumerate(kinds)])
    return part.select(F.col("p_brand").alias("book_key"), F.col("p_partkey").alias("line_no"), line.alias("line"))


def glossary_merge(spark, sf_dir):
    """SET05: a store with incoming records merged (rows only: appended lines are numbered)."""
    new = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_key"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("term"), F.lit("tr").alias("translation"), F.lit(None).cast("string").alias("category"), F.col("p_type").alias("definition"))
    return glossary.merge_records(_store(spark, sf_dir), new)


def glossary_merge3(spark, sf_dir):
    """JN18: my edit and the file's, merged over what both came from."""
    part = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("seq"), F.min("p_size").alias("size")).withColumnRenamed("p_brand", "book_key")
    rows = part.withColumn("line", F.col("term"))
    return glossary.merge3(rows.filter("size > 10"), rows.filter("size < 40"), rows.filter("size between 5 and 45")).select("book_key", "side", "seq", "key")


def html_text(spark, sf_dir):
    """FN34, FN27, FN28: escaping, loose numbers, furniture keys of part names."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("<b>"), F.col("p_name"), F.lit('</b> & "'), F.col("p_partkey").cast("string"), F.lit('"'))
    return part.select("p_partkey", T.html_escape(name).alias("html"), T.furniture_key(name).alias("furniture"), T.loose_number(F.concat(F.col("p_size").cast("string"), F.lit(",5 %"))).alias("number"))


def hyphen_words(spark, sf_dir):
    """AGG05: compounds seen with their hyphen more often than solid."""
    docs = pages(spark, sf_dir)
    joined = docs.select("book_key", F.regexp_replace("text", "(the|and) ([a-z])", "$1-$2").alias("text"))
    return translation.hyphen_keep_set(joined)


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

def _fold_sql(w: str) -> str:
    def looked_at(x: str) -> str:
        return f"length({x}) > 3 AND ends_with({x}, 's') AND NOT regexp_matches({x}, '(?:ss|us|is|os)$') AND {x} NOT IN ({_list(W.INVARIANT)}) AND NOT regexp_matches({x}, '\\p{{Cyrillic}}')"

    two, one = f"left({w}, length({w}) - 2)", f"left({w}, length({w}) - 1)"
    return f"""CASE WHEN NOT ({looked_at(w)}) THEN {w} WHEN regexp_matches({w}, '[^aeiou]ies$') AND length({w}) >= 5 THEN left({w}, length({w}) - 3) || 'y'
  WHEN regexp_matches({w}, '(?:sh|ch|x|z|s)es$') THEN CASE WHEN NOT ({looked_at(two)}) THEN {two} ELSE {one} END ELSE {one} END"""


def _concept_sql(text: str) -> str:
    """A lateral chain is avoided: norm, words, then the last word folded."""
    norm = f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return norm


_MARKS = f"len(regexp_extract_all(regexp_replace(text, '([^0-9A-Za-z_])', '\\1\\1', 'g'), '{T.CITE_MARK}'))"
_WS2 = "[ \\t\\n,]"
_LINES = "lines_ AS (SELECT book_key, page, idx, text FROM (SELECT source AS book_key, doc_id AS page, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS idx FROM documents) WHERE trim(text) <> '')"


def _find_sql(query: str) -> str:
    pattern = T.find_pattern(query)
    return f"""h_ AS (SELECT source AS book_key, doc_id AS page, text, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM documents WHERE regexp_matches(text, '{pattern}')),
hits_ AS (SELECT book_key, page, CAST(i - 1 AS INT) AS hit,
  CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS "start",
  CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS INT) AS "end"
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM h_))"""


ORACLE = {
    "shares_jaccard": f"WITH {_CONCEPTS}, {_TOPS} SELECT a, b, n, round(sim, 9) AS sim FROM sims_ WHERE sim >= 0.06",
    "merge_nodes": f"""WITH {_CONCEPTS}, votes_ AS (SELECT id, label, count(*) AS v, sum(weight) AS w FROM concepts_ GROUP BY ALL),
lab_ AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, w DESC, length(label) DESC, label) AS r FROM votes_) WHERE r = 1),
g_ AS (SELECT id, gloss FROM (SELECT id, gloss, row_number() OVER (PARTITION BY id ORDER BY length(gloss) DESC, gloss DESC) AS r FROM concepts_ WHERE gloss IS NOT NULL) WHERE r = 1),
pp_ AS (SELECT id, sum(least(c, 8)) AS pages FROM (SELECT id, book_key, count(DISTINCT p) AS c FROM (SELECT id, book_key, unnest(pages) AS p FROM concepts_) GROUP BY ALL) GROUP BY id),
w_ AS (SELECT id, round(sum(weight), 6) AS weight, count(DISTINCT book_key) AS books FROM concepts_ GROUP BY id)
SELECT w_.id, label, gloss, weight, books, CAST(pages AS BIGINT) AS pages FROM w_ JOIN lab_ USING (id) LEFT JOIN g_ USING (id) JOIN pp_ USING (id)""",
    "label_vote": f"""WITH {_CONCEPTS}, votes_ AS (SELECT id, label, count(*) AS v, sum(weight) AS w FROM concepts_ GROUP BY ALL)
SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, w DESC, length(label) DESC, label) AS r FROM votes_) WHERE r = 1""",
    "merge_edges": """WITH e AS (SELECT 'b:' || l_suppkey AS a, 'n:' || l_partkey AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'shares' ELSE 'mentions' END AS rel, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL)
SELECT a, b, rel, weight FROM e WHERE b IN (SELECT 'n:' || p_partkey FROM part WHERE p_size > 10)""",
    "book_nodes": "SELECT 'b:' || s_suppkey AS id, s_name AS label, greatest(0.5, least(6.0, CAST(s_suppkey * 7 / 100.0 AS DOUBLE))) AS weight FROM supplier",
    "co_occurrence": f"""WITH {_CONCEPTS}, c_ AS (SELECT book_key, id, sum(weight) AS weight FROM concepts_ GROUP BY ALL),
p_ AS (SELECT DISTINCT book_key, id, unnest(pages) AS page FROM concepts_),
r_ AS (SELECT p_.*, row_number() OVER (PARTITION BY book_key, page ORDER BY weight DESC, id) AS r FROM p_ JOIN c_ USING (book_key, id)),
k_ AS (SELECT * FROM r_ WHERE r <= 24),
n_ AS (SELECT x.book_key, x.id AS a, y.id AS b, count(*) AS weight FROM k_ x JOIN k_ y ON x.book_key = y.book_key AND x.page = y.page AND x.id < y.id GROUP BY ALL)
SELECT book_key, a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY weight DESC, a, b) AS r FROM n_) WHERE r <= 20""",
    "dice_pairs": """WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS a, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS b FROM part),
x AS (SELECT p_partkey, g, count(*) AS n FROM (SELECT p_partkey, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS g FROM p) GROUP BY ALL),
y AS (SELECT p_partkey, g, count(*) AS n FROM (SELECT p_partkey, unnest(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS g FROM p) GROUP BY ALL),
s AS (SELECT x.p_partkey, sum(least(x.n, y.n)) AS shared FROM x JOIN y ON x.p_partkey = y.p_partkey AND x.g = y.g GROUP BY ALL)
SELECT p.p_partkey, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN length(a) < 2 OR length(b) < 2 THEN 0.0 ELSE 2.0 * coalesce(shared, 0) / (length(a) + length(b) - 2) END, 9) AS sim
FROM p LEFT JOIN s ON p.p_partkey = s.p_partkey""",
    "plural_fold": f"""WITH w_ AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '{T.TOKEN.replace("'", "''")}'), lambda x: regexp_matches(x, '^\\p{{L}}'))) AS w FROM documents)
SELECT w, folded FROM (SELECT w, {_fold_sql('w')} AS folded FROM w_) WHERE w <> folded""",
    "concept_ids": f"""WITH n_ AS (SELECT p_partkey, name, {_concept_sql('name')} AS norm FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') || 's'' ' || p_type || ' Boxes' AS name FROM part)),
k_ AS (SELECT *, list_filter(string_split(norm, ' '), lambda x: x <> 's') AS toks FROM n_),
l_ AS (SELECT *, toks[len(toks)] AS w FROM k_)
SELECT p_partkey, norm AS norm_id, array_to_string(list_append(toks[1:len(toks) - 1], {_fold_sql('w')}), ' ') AS concept_id, norm AS term_key, lower(trim(regexp_replace(name, '{T.WS}+', ' ', 'g'))) AS carry_key, norm AS out_norm FROM l_""",
    "composed_ids": "WITH n AS (SELECT p_partkey, 'fine ' || p_name || ' a1 caf\u00e9 1' || lower(p_type) || ' \u0435\u0436 hand' AS k FROM part) SELECT p_partkey, k || 's' AS norm_id, k AS concept_id, k || 's' AS term_key FROM n",
    "content_keys": """WITH c_ AS (SELECT p_partkey, p_name, list_reduce(list_transform(string_split(p_name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda h, x: (h * 33 + x) % 4294967296, CAST(5381 AS BIGINT)) AS h FROM part)
SELECT p_partkey, lower(printf('%x', h)) || '-' || lower(printf('%x', strlen(p_name))) AS content_key, h AS djb2 FROM c_""",
    "page_classes": f"""WITH {_LINES}, m_ AS (SELECT book_key, page, {_MARKS} AS marks, regexp_matches(text, '{pagekinds.REFERENCE_ENTRY.replace("'", "''")}') AS entry, length(trim(text)) + 1 AS chars,
  len(regexp_extract_all(regexp_replace(trim(text), '([0-9])({_WS2})', '\\1\\2\\2', 'g'), '{pagekinds.INDEX_BINDING.replace("'", "''")}')) AS ib, len(regexp_extract_all(regexp_replace(trim(text), '([0-9]) ', '\\1  ', 'g'), '{pagekinds.CONTENTS_BINDING.replace("'", "''")}')) AS tb FROM lines_),
p_ AS (SELECT book_key, page, sum(marks) AS marks, count(*) FILTER (marks > 0 AND entry) AS entries, sum(chars) AS chars, sum(ib) AS ib, sum(tb) AS tb FROM m_ GROUP BY ALL),
f_ AS (SELECT book_key, page, entries >= 5 AND marks >= 10 AS is_ref, chars >= 50 AND ib >= 3 AND 1000.0 * ib / chars >= 8 AS is_index, chars >= 50 AND tb >= 8 AND 1000.0 * tb / chars >= 18 AS is_toc FROM p_),
g_ AS (SELECT *, is_ref OR is_index OR is_toc AS f FROM f_)
SELECT book_key, page, is_ref, is_index, is_toc, f OR coalesce(lag(f) OVER w AND lead(f) OVER w, false) AS ref_page FROM g_ WINDOW w AS (PARTITION BY book_key ORDER BY page)""",
    "citation_density": f"SELECT doc_id AS page, {_MARKS} AS marks, {_MARKS} >= 8 AS citation_page FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "find_hits": f'WITH {_find_sql("of the")} SELECT book_key, page, hit, "start", "end" FROM hits_',
    "find_wrap_order": f'WITH {_find_sql("and the")}, t_ AS (SELECT source AS book_key, max(doc_id) + 1 AS pages FROM documents GROUP BY source) SELECT book_key, page, hit, ((page - 500) % pages + pages) % pages AS turn FROM hits_ JOIN t_ USING (book_key)',
    "library_order": """WITH b AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_name AS name, c_custkey % 5 / 4.0 AS progress, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE 0 END AS opened FROM customer),
r AS (SELECT *, progress > 0.005 AND progress < 0.995 AS reading FROM b)
SELECT path, row_number() OVER (ORDER BY CASE WHEN reading THEN 0 ELSE 1 END, CASE WHEN reading THEN -opened ELSE 0 END, lower(name), path) AS place FROM r""",
    "asof_section": """WITH v AS (SELECT user_id, ts, max(event_id) AS id FROM events WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT b.user_id AS book_key, strftime(b.ts, '%Y-%m-%d %H:%M:%S.%f') AS at, v.id FROM b ASOF JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts""",
    "repetition_window": """WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, CAST(value AS DOUBLE) AS y FROM events)
SELECT user_id, place FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE q.user_id = p.user_id AND q.event_type = p.event_type AND q.place < p.place AND q.place > p.place - 8 AND abs(q.y - p.y) <= 5.0)""",
    "gap_islands": """WITH r AS (SELECT o_orderkey, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'F')
SELECT 1 AS book_key, min(o_orderkey) AS first, max(o_orderkey) AS last FROM r GROUP BY i""",
    "catch_up_list": """WITH o AS (SELECT o_custkey, max(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey AS path FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE n IS NULL OR s = 'P' OR n < 10""",
    "prune_list": "SELECT DISTINCT o_custkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "weighted_medians": """WITH a AS (SELECT l_suppkey, l_quantity AS q, sum(l_extendedprice) AS w, sum(l_linenumber) AS m, count(*) AS c FROM lineitem GROUP BY ALL),
b AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY q) AS wu, sum(w) OVER (PARTITION BY l_suppkey) AS wa, sum(c) OVER (PARTITION BY l_suppkey ORDER BY q) AS cu, sum(c) OVER (PARTITION BY l_suppkey) AS ca FROM a)
SELECT l_suppkey, min(q) FILTER (wu * 2 >= wa) AS median, arg_max(q, (m, -q)) AS mode, min(q) FILTER (cu > floor(ca / 2)) AS upper FROM b GROUP BY l_suppkey""",
    "learned_offset": """WITH v AS (SELECT l_partkey, CAST(l_quantity % 3 AS INT) AS o, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, o) AS r FROM v)
SELECT l_partkey, max(o) FILTER (r = 1) AS "offset" FROM r GROUP BY l_partkey HAVING max(n) FILTER (r = 1) >= 3 AND max(n) FILTER (r = 1) >= 2 * coalesce(max(n) FILTER (r = 2), 0)""",
    "pie_tail_fold": """WITH s AS (SELECT n_name, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING sum(c_acctbal) > 0),
r AS (SELECT *, row_number() OVER (ORDER BY v DESC, n_name) AS r, count(*) OVER () AS n FROM s)
SELECT CAST(CASE WHEN n > 5 AND r >= 5 THEN 5 ELSE r END AS INT) AS slot, CASE WHEN n > 5 AND r >= 5 THEN 'other' ELSE n_name END AS label, round(sum(v), 2) AS v FROM r GROUP BY ALL""",
    "moving_eta": """SELECT o_custkey AS book_key, o_orderkey AS page, round(avg(CAST(o_totalprice AS DOUBLE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
  * (count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)), 4) AS eta FROM orders""",
    "carry_over_plan": f"""WITH {_LINES}, k_ AS (SELECT *, lower(trim(regexp_replace(text, '{T.WS}+', ' ', 'g'))) AS key FROM lines_),
o_ AS (SELECT book_key, key, 't:' || page || ':' || idx AS tr, row_number() OVER (PARTITION BY book_key, key ORDER BY page, idx) AS rn FROM k_ WHERE regexp_matches(text, '[.!?]$')),
t_ AS (SELECT book_key, page, idx, key, row_number() OVER (PARTITION BY book_key, key ORDER BY page, idx) AS rn FROM k_)
SELECT t_.book_key, page, idx, tr FROM t_ LEFT JOIN o_ ON t_.book_key = o_.book_key AND t_.key = o_.key AND t_.rn = o_.rn""",
    "stale_translations": """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber * 13 BETWEEN 1 AND 60 AND l_linenumber * 13 <> CAST(l_quantity AS INT) AND l_linenumber * 13 <> 2""",
    "glossary_word_match": """WITH g(term) AS (VALUES ('the'), ('and'), ('of a'), ('is'), ('und die'), ('F1'), ('re')),
c AS (SELECT DISTINCT conv_id || ':' || turn AS text_id, text FROM conversations WHERE text IS NOT NULL)
SELECT DISTINCT text_id, term FROM c, g WHERE regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])' || lower(term) || '(?:$|[^\\p{L}\\p{N}_])')""",
    "glossary_parse": """SELECT p_brand AS book_key, p_partkey AS line_no, trim(p_name) AS term, CASE WHEN p_partkey % 6 IN (1, 3) THEN p_type END AS translation,
  CASE WHEN p_partkey % 6 IN (2, 3) THEN p_brand END AS category, CASE WHEN p_partkey % 6 = 3 THEN p_type || ' :: more' END AS definition FROM part WHERE p_partkey % 6 < 4""",
    "glossary_merge3": f"""WITH p AS (SELECT p_brand AS book_key, min(p_partkey) AS seq, min(p_size) AS size, {_concept_sql('p_name')} AS key FROM part GROUP BY p_brand, p_name)
SELECT book_key, 0 AS side, seq, key FROM p WHERE size BETWEEN 5 AND 45 AND (size < 40 OR size <= 10) UNION ALL SELECT book_key, 1, seq, key FROM p WHERE size < 40 AND NOT size BETWEEN 5 AND 45""",
    "html_text": """SELECT p_partkey, '&lt;b&gt;' || p_name || '&lt;/b&gt; &amp; &quot;' || p_partkey || '&quot;' AS html, regexp_replace(lower('<b>' || p_name || '</b> & "' || p_partkey || '"'), '[0-9]+', '#', 'g') AS furniture, CAST(p_size + 0.5 AS DOUBLE) AS number FROM part""",
}

"""Queries over what a reader sees: drawn graphs, outlines, pages, prompts and exports, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.operators import glossary, graph, search, translation
from tomeloom.plans.corpus import lines, pages, table
from tomeloom.plans.library import _CONCEPTS, _LINES, _TOPS, _concepts


def _nodes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.concat(F.lit("n:"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") > 40, "book").otherwise("term").alias("kind"), F.col("p_retailprice").cast("double").alias("weight"))


def node_search(spark, sf_dir):
    """SE05: nodes whose label has the words, prefixes and books first."""
    return graph.search_nodes(_nodes(spark, sf_dir), " Ring")


def heaviest_nodes(spark, sf_dir):
    """WIN04: the 700 concepts that are drawn."""
    return graph.heaviest(_nodes(spark, sf_dir)).select("id", "weight")


def graph_sizes(spark, sf_dir):
    """AGG14: books and concepts of a graph."""
    return graph.graph_stats(_nodes(spark, sf_dir))


def seed_layout(spark, sf_dir):
    """GR06: where the drawing starts, a spiral by weight."""
    out = graph.seed_positions(_nodes(spark, sf_dir), 800.0, 600.0)
    return out.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def nearest_node(spark, sf_dir):
    """GR07: the node under a point."""
    part = table(spark, sf_dir, "part")
    spots = part.select(F.concat(F.lit("n:"), "p_partkey").alias("id"), (F.col("p_size") * 3.0).alias("x"), (F.col("p_retailprice") - 900.0).cast("double").alias("y"))
    return graph.nearest(spots, 31.0, 12.0)


def similar_books(spark, sf_dir):
    """GR04: the three books that share most concepts with each."""
    shares = graph.share_candidates(_concepts(spark, sf_dir)).withColumn("weight", F.round("sim", 9))
    return graph.neighbours(shares.select("a", "b", "weight"))


def export_text(spark, sf_dir):
    """SNK06: pages as text, with a note for each run of empty ones."""
    rows = lines(spark, sf_dir).withColumn("tr", F.col("text"))
    gaps = translation.gap_runs(pages(spark, sf_dir).select("book_key", "page", (F.trim("text") == "").alias("empty")), F.col("empty"))
    out = translation.export_txt(rows, gaps)
    return out.select("book_key", "page", "block", F.md5(F.col("text").cast("binary")).alias("text"))


def _sized(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "other").otherwise("prose")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book_key"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("fh"), kind.alias("kind"))


def render_classes(spark, sf_dir):
    """CLS12, AGG08: heads, notes and body by size against the book's body size."""
    rows = _sized(spark, sf_dir)
    sized = rows.join(translation.body_size(rows), "book_key", "left")
    cls = translation.render_class(F.col("fh"), F.col("body_fh"), F.lit("- x"))
    return sized.select("book_key", cls.alias("cls")).groupBy("book_key", "cls").agg(F.count(F.lit(1)).alias("n"))


def outline_match(spark, sf_dir):
    """JN14, FN06: outline rows by the most similar heading on their page."""
    part = table(spark, sf_dir, "part")
    outline = part.select(F.col("p_brand").alias("book_key"), F.col("p_partkey").alias("id"), F.col("p_size").alias("page"), F.col("p_name").alias("title"))
    heads = part.select(F.col("p_brand").alias("book_key"), F.col("p_size").alias("page"), (F.col("p_partkey") * 2).alias("idx"), F.concat("p_name", F.lit(" "), F.substring("p_type", 1, 1)).alias("text"), F.concat(F.lit("t:"), "p_partkey").alias("tr"))
    return translation.match_outline(outline, heads)


def outline_search(spark, sf_dir):
    """CLS15: outline rows by page or by title."""
    outline = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("page"), F.col("p_name").alias("title"), F.col("p_type").alias("tr"))
    return search.outline_filter(outline, "4").select(F.lit("page").alias("by"), "id").unionByName(search.outline_filter(outline, "Econ").select(F.lit("title").alias("by"), "id"))


def uncovered_paragraphs(spark, sf_dir):
    """JN12: boxes that no figure of their page covers."""
    li = table(spark, sf_dir, "lineitem")
    box = [F.col("l_suppkey").alias("book_key"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("idx"), F.col("l_quantity").alias("x")]
    paragraphs = li.select(*box, F.round(F.col("l_tax") * 100).alias("y"), F.lit(10.0).alias("w"), F.lit(4.0).alias("h"))
    figures = li.filter("l_returnflag = 'R'").select(*box, F.round(F.col("l_discount") * 100).alias("y"), F.lit(12.0).alias("w"), F.lit(6.0).alias("h"))
    return search.outside_figures(paragraphs, figures).select("book_key", "page", "idx")


def torn_pages(spark, sf_dir):
    """JN20: paragraphs that go on on the next page; a document is a book that turns pages at commas."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_key"), F.posexplode(F.split("text", ", ")).alias("page", "text"))
    return translation.stitch_pages(docs.withColumn("idx", F.lit(0)).withColumn("kind", F.lit("prose")))


PAIRS = (("the", "le"), ("and", "et"), ("of a", "d'un"), ("und die", "et la"), ("re", "ré"))


def translation_prompts(spark, sf_dir):
    """FN31, JN06: prompts with the terms that the text has."""
    words = spark.createDataFrame([(*p, i) for i, p in enumerate(PAIRS)], "term string, translation string, seq int")
    c = table(spark, sf_dir, "conversations").filter("text is not null").groupBy(F.concat_ws(":", "conv_id", "turn").alias("text_id")).agg(F.min("text").alias("text"))
    return glossary.build_prompts(c, words, "French").select("text_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


def folded_duplicates(spark, sf_dir):
    """AGG19, GR02: variants of a term as one record."""
    part = table(spark, sf_dir, "part")
    source = F.when(F.min("p_size") < 3, "user").otherwise("mined")
    records = part.groupBy(F.col("p_brand").alias("book_key"), F.col("p_name").alias("term")).agg(F.count(F.lit(1)).alias("freq"), source.alias("source"), F.array_sort(F.collect_set("p_size")).alias("pages"))
    clusters = records.select("book_key", "term", F.substring_index("term", " ", -1).alias("cluster"))
    out = glossary.fold_duplicates(records, clusters)
    return out.select("book_key", "term", "freq", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def to_translate(spark, sf_dir):
    """FN14, FN33: which documents a reader of English would have translated, and plural forms."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.needs_translation(F.col("lang"), F.lit("en-GB")).alias("needed"), T.plural_form(F.col("n_chars"), "ru").cast("int").alias("ru"), T.plural_form(F.col("n_chars"), "fr").cast("int").alias("fr"))


def _sidecars(spark, sf_dir):
    part = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("freq"), F.min("p_size").alias("s"), F.collect_set(F.col("p_size") - 30).alias("pages"))
    entry = F.struct(F.when(F.col("s") < 20, "topic").otherwise("gadget").alias("kind"), F.col("pages"), F.col("freq"), F.when(F.col("s") < 10, "user").otherwise("mined").alias("source"))
    terms = F.map_from_entries(F.collect_list(F.struct(F.col("p_name"), entry)))
    raw = part.groupBy(F.col("p_brand").alias("book_key")).agg(terms.alias("terms"))
    return raw.select("book_key", F.to_json(F.struct(F.lit(2).alias("v"), F.lit("EN").alias("lang"), F.lit("no tag!").alias("target"), "terms")).alias("json"))


def _listed(c):
    return F.array_join(F.transform(c, lambda p: p.cast("string")), ",")


def sidecar_fields(spark, sf_dir):
    """SRC13: entries of sidecar files, held to their vocabularies."""
    out = glossary.parse_sidecar(_sidecars(spark, sf_dir))
    return out.select("book_key", "lang", "target", "key", "kind", _listed("pages").alias("pages"), "freq", "source")


def sidecar_merge(spark, sf_dir):
    """AGG20, JN04: a new sidecar out of records and the previous one."""
    part = table(spark, sf_dir, "part").filter("p_size > 5").groupBy(F.col("p_brand").alias("book_key"), F.col("p_name").alias("term"))
    records = part.agg((F.max("p_size") / 10).cast("long").alias("freq"), F.collect_set("p_size").alias("pages")).withColumn("kind", F.lit(None).cast("string")).withColumn("aliases", F.array(F.lit("same"), F.lit("Same")))
    records = records.withColumn("source", F.lit("model"))
    out = glossary.build_sidecar(records, glossary.parse_sidecar(_sidecars(spark, sf_dir)))
    return out.select("book_key", "key", "kind", F.array_join("aliases", "|").alias("aliases"), _listed("pages").alias("pages"), "freq", "source")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_NODES = "n_ AS (SELECT 'n:' || p_partkey AS id, p_name AS label, CASE WHEN p_size > 40 THEN 'book' ELSE 'term' END AS kind, CAST(p_retailprice AS DOUBLE) AS weight FROM part)"
_NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_SIDE = f"""WITH g_ AS (SELECT p_brand AS book_key, {_NORM.format('p_name')} AS key, count(*) AS freq, min(p_size) AS s, list(DISTINCT p_size - 30) AS all_pages FROM part GROUP BY ALL),
s_ AS (SELECT book_key, key, freq, CASE WHEN s < 20 THEN 'topic' END AS kind, CASE WHEN s < 10 THEN 'user' ELSE 'mined' END AS source, list_sort(list_filter(all_pages, lambda p: p >= 1))[1:8] AS pages FROM g_)"""
_END = "[.!?…:;][\"»”’)\\]]*[ \\t\\n]*$"
_VALUES = ", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + f"', {i})" for i, (a, b) in enumerate(PAIRS))
ORACLE = {
    "node_search": f"WITH {_NODES} SELECT id, label, round(CASE WHEN starts_with(lower(label), 'ring') THEN 1000.0 ELSE 0 END + CASE WHEN kind = 'book' THEN 500.0 ELSE 0 END + ln(1 + weight), 6) AS rank_score FROM n_ WHERE contains(lower(label), 'ring')",
    "heaviest_nodes": f"WITH {_NODES} SELECT id, weight FROM n_ WHERE kind <> 'book' ORDER BY weight DESC, id LIMIT 700",
    "graph_sizes": f"WITH {_NODES} SELECT count(*) FILTER (kind = 'book') AS books, count(*) FILTER (kind <> 'book') AS concepts FROM n_",
    "seed_layout": f"""WITH {_NODES}, i_ AS (SELECT id, row_number() OVER (ORDER BY weight DESC, id) - 1 AS i FROM n_ QUALIFY i < 700)
SELECT id, round(400.0 + 14.0 * sqrt(i + 0.5) * cos(i * 2.399963229728653), 4) AS x, round(300.0 + 14.0 * sqrt(i + 0.5) * sin(i * 2.399963229728653), 4) AS y FROM i_""",
    "nearest_node": """WITH d AS (SELECT 'n:' || p_partkey AS id, sqrt(power(p_size * 3.0 - 31.0, 2) + power(CAST(p_retailprice - 900.0 AS DOUBLE) - 12.0, 2)) AS d FROM part)
SELECT id FROM d WHERE d <= 24.0 ORDER BY d, id LIMIT 1""",
    "similar_books": f"""WITH {_CONCEPTS}, {_TOPS}, s_ AS (SELECT a, b, round(sim, 9) AS weight FROM sims_ WHERE sim >= 0.06),
e_ AS (SELECT a AS book, b AS other, weight FROM s_ UNION ALL SELECT b, a, weight FROM s_)
SELECT book, other, weight, CAST(row_number() OVER (PARTITION BY book ORDER BY weight DESC, other) AS INT) AS rank FROM e_ QUALIFY rank <= 3""",
    "export_text": f"""WITH {_LINES}, e_ AS (SELECT source AS book_key, doc_id AS page FROM documents WHERE trim(coalesce(text, '')) = ''),
i_ AS (SELECT *, page - row_number() OVER (PARTITION BY book_key ORDER BY page) AS island FROM e_),
g_ AS (SELECT book_key, min(page) AS a, max(page) AS b FROM i_ GROUP BY book_key, island)
SELECT book_key, page, 1 AS block, md5(string_agg(text, chr(10) || chr(10) ORDER BY idx)) AS text FROM lines_ GROUP BY ALL
UNION ALL SELECT book_key, a, 0, md5(CASE WHEN a = b THEN '[page ' || a ELSE '[pages ' || a || '–' || b END || ' not translated]') FROM g_""",
    "render_classes": """WITH r AS (SELECT l_suppkey AS book_key, l_quantity AS fh, l_returnflag <> 'R' AS prose FROM lineitem),
c AS (SELECT book_key, fh, row_number() OVER (PARTITION BY book_key ORDER BY fh) AS i, count(*) OVER (PARTITION BY book_key) AS n FROM r WHERE prose AND fh > 0),
b AS (SELECT book_key, fh AS body FROM c WHERE i = n // 2 + 1)
SELECT book_key, CASE WHEN fh / body >= 1.15 THEN 'head' WHEN fh / body > 0 AND fh / body <= 0.88 THEN 'foot' ELSE 'hang' END AS cls, count(*) AS n FROM r LEFT JOIN b USING (book_key) GROUP BY ALL""",
    "outline_match": f"""WITH o AS (SELECT p_brand AS book_key, p_partkey AS id, p_size AS page, {_NORM.format('p_name')} AS a FROM part),
h AS (SELECT p_brand AS book_key, p_partkey AS k, p_size AS page, {_NORM.format("p_name || ' ' || left(p_type, 1)")} AS b, 't:' || p_partkey AS tr FROM part),
oa AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS g FROM o) GROUP BY ALL),
hb AS (SELECT k, g, count(*) AS n FROM (SELECT k, unnest(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS g FROM h) GROUP BY ALL),
p AS (SELECT o.book_key, o.id, h.k, h.tr, length(a) + length(b) - 2 AS size FROM o JOIN h ON o.book_key = h.book_key AND o.page = h.page),
s AS (SELECT p.book_key, p.id, p.k, p.tr, 2.0 * sum(least(oa.n, hb.n)) / any_value(size) AS sim FROM p JOIN oa ON oa.id = p.id JOIN hb ON hb.k = p.k AND hb.g = oa.g GROUP BY ALL)
SELECT book_key, id, arg_max(tr, (sim, -k)) AS tr FROM s WHERE sim >= 0.75 GROUP BY ALL""",
    "outline_search": "SELECT 'page' AS \"by\", p_partkey AS id FROM part WHERE starts_with(CAST(p_size AS VARCHAR), '4') UNION ALL SELECT 'title', p_partkey FROM part WHERE contains(lower(p_name), 'econ') OR contains(lower(p_type), 'econ')",
    "uncovered_paragraphs": """WITH p AS (SELECT l_suppkey AS book_key, l_linenumber AS page, l_orderkey AS idx, l_quantity AS x, round(l_tax * 100) AS y FROM lineitem),
f AS (SELECT l_suppkey AS book_key, l_linenumber AS page, l_quantity AS x, round(l_discount * 100) AS y FROM lineitem WHERE l_returnflag = 'R')
SELECT book_key, page, idx FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.book_key = p.book_key AND f.page = p.page
  AND greatest(0.0, least(p.x + 10, f.x + 12) - greatest(p.x, f.x)) * greatest(0.0, least(p.y + 4, f.y + 6) - greatest(p.y, f.y)) >= 24.0)""",
    "torn_pages": f"""WITH p_ AS (SELECT doc_id AS book_key, unnest(string_split(text, ', ')) AS t, generate_subscripts(string_split(text, ', '), 1) - 1 AS page FROM documents),
e_ AS (SELECT book_key, CAST(page AS INT) AS page, 0 AS li, t AS lt, 0 AS fi, t AS ft FROM p_ WHERE t <> ''),
n_ AS (SELECT *, lead(page) OVER w AS np, lead(fi) OVER w AS ni, lead(ft) OVER w AS nt FROM e_ WINDOW w AS (PARTITION BY book_key ORDER BY page))
SELECT book_key, page, li AS idx, np AS to_page, ni AS to_idx FROM n_ WHERE np - page <= 3 AND NOT regexp_matches(lt, '{_END}') AND regexp_matches(nt, '^[«"“(]?[\\p{{Ll}}]')""",
    "translation_prompts": f"""WITH g(term, tr, seq) AS (VALUES {_VALUES}),
c AS (SELECT conv_id || ':' || turn AS text_id, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
m AS (SELECT text_id, string_agg(term || ' = ' || tr, chr(10) ORDER BY seq) AS terms FROM c, g WHERE regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])' || term || '(?:$|[^\\p{{L}}\\p{{N}}_])') GROUP BY ALL)
SELECT text_id, md5(CASE WHEN terms IS NULL THEN '' ELSE 'Use these translations:' || chr(10) || terms || chr(10) || chr(10) END || 'Translate the following segment into French, without additional explanation.' || chr(10) || chr(10) || text) AS prompt
FROM c LEFT JOIN m USING (text_id)""",
    "folded_duplicates": """WITH r AS (SELECT p_brand AS book_key, p_name AS term, count(*) AS freq, min(p_size) >= 3 AS mined, list(DISTINCT p_size) AS pages FROM part GROUP BY ALL),
k AS (SELECT *, regexp_extract(term, '[^ ]*$') AS cluster FROM r),
f AS (SELECT book_key, cluster, arg_min(term, (mined, -freq, term)) AS term, CAST(sum(freq) AS BIGINT) AS freq, list_sort(list(term)) AS terms, list_sort(list_distinct(flatten(list(pages))))[1:8] AS pages FROM k GROUP BY ALL)
SELECT book_key, term, freq, array_to_string(list_filter(terms, lambda x: x <> term)[1:12], '|') AS aliases, array_to_string(pages, ',') AS pages FROM f""",
    "sidecar_fields": f"""{_SIDE} SELECT book_key, 'en' AS lang, 'und' AS target, key, kind, CASE WHEN len(pages) > 0 THEN array_to_string(pages, ',') END AS pages, freq, source FROM s_""",
    "sidecar_merge": f"""{_SIDE}, r_ AS (SELECT p_brand AS book_key, {_NORM.format('p_name')} AS key, CAST(floor(max(p_size) / 10) AS BIGINT) AS freq, list(DISTINCT p_size) AS pages FROM part WHERE p_size > 5 GROUP BY ALL)
SELECT r_.book_key, r_.key, kind, 'same' AS aliases, array_to_string(list_sort(list_distinct(list_concat(r_.pages, coalesce(s_.pages, []))))[1:8], ',') AS pages,
  CASE WHEN greatest(s_.freq, r_.freq) >= 1 THEN greatest(s_.freq, r_.freq) END AS freq, CASE WHEN source = 'user' THEN 'user' ELSE 'model' END AS source
FROM r_ LEFT JOIN s_ ON s_.book_key = r_.book_key AND s_.key = r_.key""",
    "to_translate": """SELECT doc_id, coalesce(CASE WHEN regexp_matches(regexp_extract(lower(trim(lang)), '^[^-_]*'), '^[a-z]{2,3}$') THEN regexp_extract(lower(trim(lang)), '^[^-_]*') END, '') <> 'en' AS needed,
CAST(CASE WHEN n_chars % 10 = 1 AND n_chars % 100 <> 11 THEN 0 WHEN n_chars % 10 BETWEEN 2 AND 4 AND n_chars % 100 NOT BETWEEN 12 AND 14 THEN 1 ELSE 2 END AS INT) AS ru, CAST(CASE WHEN n_chars <= 1 THEN 0 ELSE 1 END AS INT) AS fr FROM documents""",
}

"""Queries over selections, threads, stores, shapes of text and pages as they flow, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.operators import desk, pagekinds, search, stitch
from tomeloom.plans.corpus import lines, pages, table
from tomeloom.plans.library import _LINES, _find_sql
from tomeloom.sources import readers
from tomeloom.streaming import runs


def selection_context(spark, sf_dir):
    """FN30: around the middle three words of each document, its sentence and a window of its text."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.flat(F.col("text")).alias("t"))
    words = F.split("t", " ")
    docs = docs.withColumn("picked", F.array_join(F.slice(words, F.floor(F.size(words) / 2).cast("int") + 1, 3), " "))
    raw = F.concat(F.lit("ab-\n  "), F.col("picked"), F.lit(" \n x"))
    return docs.select("doc_id", desk.selection(raw).alias("selection"), desk.context_window(F.col("t"), F.col("picked")).alias("context"), desk.sentence_around(F.col("t"), F.col("picked")).alias("sentence"))


def thread_prune(spark, sf_dir):
    """WIN12: conversations as threads of a few books; those that stay."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n"))
    threads = c.select((F.col("conv_id") % 5).alias("book"), F.col("conv_id").alias("id"), (F.col("conv_id") * 7919 % 1000).alias("ts"), F.when(F.col("conv_id") % 4 == 0, 0).otherwise(F.col("n")).alias("n"), (F.col("conv_id") % 50 < 5).alias("active"))
    return desk.prune_threads(threads).select("book", "id")


def _stores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 40 + 1).cast("int")), lambda i: i.cast("string")), ",")
    json = F.concat(F.lit('{"bookPath":"/lib/a b/'), F.col("o_orderkey").cast("string"), F.lit('.PDF","total":9,"pages":"'), F.repeat(F.col("o_orderpriority"), (F.col("o_orderkey") % 300).cast("int")), F.lit('","donePages":['), done, F.lit("]}"))
    return o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".json")).alias("file"), F.when(F.col("o_orderkey") % 11 > 0, json).otherwise("").alias("json"))


def store_sizes(spark, sf_dir):
    """AGG15, SRC15: stores by size, read by their head and tail."""
    index = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("/lib/a b/"), F.col("o_orderkey").cast("string"), F.lit(".PDF")).alias("path"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"))
    return desk.store_sizes(_stores(spark, sf_dir), index)


def node_kinds(spark, sf_dir):
    """AGG14: nodes of a graph by kind."""
    return desk.counts_by_kind(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind")))


def library_index(spark, sf_dir):
    """SRC16: scanned paths with what an index and reading positions say of them."""
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/lib/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".pdf"))
    index = c.filter("c_custkey % 3 > 0").select(path.alias("path"), F.when(F.col("c_custkey") % 7 == 0, "{broken").otherwise(F.format_string('{"title":"T %d","pages":%d}', "c_custkey", F.col("c_custkey") % 900)).alias("json"))
    positions = c.filter("c_custkey % 2 = 0").select(path.alias("path"), F.format_string('{"progress":0.25,"lastOpened":%d}', "c_custkey").alias("json"))
    return desk.library_index(c.select(path.alias("path")), index, positions)


def text_shapes(spark, sf_dir):
    """CLS10: lines of raw pages that are code, catalogue entries, captions or welded rows."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(F.coalesce("html", F.lit("")), "\n")).alias("line", "t")).filter("trim(t) <> ''")
    # every third line is made a caption, and every fifth a listing
    t = F.when(F.col("line") % 3 == 1, F.concat(F.lit("Table 2"), F.when(F.col("line") % 2 == 0, ": ").otherwise(".1 "), F.col("t"))).when(F.col("line") % 5 == 2, F.concat(F.lit("?x a:b http://a.b/c "), F.substring("t", 1, 20))).otherwise(F.col("t"))
    rows = rows.select("page_id", "line", t.alias("t"))
    return rows.select("page_id", "line", desk.code_shaped(F.col("t")).alias("code"), desk.catalogue_shaped(F.col("t")).alias("catalogue"), desk.is_caption(F.col("t")).alias("caption"), desk.welded_row(F.col("t"), ("the", "of", "and", "in")).alias("welded"))


def page_flow(spark, sf_dir):
    """LAY11, JN12: lines of documents and boxes between them as a reflowed page."""
    rows = lines(spark, sf_dir).filter("idx < 30")
    paragraphs = rows.select("book_key", "page", "idx", F.when(F.col("idx") % 7 == 3, "caption").when(F.col("idx") % 11 == 5, "other").otherwise("prose").alias("kind"), F.when(F.col("idx") % 4 > 0, F.col("text")).alias("tr"), (F.col("idx") % 9 == 8).alias("continued"), F.lit(50.0).alias("x"), (F.col("idx") * 20.0).alias("y"), F.lit(100.0).alias("w"), F.lit(15.0).alias("h"), F.when(F.col("idx") == 0, 14.0).otherwise(10.0).alias("fh"))
    spots = pages(spark, sf_dir).filter("page % 3 = 0").select("book_key", "page", F.explode(F.array(F.lit(37.0), F.lit(200.0), F.lit(100000.0))).alias("y"))
    figures = spots.select("book_key", "page", F.lit(40.0).alias("x"), "y", F.lit(120.0).alias("w"), F.lit(40.0).alias("h"))
    body = rows.select("book_key").distinct().withColumn("body_fh", F.lit(10.0))
    return desk.flow(paragraphs, figures, body)


def picture_boxes(spark, sf_dir):
    """SRC08: line items as drawing operations (rows only: a stack of transforms)."""
    li = table(spark, sf_dir, "lineitem")
    op = F.element_at(F.array(*[F.lit(x) for x in ("save", "transform", "image", "form_begin", "image", "form_end", "restore")]), F.col("l_linenumber").cast("int"))
    args = F.array(F.col("l_quantity").cast("double"), F.lit(0.0), F.lit(0.0), F.col("l_quantity").cast("double"), F.col("l_discount") * 100.0, F.col("l_tax") * 100.0)
    rows = li.filter("l_linenumber <= 7").select(F.col("l_orderkey").cast("string").alias("book_key"), F.lit(1).cast("long").alias("page"), F.col("l_linenumber").alias("seq"), op.alias("op"), args.cast("array<double>").alias("args"))
    views = rows.select("book_key", "page").distinct().withColumn("view", F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, -1.0, 0.0, 800.0)]))
    return desk.image_boxes(rows, views)


def paragraph_lines(spark, sf_dir):
    """LAY05: fragments of paragraphs as lines; a fragment's height is its place's, give or take a little."""
    li = table(spark, sf_dir, "lineitem")
    top = (F.col("l_linenumber") / 3).cast("int") * 12.0 + (F.col("l_linenumber") % 3)
    words = li.select(F.lit("b").alias("book_key"), F.col("l_orderkey").alias("page"), F.lit(0).alias("idx"), top.alias("top"), (F.col("l_linenumber") * 10.0).alias("left"), (F.col("l_linenumber") * 10.0 + 8).alias("right"))
    return desk.line_boxes(words, 10.0).select("page", "idx", "line", "top", "left", "right")


def rotated_share(spark, sf_dir):
    """CLS05: pages most of whose items are turned."""
    li = table(spark, sf_dir, "lineitem")
    turned = F.when(F.col("l_returnflag") == "N", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    return pagekinds.rotated_pages(li.select(F.lit("b").alias("book_key"), F.col("l_orderkey").alias("page"), F.col("l_linestatus").alias("str"), turned.alias("transform"))).select("page", "is_rotated")


def item_text(spark, sf_dir):
    """SRC04: pages put together of their items."""
    li = table(spark, sf_dir, "lineitem")
    items = li.select(F.lit("b").alias("book_key"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("item_no"), F.when(F.col("l_linenumber") % 5 > 0, F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))).alias("str"), (F.col("l_linenumber") % 2 == 0).alias("has_eol"))
    return readers.page_text(items).select("page", "text")


def outline_lines(spark, sf_dir):
    """SRC06, SRC07: parts of a brand as an outline: its headings and where they point."""
    part = table(spark, sf_dir, "part")
    outline = part.select(F.col("p_brand").alias("book_key"), F.col("p_partkey").alias("id"), (F.col("p_size") % 4 + 1).alias("depth"), F.col("p_name").alias("title"))
    at = readers.outline_position(F.when(F.col("p_size") % 3 == 0, "XYZ").otherwise("Fit"), F.col("p_size") * 20.0, F.lit(800.0))
    first = part.groupBy(F.col("p_brand").alias("book_key")).agg(F.round(F.sum(at), 6).alias("fractions"))
    return readers.outline_headings(outline).join(first, "book_key")


def answer_tokens(spark, sf_dir):
    """SRC18: turns as a server's token stream, up to its end mark."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    body = F.when(F.col("turn") >= 4, "data: [DONE]").when(F.col("turn") == 1, ": ping").otherwise(F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("role").alias("content")).alias("delta"))).alias("choices")))))
    return readers.sse_tokens(c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), body.alias("line")).distinct())


def chart_points(spark, sf_dir):
    """SRC20: chart specifications out of orders, some of them broken."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "radar").when(F.col("o_orderkey") % 2 == 0, "Bar").otherwise("pie")
    code = F.concat(F.lit('{"type":"'), kind, F.lit('","x":" day ","series":["a","b"],"data":[{"day":"'), "o_orderpriority", F.lit('","a":"1 '), (F.col("o_orderkey") % 10).cast("string"), F.lit('50,5 %","b":"x"}]'), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise("}"))
    return readers.chart_specs(o.select(F.col("o_orderkey").alias("spec_id"), code.alias("code")))


def translated_hits(spark, sf_dir):
    """SE02: hits in translations that are shown."""
    rows = lines(spark, sf_dir).select("book_key", "page", "idx", F.col("text").alias("tr"), F.when(F.col("idx") % 4 == 1, "caption").otherwise("prose").alias("kind"), F.lit(0.0).alias("x"), (F.col("idx") * 10.0).alias("y"), F.lit(100.0).alias("w"), F.lit(8.0).alias("h"))
    figures = pages(spark, sf_dir).filter("page % 2 = 0").select("book_key", "page", F.lit(0.0).alias("x"), F.lit(18.0).alias("y"), F.lit(100.0).alias("w"), F.lit(14.0).alias("h"))
    return search.find_translated(rows, figures, "and the")


def text_numbers(spark, sf_dir):
    """FN08, FN28, FN32, FN33: page signatures, Roman numerals, hosts, plural forms."""
    part = table(spark, sf_dir, "part")
    numeral = F.element_at(F.array(*[F.lit(_roman(n)) for n in range(1, 51)]), F.greatest(F.lit(1), F.least(F.lit(50), F.col("p_size"))).cast("int"))
    url = F.concat(F.lit("https://"), F.when(F.col("p_size") % 2 == 0, "www.").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".example.org:80/x?y"))
    return part.select(
        "p_partkey", T.page_signature(F.repeat("p_name", 7)).alias("signature"), T.roman_value(numeral).cast("long").alias("roman"), T.host_of(url).alias("host"),
        T.plural_form(F.col("p_size"), "ru").alias("ru"), T.plural_form(F.col("p_size"), "en").alias("en"), T.plural_form(F.col("p_size"), "ja").alias("ja"),
    )


def _roman(n: int) -> str:
    out = ""
    for v, s in ((50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def stitched_pages(spark, sf_dir):
    """LAY09, JN20, STR04: line items as pages' paragraphs, an order a book, by all of the stitch rules
    (rows only here; tests hold them to a plain version)."""
    li = table(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    right = F.when(q % 3 == 0, 300.0).otherwise(299.5)
    box = F.struct((q % 2 * 12.0).alias("top"), F.lit(50.0).alias("left"), right.alias("right"))
    text = F.concat(F.when(q % 5 == 0, "Then ").when(q % 7 == 0, "• ").otherwise("and "), F.col("l_returnflag"), F.lit(" goes on"), F.when(q % 4 == 0, ".").otherwise(""))
    rows = li.select(
        F.col("l_orderkey").alias("book_key"), (n / 2).cast("int").alias("page"), n.alias("idx"), F.lit(50.0).alias("x"), F.lit(250.0).alias("w"), F.when(q % 11 == 0, 14.0).otherwise(10.0).alias("fh"),
        F.when(q % 13 == 0, "other").otherwise("prose").alias("kind"), text.alias("text"), F.array(box, box).alias("lines"), F.lit(12.0).alias("line_h"), (F.col("l_linestatus") == "X").alias("ref_page"), F.lit(False).alias("in_figure"),
    )
    return stitch.stitch(rows.dropDuplicates(["book_key", "page", "idx"]))


def due_builds(spark, sf_dir):
    """STR05: what build requests and shards leave to do."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    action = F.when(F.col("o_orderpriority") == "1-URGENT", "force").when(F.col("o_orderstatus") == "F", "forget").otherwise("build")
    requests = o.select((F.col("o_custkey") % 700).alias("path"), F.col("o_orderkey").alias("at"), action.alias("action"))
    shards = c.filter("c_custkey % 700 = c_custkey").select(F.col("c_custkey").alias("path"), F.when(F.col("c_custkey") % 3 == 0, "seed").otherwise("deep").alias("stage"), (F.col("c_custkey") % 4).alias("gen"))
    return runs.build_queue(requests, shards, 3)


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FLAT = f"trim(regexp_replace(text, {_lit(T.WS + '+')}, ' ', 'g'))"
_PATH = "'/lib/' || c_mktsegment || '/' || c_name || '.pdf'"
ORACLE = {
    "selection_context": f"""WITH t AS (SELECT doc_id, {_FLAT} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, array_to_string(list_slice(string_split(t, ' '), len(string_split(t, ' ')) // 2 + 1, len(string_split(t, ' ')) // 2 + 3), ' ') AS picked FROM t),
a AS (SELECT *, instr(lower(t), lower(picked)) AS pos, length(t) AS n FROM p),
b AS (SELECT *, greatest(0, least(CAST(floor(CASE WHEN pos > 0 THEN pos - 1 + length(picked) / 2 ELSE n / 2 END - 1100 + 0.5) AS BIGINT), n - 2200)) AS s,
  left(t, pos - 1) AS before, substr(t, pos + length(picked)) AS behind FROM a),
c AS (SELECT *, length(regexp_extract(before, '(?s)^(.*[.!?…][")\\]]?)\\s', 1)) AS start, regexp_extract(behind, '(?s)^(.*?[.!?…][")\\]]?)', 1) AS tail FROM b),
d AS (SELECT *, trim(substr(t, start + 1, least(pos - 1 + length(picked) + CASE WHEN tail = '' THEN length(behind) ELSE length(tail) END - start, 600))) AS found FROM c)
SELECT doc_id, trim(regexp_replace('ab' || picked || ' ' || chr(10) || ' x', {_lit(T.WS + '+')}, ' ', 'g')) AS selection,
  CASE WHEN n <= 2200 THEN t ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substr(t, s + 1, 2200) || CASE WHEN s + 2200 < n THEN '…' ELSE '' END END AS context,
  CASE WHEN pos > 0 AND len(string_split(found, ' ')) > len(string_split(picked, ' ')) THEN found END AS sentence FROM d""",
    "thread_prune": """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n0 FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id % 5 AS book, conv_id AS id, conv_id * 7919 % 1000 AS ts, CASE WHEN conv_id % 4 = 0 THEN 0 ELSE n0 END AS n, conv_id % 50 < 5 AS active FROM c),
s AS (SELECT *, active OR row_number() OVER (PARTITION BY book ORDER BY ts DESC, id) = 1 AS safe, count(*) OVER (PARTITION BY book) AS cnt FROM t)
SELECT book, id FROM s QUALIFY safe OR row_number() OVER (PARTITION BY book ORDER BY safe, CASE WHEN n = 0 THEN 0 ELSE 1 END, ts, id) > cnt - 30""",
    "store_sizes": """WITH s AS (SELECT o_orderkey, '{"bookPath":"/lib/a b/' || o_orderkey || '.PDF","total":9,"pages":"' || repeat(o_orderpriority, CAST(o_orderkey % 300 AS INT)) || '","donePages":[' || array_to_string(range(1, o_orderkey % 40 + 2), ',') || ']}' AS j FROM orders WHERE o_orderkey % 11 > 0)
SELECT o_orderkey || '.json' AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'Order ' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS title, strlen(j) AS bytes, o_orderkey % 40 + 1 AS pages FROM s""",
    "node_kinds": "SELECT c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY ALL",
    "library_index": f"""SELECT {_PATH} AS path, c_name AS name, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 7 > 0 THEN 'T ' || c_custkey END AS title, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 7 > 0 THEN c_custkey % 900 END AS pages,
  CASE WHEN c_custkey % 2 = 0 THEN 0.25 END AS progress, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS last_opened FROM customer""",
    "text_shapes": f"""WITH r AS (SELECT page_id, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS line FROM (SELECT page_id, string_split(coalesce(html, ''), chr(10)) AS a FROM pages)),
l AS (SELECT page_id, line, CASE WHEN line % 3 = 1 THEN 'Table 2' || CASE WHEN line % 2 = 0 THEN ': ' ELSE '.1 ' END || t WHEN line % 5 = 2 THEN '?x a:b http://a.b/c ' || left(t, 20) ELSE t END AS t FROM r WHERE trim(t) <> ''),
k AS (SELECT *, list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda w: w <> '') AS w FROM l),
m AS (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, {_lit(desk.CODE_TOKEN)}))) + len(regexp_extract_all(t, {_lit(desk.CODE_ADDRESS)})) AS marks, len(list_filter(w, lambda x: regexp_matches(x, {_lit(desk.IDENTIFIER_TOKEN)}))) AS ids,
  regexp_replace(t, {_lit(desk.CAPTION + '[0-9.]*')}, '', 'g') AS rest FROM k)
SELECT page_id, line, regexp_matches(t, {_lit(desk.CODE_OPEN)}) OR regexp_matches(t, {_lit(desk.CODE_MAP)}) OR regexp_matches(t, {_lit(desk.CODE_LANGUAGE)}) OR (marks >= 1 AND marks >= 0.2 * len(w)) AS code, ids >= 1 AND ids >= 0.25 * len(w) AS catalogue,
  regexp_matches(t, {_lit(desk.CAPTION)}) AND (regexp_matches(rest, '^\\s*[:.—–-]') OR NOT regexp_matches(rest, '^\\s*[a-zа-яё]')) AS caption,
  NOT regexp_matches(trim(t), {_lit(desk.ROW_END)}) AND len(list_filter(w, lambda x: regexp_replace(lower(x), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') IN ('the', 'of', 'and', 'in'))) < 2 AS welded FROM m""",
    "page_flow": f"""WITH {_LINES}, p AS (SELECT book_key, page, idx, CASE WHEN idx % 7 = 3 THEN 'caption' WHEN idx % 11 = 5 THEN 'other' ELSE 'prose' END AS kind, CASE WHEN idx % 4 > 0 THEN text END AS tr, idx * 20.0 AS y FROM lines_ WHERE idx < 30 AND idx % 9 <> 8),
f AS (SELECT source AS book_key, doc_id AS page, unnest([37.0, 200.0, 100000.0]) AS y FROM documents WHERE doc_id % 3 = 0),
s AS (SELECT * FROM p WHERE kind <> 'caption' AND NOT EXISTS (SELECT 1 FROM f WHERE f.book_key IS NOT DISTINCT FROM p.book_key AND f.page = p.page AND greatest(0, least(p.y + 15, f.y + 40) - greatest(p.y, f.y)) * 100 >= 0.6 * 1500)),
i AS (SELECT book_key, page, CAST(idx AS DOUBLE) AS pos, 1 AS side, CASE WHEN kind = 'prose' AND coalesce(tr, '') <> '' THEN CASE WHEN idx = 0 THEN 'head' ELSE 'p' END ELSE 'crop' END AS kind, tr AS text, 50.0 AS x, y FROM s
  UNION ALL SELECT f.book_key, f.page, coalesce((SELECT min(s.idx) FROM s WHERE s.page = f.page AND s.book_key IS NOT DISTINCT FROM f.book_key AND (f.y < s.y OR f.y = s.y AND 40.0 <= 50.0)), 1e18), 0, 'figure', NULL, 40.0, f.y FROM f)
SELECT book_key, page, row_number() OVER (PARTITION BY book_key, page ORDER BY pos, side, CASE WHEN side = 0 THEN y END, x) - 1 AS place, kind, text, x, y FROM i""",
    "paragraph_lines": """WITH l AS (SELECT l_orderkey AS page, l_linenumber // 3 AS g, min(l_linenumber // 3 * 12.0 + l_linenumber % 3) AS top, min(l_linenumber * 10.0) AS "left", max(l_linenumber * 10.0 + 8) AS "right" FROM lineitem GROUP BY ALL)
SELECT page, 0 AS idx, row_number() OVER (PARTITION BY page ORDER BY g) - 1 AS line, top, "left", "right" FROM l""",
    "rotated_share": "SELECT l_orderkey AS page, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) >= 0.5 AS is_rotated FROM lineitem GROUP BY ALL",
    "item_text": "SELECT l_orderkey AS page, string_agg(CASE WHEN l_linenumber % 5 > 0 THEN l_returnflag || l_linestatus || l_partkey ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN chr(10) ELSE '' END, '' ORDER BY l_linenumber, l_returnflag || l_linestatus || l_partkey) AS text FROM lineitem GROUP BY ALL",
    "outline_lines": """WITH t AS (SELECT p_brand, p_partkey, p_name FROM part WHERE p_size % 4 + 1 <= 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 40),
h AS (SELECT p_brand AS book_key, left(string_agg(trim(p_name), '; ' ORDER BY p_partkey, p_name), 600) AS headings FROM t GROUP BY ALL),
f AS (SELECT p_brand AS book_key, round(sum(CASE WHEN p_size % 3 = 0 THEN greatest(0.0, least(1.0, 1.0 - p_size * 20.0 / 800.0)) ELSE 0.0 END), 6) AS fractions FROM part GROUP BY ALL)
SELECT book_key, headings, fractions FROM h JOIN f USING (book_key)""",
    "answer_tokens": """WITH l AS (SELECT DISTINCT conv_id, turn, CASE WHEN turn >= 4 THEN NULL WHEN turn = 1 THEN '' ELSE role END AS token FROM conversations WHERE text IS NOT NULL),
e AS (SELECT conv_id, min(turn) AS stop FROM l WHERE token IS NULL GROUP BY ALL)
SELECT l.conv_id AS stream_id, turn AS seq, token FROM l LEFT JOIN e USING (conv_id) WHERE token <> '' AND (stop IS NULL OR turn < stop)""",
    "chart_points": """WITH o AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'bar' ELSE 'pie' END AS kind FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0),
s AS (SELECT *, unnest(CASE WHEN kind = 'pie' THEN ['a'] ELSE ['a', 'b'] END) AS series FROM o)
SELECT o_orderkey AS spec_id, kind, 'day' AS x, series, o_orderpriority AS name, CASE WHEN series = 'a' THEN CAST('1' || o_orderkey % 10 || '50.5' AS DOUBLE) END AS value FROM s""",
    "due_builds": """WITH r AS (SELECT o_custkey % 700 AS path, o_orderkey AS a, CASE WHEN o_orderpriority = '1-URGENT' THEN 'force' WHEN o_orderstatus = 'F' THEN 'forget' ELSE 'build' END AS action FROM orders),
e AS (SELECT path, arg_max(action, a) AS action, max(a) FILTER (action = 'forget') AS forgot FROM r GROUP BY path),
f AS (SELECT r.path, min(a) AS a, bool_or(r.action = 'force') AS forced FROM r JOIN e USING (path) WHERE forgot IS NULL OR a > forgot GROUP BY r.path),
s AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 'seed' ELSE 'deep' END AS have, c_custkey % 4 AS gen FROM customer WHERE c_custkey < 700),
j AS (SELECT path, a, forced, have, forced OR have IS NULL OR gen < 3 AS anew FROM e JOIN f USING (path) LEFT JOIN s USING (path) WHERE e.action <> 'forget')
SELECT path, a AS at, CASE WHEN anew THEN 'seed' ELSE 'deep' END AS stage FROM j WHERE anew OR have <> 'deep'""",
    "translated_hits": f"""WITH {_LINES}, shown_ AS (SELECT book_key AS b, page, idx, text FROM lines_ WHERE idx % 4 <> 1 AND NOT (page % 2 = 0 AND idx = 2)),
{_find_sql("and the").replace("source AS book_key, doc_id AS page,", "b AS book_key, page || ':' || idx AS page,").replace("FROM documents", "FROM shown_")}
SELECT book_key, CAST(string_split(page, ':')[1] AS BIGINT) AS page, CAST(string_split(page, ':')[2] AS INT) AS idx, hit, "start", "end" FROM hits_""",
    "text_numbers": """WITH p AS (SELECT *, repeat(p_name, 7) AS s FROM part)
SELECT p_partkey, list_reduce(list_prepend(CAST(length(s) AS BIGINT), list_transform(range(1, length(s) + 1, 32), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))), lambda h, x: (h * 31 + x) & 4294967295) AS signature,
  greatest(1, least(50, p_size)) AS roman, replace(p_name, ' ', '-') || '.example.org' AS host,
  CASE WHEN p_size % 10 = 1 AND p_size % 100 <> 11 THEN 0 WHEN p_size % 10 BETWEEN 2 AND 4 AND p_size % 100 NOT BETWEEN 12 AND 14 THEN 1 ELSE 2 END AS ru, CASE WHEN p_size = 1 THEN 0 ELSE 1 END AS en, 0 AS ja FROM p""",
}

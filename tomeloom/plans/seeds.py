"""Queries over shards and a term store's passes, with SQL.  Models are stand-ins that answer by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.functions.udfs import split_authors, split_citations
from tomeloom.operators import glossary, graph, layout, mining, passes, seed
from tomeloom.operators.mining import ALL_LISTS
from tomeloom.plans.corpus import lines, pages, table
from tomeloom.plans.library import _CONCEPTS, _MARKS, _concepts, _fold_sql
from tomeloom.plans.terms import _COUNTED, _list, ranked_sql
from tomeloom.sources import readers, sinks
from tomeloom.sources.tables import fresh_path, written


def _title(c):
    return F.initcap(c)


def _people(spark, sf_dir):
    """(book_key, name): a brand's suppliers, named after the words of its parts."""
    part = table(spark, sf_dir, "part").filter("p_size < 12")
    words = F.split("p_name", " ")
    name = F.when(F.col("p_size") % 4 == 0, F.concat(_title(words[1]), F.lit(", A."))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("Ann "), _title(words[0]), F.lit("er Jr."))).otherwise(F.concat(F.lit("Bo "), _title(words[1]), _title(words[0])))
    return part.select(F.col("p_brand").alias("book_key"), name.alias("name")).distinct()


def surnames(spark, sf_dir):
    """FN22: surnames of authors, whether they may claim a term, and bare surnames of labels."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    label = F.when(F.col("p_size") % 3 == 0, F.concat(_title(words[0]), F.lit(", R."))).when(F.col("p_size") % 3 == 1, words[0]).otherwise(_title(F.col("p_name")))
    sn = seed.surname(F.col("name"))
    people = _people(spark, sf_dir).select("book_key", "name", sn.alias("surname"), F.coalesce(seed.usable_surname(sn), F.lit(False)).alias("usable"))
    bare = part.select(F.col("p_brand").alias("book_key"), label.alias("name"), seed.bare_surname(label).alias("surname"), F.lit(None).cast("boolean").alias("usable")).distinct()
    return people.unionByName(bare)


def author_terms(spark, sf_dir):
    """JN02: surnames that name one author of their book."""
    return seed.author_keys(_people(spark, sf_dir))


def _found(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    label = F.when(F.col("p_size") % 5 == 0, F.concat(_title(words[0]), F.lit("er"))).when(F.col("p_size") % 5 == 1, F.concat(F.col("p_name"), F.lit("s"))).otherwise(F.col("p_name"))
    return part.select(
        F.col("p_brand").alias("book_key"), F.col("p_partkey").cast("long").alias("seq"), label.alias("label"), F.col("p_size").cast("long").alias("freq"), F.array((F.col("p_partkey") % 30 + 1).cast("int"), (F.col("p_size") + 1).cast("int")).alias("pages"),
        F.when(F.col("p_size") % 7 > 0, F.concat_ws("/", "p_name", "p_type")).alias("stat_key"), F.when(F.col("p_size") % 6 == 0, "topic").alias("kind"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("About "), "p_type")).alias("gloss"),
    )


def seed_concepts(spark, sf_dir):
    """JN03, PIPE06: a shard's nodes: terms as concepts or as mentions of authors."""
    nodes, _ = seed.upsert_concepts(_found(spark, sf_dir), _people(spark, sf_dir), most=40)
    return nodes.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


def seed_edges(spark, sf_dir):
    """PIPE06: a shard's edges: what a book mentions and by whom it is."""
    return seed.upsert_concepts(_found(spark, sf_dir), _people(spark, sf_dir), most=40)[1]


def _polite(terms):
    """A model that calls terms with an r things, and says nothing of others."""
    return [f"{t} :: topic :: A thing that is told of." if "r" in t else "" for t in terms]


def deep_nodes(spark, sf_dir):
    """PIPE07: nodes with kinds and glosses from a stand-in's lines, books of three brands apart."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_key"), F.col("p_name").alias("label")).distinct()
    nodes = part.select("book_key", F.concat(F.lit("n:"), T.concept_id(F.col("label"))).alias("id"), F.lit("term").alias("kind"), "label", F.when(F.length("label") % 2 == 0, "Known.").alias("gloss"), F.lit(1.0).alias("weight"), F.array().cast("array<int>").alias("pages"))
    prov = part.select("book_key").distinct().select("book_key", F.when(F.length("book_key") % 2 == 0, "article").otherwise("unknown").alias("prov"))
    return seed.deepen(nodes, prov, {"article": _polite, "book": lambda terms: [""] * len(terms)}).select("book_key", "label", "kind", "gloss")


def shard_stages(spark, sf_dir):
    """STR06: the stage of each book's shard."""
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.col("p_type").alias("book_key"), F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") == 7), "topic").otherwise(F.when(F.col("p_type") == "SMALL", "person").otherwise("term")).alias("kind"), F.lit(None).cast("string").alias("gloss"))
    return seed.stage_of(nodes)


def _store(spark, sf_dir):
    """(lines, sidecar) of a store: brands as books, their parts as lines, some of them comments."""
    part = table(spark, sf_dir, "part")
    n = F.row_number().over(_by("p_brand", "p_partkey"))
    text = F.when(F.col("p_size") % 10 == 9, F.concat(F.lit("# "), "p_name")).otherwise(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, " = tr").otherwise(""), F.when(F.col("p_size") % 3 == 0, " :: cat :: Its definition.").otherwise("")))
    store = part.select(F.col("p_brand").alias("book_key"), n.alias("line_no"), text.alias("line"))
    side = part.filter("p_size % 4 = 0").select(
        F.col("p_brand").alias("book_key"), F.lit("en").alias("lang"), F.lit("ru").alias("target"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("key"), F.lit(None).cast("string").alias("kind"),
        F.array(F.concat(F.lit("alias "), "p_type")).alias("aliases"), F.array(F.lit(3), F.lit(1)).alias("pages"), F.col("p_size").cast("long").alias("freq"), F.when(F.col("p_size") % 8 == 0, "user").otherwise("mined").alias("source"),
    )
    return store, side


def _by(key, order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


def store_strip(spark, sf_dir):
    """SET03: a store without some records, others without their definitions."""
    store, _ = _store(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    key = T.term_key(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
    gone = part.filter("p_partkey % 5 = 0").select(F.col("p_brand").alias("book_key"), key.alias("key"))
    bare = part.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("book_key"), key.alias("key"))
    return passes.strip_definitions(passes.strip_lines(store, gone), bare)


def unaliased_terms(spark, sf_dir):
    """SET04: terms mined anew but for those that a store has folded."""
    _, side = _store(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    term = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Alias "), "p_type")).otherwise(F.col("p_name"))
    return seed.without_aliases(part.select(F.col("p_brand").alias("book_key"), term.alias("term"), F.col("p_partkey").alias("rank")), side)


def saved_store(spark, sf_dir):
    """SNK04: a store's sidecar after new records came in."""
    store, side = _store(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    incoming = part.select(
        F.col("p_brand").alias("book_key"), F.col("p_partkey").cast("long").alias("seq"), F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("new "), F.col("p_partkey").cast("string"))).alias("term"),
        none.alias("translation"), none.alias("category"), none.alias("definition"), none.alias("kind"), F.lit(None).cast("array<string>").alias("aliases"), F.array(F.col("p_size").cast("int")).alias("pages"), (F.col("p_size") + 5).cast("long").alias("freq"), F.lit("mined").alias("source"),
    )
    _, out = passes.save_glossary(store, side, incoming)
    return out.select("book_key", "key", "freq", "source", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def domain_lines(spark, sf_dir):
    """AGG17: the ten most frequent terms of each brand."""
    part = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("book_key"), F.col("p_name").alias("term")).agg(F.sum("p_size").alias("freq"))
    return passes.domain_line(part)


def mined_store(spark, sf_dir):
    """PIPE02: an empty store after mining, citation pages left out."""
    empty = spark.createDataFrame([], "book_key string, line_no long, line string")
    side = spark.createDataFrame([], "book_key string, lang string, target string, key string, kind string, aliases array<string>, pages array<int>, freq long, source string")
    out, _ = passes.mine_glossary(pages(spark, sf_dir), empty, side, cap=40, min_freq=3)
    return out.select("book_key", "line_no", "line", "change")


def _enricher(terms):
    return [f"{t} :: term :: household goods :: It is a thing of daily use." if len(t) % 3 else "no idea" for t in terms]


def enriched_terms(spark, sf_dir):
    """PIPE03: empty fields of a store's records filled by a stand-in's lines."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_key"), F.col("p_name").alias("term")).distinct()
    even = F.length("term") % 2 == 0
    records = part.select("book_key", "term", F.when(even, "own").alias("category"), F.lit(None).cast("string").alias("definition"), F.lit(None).cast("string").alias("kind"), F.lit("").alias("sample"))
    return passes.enrich(records, _enricher, "en").drop("sample")


def _same(listed):
    """One concept, spelt as its first member, unless a bolt is among them."""
    return ["no" if "bolt" in x else f"yes :: {x.split(', ')[0]}" for x in listed]


def _defined(terms):
    return [f"{t} :: {'no' if len(t) % 4 == 0 else 'yes'}" for t in terms]


def validated_terms(spark, sf_dir):
    """PIPE04: likely duplicates folded, refused definitions cleared."""
    part = table(spark, sf_dir, "part")
    term = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))
    rows = part.select(F.col("p_type").alias("book_key"), term.alias("term"), "p_size", "p_partkey").groupBy("book_key", "term").agg(F.sum("p_size").cast("long").alias("freq"), F.array_sort(F.collect_set((F.col("p_partkey") % 5 + 1).cast("int"))).alias("pages"))
    # names of two words are alike only in their plurals
    records = rows.select("book_key", "term", "freq", "pages", F.when(F.col("term").like("red %"), "user").otherwise("mined").alias("source"), F.lit("Is told.").alias("definition"))
    out = passes.validate(records, _same, _defined)
    return out.select("book_key", "term", "freq", "source", "definition", F.array_join("aliases", ",").alias("aliases"))


def _first_translator(terms):
    return [f"«{t[::-1]}»." if len(t) % 2 else "Is this what you mean?" for t in terms]


def _second_translator(terms):
    return [f'The term "{t}" means "{t.upper()}"' if len(t) % 4 else "?" for t in terms]


def translated_terms(spark, sf_dir):
    """PIPE05: terms by the first answer that passes the gates, the rest asked again."""
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("book_key"), F.when(F.col("p_size") == 1, F.upper(F.substring_index("p_name", " ", 1))).otherwise(F.col("p_name")).alias("term")).distinct()
    return passes.translate_terms(part.withColumn("sample", F.lit("")), _first_translator, _second_translator)


def shard_round_trip(spark, sf_dir):
    """SNK01, SNK02, SRC09-SRC11, JN11: shards written, some forgotten, read, healed."""
    nodes = _concepts(spark, sf_dir).select("book_key", "label", "weight", "pages", "seq")
    node = F.struct(F.concat(F.lit("n:old "), "label").alias("id"), F.lit("term").alias("kind"), F.col("label"), F.lit(None).cast("string").alias("gloss"), F.array("book_key").alias("books"), "weight", F.create_map("book_key", F.col("pages").cast("array<int>")).alias("pages"))
    edge = F.struct(F.concat(F.lit("b:"), "book_key").alias("a"), F.concat(F.lit("n:old "), "label").alias("b"), F.when(F.col("seq") % 5 == 0, "unknown").otherwise("mentions").alias("rel"), "weight")
    shards = nodes.groupBy("book_key").agg(F.array_sort(F.collect_list(F.struct("seq", node.alias("n"), edge.alias("e"))), lambda a, b: (a["seq"] - b["seq"]).cast("int")).alias("x"))
    bad = (F.col("book_key").cast("int") % 10) == 3
    shards = shards.select("book_key", F.when(bad, 2).otherwise(1).alias("version"), F.col("book_key").alias("key"), F.transform("x", lambda x: x["n"]).alias("nodes"), F.transform("x", lambda x: x["e"]).alias("edges"))
    path = fresh_path(spark, "shards")
    shards.write.partitionBy("book_key").json(path)
    sinks.forget(spark, path, shards.select("book_key").filter("book_key in ('1', '2')"))
    back = written(readers.read_shards(spark, path), "read")
    own = readers.shard_nodes(back)
    edges = readers.shard_edges(back, own)
    return edges.groupBy("book_key", "a", "b", "rel").agg(F.sum("weight").alias("weight"))


def upserted_pages(spark, sf_dir):
    """SNK03: rows of a store replaced by those that changed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_key"), F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("tr"))
    changed = o.filter("page % 3 = 0").withColumn("tr", F.lit("new")).unionByName(o.limit(0)).unionByName(spark.createDataFrame([(-1, -1, "added")], "book_key long, page long, tr string"))
    return sinks.upsert(o, changed, ["book_key", "page"])


def mined_counts(spark, sf_dir):
    """JN01: counts that words of the benchmark have as terms of each source that has them."""
    counts = mining.gram_counts(pages(spark, sf_dir), mining.StopLists().func, min_freq=3)
    bench = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term")).distinct()
    # what a sidecar would ask for: each source's own words of the benchmark
    asked = pages(spark, sf_dir).select("book_key", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).distinct().join(bench, "term", "left_semi")
    return mining.lookup_counts(counts, asked).select("book_key", "term", "freq", "page_count")


def library_graph(spark, sf_dir):
    """GR03, PIPE08: the merged library: how many nodes and edges of each kind, and their weight."""
    nodes = _concepts(spark, sf_dir)
    books = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("book_key"), F.col("s_name").alias("title"), F.col("s_name").alias("path"), (F.col("s_suppkey") * 7).alias("pages"), F.lit("book").alias("prov"))
    edges = nodes.select(F.concat(F.lit("b:"), "book_key").alias("a"), F.col("id").alias("b"), F.lit("mentions").alias("rel"), "weight")
    merged, kept = graph.merge_graph(nodes, edges, books)
    left = merged.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight"))
    right = kept.filter("rel <> 'shares'").groupBy(F.col("rel").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight"))
    return left.unionByName(right)


def lookup_blocks(spark, sf_dir):
    """SE06, JN21: prompt texts of lookups (rows only: a fold over a bounded text)."""
    concepts = _concepts(spark, sf_dir).withColumn("id", F.concat(F.lit("n:"), T.concept_id(F.col("label"))))
    nodes = graph.merge_nodes(concepts)
    books = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("book_key"), F.col("s_name").alias("title"), F.col("s_name").alias("path"), F.lit("article").alias("prov"))
    part = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0")
    questions = part.select(F.col("p_partkey").alias("q_id"), F.concat(F.lit("What is the "), F.col("p_name"), F.lit(" about?")).alias("q"), (F.col("p_partkey") % 50).cast("string").alias("open_book"))
    hits = written(graph.graph_lookup(questions, nodes), "hits")
    shares = graph.share_candidates(concepts).select(F.concat(F.lit("b:"), "a").alias("a"), F.concat(F.lit("b:"), "b").alias("b"), F.col("sim").alias("weight"))
    return graph.lookup_block(hits, nodes, books, shares, questions.select("q_id", "open_book"))


def paragraphs_of_items(spark, sf_dir):
    """SRC03, LAY01-LAY04, LAY06, FN35, FN36, FN38, CLS09: words of documents set as pages of items, put
    together again as paragraphs with their kinds (rows only: geometry)."""
    rows = lines(spark, sf_dir).select("book_key", "page", "idx", F.posexplode(F.split("text", " ")).alias("n", "str")).filter("str <> ''")
    at = F.array(F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), 50.0 + F.col("n") * 45.0, 780.0 - F.col("idx") * 12.0 - F.when(F.col("idx") > 5, 30.0).otherwise(0.0))
    items = rows.select("book_key", "page", F.shiftleft(F.col("idx").cast("long"), 31).bitwiseOR(F.col("n").cast("long")).alias("item_no"), "str", at.alias("transform"), (F.length("str") * 5.0).alias("width"), F.lit(False).alias("has_eol"))
    views = rows.select("book_key", "page").distinct().withColumn("view", F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, -1.0, 0.0, 800.0)]))
    return layout.cluster_paragraphs(items, views)


def bylines(spark, sf_dir):
    """FN21, FN24, FN22: the names in author lines made of parts, whether a line reads as one, and the
    citations in whole documents (rows only: token machines)."""
    people = _people(spark, sf_dir).groupBy("book_key").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 4), "; ").alias("line"))
    people = people.withColumn("names", split_authors(F.col("line")))
    names = people.select("book_key", F.array_join("names", "|").alias("found"), seed.is_byline(F.col("line"), F.col("names")).alias("reads"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("book_key"), split_citations(F.col("text")).alias("runs"), "text")
    cited = docs.select("book_key", F.array_join(F.transform(F.filter("runs", lambda r: r["cite"]), lambda r: r["text"]), "|").alias("found"), (F.array_join(F.transform("runs", lambda r: r["text"]), "") == F.col("text")).alias("reads"))
    return names.unionByName(cited)


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_NORM = "trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_CAP = "upper(left({0}, 1)) || lower(substr({0}, 2))"
_W0, _W1 = "string_split(p_name, ' ')[1]", "string_split(p_name, ' ')[2]"
_ORDINARY = _list(dict.fromkeys((*ALL_LISTS.func, *ALL_LISTS.common, *ALL_LISTS.capital)))
_PEOPLE = f"""people_ AS (SELECT DISTINCT p_brand AS book_key, CASE WHEN p_size % 4 = 0 THEN {_CAP.format(_W1)} || ', A.' WHEN p_size % 4 = 1 THEN 'Ann ' || {_CAP.format(_W0)} || 'er Jr.' ELSE 'Bo ' || {_CAP.format(_W1)} || {_CAP.format(_W0)} END AS name FROM part WHERE p_size < 12),
named_ AS (SELECT *, CASE WHEN contains(name, ',') THEN string_split(name, ',')[1] ELSE string_split(name, ' ')[2] END AS sn, 'n:' || {_NORM.format('name')} AS author FROM people_),
able_ AS (SELECT *, len(regexp_extract_all(sn, '\\p{{L}}')) >= 3 AND lower(sn) NOT IN ({_ORDINARY}) AS usable, {_NORM.format('sn')} AS plain FROM named_)"""


def _id_sql(label: str) -> str:
    """A concept id of plain words, of which {0} is folded last."""
    words = f"string_split({_NORM.format(label)}, ' ')"
    return f"array_to_string(list_append({words}[1:len({words}) - 1], {_fold_sql(f'{words}[len({words})]')}), ' ')"


_KEYS = f"""keyed_ AS (SELECT book_key, author, unnest(list_distinct([plain, {_id_sql('sn')}])) AS key FROM able_ WHERE usable),
claims_ AS (SELECT book_key, key, min(author) AS author FROM keyed_ GROUP BY ALL HAVING count(DISTINCT author) = 1)"""
_FOUND = f"""found_ AS (SELECT p_brand AS book_key, p_partkey AS seq, CASE WHEN p_size % 5 = 0 THEN {_CAP.format(_W0)} || 'er' WHEN p_size % 5 = 1 THEN p_name || 's' ELSE p_name END AS label, p_size AS freq,
  [p_partkey % 30 + 1, p_size + 1] AS pages, CASE WHEN p_size % 7 > 0 THEN p_name || '/' || p_type END AS stat_key, CASE WHEN p_size % 6 = 0 THEN 'topic' END AS kind, CASE WHEN p_size % 4 = 0 THEN 'About ' || p_type END AS gloss FROM part),
met_ AS (SELECT f.*, coalesce(a.author, b.author, p.author, 'n:' || {_id_sql('label')}) AS id, coalesce(a.author, b.author, p.author) IS NOT NULL AS own,
    stat_key IS NULL OR row_number() OVER (PARTITION BY f.book_key, stat_key ORDER BY seq) = 1 AS fresh
  FROM (SELECT *, CASE WHEN NOT contains(label, ' ') AND regexp_matches(label, '^\\p{{Lu}}') THEN label END AS sn FROM found_) f
  LEFT JOIN claims_ a ON a.book_key = f.book_key AND a.key = {_id_sql('f.sn')} LEFT JOIN claims_ b ON b.book_key = f.book_key AND b.key = {_NORM.format('f.sn')}
  LEFT JOIN (SELECT DISTINCT book_key, author FROM named_) p ON p.book_key = f.book_key AND p.author = 'n:' || {_NORM.format('f.label')}),
sum_ AS (SELECT book_key, id, bool_or(own) AS own, min(seq) AS seq, arg_min(label, seq) AS label, CAST(sum(CASE WHEN fresh THEN freq ELSE 0 END) AS DOUBLE) AS weight, arg_max(kind, seq) FILTER (kind IS NOT NULL) AS kind,
  arg_min(gloss, seq) FILTER (gloss IS NOT NULL) AS gloss, list_sort(list_distinct(flatten(list(pages))))[1:8] AS pages FROM met_ GROUP BY book_key, id),
new_ AS (SELECT * FROM sum_ WHERE NOT own QUALIFY row_number() OVER (PARTITION BY book_key ORDER BY seq) <= 40),
nodes_ AS (SELECT book_key, id, coalesce(kind, 'term') AS kind, label, gloss, weight, array_to_string(pages, ',') AS pages FROM new_
  UNION ALL SELECT n.book_key, n.author, 'person', min(n.name), NULL, coalesce(any_value(s.weight), 0) + 1.0, coalesce(array_to_string(any_value(s.pages), ','), '') FROM named_ n LEFT JOIN sum_ s ON s.book_key = n.book_key AND s.id = n.author GROUP BY n.book_key, n.author)"""
_TOKENS = "list_filter(regexp_extract_all(coalesce(text, ''), '" + T.TOKEN.replace("'", "''") + "'), lambda w: regexp_matches(w, '^\\p{L}'))"
_STORE = """store_ AS (SELECT p_brand AS book_key, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line_no, p_partkey, p_size, p_name || ' ' || p_partkey AS term,
  CASE WHEN p_size % 10 = 9 THEN '# ' || p_name ELSE p_name || ' ' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ' = tr' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' :: cat :: Its definition.' ELSE '' END END AS line FROM part)"""
ORACLE = {
    "surnames": f"""WITH {_PEOPLE}, l AS (SELECT DISTINCT p_brand AS book_key, CASE WHEN p_size % 3 = 0 THEN {_CAP.format(_W0)} || ', R.' WHEN p_size % 3 = 1 THEN {_W0} ELSE {_CAP.format(_W0)} || ' ' || {_CAP.format(_W1)} END AS name FROM part)
SELECT book_key, name, sn AS surname, usable FROM able_ UNION ALL SELECT book_key, name, CASE WHEN contains(name, ',') THEN string_split(name, ',')[1] END, NULL FROM l""",
    "author_terms": f"WITH {_PEOPLE}, {_KEYS} SELECT book_key, key, author FROM claims_",
    "seed_concepts": f"WITH {_PEOPLE}, {_KEYS}, {_FOUND} SELECT * FROM nodes_",
    "seed_edges": f"""WITH {_PEOPLE}, {_KEYS}, {_FOUND}
SELECT book_key, 'b:' || book_key AS a, id AS b, 'mentions' AS rel, CAST(sum(freq) AS DOUBLE) AS weight FROM met_ SEMI JOIN nodes_ USING (book_key, id) WHERE fresh GROUP BY book_key, id
UNION ALL SELECT DISTINCT book_key, author, 'b:' || book_key, 'by', 1.0 FROM named_""",
    "deep_nodes": """WITH n AS (SELECT DISTINCT p_brand AS book_key, p_name AS label FROM part), t AS (SELECT *, length(book_key) % 2 = 0 AND contains(label, 'r') AS said FROM n)
SELECT book_key, label, CASE WHEN said THEN 'topic' ELSE 'term' END AS kind, CASE WHEN length(label) % 2 = 0 THEN 'Known.' WHEN said THEN 'A thing that is told of.' END AS gloss FROM t""",
    "shard_stages": "SELECT p_type AS book_key, CASE WHEN p_type = 'SMALL' OR bool_or(p_type = 'ECONOMY' AND p_size = 7) THEN 'deep' ELSE 'seed' END AS stage FROM part GROUP BY p_type",
    "store_strip": f"""WITH {_STORE} SELECT book_key, line_no, CASE WHEN p_partkey % 2 = 0 AND p_size % 10 <> 9 THEN replace(line, ':: cat :: Its definition.', ':: cat') ELSE line END AS line FROM store_ WHERE p_size % 10 = 9 OR p_partkey % 5 <> 0""",
    "unaliased_terms": """SELECT p_brand AS book_key, CASE WHEN p_size % 2 = 0 THEN 'Alias ' || p_type ELSE p_name END AS term, p_partkey AS rank FROM part p
WHERE p_size % 2 = 1 OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.p_size % 4 = 0)""",
    "saved_store": f"""WITH {_STORE}, s AS (SELECT book_key, term, p_size, p_partkey, p_size % 3 = 0 AS inc, p_size % 4 = 0 AS had FROM store_ WHERE p_size % 10 <> 9 OR p_size % 3 = 0)
SELECT book_key, term AS key, CASE WHEN inc THEN p_size + 5 WHEN had THEN p_size END AS freq, CASE WHEN had AND p_size % 8 = 0 THEN 'user' WHEN inc OR had THEN 'mined' END AS source,
  CASE WHEN inc OR had THEN array_to_string(list_sort(list_distinct(list_concat(CASE WHEN had THEN [3, 1] ELSE [] END, CASE WHEN inc AND p_size >= 1 THEN [p_size] ELSE [] END))), ',') END AS pages FROM s
UNION ALL SELECT p_brand, 'new ' || p_partkey, p_size + 5, 'mined', CASE WHEN p_size >= 1 THEN CAST(p_size AS VARCHAR) END FROM part WHERE p_size % 3 <> 0""",
    "domain_lines": """WITH g AS (SELECT p_brand, p_name, sum(p_size) AS f FROM part GROUP BY ALL), t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY f DESC, p_name) <= 10)
SELECT p_brand AS book_key, string_agg(p_name, ', ' ORDER BY f DESC, p_name) AS domain FROM t GROUP BY ALL""",
    "enriched_terms": """SELECT DISTINCT p_brand AS book_key, p_name AS term, CASE WHEN length(p_name) % 2 = 0 THEN 'own' WHEN length(p_name) % 3 > 0 THEN 'household goods' END AS category,
  CASE WHEN length(p_name) % 3 > 0 THEN 'It is a thing of daily use.' END AS definition, CASE WHEN length(p_name) % 3 > 0 THEN 'term' END AS kind FROM part""",
    "mined_counts": f"""{_COUNTED}, kept_ AS (SELECT * FROM counts_ WHERE freq >= 3),
bench_ AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM benchmark),
asked_ AS (SELECT DISTINCT book_key, unnest({_TOKENS}) AS term FROM pages_)
SELECT book_key, term, coalesce(freq, 0) AS freq, coalesce(page_count, 0) AS page_count FROM (SELECT * FROM asked_ SEMI JOIN bench_ USING (term)) a LEFT JOIN (SELECT book_key AS kb, key, freq, page_count FROM kept_) ON book_key IS NOT DISTINCT FROM kb AND lower(term) = key""",
    "mined_store": f"""WITH all_ AS ({ranked_sql(40, 3, 2).replace("FROM documents)", f"FROM documents WHERE text IS NULL OR {_MARKS} < 8)", 1)}),
first_ AS (SELECT * FROM all_ QUALIFY row_number() OVER (PARTITION BY book_key, {_NORM.format('term')} ORDER BY rank) = 1)
SELECT book_key, row_number() OVER (PARTITION BY book_key ORDER BY rank) AS line_no, term AS line, 'added' AS change FROM first_""",
    "library_graph": f"""WITH {_CONCEPTS} SELECT 'term' AS kind, count(DISTINCT id) AS n, round(sum(weight), 3) AS weight FROM concepts_
UNION ALL SELECT 'book', count(*), round(sum(greatest(0.5, least(6.0, s_suppkey * 7 / 100.0))), 3) FROM supplier
UNION ALL SELECT 'mentions', count(*), round(sum(w), 3) FROM (SELECT book_key, id, sum(weight) AS w FROM concepts_ GROUP BY ALL)""",
    "upserted_pages": "SELECT o_custkey AS book_key, o_orderkey AS page, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS tr FROM orders UNION ALL SELECT -1, -1, 'added'",
    "shard_round_trip": f"""WITH {_CONCEPTS}, k AS (SELECT *, {_id_sql('label')} AS cid FROM concepts_ WHERE book_key NOT IN ('1', '2') AND CAST(book_key AS INT) % 10 <> 3)
SELECT book_key, 'b:' || book_key AS a, 'n:' || cid AS b, 'mentions' AS rel, sum(weight) AS weight FROM k WHERE seq % 5 <> 0 GROUP BY book_key, cid""",
}

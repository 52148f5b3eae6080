"""The term store: line grammar, merging, sidecar, three-way merge, matching, duplicates.

A store is rows (book_key, line_no, line).  Records are (book_key, term, translation,
category, definition[, kind, aliases, pages, freq, source]); empty fields are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.operators.ordered import connected

# The line grammar.
COMMENT = f"^{T.WS}*#(?:{T.WS}|#|$)"
#: A field separator has white space on one side at least, so std::vector stays whole.
FIELD = "(?:[ \\t]+::[ \\t]*|::[ \\t]+)"
TRANSLATION = "^(.*?)[ \\t]*(?:=|->|→|—)[ \\t]*(.*)$"
KINDS = ("person", "org", "place", "work", "topic", "term")
SOURCES = ("mined", "user", "model", "graph")
MAX_PAGES, MAX_ALIASES = 8, 12
#: Terms up to which a list is sent to the texts.
LISTED = 64


def field(c: Column) -> Column:
    """Flattened text; null if it has neither letter nor digit."""
    c = T.flat(c)
    return F.when(c.rlike("[\\p{L}\\p{N}]"), c)


def parse_line(line: Column) -> Column:
    """struct(term, translation, category, definition); null for blank lines and comments."""
    parts = F.split(F.regexp_replace(line, FIELD, "\u0001"), "\u0001")
    head = F.try_element_at(parts, F.lit(1))
    paired = head.rlike(TRANSLATION)
    term = field(F.when(paired, F.regexp_extract(head, TRANSLATION, 1)).otherwise(head))
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), " :: ")
    record = F.struct(term.alias("term"), F.when(paired, field(F.regexp_extract(head, TRANSLATION, 2))).alias("translation"), field(F.try_element_at(parts, F.lit(2))).alias("category"), field(rest).alias("definition"))
    return F.when((F.trim(line) != "") & ~line.rlike(COMMENT) & term.isNotNull(), record)


def parse_glossary(lines: DataFrame) -> DataFrame:
    """Records of a store's live lines, with their line numbers."""
    return lines.select("book_key", "line_no", parse_line(F.col("line")).alias("r")).filter("r is not null").select("book_key", "line_no", "r.*")


def format_line() -> Column:
    """A record as a line; reading it back gives the record."""
    term = F.regexp_replace(T.flat(F.col("term")), "^(?:#+[ \\t]+|#+$)+", "")
    category = F.coalesce("category", F.lit(""))
    tail = F.when(F.col("definition").isNotNull(), F.concat(F.lit(" :: "), category, F.lit(" :: "), F.col("definition"))).when(category != "", F.concat(F.lit(" :: "), category)).otherwise("")
    return F.concat(term, F.when(F.col("translation").isNotNull(), F.concat(F.lit(" = "), F.col("translation"))).otherwise(""), tail)


def format_glossary(records: DataFrame) -> DataFrame:
    rows = records.select("book_key", "line_no", format_line().alias("line"))
    return rows.filter("line <> ''")


def merge_records(lines: DataFrame, incoming: DataFrame, fresh: bool = False) -> DataFrame:
    """(book_key, line_no, line, change): the store after incoming records (with ``seq``).

    Lines keep their place; empty fields are filled (change = updated), unknown terms are
    appended in order (added), terms commented out are not.  fresh drops the old lines.
    Merging the result again changes nothing.
    """
    lines = lines.limit(0) if fresh else lines
    live = parse_glossary(lines).withColumn("key", T.term_key(F.col("term")))
    first = F.row_number().over(Window.partitionBy("book_key", "key").orderBy("line_no"))
    owned = live.withColumn("r", first).filter("r = 1").drop("r")
    body = F.regexp_replace("line", "^[ \\t]*#+[ \\t]*", "")
    blocked = lines.filter(F.col("line").rlike(COMMENT)).select("book_key", T.term_key(parse_line(body)["term"]).alias("key")).filter("key is not null").distinct()
    new = incoming.withColumn("key", T.term_key(F.col("term"))).filter("key <> ''")
    # of several incoming records of a term each may fill what those before it left empty
    seq = F.col("seq")
    filled = new.groupBy("book_key", "key").agg(F.min_by("term", seq).alias("term"), F.min("seq").alias("seq"), *[F.min_by(field(F.col(c)), F.when(field(F.col(c)).isNotNull(), seq)).alias(c) for c in ("translation", "category", "definition")])
    both = owned.join(filled.select("book_key", "key", *[F.col(c).alias(f"new_{c}") for c in ("translation", "category", "definition")]), ["book_key", "key"])
    gains = F.lit(False)
    for c in ("translation", "category", "definition"):
        gains = gains | (F.col(c).isNull() & F.col(f"new_{c}").isNotNull())
    changed = both.filter(gains).select("book_key", "line_no", "term", *[F.coalesce(c, f"new_{c}").alias(c) for c in ("translation", "category", "definition")])
    changed = changed.select("book_key", "line_no", format_line().alias("updated"))
    kept = lines.join(changed, ["book_key", "line_no"], "left").select("book_key", F.col("line_no").cast("long").alias("line_no"), F.coalesce("updated", "line").alias("line"), F.when(F.col("updated").isNotNull(), "updated").otherwise("kept").alias("change"))
    added = filled.join(owned.select("book_key", "key"), ["book_key", "key"], "left_anti").join(blocked, ["book_key", "key"], "left_anti")
    last = lines.filter("trim(line) <> ''").groupBy("book_key").agg(F.max("line_no").alias("last"))
    order = F.row_number().over(Window.partitionBy("book_key").orderBy("seq"))
    added = added.withColumn("line", format_line()).filter("line <> ''").withColumn("n", order).join(last, "book_key", "left")
    tail = added.select("book_key", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long").alias("line_no"), "line", F.lit("added").alias("change"))
    # blank lines at the end make room for what is appended
    room = tail.select("book_key").distinct().join(last, "book_key", "left")
    blank = kept.join(room, "book_key", "left_semi").filter("trim(line) = ''").join(last, "book_key").filter(F.col("line_no") > F.col("last"))
    kept = kept.join(blank.select("book_key", "line_no"), ["book_key", "line_no"], "left_anti")
    return kept.unionByName(tail)


def clean_meta(kind: Column, aliases: Column, pages: Column, freq: Column, source: Column, own_key: Column) -> list[Column]:
    """Sidecar fields within their vocabularies: pages ascending and at most 8, aliases at most
    12, distinct by key and none of the term itself."""
    keyed = F.transform(F.filter(F.transform(aliases, field), lambda a: a.isNotNull()), lambda a: F.struct(T.term_key(a).alias("k"), a.alias("a")))
    firsts = F.filter(keyed, lambda x, i: (x["k"] != own_key) & (F.size(F.filter(F.slice(keyed, F.lit(1), i), lambda y: y["k"] == x["k"])) == 0))
    aliases = F.transform(F.slice(firsts, 1, MAX_ALIASES), lambda x: x["a"])
    pages = F.slice(F.array_sort(F.array_distinct(F.filter(pages, lambda p: p >= 1))), 1, MAX_PAGES)
    return [
        F.when(kind.isin(*KINDS), kind).alias("kind"), F.when(F.size(aliases) > 0, aliases).alias("aliases"), F.when(F.size(pages) > 0, pages).alias("pages"),
        F.when(freq >= 1, freq).alias("freq"), F.when(source.isin(*SOURCES), source).alias("source"),
    ]


SIDECAR = "struct<v:int,lang:string,target:string,terms:map<string,struct<kind:string,aliases:array<string>,pages:array<int>,freq:bigint,source:string>>>"


def parse_sidecar(raw: DataFrame) -> DataFrame:
    """(book_key, lang, target, key, kind, aliases, pages, freq, source) from (book_key, json);
    other versions and broken JSON give no rows."""
    rows = raw.select("book_key", F.from_json("json", SIDECAR).alias("m")).filter("m.v = 2")

    def tag(c: Column) -> Column:
        return F.when(F.trim(c).rlike("^[A-Za-z]{2,8}(?:-[A-Za-z0-9]{2,8})*$"), F.lower(F.trim(c))).otherwise("und")

    rows = rows.select("book_key", tag(F.col("m.lang")).alias("lang"), tag(F.col("m.target")).alias("target"), F.explode("m.terms").alias("k", "t"))
    rows = rows.withColumn("key", T.term_key(F.col("k"))).filter("key <> ''")
    return rows.select("book_key", "lang", "target", "key", *clean_meta(F.col("t.kind"), F.col("t.aliases"), F.col("t.pages"), F.col("t.freq"), F.col("t.source"), F.col("key")))


def format_sidecar(meta: DataFrame) -> DataFrame:
    """(book_key, json): a book's entries as one document, in key order."""
    entry = F.struct("kind", "aliases", "pages", "freq", "source")
    rows = meta.groupBy("book_key").agg(F.first("lang").alias("lang"), F.first("target").alias("target"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("key"), F.to_json(entry).alias("v"))))).alias("m"))
    terms = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.lit(":"), e["value"])), ",")
    return rows.select("book_key", F.concat(F.lit('{"v":2,"lang":"'), F.col("lang"), F.lit('","target":"'), F.col("target"), F.lit('","terms":{'), terms, F.lit("}}")).alias("json"))


def apply_meta(records: DataFrame, meta: DataFrame) -> DataFrame:
    """Records with the sidecar's fields where they have none of their own."""
    names = ("kind", "aliases", "pages", "freq", "source")
    m = meta.select(F.col("book_key").alias("mb"), F.col("key").alias("mk"), *[F.col(n).alias(f"m_{n}") for n in names])
    rows = records.withColumn("key", T.term_key(F.col("term"))).join(m, (F.col("book_key") == F.col("mb")) & (F.col("key") == F.col("mk")), "left")
    own = [F.coalesce(F.col(n) if n in records.columns else F.lit(None), F.col(f"m_{n}")).alias(n) for n in names]
    return rows.select(*[c for c in records.columns if c not in names], *own)


def build_sidecar(records: DataFrame, previous: DataFrame) -> DataFrame:
    """(book_key, key, kind, aliases, pages, freq, source): sets united, counts maximal, a user's
    own line stays the user's; entries without a record go."""
    old = previous.select("book_key", "key", *[F.col(n).alias(f"o_{n}") for n in ("kind", "aliases", "pages", "freq", "source")])
    rows = records.withColumn("key", T.term_key(F.col("term"))).join(old, ["book_key", "key"], "left")
    none_s, none_i = F.array().cast("array<string>"), F.array().cast("array<int>")
    aliases = F.concat(F.coalesce("o_aliases", none_s), F.coalesce("aliases", none_s))
    pages = F.concat(F.coalesce("o_pages", none_i), F.coalesce(F.col("pages").cast("array<int>"), none_i))
    source = F.when(F.col("o_source") == "user", "user").otherwise(F.coalesce("source", "o_source"))
    return rows.select("book_key", "key", *clean_meta(F.coalesce("kind", "o_kind"), aliases, pages, F.greatest("o_freq", "freq"), source, F.col("key")))


def merge3(base: DataFrame, mine: DataFrame, disk: DataFrame) -> DataFrame:
    """Records of disk that mine has too or base never had (what I removed stays removed),
    then mine's own.  Records come as (book_key, seq, term, line)."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("key", T.term_key(F.col("term")))

    b, m, d = keyed(base), keyed(mine), keyed(disk)
    flags = d.join(m.select("book_key", "key").distinct().withColumn("in_mine", F.lit(True)), ["book_key", "key"], "left")
    flags = flags.join(b.select("book_key", "key").distinct().withColumn("in_base", F.lit(True)), ["book_key", "key"], "left")
    theirs = flags.filter("in_mine is not null or in_base is null")
    edited = theirs.join(m.select("book_key", "key", F.col("line").alias("my_line")), ["book_key", "key"], "left")
    edited = edited.select("book_key", F.lit(0).alias("side"), "seq", "key", F.coalesce("my_line", "line").alias("line"))
    own = m.join(d.select("book_key", "key"), ["book_key", "key"], "left_anti").select("book_key", F.lit(1).alias("side"), "seq", "key", "line")
    return edited.unionByName(own)


_WORD = "[\\p{L}\\p{N}_]+"


def _patterned(glossary: DataFrame) -> DataFrame:
    """The glossary's rows with their terms' ``first`` words and ``pattern``; terms without a word are none."""
    edge = "[\\p{L}\\p{N}_]"
    term = F.lower("term")
    quoted = F.concat(F.lit("\\Q"), term, F.lit("\\E"))
    pattern = F.concat(F.when(term.rlike(f"^{edge}"), "(?:^|[^\\p{L}\\p{N}_])").otherwise(""), quoted, F.when(term.rlike(f"{edge}$"), "(?:$|[^\\p{L}\\p{N}_])").otherwise(""))
    return glossary.withColumn("first", F.lower(F.regexp_extract("term", _WORD, 0))).filter("first <> ''").withColumn("pattern", pattern)


def _found() -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lower))


def _hit(row: Row) -> Column:
    """Whether a text, with its distinct ``words`` and in lower case (``low``), has a row's term."""
    return F.array_contains("words", F.lit(row["first"])) & F.col("low").rlike(row["pattern"])


def match_glossary(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(text_id, term): terms that occur in a text as words (edges count where the term's own
    edge is a word character), case-blind.

    Texts and terms are tested by a term's first word against a text's distinct words, and the
    exact test runs on those that have it.  A list of up to LISTED terms goes to the texts, which
    are neither repeated for each word nor moved; with a longer one the words alone meet the terms, and
    texts come to their hits.  A term whose first word is glued to others in the text shares no
    token with it and cannot match by the definition.
    """
    g = _patterned(glossary.select("term").distinct())
    if len(listed := g.limit(LISTED + 1).collect()) <= LISTED:
        rows = texts.select("text_id", F.lower("text").alias("low"), _found().alias("words"))
        hits = [F.when(_hit(r), F.lit(r["term"])) for r in listed]
        none = F.array().cast("array<string>")
        return rows.select("text_id", F.explode(F.array_compact(F.array(*hits)) if hits else none).alias("term")).distinct()
    named = texts.select("text_id", "text", F.xxhash64("text").alias("digest"))
    met = named.select("text_id", "digest", F.explode(_found()).alias("first")).join(g, "first").select("text_id", "digest", "term", "pattern").distinct()
    return met.join(named, ["text_id", "digest"]).filter(F.regexp_like(F.lower("text"), F.col("pattern"))).select("text_id", "term").distinct()


def build_prompts(texts: DataFrame, glossary: DataFrame, target: str, context: Column | None = None) -> DataFrame:
    """(text_id, prompt): terms that matter, context, then the text.  glossary: (term, translation, seq).

    Terms of a list of up to LISTED are put in where the text is: no text is read twice, and
    neither texts nor hits meet in a join.
    """
    g = _patterned(glossary.select("term", "seq", F.concat_ws(" = ", "term", "translation").alias("l")))
    if len(listed := g.limit(LISTED + 1).collect()) <= LISTED:
        listed.sort(key=lambda r: (r["seq"] is not None, r["seq"], r["l"].encode()))
        rows = texts.withColumn("low", F.lower("text")).withColumn("words", _found())
        hits = F.array_compact(F.array(*[F.when(_hit(r), F.lit(r["l"])) for r in listed])) if listed else F.array().cast("array<string>")
        rows = rows.withColumn("terms", F.array_join(F.when(F.size(hits) > 0, hits), "\n"))
    else:
        hits = match_glossary(texts, glossary).join(glossary.select("term", "translation", "seq"), "term")
        terms = hits.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" = ", "term", "translation").alias("l")))), lambda x: x["l"]), "\n").alias("terms"))
        rows = texts.join(terms, "text_id", "left")
    block = F.when(F.col("terms").isNotNull(), F.concat(F.lit("Use these translations:\n"), F.col("terms"), F.lit("\n\n"))).otherwise("")
    ask = F.lit(f"Translate the following segment into {target}, without additional explanation.\n\n")
    return rows.select("text_id", F.concat(block, F.concat(context, F.lit("\n\n")) if context is not None else F.lit(""), ask, F.col("text")).alias("prompt"))


def duplicate_pairs(records: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(book_key, a, b, sim): terms of a bigram similarity of at least ``threshold``; terms of one
    concept id are paired with the first of them.

    Terms that similar share a rare bigram: of a term's bigrams in order of rarity only the
    first (1 - t/(2-t)) share need be joined, so frequent bigrams never make pairs.
    """
    rows = records.select("book_key", "term").distinct().withColumn("norm", T.out_norm(F.col("term"))).withColumn("cid", T.concept_id(F.col("term")))
    # terms of one concept are each paired with the first of them
    first = rows.filter("cid <> ''").groupBy("book_key", "cid").agg(F.min("term").alias("a"))
    same = rows.join(first, ["book_key", "cid"]).filter("term > a").select("book_key", "a", F.col("term").alias("b"), F.lit(1.0).alias("sim"))
    grams = rows.withColumn("grams", T.bigrams(F.col("norm")))
    # bigrams are numbered within equals, so multisets become sets
    each = grams.select("book_key", "term", "norm", F.posexplode("grams").alias("i", "g"))
    numbered = each.withColumn("k", F.row_number().over(Window.partitionBy("book_key", "term", "g").orderBy("i")))
    often = numbered.groupBy("book_key", "g", "k").agg(F.count(F.lit(1)).alias("df"))
    ranked = numbered.join(often, ["book_key", "g", "k"])
    size = F.count(F.lit(1)).over(Window.partitionBy("book_key", "term"))
    place = F.row_number().over(Window.partitionBy("book_key", "term").orderBy("df", "g", "k"))
    least = threshold / (2 - threshold)  # Dice t is Jaccard t / (2 - t); a partner has at least that share of the size
    prefix = ranked.withColumn("size", size).withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1)
    held = prefix.select("book_key", "g", "k", "term", "norm")
    pairs = held.alias("x").join(held.alias("y"), ["book_key", "g", "k"]).filter("x.term < y.term").select("book_key", F.col("x.term").alias("a"), F.col("y.term").alias("b"), F.col("x.norm").alias("na"), F.col("y.norm").alias("nb")).distinct()
    near = pairs.withColumn("sim", T.dice(F.col("na"), F.col("nb"))).filter(F.col("sim") >= threshold).select("book_key", "a", "b", "sim")
    return same.unionByName(near).groupBy("book_key", "a", "b").agg(F.max("sim").alias("sim"))


def cluster_duplicates(records: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(book_key, term, cluster): terms joined by duplicate pairs; cluster is the smallest term."""
    found = connected(duplicate_pairs(records, threshold), "book_key")
    return found.select("book_key", F.col("node").alias("term"), F.col("least").alias("cluster"))


def fold_duplicates(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """Records with each cluster as one: the user's line or the most frequent term leads; the
    others become aliases, counts add up, pages unite."""
    rows = records.join(clusters, ["book_key", "term"], "left").withColumn("cluster", F.coalesce("cluster", "term"))
    lead = F.struct((F.col("source") != "user").cast("int"), -F.col("freq"), F.col("term"))
    out = rows.groupBy("book_key", "cluster").agg(F.min_by("term", lead).alias("term"), F.sum("freq").alias("freq"), F.array_sort(F.collect_set("term")).alias("terms"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))), 1, MAX_PAGES).alias("pages"))
    return out.select("book_key", "term", "freq", F.slice(F.array_remove("terms", F.col("term")), 1, MAX_ALIASES).alias("aliases"), "pages")


def ask_in_batches(records: DataFrame, model: Callable[[list[str]], list[str]], size: int = 12) -> DataFrame:
    """(book_key, term, reply): a model's replies to batches of terms; it is called on executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            replies: list[str] = []
            for at in range(0, len(df), size):
                replies += model(df["term"].iloc[at : at + size].tolist())
            yield df.assign(reply=replies)

    return records.select("book_key", "term").mapInPandas(run, "book_key string, term string, reply string")

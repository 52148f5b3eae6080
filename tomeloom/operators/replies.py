"""Reading a model's replies: gates that refuse them, field cleaners, and line parsers.

A reply is text in lines of fields; what it says of a term is joined to what was asked by
concept id.  A field that fails its gate is null, the rest of the line stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.operators.metadata import tags
from tomeloom.operators.mining import StopLists

# The format that prompts ask for, and its limits.
SEP = "::"
KINDS = ("person", "org", "place", "work", "topic", "term")
NAMING = ("person", "org", "place", "work")
GLOSS_CHARS, DEFINITION_CHARS, CATEGORY_CHARS, CATEGORY_WORDS, SUMMARY_CHARS, HEAD_TAGS = 160, 200, 48, 4, 400, 8
YES, NO = ("да", "yes", "верно", "true"), ("нет", "no", "неверно", "false")
TAG_HEADS, SUMMARY_HEADS = ("ТЕМЫ", "ТЕМА", "TOPICS", "TAGS"), ("СВОДКА", "ИТОГ", "SUMMARY")

CJK = "[぀-ヿ一-鿿]"
QUOTED = "^[«\"“'‘]+(.+?)[»\"”'’]+$"
BULLET = r"^\s*(?:[-*•]\s+|[0-9]{1,2}[.)]\s+)"
SENTENCE_END = r"[.!?](?:\s|$)"


def alphabet_ok(c: Column, lang: str) -> Column:
    """Some letter of the reader's alphabet, and at most one character in twenty is CJK."""
    cjk = F.length(c) - F.length(F.regexp_replace(c, CJK, ""))
    return (c != "") & (cjk * 20 <= F.length(c)) & c.rlike("[А-Яа-яЁё]" if lang == "ru" else "[A-Za-z]")


def reply_rejected(raw: Column, items: int, per_item: int, lang: str, needs_sep: bool = True, echoes: Sequence[str] = ()) -> Column:
    """Nothing, a runaway, the prompt given back (``echoes``), no separator, or the wrong alphabet."""
    c = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", ""))
    bad = (c == "") | (F.length(c) > 400 + items * per_item) | ~alphabet_ok(c, lang)
    for e in echoes:
        bad = bad | c.contains(e)
    return bad | ~c.contains(SEP) if needs_sep else bad


def _unquoted(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(c, QUOTED, 1)), F.lit("")), c)


def _says(c: Column, term: Column) -> Column:
    """Something other than the term itself, without the lines' own separator."""
    return ~c.contains(SEP) & c.rlike(r"[\p{L}\p{N}]") & (T.concept_id(c) != T.concept_id(term))


def _sentence(raw: Column) -> Column:
    """The first sentence, without quotes around and dashes before (full stops up to character 20 end none)."""
    g = F.trim(F.regexp_replace(_unquoted(T.flat(raw)), "^[-–—:•* ]+", ""))
    stop = F.regexp_instr(g, F.lit(SENTENCE_END))
    return F.trim(F.when(stop > 21, F.substring(g, F.lit(1), stop)).otherwise(g))


def clean_gloss(raw: Column, term: Column, lang: str) -> Column:
    """A gloss of one line and sentence, or null."""
    g = _sentence(F.split(raw, "\n")[0])
    return F.when((g != "") & (F.length(g) <= GLOSS_CHARS) & alphabet_ok(g, lang) & _says(g, term), g)


def clean_definition(raw: Column, term: Column, lang: str, sample: Column | None = None) -> Column:
    """A definition of one sentence, or null; one that only quotes the sample is none."""
    g = _sentence(raw)
    good = (g != "") & (F.length(g) <= DEFINITION_CHARS) & alphabet_ok(g, lang) & _says(g, term)
    if sample is not None:
        good = good & ~F.coalesce(F.contains(F.lower(sample), F.lower(g)), F.lit(False))
    return F.when(good, g)


def clean_category(raw: Column, term: Column, lang: str) -> Column:
    """A short noun phrase that is no kind word, or null."""
    c = F.trim(F.regexp_replace(F.regexp_replace(T.flat(raw), "^[-–—:•* ]+", ""), "[.!?;]$", ""))
    short = (c != "") & (F.length(c) <= CATEGORY_CHARS) & (F.size(F.split(c, " ")) <= CATEGORY_WORDS)
    return F.when(short & ~F.lower(c).isin(*KINDS) & alphabet_ok(c, lang) & _says(c, term), c)


def clean_translation(raw: Column, term: Column) -> Column:
    """The first line without quotes around and without a full stop that the term has not."""
    line = T.flat(F.split(F.regexp_replace(raw, r"^\s+", ""), "\n")[0])
    t = F.trim(F.regexp_replace(_unquoted(line), "。$", ""))
    return F.when(term.endswith("."), t).otherwise(F.trim(F.regexp_replace(t, r"\.$", "")))


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def plausible(tr: Column, term: Column) -> Column:
    """A term's translation is a term: few words more, and not far longer."""
    return (tr != "") & (_words(tr) <= _words(term) * 2 + 2) & (F.length(tr) <= F.greatest(F.lit(60), F.length(term) * 4))


def junky(tr: Column, term: Column, sample: Column) -> Column:
    """A question mark, no letter or digit, or a stretch of the sample rather than the term."""
    low = F.lower(tr)
    quotes = (F.length(tr) > F.length(term) + 4) & (low != F.lower(term)) & F.coalesce(F.contains(F.lower(sample), low), F.lit(False))
    return (tr == "") | tr.contains("?") | ~tr.rlike("[A-Za-zА-Яа-яЁё0-9]") | quotes


def keep_as_is(term: Column) -> Column:
    """Acronyms and symbols: capitals, digits and joiners alone."""
    return term.rlike("^[A-Z0-9][A-Z0-9.+/&-]*$") & term.rlike("[A-Z]")


def last_quoted(raw: Column) -> Column:
    """The last stretch in quotes, or all of it."""
    found = F.regexp_extract_all(raw, F.lit("[«\"“]([^«»\"“”]+)[»\"”]"), F.lit(1))
    return F.coalesce(F.nullif(F.trim(F.try_element_at(found, F.lit(-1))), F.lit("")), raw)


def verdict(c: Column) -> Column:
    """True, false or (no verdict at the head) null."""

    def heads(words: Sequence[str]) -> Column:
        return c.rlike(rf"(?iu)^(?:{'|'.join(words)})(?!\p{{L}})")

    return F.when(heads(YES), True).when(heads(NO), False)


def name_shaped(label: Column, stop: StopLists) -> Column:
    """Whether some word begins with a capital, is no acronym and no ordinary word."""

    def named(word: Column) -> Column:
        w = F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        return w.rlike(r"^\p{Lu}") & (w != F.upper(w)) & ~F.lower(w).isin(*stop.func, *stop.common, *stop.capital)

    return F.exists(F.split(T.flat(label), " "), named)


def guarded_kind(kind: Column, label: Column, stop: StopLists) -> Column:
    """The kind that a label may have: names alone are persons, bodies or places; works become topics."""
    named = name_shaped(label, stop)
    return F.when(~kind.isin(*NAMING), kind).when(~named, "term").when(kind == "work", "topic").otherwise(kind)


def _lines(asked: DataFrame, replies: DataFrame, usable: Column | None = None) -> DataFrame:
    """asked with ``p``, the fields of the first reply line about its term; of the terms asked
    under one concept id the first in order has it.

    replies: (book_key, reply).  Terms that nobody asked about fall out by the join.
    """
    rows = replies.select("book_key", F.posexplode(F.split("reply", "\r?\n")).alias("no", "line"))
    fields = F.split(F.trim(F.regexp_replace("line", BULLET, "")), rf"\s*{SEP}\s*")
    rows = rows.select("book_key", "no", fields.alias("p")).filter(F.size("p") >= 2).withColumn("cid", T.concept_id(F.col("p")[0])).filter("cid <> ''")
    if usable is not None:
        rows = rows.filter(usable)
    rows = rows.groupBy("book_key", "cid").agg(F.min_by("p", "no").alias("p"))
    first = F.row_number().over(Window.partitionBy("book_key", "cid").orderBy("term"))
    asked = asked.withColumn("cid", T.concept_id(F.col("term"))).withColumn("_first", first).filter("_first = 1")
    return asked.join(rows, ["book_key", "cid"]).drop("cid", "_first")


def _rest(start: int) -> Column:
    return F.array_join(F.slice("p", start, F.greatest(F.lit(0), F.size("p") - start + 1)), f" {SEP} ")


def parse_typed(asked: DataFrame, replies: DataFrame, lang: str, stop: StopLists | None = None) -> DataFrame:
    """(book_key, term, kind, gloss) from lines "term :: kind :: gloss" about terms asked
    (book_key, term); an unknown kind is ``term``, and the guard is held against the label asked."""
    rows = _lines(asked.select("book_key", "term"), replies)
    kind = F.lower(T.flat(F.col("p")[1]))
    kind = guarded_kind(F.when(kind.isin(*KINDS), kind).otherwise("term"), F.col("term"), stop or StopLists())
    return rows.select("book_key", "term", kind.alias("kind"), F.when(F.size("p") > 2, clean_gloss(_rest(3), F.col("term"), lang)).alias("gloss"))


def parse_enriched(asked: DataFrame, replies: DataFrame, lang: str, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(book_key, term, kind, category, definition) from lines "term [:: kind] :: category :: definition"
    about terms asked (book_key, term, sample); a lone field is a category if it looks like one."""
    rows = _lines(asked.select("book_key", "term", "sample"), replies)
    kind = F.lower(T.flat(F.col("p")[1]))
    rows = rows.withColumn("kind", F.when(kind.isin(*kinds), kind))
    rows = rows.withColumn("p", F.when(F.col("kind").isNotNull(), F.slice("p", 3, F.greatest(F.lit(0), F.size("p") - 2))).otherwise(F.slice("p", 2, F.size("p") - 1)))
    lone = T.flat(F.try_element_at("p", F.lit(1)))
    brief = (F.length(lone) <= CATEGORY_CHARS) & (F.size(F.split(lone, " ")) <= CATEGORY_WORDS) & ~lone.rlike("[.!?;]$")
    category = F.when((F.size("p") >= 2) | brief, F.try_element_at("p", F.lit(1)))
    definition = F.when(F.size("p") >= 2, _rest(2)).when(~brief, F.try_element_at("p", F.lit(1)))
    term = F.col("term")
    return rows.select("book_key", "term", "kind", clean_category(category, term, lang).alias("category"), clean_definition(definition, term, lang, F.col("sample")).alias("definition"))


def parse_verdicts(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """(book_key, term, verdict) from lines "term :: yes|no"; lines without a verdict do not count."""
    rows = _lines(asked.select("book_key", "term"), replies, verdict(F.array_join(F.slice("p", 2, F.size("p") - 1), " ")).isNotNull())
    return rows.select("book_key", "term", verdict(F.array_join(F.slice("p", 2, F.size("p") - 1), " ")).alias("verdict"))


def parse_duplicates(clusters: DataFrame, replies: DataFrame) -> DataFrame:
    """(book_key, cluster, lead) from replies (book_key, cluster, reply) "yes :: spelling" or "no".

    The first line with a verdict counts.  lead is null for no verdict or "no", the spelling
    picked if it is one of the cluster's terms, else its first term.  clusters: (book_key, cluster, term).
    """
    rows = replies.select("book_key", "cluster", F.posexplode(F.split("reply", "\r?\n")).alias("no", "line")).withColumn("line", F.trim(F.regexp_replace("line", BULLET, "")))
    rows = rows.withColumn("said", verdict(F.col("line"))).filter("said is not null")
    fields = F.split("line", rf"\s*{SEP}\s*")
    pick = F.when(F.size(fields) > 1, T.concept_id(F.array_join(F.slice(fields, 2, F.size(fields) - 1), f" {SEP} ")))
    rows = rows.withColumn("pick", pick).groupBy("book_key", "cluster").agg(F.min_by(F.struct("said", "pick"), "no").alias("v"))
    named = clusters.join(rows, ["book_key", "cluster"], "left").withColumn("picked", T.concept_id(F.col("term")) == F.col("v.pick"))
    out = named.groupBy("book_key", "cluster").agg(F.bool_or("v.said").alias("said"), F.min(F.when(F.col("picked"), F.col("term"))).alias("picked"), F.min("term").alias("first"))
    return out.select("book_key", "cluster", F.when(F.col("said"), F.coalesce("picked", "first")).alias("lead"))


def head_tags(reply: Column) -> Column:
    """The tags of a reply's first topics line."""
    return tags(F.regexp_extract(reply, rf"(?imu)^[ \t]*(?:{'|'.join(TAG_HEADS)})[ \t]*[:：][ \t]*(.+)$", 1), HEAD_TAGS)


def head_summary(reply: Column, lang: str) -> Column:
    """The summary of a reply, up to an empty line; null if under four words or over 400 characters."""
    s = T.flat(F.regexp_extract(reply, rf"(?imu)^[ \t]*(?:{'|'.join(SUMMARY_HEADS)})[ \t]*[:：][ \t]*([\s\S]+?)(?:\n\s*\n|\z)", 1))
    return F.when((F.length(s) <= SUMMARY_CHARS) & (F.size(F.split(s, " ")) >= 4) & alphabet_ok(s, lang), s)

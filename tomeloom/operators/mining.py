"""Term mining: n-gram counts, the derived stoplist, C-value ranking, conjunction split.

A book's pages go in as rows (book_key, page, text); no page is ever held with others.
Counting explodes each page into its valid n-grams and aggregates them with map-side
combining; what follows works on counts, which are far smaller than the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.functions import words as W
from tomeloom.sources.tables import written

MAX_N = 4
MAX_KEY = 64
MAX_PAGES = 8
#: Keys up to which they are sent to all tasks.
SENT = 50_000


@dataclass(frozen=True)
class StopLists:
    """func: no term begins or ends on one.  common: no capitalised word of these is a name.
    capital: nouns that running text writes with a capital anyway."""

    func: tuple[str, ...] = field(default=tuple(W.ENGLISH_FUNCTION))
    common: tuple[str, ...] = field(default=tuple(W.ENGLISH_COMMON))
    capital: tuple[str, ...] = field(default=tuple(W.ENGLISH_CAPITAL))

    @classmethod
    def for_language(cls, lang: str) -> StopLists:
        """English alone for English, with Russian for all others (a word of any list is worth
        nothing at a term's edge in any language)."""
        if lang == "en":
            return cls()
        func = (*W.RUSSIAN_FUNCTION, *W.RUSSIAN_QUESTION_FUNCTION, *W.RUSSIAN_INFLECTED_FUNCTION, *W.ENGLISH_FUNCTION)
        return cls(tuple(dict.fromkeys(func)), tuple(dict.fromkeys((*W.RUSSIAN_COMMON, *W.ENGLISH_COMMON))), (*W.RUSSIAN_CAPITAL, *W.ENGLISH_CAPITAL))


ALL_LISTS = StopLists.for_language("und")


def _edge(w: Column, func: Sequence[str]) -> Column:
    return (F.length(w) >= 2) & ~w.isin(*func)


def grams(pages: DataFrame, func: Sequence[str], cased: bool = False) -> DataFrame:
    """One row per counted n-gram: book_key, page, s (sentence), c (clause), a (token), n, key,
    surface (null where it is the key), inner (not at the sentence's start), capital (it opens on
    one), prose (the sentence reads as prose).  With ``cased``, only those that have a surface of their own."""
    rows = pages.select("book_key", "page", F.posexplode(T.sentences(F.col("text"))).alias("s", "raw"))
    rows = rows.select("book_key", "page", "s", T.is_prose(F.col("raw")).alias("prose"), F.posexplode(T.clauses(F.col("raw"))).alias("c", "toks"))
    rows = rows.withColumn("low", F.transform("toks", F.lower))
    if cased:
        rows = rows.filter(F.col("toks") != F.col("low"))
    # a token's row has the tokens after it, not the clause: clauses have thousands of tokens at times
    names = [f"{c}{i}" for c in "wt" for i in range(MAX_N)]
    shifted = [F.slice(c, i + 1, F.size("toks")) if i else F.col(c) for c in ("low", "toks") for i in range(MAX_N)]
    rows = rows.select("book_key", "page", "s", "c", "prose", F.posexplode(F.arrays_zip(*[x.alias(n) for x, n in zip(shifted, names, strict=True)])).alias("a", "z"))
    rows = rows.select("book_key", "page", "s", "c", "prose", "a", *[F.col("z").getField(n).alias(n) for n in names])
    # a first word that may not open a term is dropped before any n-gram is made
    rows = rows.filter(_edge(F.col("w0"), func))
    low = [F.col(f"w{i}") for i in range(MAX_N)]
    rows = rows.withColumn("capital", T.is_capital(F.col("t0")))
    differs = [~F.col(f"t{i}").eqNullSafe(F.col(f"w{i}")) for i in range(MAX_N)]
    if cased:
        rows = rows.filter(reduce(Column.__or__, differs))
    made = []
    for n in range(1, MAX_N + 1):
        inner = F.lit(True)
        for w in low[1 : n - 1]:
            inner = inner & (F.length(w) >= 2)
        last = low[n - 1].isNotNull() & inner & (_edge(low[n - 1], func) if n > 1 else F.lit(True))
        own = reduce(Column.__or__, differs[:n])
        surface = F.when(own, F.concat_ws(" ", *[f"t{i}" for i in range(n)]))
        made.append(F.when(last & own if cased else last, F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *low[:n]).alias("key"), surface.alias("surface"))))
    rows = rows.select("book_key", "page", "s", "c", "a", "prose", "capital", F.explode(F.array(*made)).alias("g")).filter("g is not null")
    rows = rows.select("book_key", "page", "s", "c", "a", "g.n", "g.key", "g.surface", ((F.col("c") + F.col("a")) > 0).alias("inner"), "capital", "prose")
    return rows.filter(F.length("key") <= MAX_KEY)


def _spot() -> Column:
    """A place on a page as one number that sorts: sentence, clause (16 bits), token (24 bits).

    A clause of 16 million tokens or a sentence of 65,536 clauses would count as its last.
    """
    c, a = F.least("c", F.lit((1 << 16) - 1)), F.least("a", F.lit((1 << 24) - 1))
    return F.shiftleft(F.col("s").cast("long"), 40).bitwiseOR(F.shiftleft(c.cast("long"), 24)).bitwiseOR(a.cast("long"))


def _place() -> Column:
    """A place in a book, which sorts."""
    return F.struct(F.col("page").cast("long").alias("page"), F.col("spot"))


def _before(place: str) -> Column:
    """What is greater the earlier the place."""
    return F.struct(*[(-F.col(f"{place}.{part}")).alias(part) for part in ("page", "spot")])


def gram_counts(pages: DataFrame, func: Sequence[str], min_freq: int = 1) -> DataFrame:
    """One row per (book_key, key) that occurs min_freq times: n, freq, page_count, non_init,
    cap_non_init, display, first_seen.

    Text is dealt by page before it is taken apart, so a page's occurrences meet where they are
    made, and what tasks exchange is a row for each of their own n-grams, not for each page's.
    First pass: numbers only, so aggregates hash and combine on the map side.  Second pass, for
    keys that reach min_freq: occurrences not in plain lower case, which decide the shown form.
    The keys between are a written table.
    """
    pages = pages.repartition("page")
    found = grams(pages, func).withColumn("spot", _spot())
    cased = F.col("surface").isNotNull()
    paged = found.groupBy("book_key", "key", "n", "page").agg(
        F.count(F.lit(1)).alias("freq"), F.count_if("inner").alias("non_init"), F.count_if(F.col("inner") & F.col("capital")).alias("cap_non_init"), F.count_if(F.col("inner") & cased).alias("cased"), F.min("spot").alias("spot")
    )
    keys = paged.groupBy("book_key", "key", "n").agg(
        *[F.sum(c).alias(c) for c in ("freq", "non_init", "cap_non_init", "cased")],
        F.min(F.col("page").cast("long")).alias("page"), F.min_by("spot", "page").alias("spot"), F.count(F.lit(1)).alias("page_count"),
    )
    keys = keys.withColumn("first_seen", _place()).drop("page", "spot")
    keys = written(keys.filter(F.col("freq") >= min_freq), "keys")
    forms = grams(pages, func, cased=True).withColumn("spot", _spot())
    forms = forms.groupBy("book_key", "key", "surface", "page").agg(F.count_if("inner").alias("f"), F.min("spot").alias("spot"), F.min(F.when(F.col("inner"), F.col("spot"))).alias("inner_spot"))
    page = F.col("page").cast("long")
    inner_page = F.when(F.col("inner_spot").isNotNull(), page)
    forms = forms.groupBy("book_key", "key", "surface").agg(F.sum("f").alias("f"), F.min(page).alias("page"), F.min_by("spot", page).alias("spot"), F.min(inner_page).alias("inner_page"), F.min_by("inner_spot", inner_page).alias("inner_spot"))
    inner_place = F.when(F.col("inner_page").isNotNull(), F.struct(F.col("inner_page").alias("page"), F.col("inner_spot").alias("spot")))
    forms = forms.select("book_key", "key", "surface", "f", _place().alias("place"), inner_place.alias("inner_place"))
    forms = forms.join(keys.select("book_key", "key"), ["book_key", "key"], "left_semi")
    shown = forms.groupBy("book_key", "key").agg(
        F.min(F.struct("place", "surface")).alias("first"),
        F.max(F.when(F.col("f") > 0, F.struct(F.col("f"), _before("inner_place"), F.col("surface").alias("surface")))).alias("best"),
    )
    first = F.when(F.col("first.place") == F.col("first_seen"), F.col("first.surface"))
    best = F.when(F.col("best.f") > F.col("non_init") - F.col("cased"), F.col("best.surface"))
    display = F.coalesce(F.when(F.col("non_init") == 0, first).otherwise(best), F.col("key"))
    out = keys.join(shown, ["book_key", "key"], "left").withColumn("display", display)
    return out.select("book_key", "key", "n", "freq", "page_count", "non_init", "cap_non_init", "display", "first_seen")


def _of_keys(found: DataFrame, only: DataFrame) -> DataFrame:
    """n-grams whose (book_key, key) is in only; up to SENT keys are sent to all tasks, so that other n-grams go nowhere."""
    only = only.select("book_key", "key").distinct()
    return found.join(F.broadcast(only) if only.limit(SENT + 1).count() <= SENT else only, ["book_key", "key"], "left_semi")


def samples(pages: DataFrame, func: Sequence[str], only: DataFrame) -> DataFrame:
    """(book_key, key, sample): the first prose sentence of each key, else the first at all.

    Places are chosen first, as numbers, which aggregates hash; sentences are read of the pages chosen alone.
    """
    found = _of_keys(grams(pages, func), only).withColumn("spot", _spot()).withColumn("rank", F.when(F.col("prose"), 0).otherwise(1))
    paged = found.groupBy("book_key", "key", "rank", "page").agg(F.min("spot").alias("spot"))
    ranked = paged.groupBy("book_key", "key", "rank").agg(F.min("page").alias("page"), F.min_by("spot", "page").alias("spot"))
    chosen = ranked.groupBy("book_key", "key").agg(F.min_by("page", "rank").alias("page"), F.min_by("spot", "rank").alias("spot"))
    chosen = written(chosen.select("book_key", "key", "page", F.shiftright("spot", 40).cast("int").alias("s")), "chosen")
    read = pages.join(chosen.select("book_key", "page").distinct(), ["book_key", "page"], "left_semi")
    read = read.select("book_key", "page", F.posexplode(T.sentences(F.col("text"))).alias("s", "sample"))
    return chosen.join(read, ["book_key", "page", "s"]).select("book_key", "key", "sample")


def page_lists(pages: DataFrame, func: Sequence[str], most: int = MAX_PAGES, only: DataFrame | None = None) -> DataFrame:
    """(book_key, key, pages): the first ``most`` pages of each key (of ``only``), ascending."""
    rows = grams(pages, func).select("book_key", "key", "page")
    rows = (_of_keys(rows, only) if only is not None else rows).distinct()
    rank = F.row_number().over(Window.partitionBy("book_key", "key").orderBy("page"))
    rows = rows.withColumn("r", rank).filter(F.col("r") <= most)
    return rows.groupBy("book_key", "key").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def auto_stopwords(counts: DataFrame, page_totals: DataFrame, floor: int, min_pages: int, least_pages: int = 32) -> DataFrame:
    """(book_key, token): short words on over 60 % of a book's pages, mostly lower case, that no
    collocation redeems (2 % of the word's own count, 25 % above 85 % of the pages).

    page_totals: (book_key, pages).  Books of under ``least_pages`` pages derive none.
    """
    known = counts.join(page_totals, "book_key").filter(F.col("pages") >= least_pages)
    short = known.filter((F.col("n") == 1) & (F.length("key") <= 5) & (F.col("page_count") > F.col("pages") * 0.6) & (F.col("cap_non_init") * 2 <= F.col("non_init")))
    price = F.when(F.col("page_count") > F.col("pages") * 0.85, 0.25).otherwise(0.02)
    short = short.select("book_key", F.col("key").alias("token"), "freq", price.alias("price"))
    multi = known.filter((F.col("n") >= 2) & (F.col("freq") >= floor) & (F.col("page_count") >= min_pages)).select("book_key", "key", "freq", F.split("key", " ").alias("toks"))
    # a book's provisional words are few (they stand on most pages): one array a book
    lists = short.groupBy("book_key").agg(F.collect_set("token").alias("stops"))
    multi = multi.join(lists, "book_key")
    ends = multi.select("book_key", "freq", "toks", "stops", F.posexplode(F.array(F.col("toks")[0], F.element_at("toks", -1))).alias("e", "token"))
    at = F.when(F.col("e") == 0, 0).otherwise(F.size("toks") - 1)
    others = F.filter("toks", lambda w, i: (i != at) & F.array_contains("stops", w))
    bound = ends.filter(F.array_contains("stops", F.col("token")) & (F.size(others) == 0)).groupBy("book_key", "token").agg(F.max("freq").alias("bound"))
    out = short.join(bound, ["book_key", "token"], "left")
    return out.filter(F.coalesce("bound", F.lit(0)) < F.col("freq") * F.col("price")).select("book_key", "token")


def candidates(counts: DataFrame, floor: int, min_pages: int, auto: DataFrame | None = None) -> DataFrame:
    """Counts that reach floor and spread, and neither begin nor end on a derived stopword."""
    out = counts.filter((F.col("freq") >= floor) & (F.col("page_count") >= min_pages))
    if auto is None:
        return out
    for end in (1, -1):
        word = F.element_at(F.split("key", " "), F.lit(end))
        stop = auto.select(F.col("book_key").alias("sb"), F.col("token").alias("st"))
        out = out.join(stop, (out["book_key"] == F.col("sb")) & (word == F.col("st")), "left_anti")
    return out


def _inside(key: Column) -> Column:
    """Distinct proper sub-n-grams of a key."""
    toks = F.split(key, " ")
    n = F.size(toks)
    subs = F.transform(F.sequence(F.lit(1), n - 1), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda a: F.array_join(F.slice(toks, a, size), " ")))
    return F.array_distinct(F.flatten(subs))


def cvalue(cands: DataFrame) -> DataFrame:
    """Candidates with ``adj``: their count less what longer candidates around them account for.

    Lengths run from four down, so three self-joins unroll what is a recursion.
    """
    nested = None
    for n in range(MAX_N, 1, -1):
        level = cands.filter(F.col("n") == n).select("book_key", "key", "freq")
        if nested is not None:
            sums = nested.groupBy("book_key", "key").agg(F.sum("contrib").alias("nested"))
            level = level.join(sums, ["book_key", "key"], "left").withColumn("freq", F.col("freq") - F.coalesce("nested", F.lit(0)))
        subs = level.filter("freq > 0").select("book_key", F.explode(_inside(F.col("key"))).alias("key"), F.col("freq").alias("contrib"))
        subs = written(subs, "inside")  # the levels below read it again
        nested = subs if nested is None else nested.unionByName(subs)
    sums = nested.groupBy("book_key", "key").agg(F.sum("contrib").alias("nested"))
    out = cands.join(sums, ["book_key", "key"], "left")
    return out.withColumn("adj", F.col("freq") - F.coalesce("nested", F.lit(0))).drop("nested")


def accepted(scored: DataFrame, floor: int, common: Sequence[str], cap_floor: int = 4) -> DataFrame:
    """Terms with their score: several words by adj * log2(n); acronyms and names by adj."""
    shown, adj = F.col("display"), F.col("adj")
    acronym = (F.length(shown) >= 2) & (shown == F.upper(shown)) & shown.rlike("\\p{Lu}") & ~shown.rlike("^[IVXLCDM]+$")
    name = (F.length(shown) >= 3) & shown.rlike("^\\p{Lu}[^\\p{Lu}]") & (F.col("cap_non_init") >= cap_floor) & (F.col("cap_non_init") > F.col("non_init") - F.col("cap_non_init")) & ~F.col("key").isin(*common)
    score = F.when(F.col("n") >= 2, F.when(adj >= floor, adj * F.log2(F.col("n")))).when(acronym & (adj >= floor), adj.cast("double")).when(name, adj.cast("double"))
    return scored.withColumn("score", score).filter("score is not null")


def split_conjunctions(terms: DataFrame, cands: DataFrame) -> DataFrame:
    """"precision and recall" gives way to its halves where both are candidates themselves.

    A half that is no term yet takes the pair's score; of several pairs the first seen counts.
    """
    toks = F.split("key", " ")
    place = F.array_position(F.transform(toks, lambda w: w.isin(*W.CONJUNCTIONS)), F.lit(True)).cast("int")
    one = F.size(F.filter(toks, lambda w: w.isin(*W.CONJUNCTIONS))) == 1
    pairs = terms.filter(one & (place > 1) & (place < F.size(toks)))
    left = F.array_join(F.slice(toks, F.lit(1), place - 1), " ")
    right = F.array_join(F.slice(toks, place + 1, F.size(toks)), " ")
    pairs = pairs.select("book_key", F.col("key").alias("pair"), F.col("score").alias("pair_score"), F.col("first_seen").alias("pair_seen"), F.array(left, right).alias("halves"))
    halves = pairs.select("book_key", "pair", "pair_score", "pair_seen", "halves", F.posexplode("halves").alias("side", "key")).join(cands, ["book_key", "key"])
    both = halves.groupBy("book_key", "pair", "halves").agg(F.count_distinct("side").alias("sides")).filter("sides = 2").select("book_key", "pair")
    kept = terms.join(both.withColumnRenamed("pair", "key"), ["book_key", "key"], "left_anti")
    new = halves.join(both, ["book_key", "pair"], "left_semi").join(terms.select("book_key", "key"), ["book_key", "key"], "left_anti")
    first = F.row_number().over(Window.partitionBy("book_key", "key").orderBy(F.desc("pair_score"), "pair_seen"))
    new = new.withColumn("r", first).filter("r = 1").withColumn("score", F.col("pair_score"))
    return kept.unionByName(new.select(*kept.columns))


def top_terms(terms: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` best terms a book; ties go to the longer n-gram, then to the one seen first."""
    order = Window.partitionBy("book_key").orderBy(F.desc(F.round("score", 9)), F.desc("n"), "first_seen", "key")
    return terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def mine_terms(
    pages: DataFrame, stop: StopLists | None = None, *, cap: int = 120, min_freq: int = 5, min_pages: int = 2, auto_stop: bool = False, with_pages: bool = False, with_sample: bool = False
) -> DataFrame:
    """book_key, rank, term, key, freq, score[, pages][, sample] of each book's best terms."""
    stop = stop or StopLists()
    counts = gram_counts(pages, stop.func, min_freq)
    auto = None
    if auto_stop:
        auto = auto_stopwords(counts, pages.groupBy("book_key").agg(F.count_distinct("page").alias("pages")), min_freq, min_pages)
    # what reaches the floor is a small table that the ranking reads several times
    cands = written(candidates(counts, min_freq, min_pages, auto), "candidates")
    terms = written(accepted(cvalue(cands), min_freq, stop.common), "terms")
    terms = split_conjunctions(terms, cands.withColumn("adj", F.col("freq")))
    out = top_terms(terms, cap).withColumnRenamed("display", "term")
    columns = ["book_key", "rank", "term", "key", "freq", F.round("score", 6).alias("score")]
    if with_pages or with_sample:
        out = written(out, "terms")
        keys = out.select("book_key", "key")  # of the table: pages are not listed again for samples
    if with_pages:
        out = out.join(page_lists(pages, stop.func, only=keys), ["book_key", "key"])
        columns.append("pages")
    if with_sample:
        out = out.join(samples(pages, stop.func, keys), ["book_key", "key"])
        out = out.withColumn("sample", T.clamp_sample(F.col("sample"), F.col("key")))
        columns.append("sample")
    return out.select(*columns)


def lookup_counts(counts: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases (book_key, term) with the count of the key they would have been counted under."""
    rows = phrases.withColumn("key", T.mine_key(F.col("term")))
    found = counts.select("book_key", "key", "freq", "page_count")
    return rows.join(found, ["book_key", "key"], "left").withColumn("freq", F.coalesce("freq", F.lit(0))).withColumn("page_count", F.coalesce("page_count", F.lit(0)))

"""A book's language by script shares and a vote of function words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.functions.words import CYRILLIC_LANGUAGES, LANGUAGE_WORDS
from tomeloom.operators.ordered import running_before

# How much is read, and what evidence a verdict asks for.
PER_PAGE, PER_BOOK = 4_000, 120_000
MIN_LETTERS, MIN_TOKENS, MIN_HITS, MIN_DENSITY, MIN_CONFIDENCE, PRIOR = 80, 60, 8, 0.11, 0.12, 4
SCRIPT_LEAD, MIX_SHARE, KANA_MIN = 0.5, 0.15, 0.05
SCRIPT_LANGUAGE = {"Greek": ("el", 0.9), "Hangul": ("ko", 1.0), "Arabic": ("ar", 0.6), "Hebrew": ("he", 0.85), "Devanagari": ("hi", 0.6)}
HAN_CONFIDENCE = {"ja": 0.95, "zh": 0.9}


def pooled(pages: DataFrame) -> DataFrame:
    """The text a verdict reads: 4000 characters a page, 120 000 a book, in page order."""
    rows = pages.select("book_key", "page", F.substring("text", 1, PER_PAGE).alias("text")).filter("text <> ''")
    rows = running_before(rows, "book_key", "page", F.length("text"), "before")
    rows = rows.withColumn("left", (PER_BOOK - F.col("before")).cast("int")).filter("left > 0")
    return rows.select("book_key", F.substring("text", F.lit(1), F.col("left")).alias("text"))


def script_histogram(texts: DataFrame, *keys: str) -> DataFrame:
    """Characters of each script by key, and their total."""
    sums = [F.sum(T.script_count(F.col("text"), s)).alias(s.lower()) for s in T.SCRIPTS]
    out = texts.groupBy(*keys).agg(*sums)
    return out.withColumn("total", sum((F.col(s.lower()) for s in T.SCRIPTS[1:]), F.col(T.SCRIPTS[0].lower())))


def word_table(spark: SparkSession) -> DataFrame:
    """(word, lang, weight): a word of several languages counts a share for each. Some 300 fixed rows."""
    by_word: dict[str, list[str]] = {}
    for lang, words in LANGUAGE_WORDS.items():
        for w in words.split():
            by_word.setdefault(w, []).append(lang)
    return spark.createDataFrame([(w, lang, 1.0 / len(langs)) for w, langs in by_word.items() for lang in langs], "word string, lang string, weight double")


def detect_language(pages: DataFrame) -> DataFrame:
    """(book_key, lang, confidence); `und` where the evidence is thin."""
    read = pooled(pages)
    hist = script_histogram(read, "book_key")
    words = read.select("book_key", F.explode(F.regexp_extract_all("text", F.lit("\\p{L}+"), F.lit(0))).alias("w"))
    words = words.withColumn("cyr", F.col("w").rlike("^\\p{IsCyrillic}")).withColumn("word", F.lower("w"))
    counts = words.groupBy("book_key", "word").agg(F.count(F.lit(1)).alias("c"), F.count_if("cyr").alias("cyr"))
    totals = counts.groupBy("book_key").agg(F.sum("c").alias("tokens"), F.sum("cyr").alias("cyr_tokens"))
    votes = counts.join(F.broadcast(word_table(pages.sparkSession)), "word").groupBy("book_key", "lang").agg(F.sum(F.col("c") * F.col("weight")).alias("raw"))
    cyrillic = F.col("lang").isin(*CYRILLIC_LANGUAGES)
    share = F.when(cyrillic, F.col("cyrillic")).otherwise(F.col("latin")) / F.col("total")
    lead = F.greatest(*[F.col(s.lower()) for s in T.SCRIPTS])
    top = F.coalesce(*[F.when(F.col(s.lower()) == lead, F.lit(s)) for s in T.SCRIPTS])
    base = hist.join(totals, "book_key", "left").withColumn("top", top)
    scored = votes.join(base, "book_key").filter(F.col("top").isin("Latin", "Cyrillic"))
    own = F.when(F.col("top") == "Cyrillic", cyrillic).otherwise(~cyrillic)
    scored = scored.filter(own | (share >= MIX_SHARE)).withColumn("score", F.col("raw") * share)
    rank = F.row_number().over(Window.partitionBy("book_key").orderBy(F.desc("score"), "lang"))
    first = scored.withColumn("r", rank).filter("r <= 2").groupBy("book_key").agg(
        F.max(F.when(F.col("r") == 1, F.struct("lang", "score", "raw"))).alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("second")
    )
    rows = base.join(first, "book_key", "left")
    best_cyr = F.col("best.lang").isin(*CYRILLIC_LANGUAGES)
    own_tokens = F.when(best_cyr, F.col("cyr_tokens")).otherwise(F.col("tokens") - F.col("cyr_tokens"))
    confidence = (F.col("best.score") - F.col("second")) / (F.col("best.score") + F.col("second") + 2 * PRIOR)
    voted = (F.col("tokens") >= MIN_TOKENS) & (F.col("best.score") >= MIN_HITS) & (F.try_divide("best.raw", own_tokens) >= MIN_DENSITY) & (confidence >= MIN_CONFIDENCE)
    kana = F.col("hiragana") + F.col("katakana")
    family = F.col("han") + kana
    verdict = F.when(F.col("top").isin("Latin", "Cyrillic"), F.when(voted, F.struct(F.col("best.lang").alias("lang"), F.round(confidence, 2).alias("confidence"))))
    for lang, ok in (("ja", kana / family >= KANA_MIN), ("zh", F.lit(True))):
        verdict = verdict.when(F.col("top").isin("Han", "Hiragana", "Katakana") & (family / F.col("total") >= SCRIPT_LEAD) & ok, F.struct(F.lit(lang).alias("lang"), F.round(family / F.col("total") * HAN_CONFIDENCE[lang], 2).alias("confidence")))
    for script, (lang, weight) in SCRIPT_LANGUAGE.items():
        lead_share = F.col(script.lower()) / F.col("total")
        verdict = verdict.when((F.col("top") == script) & (lead_share >= SCRIPT_LEAD), F.struct(F.lit(lang).alias("lang"), F.round(lead_share * weight, 2).alias("confidence")))
    verdict = F.coalesce(F.when(F.col("total") >= MIN_LETTERS, verdict), F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("confidence")))
    out = rows.select("book_key", verdict.alias("v")).select("book_key", "v.lang", "v.confidence")
    empty = pages.select("book_key").distinct().join(out.select("book_key"), "book_key", "left_anti")
    return out.unionByName(empty.select("book_key", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence")))

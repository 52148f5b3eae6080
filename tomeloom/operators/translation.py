"""Incremental translation: what can be carried over, what must be asked, and exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.operators.ordered import running_before


def carry_over(todo: DataFrame, old: DataFrame, page_count: int) -> DataFrame:
    """todo (book_key, page, idx, text) with ``tr`` from old (…, tr) of equal text; each old row
    serves once, in stored order; stale ones never.

    Rows of a key are numbered on both sides, which makes the one-to-one match an equi-join.
    """
    fit = old.filter((F.col("tr") != "") & ~T.looks_stale(F.col("text"), F.col("tr"), F.lit(page_count)))
    order = Window.partitionBy("book_key", "key").orderBy("page", "idx")
    left = todo.withColumn("key", T.carry_key(F.col("text"))).withColumn("rn", F.row_number().over(order))
    right = fit.withColumn("key", T.carry_key(F.col("text"))).withColumn("rn", F.row_number().over(order)).select("book_key", "key", "rn", "tr")
    return left.drop("tr").join(right, ["book_key", "key", "rn"], "left").drop("key", "rn")


def translation_plan(paragraphs: DataFrame, ref_pages: DataFrame, done_pages: DataFrame, old: DataFrame, page_count: int) -> DataFrame:
    """Prose paragraphs of pages that are neither reference pages nor done, with ``action``:
    carry (tr is set) or ask."""
    rows = paragraphs.filter("kind = 'prose'") if "kind" in paragraphs.columns else paragraphs
    rows = rows.join(ref_pages.select("book_key", "page"), ["book_key", "page"], "left_anti").join(done_pages.select("book_key", "page"), ["book_key", "page"], "left_anti")
    out = carry_over(rows, old, page_count)
    return out.withColumn("action", F.when(F.col("tr").isNotNull(), "carry").otherwise("ask"))


def run_plan(plan: DataFrame, model: Callable[[str], str], retries: int = 2) -> DataFrame:
    """The plan with every ``ask`` answered by the model, called on executors; a failure that
    persists gives an empty translation."""

    def answered(text: str) -> str:
        for _ in range(retries):
            try:
                return model(text)
            except Exception:  # the model is outside: one paragraph's failure is soft
                continue
        return ""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            ask = df["action"] == "ask"
            df.loc[ask, "tr"] = [answered(t) for t in df.loc[ask, "text"]]
            yield df

    return plan.mapInPandas(run, plan.schema)


def body_size(paragraphs: DataFrame) -> DataFrame:
    """(book_key, body_fh): the upper median glyph height of prose.

    Heights are counted first, so a book's few distinct sizes are ordered, not its paragraphs.
    """
    counts = paragraphs.filter("kind = 'prose' and fh > 0").groupBy("book_key", "fh").agg(F.count(F.lit(1)).alias("c"))
    return upper_median(counts, ["book_key"], "fh", "c").withColumnRenamed("fh", "body_fh")


def upper_median(counts: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """Per key, the value at place n div 2 (from 0) of the sorted values, given their counts."""
    w = Window.partitionBy(*keys).orderBy(value)
    rows = counts.withColumn("upto", F.sum(count).over(w)).withColumn("all", F.sum(count).over(Window.partitionBy(*keys)))
    return rows.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*keys).agg(F.min(value).alias(value))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Per key, the smallest value up to which at least half of the weight lies."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    by = Window.partitionBy(*keys)
    sums = sums.withColumn("upto", F.sum("w").over(by.orderBy(value))).withColumn("all", F.sum("w").over(by))
    return sums.filter(F.col("upto") * 2 >= F.col("all")).groupBy(*keys).agg(F.min(value).alias(value))


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Per key, the value of most weight; the smaller of equals."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("w"), -F.col(value))).alias(value))


def learned_offset(votes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key, the value of at least three votes and twice the runner-up's, where there is one."""
    counts = votes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    top = counts.withColumn("r", r).filter("r <= 2").groupBy(*keys).agg(F.max(F.when(F.col("r") == 1, F.struct("n", value))).alias("b"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0)).alias("second"))
    return top.filter("b.n >= 3 and b.n >= 2 * second").select(*keys, F.col(f"b.{value}").alias(value))


def hyphen_keep_set(lines: DataFrame) -> DataFrame:
    """(book_key, word): compounds seen with their hyphen more often than solid."""
    letter = "A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё"
    words = F.regexp_extract_all("text", F.lit(f"[{letter}][{letter}'’-]*[{letter}]|[{letter}]"), F.lit(0))
    rows = lines.select("book_key", F.explode(words).alias("w")).select("book_key", F.regexp_replace(F.lower("w"), "^['’]+|['’]+$", "").alias("word")).filter("length(word) >= 2")
    counts = rows.groupBy("book_key", "word").agg(F.count(F.lit(1)).alias("n"))
    inner = F.instr(F.substring("word", F.lit(2), F.length("word") - 2), "-") > 0
    hyphened = counts.filter(inner).withColumn("solid", F.replace("word", F.lit("-"), F.lit("")))
    solid = counts.filter(~inner).select("book_key", F.col("word").alias("solid"), F.col("n").alias("m"))
    return hyphened.join(solid, ["book_key", "solid"], "left").filter(F.col("n") > F.coalesce("m", F.lit(0))).select("book_key", "word")


def gap_runs(pages: DataFrame, missing: Column) -> DataFrame:
    """(book_key, first, last): runs of neighbouring pages for which ``missing`` holds."""
    rows = running_before(pages.filter(missing), "book_key", "page", F.lit(1), "n").withColumn("island", F.col("page") - F.col("n"))
    return rows.groupBy("book_key", "island").agg(F.min("page").alias("first"), F.max("page").alias("last")).drop("island")


def render_class(fh: Column, body: Column, text: Column) -> Column:
    """head, foot, hang or p by a paragraph's glyph height against the body's."""
    ratio = F.try_divide(fh, body)
    return F.when(ratio >= 1.15, "head").when((ratio > 0) & (ratio <= 0.88), "foot").when(text.rlike("^(?:[•·–—-]|[0-9]{1,2}[.)]) "), "hang").otherwise("p")


def export_txt(paragraphs: DataFrame, gaps: DataFrame) -> DataFrame:
    """(book_key, page, block, text): a page's translated paragraphs, and a note for each gap.

    Rows stay rows; ``write_text`` of sources.sinks orders and writes them per book.
    """
    body = F.transform(F.array_sort(F.collect_list(F.struct("idx", "tr"))), lambda p: p["tr"])
    rows = paragraphs.filter("tr <> ''").groupBy("book_key", "page").agg(F.array_join(body, "\n\n").alias("text")).withColumn("block", F.lit(1))
    pages = F.when(F.col("first") == F.col("last"), F.concat(F.lit("[page "), F.col("first"))).otherwise(F.concat(F.lit("[pages "), F.col("first"), F.lit("–"), F.col("last")))
    notes = gaps.select("book_key", F.col("first").alias("page"), F.concat(pages, F.lit(" not translated]")).alias("text"), F.lit(0).alias("block"))
    return rows.select("book_key", "page", "block", "text").unionByName(notes.select("book_key", "page", "block", "text"))


def export_html(paragraphs: DataFrame, body: DataFrame, cited: Callable[[Column], Column]) -> DataFrame:
    """(book_key, page, html): paragraphs as elements of their class, citations in spans.

    ``cited`` splits a text into runs (functions.udfs.split_citations).
    """
    rows = paragraphs.filter("tr <> ''").join(body, "book_key", "left").withColumn("cls", render_class(F.col("fh"), F.col("body_fh"), F.col("tr"))).withColumn("runs", cited(F.col("tr")))
    inner = F.array_join(F.transform("runs", lambda r: F.when(r["cite"], F.concat(F.lit('<span class="cite">'), T.html_escape(r["text"]), F.lit("</span>"))).otherwise(T.html_escape(r["text"]))), "")
    element = F.concat(F.when(F.col("cls") == "head", "<h2>").otherwise(F.concat(F.lit('<p class="'), F.col("cls"), F.lit('">'))), inner, F.when(F.col("cls") == "head", "</h2>").otherwise("</p>"))
    return rows.groupBy("book_key", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", element.alias("e")))), lambda x: x["e"]), "\n").alias("html"))


def match_outline(outline: DataFrame, paragraphs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(book_key, id, tr): an outline row's translation from the most similar heading on its page.

    Equal titles and equal headings of a page meet once, and two texts are compared once, however
    many pages have them.
    """
    heads = paragraphs.filter("tr <> ''").select("book_key", "page", "idx", "tr", T.out_norm(F.col("text")).alias("n"))
    heads = heads.groupBy("book_key", "page", "n").agg(F.min("idx").alias("idx"), F.min_by("tr", "idx").alias("tr"))
    titles = outline.select("book_key", "id", "page", T.out_norm(F.col("title")).alias("t"))
    pairs = titles.select("book_key", "page", "t").distinct().join(heads, ["book_key", "page"])
    alike = pairs.select("t", "n").distinct().withColumn("sim", T.dice(F.col("t"), F.col("n"))).filter(F.col("sim") >= threshold)
    best = pairs.join(alike, ["t", "n"]).groupBy("book_key", "page", "t").agg(F.max(F.struct(F.col("sim"), (-F.col("idx")).alias("place"), F.col("tr").alias("tr"))).alias("b"))
    # an id that stands on several pages takes the best of them
    rows = titles.join(best, ["book_key", "page", "t"])
    return rows.groupBy("book_key", "id").agg(F.max_by("b.tr", F.struct("b.sim", "b.place")).alias("tr"))


def eta(progress: DataFrame) -> DataFrame:
    """(book_key, page, eta): seconds left by the mean of the last five pages' seconds."""
    order = Window.partitionBy("book_key").orderBy("page")
    mean = F.avg("seconds").over(order.rowsBetween(-4, 0))
    left = F.count(F.lit(1)).over(Window.partitionBy("book_key")) - F.row_number().over(order)
    return progress.select("book_key", "page", (mean * left).alias("eta"))


def stitch_pages(paragraphs: DataFrame) -> DataFrame:
    """(book_key, page, idx, to_page, to_idx): a page's last prose paragraph continued by the next
    text page's first, where one ends without an end mark and the other begins in lower case."""
    rows = paragraphs.filter("kind = 'prose' and text <> ''")
    ends = rows.groupBy("book_key", "page").agg(F.max_by(F.struct("idx", "text"), "idx").alias("last"), F.min_by(F.struct("idx", "text"), "idx").alias("first"))
    order = Window.partitionBy("book_key").orderBy("page")
    ends = ends.withColumn("next_page", F.lead("page").over(order)).withColumn("next", F.lead("first").over(order))
    torn = ~F.col("last.text").rlike("[.!?…:;][\"»”’)\\]]*[ \\t\\n]*$") & F.col("next.text").rlike("^[«\"“(]?[\\p{Ll}]") & (F.col("next_page") - F.col("page") <= 3)
    return ends.filter(torn).select("book_key", "page", F.col("last.idx").alias("idx"), F.col("next_page").alias("to_page"), F.col("next.idx").alias("to_idx"))

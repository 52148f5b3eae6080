"""Search in pages and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.functions.text import fuzzy_score
from tomeloom.operators.ordered import placed


def find(pages: DataFrame, query: str) -> DataFrame:
    """(book_key, page, hit, start, end): occurrences of a literal query, case-blind, white space
    matching any gap.  Offsets count characters from 0, end exclusive.

    Pages are filtered before any is split; offsets come from the pieces between hits.
    """
    if not query.split():
        return pages.select("book_key", "page", F.lit(0).alias("hit"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    pattern = T.find_pattern(query)
    rows = pages.filter(F.col("text").rlike(pattern)).select("book_key", "page", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("p"))
    lengths = F.zip_with("p", F.concat(F.transform("m", F.length), F.array(F.lit(0))), lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("hit")))
    start = F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), start.alias("out"))
    walk = F.aggregate(lengths, state, lambda s, x: F.struct((s["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["hit"]).alias("end")))).alias("out")))
    hits = F.slice(walk["out"], F.lit(1), F.size("m"))
    return rows.select("book_key", "page", F.posexplode(hits).alias("hit", "h")).select("book_key", "page", "hit", "h.start", "h.end")


def from_page(hits: DataFrame, totals: DataFrame, anchor: int) -> DataFrame:
    """hits with ``turn``: pages from the anchor to the end, then from the start (totals: book_key, pages)."""
    return hits.join(totals, "book_key").withColumn("turn", F.pmod(F.col("page") - anchor, F.col("pages"))).drop("pages")


def find_translated(paragraphs: DataFrame, figures: DataFrame, query: str) -> DataFrame:
    """Hits in translations of paragraphs that are shown: no captions, none inside a figure."""
    shown = outside_figures(paragraphs.filter("tr <> '' and kind <> 'caption'"), figures)
    rows = shown.select("book_key", F.concat_ws(":", "page", "idx").alias("page"), F.col("tr").alias("text"))
    found = find(rows, query)
    parts = F.split("page", ":")
    return found.select("book_key", parts[0].cast("long").alias("page"), parts[1].cast("int").alias("idx"), "hit", "start", "end")


def outside_figures(paragraphs: DataFrame, figures: DataFrame, share: float = 0.6) -> DataFrame:
    """Paragraphs of which no figure of the page covers ``share`` of the area."""
    f = figures.select(F.col("book_key").alias("fb"), F.col("page").alias("fp"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("w").alias("fw"), F.col("h").alias("fh2"))
    wide = F.least(F.col("x") + F.col("w"), F.col("fx") + F.col("fw")) - F.greatest("x", "fx")
    high = F.least(F.col("y") + F.col("h"), F.col("fy") + F.col("fh2")) - F.greatest("y", "fy")
    area = F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)
    return paragraphs.join(f, (F.col("book_key") == F.col("fb")) & (F.col("page") == F.col("fp")) & (area >= share * F.col("w") * F.col("h")), "left_anti")


def fuzzy_rank(rows: DataFrame, query: str, label: str, top: int) -> DataFrame:
    """rows with ``score``: the best fuzzy matches of a label."""
    scored = rows.withColumn("score", fuzzy_score(F.lit(query), F.col(label))).filter("score is not null")
    return scored.orderBy(F.desc("score"), label).limit(top)


def palette(books: DataFrame, commands: DataFrame, query: str) -> DataFrame:
    """(kind, label, score): a page jump, commands, up to six books and a find row, best first."""
    spark = books.sparkSession
    q = query.strip()
    rows = commands.select(F.lit("command").alias("kind"), "label", (fuzzy_score(F.lit(q), F.col("label")) + 1).alias("score")).filter("score is not null")
    rows = rows.unionByName(fuzzy_rank(books, q, "label", 6).select(F.lit("book").alias("kind"), "label", "score"))
    if q.isdigit():
        rows = rows.unionByName(spark.createDataFrame([("page", q, 1e6)], "kind string, label string, score double"))
    if q:
        rows = rows.unionByName(spark.createDataFrame([("find", q, -1.0)], "kind string, label string, score double"))
    return rows


def library_order(books: DataFrame, query: str = "", filter_by: str = "all") -> DataFrame:
    """books (path, name, title, progress, last_opened) with ``place``.

    Without a query: those being read by recency, then all by name; with one: prefixes first.
    Names are compared by the Unicode collation.
    """
    label = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("name"))
    reading = (F.col("progress") > 0.005) & (F.col("progress") < 0.995)
    rows = books.filter(reading) if filter_by == "reading" else books
    name = F.collate(label, "UNICODE_CI")
    q = query.strip().lower()
    if q:
        rows = rows.filter(F.lower(label).contains(q) | F.lower("name").contains(q))
        order = [F.when(F.lower(label).startswith(q), 0).otherwise(1), name, F.col("path")]
    else:
        order = [F.when(reading, 0).otherwise(1), F.when(reading, -F.coalesce("last_opened", F.lit(0))).otherwise(0), name, F.col("path")]
    return placed(rows, order)


def outline_filter(outline: DataFrame, query: str) -> DataFrame:
    """Digits select by page prefix, anything else by title or translation."""
    q = query.strip().lower()
    if q.isdigit():
        return outline.filter(F.col("page").cast("string").startswith(q))
    return outline.filter(F.lower("title").contains(q) | F.lower(F.coalesce("tr", F.lit(""))).contains(q))


def current_section(outline: DataFrame, positions: DataFrame) -> DataFrame:
    """(book_key, at, id): the last outline row at or before each position's page.

    One ordered pass over both, not a join of ranges.
    """
    o = outline.select("book_key", F.col("page").alias("at"), F.col("id"), F.lit(0).alias("side"))
    p = positions.select("book_key", "at", F.lit(None).cast(dict(outline.dtypes)["id"]).alias("id"), F.lit(1).alias("side"))
    w = Window.partitionBy("book_key").orderBy("at", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = o.unionByName(p).withColumn("id", F.last("id", ignorenulls=True).over(w))
    return rows.filter("side = 1").select("book_key", "at", "id")


def catch_up(library: DataFrame, shards: DataFrame, generation: int) -> DataFrame:
    """Books without a shard, or with one that is not deep or of an older generation."""
    s = shards.select("path", "stage", "gen")
    return library.join(s, "path", "left").filter((F.col("gen").isNull()) | (F.col("stage") != "deep") | (F.col("gen") < generation)).drop("stage", "gen")


def prune(index: DataFrame, scan: DataFrame) -> DataFrame:
    """Index rows whose file is gone."""
    return index.join(scan.select("path"), "path", "left_anti")


def pie_slices(rows: DataFrame, keys: list[str], name: str, value: str, most: int = 5, other: str = "other") -> DataFrame:
    """Positive values by size; beyond ``most`` slices the tail is one."""
    by = Window.partitionBy(*keys)
    rows = rows.filter(F.col(value) > 0).withColumn("r", F.row_number().over(by.orderBy(F.desc(value), name))).withColumn("all", F.count(F.lit(1)).over(by))
    tail = (F.col("all") > most) & (F.col("r") >= most)
    rows = rows.withColumn("slot", F.when(tail, most).otherwise(F.col("r"))).withColumn("label", F.when(tail, other).otherwise(F.col(name)))
    return rows.groupBy(*keys, "slot", "label").agg(F.sum(value).alias(value))


def repeated_within(rows: DataFrame, keys: list[str], at: str, y: str, tolerance: float, back: int) -> DataFrame:
    """rows with ``again``: a row of the same keys at a like height within the ``back`` places before.

    Heights are dealt into cells as wide as the tolerance, so only three cells are joined.
    """
    left = rows.withColumn("cell", F.explode(F.array(*[F.floor(F.col(y) / tolerance) + d for d in (-1, 0, 1)])))
    right = rows.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(at).alias("r_at"), F.col(y).alias("r_y"), F.floor(F.col(y) / tolerance).alias("r_cell"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    near = same & (F.col("cell") == F.col("r_cell")) & (F.col("r_at") < F.col(at)) & (F.col("r_at") > F.col(at) - back) & (F.abs(F.col("r_y") - F.col(y)) <= tolerance)
    hit = left.join(right, near, "left_semi").select(*keys, at, y).distinct().withColumn("again", F.lit(True))
    return rows.join(hit, [*keys, at, y], "left").withColumn("again", F.coalesce("again", F.lit(False)))


def order_key(c: Column) -> Column:
    """A name's place in lists: the Unicode collation, case-blind."""
    return F.collate(c, "UNICODE_CI")

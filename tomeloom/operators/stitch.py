"""Paragraphs torn by a page's end, told by geometry: where lines end, where they begin, what lies between.

A page's paragraphs (some dozens) are one array; its model is expressions over that array, and
two neighbouring pages' models meet by one ordered step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in units of the page's line height or shares of its measure.
SIZE, FLUSH, OFFSET = 0.02, 0.3, 0.35
HEADING, HEADING_LINES, MATH_WIDTH, MATH_SIZE = 1.12, 3, 0.15, 0.9
COLUMN_CHARS, REACH, LEAST_TOKENS, SKIP = 0.15, 0.35, 4, 3
# How a sentence ends, abbreviations that end none, how a continued half may begin.
TERMINATOR = "[.!?…][\"'”’)\\]]?$"
ABBREVIATION = "(?i)(?:etc|e\\.g|i\\.e|cf|vs|resp)\\.\\)$"
LOWER = "^[a-zà-öø-ÿа-яё]"
SYMBOL = "^(?:[\\x{370}-\\x{3ff}\\x{2100}-\\x{214f}\\x{2190}-\\x{22ff}]|[\\x{1d400}-\\x{1d7ff}])"
LIST_ITEM = "^\\s*(?:[•●▪‣∗*–—]|\\(?[0-9]{1,2}[.)]\\s|[a-z]\\)\\s)"


def _largest(a: Column) -> Column:
    return F.array_max(a)


def page_models(paragraphs: DataFrame) -> DataFrame:
    """(book_key, page, line_h, ref_page, model) from paragraphs (book_key, page, idx, x, w, fh, kind, text,
    lines array<struct<top,left,right>>, line_h, ref_page, in_figure).

    model: (col_r, tail, head, barred_after, barred_before); null for a page without text of its
    main size, or with two columns side by side.  tail and head are the last and first paragraphs
    of the measure; a heading or a wide formula behind or before them bars a join.
    """
    p = F.struct("idx", "x", "w", "fh", "kind", "text", "lines", "in_figure", F.round("fh", 2).alias("k"), F.length("text").alias("n"))
    rows = paragraphs.groupBy("book_key", "page").agg(F.array_sort(F.collect_list(F.struct("idx", p.alias("p")))).alias("s"), F.max("line_h").alias("line_h"), F.max("ref_page").alias("ref_page"))
    rows = rows.select("book_key", "page", "line_h", "ref_page", F.transform("s", lambda s: s["p"]).alias("ps"))
    rows = rows.withColumn("prose", F.filter("ps", lambda q: (q["kind"] == "prose") & (q["fh"] > 0)))
    # the size most characters are set in, the larger of equals
    sizes = F.transform("prose", lambda q: F.struct(F.aggregate(F.filter("prose", lambda o: o["k"] == q["k"]), F.lit(0), lambda a, o: a + o["n"]).alias("n"), q["k"].alias("k")))
    rows = rows.withColumn("dom", _largest(sizes)["k"])
    rows = rows.withColumn("body", F.filter("prose", lambda q: F.abs(q["fh"] - F.col("dom")) <= SIZE * F.col("dom"))).filter((F.size("body") > 0) & (F.col("line_h") > 0))
    return rows.withColumn("columns", _columns()).select("book_key", "page", "line_h", "ref_page", F.when(F.col("columns") < 2, _model()).alias("model"))


def _columns() -> Column:
    """Groups side by side that hold lines of their own and COLUMN_CHARS of the body's characters."""
    chars = F.aggregate("body", F.lit(0), lambda a, q: a + q["n"])
    by_x = F.array_sort(F.transform("body", lambda q: F.struct(q["x"].alias("x"), (q["x"] + q["w"]).alias("r"), (F.size(q["lines"]) >= 2).alias("multi"), q["n"].alias("n"))))
    group = "array<struct<r:double,multi:boolean,n:int>>"

    def put(held: Column, q: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        joined = F.struct(F.greatest(last["r"], q["r"]).alias("r"), (last["multi"] | q["multi"]).alias("multi"), (last["n"] + q["n"]).alias("n"))
        new = F.struct(q["r"].alias("r"), q["multi"].alias("multi"), q["n"].alias("n"))
        shorter = F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))
        return F.when((F.size(held) > 0) & (q["x"] <= last["r"]), F.concat(shorter, F.array(joined))).otherwise(F.concat(held, F.array(new)))

    groups = F.aggregate(by_x, F.array().cast(group), put)
    return F.size(F.filter(groups, lambda g: g["multi"] & (g["n"] >= COLUMN_CHARS * chars)))


def _model() -> Column:
    h, body = F.col("line_h"), F.col("body")
    multi = F.filter(body, lambda q: F.size(q["lines"]) >= 2)
    rights = F.transform(multi, lambda q: F.struct(q["lines"][0]["right"].alias("v"), (F.size(q["lines"]) - 1).alias("n")))
    # the right edge that most full lines share, the larger of equals
    support = F.transform(rights, lambda c: F.struct(F.aggregate(F.filter(rights, lambda o: F.abs(o["v"] - c["v"]) <= FLUSH * h), F.lit(0), lambda a, o: a + o["n"]).alias("n"), c["v"].alias("v")))
    wide = _largest(F.transform(body, lambda q: q["x"] + q["w"]))
    col_r = F.when(F.size(multi) > 0, _largest(support)["v"]).otherwise(wide)
    col_l = F.array_min(F.transform(body, lambda q: q["x"]))

    def last_left(q: Column) -> Column:
        return F.element_at(q["lines"], -1)["left"]

    inside = F.filter(body, lambda q: (q["x"] + q["w"] <= col_r + FLUSH * h) & (col_r - last_left(q) >= REACH * (col_r - col_l)))
    wider = F.filter(body, lambda q: wide - last_left(q) >= REACH * (wide - col_l))
    held = F.when(F.size(inside) > 0, inside).when(F.size(wider) > 0, wider).otherwise(body)
    right = F.when((F.size(inside) == 0) & (F.size(wider) > 0), wide).otherwise(col_r)
    heading = lambda q: (q["kind"] == "prose") & (q["fh"] >= HEADING * F.col("dom")) & (F.size(q["lines"]) <= HEADING_LINES)
    formula = lambda q: (q["kind"] == "other") & (q["w"] > MATH_WIDTH * right) & (q["fh"] >= MATH_SIZE * F.col("dom"))
    bars = F.transform(F.filter("ps", lambda q: ~q["in_figure"] & (heading(q) | formula(q))), lambda q: q["idx"])
    tail, head = F.element_at(held, -1), held[0]
    return F.struct(right.alias("col_r"), tail.alias("tail"), head.alias("head"), F.exists(bars, lambda b: b > tail["idx"]).alias("barred_after"), F.exists(bars, lambda b: b < head["idx"]).alias("barred_before"))


def stitch(paragraphs: DataFrame) -> DataFrame:
    """(book_key, page, idx, to_page, to_idx): a page's last paragraph that the next page with text (at
    most two blank ones between) goes on with.

    All of these hold: neither is a reference page; nothing bars; the tail's last line reaches its
    measure; the head's first line begins as far from the right margin as the tail's last; the
    tail ends no sentence; both are of one size; the head is no list item, and it begins in lower
    case or with a symbol, or has four tokens.
    """
    models = page_models(paragraphs)
    order = Window.partitionBy("book_key").orderBy("page")
    both = models.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("page", "ref_page", "model")])
    a, b = F.col("model"), F.col("next_model")
    tail, head, h = a["tail"], b["head"], F.col("line_h")
    last, first = F.element_at(tail["lines"], -1), head["lines"][0]
    measure = F.when(F.size(tail["lines"]) >= 2, tail["x"] + tail["w"]).otherwise(a["col_r"])
    offset = a["col_r"] - last["left"] - (b["col_r"] - first["left"])
    said, goes_on = F.rtrim(tail["text"]), F.ltrim(head["text"])
    open_ = ~said.rlike(TERMINATOR) | said.rlike(ABBREVIATION)
    begins = goes_on.rlike(LOWER) | goes_on.rlike(SYMBOL) | (F.size(F.split(goes_on, "\\s+")) >= LEAST_TOKENS)
    good = (
        ~F.col("ref_page") & ~F.col("next_ref_page") & ~a["barred_after"] & ~b["barred_before"] & (F.col("next_page") - F.col("page") <= SKIP)
        & (measure - last["right"] <= FLUSH * h) & (F.abs(offset) <= OFFSET * h) & open_
        & (F.abs(tail["fh"] - head["fh"]) <= SIZE * F.greatest(tail["fh"], head["fh"])) & ~head["text"].rlike(LIST_ITEM) & begins
    )
    return both.filter(good).select("book_key", "page", tail["idx"].alias("idx"), F.col("next_page").alias("to_page"), head["idx"].alias("to_idx"))

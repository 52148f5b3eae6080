"""What a reader's desk shows: selections with their context, threads, stores and their sizes,
shapes of text that are no prose, boxes of pictures, the flow of a page."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeloom.functions import text as T

CONTEXT, SENTENCE, THREADS = 2200, 600, 30


def selection(raw: Column) -> Column:
    """A selection with hyphens at line ends taken out and its lines joined."""
    return T.flat(F.regexp_replace(raw, "[-­][ \\t\\r]*\\n[ \\t\\r\\n]*", ""))


def sentence_around(text: Column, picked: Column) -> Column:
    """The sentence that a selection stands in (600 characters at most); null if it is not longer."""
    at = F.instr(F.lower(text), F.lower(picked))
    before, behind = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(picked), F.length(text))
    start = F.length(F.regexp_extract(before, "(?s)^(.*[.!?…][\")\\]]?)(?=\\s)", 1))
    tail = F.regexp_extract(behind, "(?s)^(.*?[.!?…][\")\\]]?)", 1)
    end = at - 1 + F.length(picked) + F.when(tail == "", F.length(behind)).otherwise(F.length(tail))
    found = F.trim(F.substring(text, start + 1, F.least(end - start, F.lit(SENTENCE))))
    longer = F.size(F.split(found, " ")) > F.size(F.split(picked, " "))
    return F.when((at > 0) & longer, found)


def context_window(text: Column, picked: Column, most: int = CONTEXT) -> Column:
    """The page, or ``most`` characters around the selection (around the middle without it), with ellipses."""
    n = F.length(text)
    at = F.instr(F.lower(text), F.lower(picked))
    middle = F.when(at > 0, at - 1 + F.length(picked) / 2).otherwise(n / 2)
    start = F.greatest(F.lit(0), F.least(F.floor(middle - most / 2 + 0.5), n - most)).cast("int")
    part = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(most)), F.when(start + most < n, "…").otherwise(""))
    return F.when(n <= most, text).otherwise(part)


def prune_threads(threads: DataFrame, most: int = THREADS) -> DataFrame:
    """threads (book, id, ts, n, active) that stay: of more than ``most`` empty ones go first, then
    those touched least recently, never the active or the newest."""
    w = Window.partitionBy("book")
    rows = threads.withColumn("newest", F.row_number().over(w.orderBy(F.desc("ts"), "id")) == 1).withColumn("all", F.count(F.lit(1)).over(w))
    safe = F.col("newest") | F.col("active")
    rank = F.row_number().over(w.orderBy(safe.cast("int"), F.when(F.col("n") == 0, 0).otherwise(1), "ts", "id"))
    rows = rows.withColumn("safe", safe).withColumn("r", rank)
    return rows.filter(F.col("safe") | (F.col("r") > F.col("all") - most)).select(*threads.columns)


def store_sizes(stores: DataFrame, index: DataFrame) -> DataFrame:
    """(file, title, bytes, pages): stores (file, json) by size, titles from the index (path, title)."""
    path = header_path(F.col("json"))
    rows = stores.filter("length(json) > 0").select("file", path.alias("path"), F.octet_length("json").cast("long").alias("bytes"), tail_pages(F.col("json")).alias("pages"))
    name = F.nullif(F.regexp_replace(F.regexp_extract("path", r"([^\\/]*)$", 1), "(?i)\\.pdf$", ""), F.lit(""))
    rows = rows.join(index.select("path", "title"), "path", "left")
    return rows.select("file", F.coalesce(F.nullif("title", F.lit("")), name, F.regexp_replace("file", "(?i)\\.json$", "")).alias("title"), "bytes", "pages")


def header_path(json: Column) -> Column:
    """A store's book by the first 2 KiB alone."""
    return F.nullif(F.regexp_extract(F.substring(json, 1, 2048), r'"bookPath":"((?:[^"\\]|\\.)*)"', 1), F.lit(""))


def tail_pages(json: Column) -> Column:
    """A store's count of pages by the last 256 KiB alone: the last list of finished pages."""
    tail = F.substring(json, F.greatest(F.length(json) - (1 << 18), F.lit(0)) + 1, F.lit(1 << 18))
    listed = F.regexp_extract(tail, r'(?s).*"donePages":\[([0-9, ]*)\]', 1)
    return F.when(F.trim(listed) == "", 0).otherwise(F.size(F.split(listed, ",")))


def counts_by_kind(nodes: DataFrame) -> DataFrame:
    """(kind, n)."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def library_index(paths: DataFrame, index: DataFrame, positions: DataFrame) -> DataFrame:
    """(path, name, title, pages, progress, last_opened) of scanned paths, from JSON key-value rows
    (path, json) of an index and of positions; broken JSON is no entry."""
    i = index.select("path", F.from_json("json", "title string, pages int").alias("i"))
    p = positions.select("path", F.from_json("json", "progress double, lastOpened bigint").alias("p"))
    name = F.regexp_replace(F.regexp_extract("path", r"([^\\/]*)$", 1), "(?i)\\.pdf$", "")
    rows = paths.join(i, "path", "left").join(p, "path", "left")
    return rows.select("path", name.alias("name"), F.nullif("i.title", F.lit("")).alias("title"), F.col("i.pages").alias("pages"), F.col("p.progress").alias("progress"), F.col("p.lastOpened").alias("last_opened"))


# --- shapes of text ----------------------------------------------------------------------------

# Openings, tokens and marks of code, of identifiers, of captions; a row's end.
CODE_OPEN = r"^(?:SELECT|PREFIX|ASK|CONSTRUCT|DESCRIBE|INSERT|DELETE|UPDATE|MATCH|RETURN|WHERE|FILTER|OPTIONAL)\b|^[@}\]]|^\{"
CODE_TOKEN = r"^(?:[?$][A-Za-z_]|#$|#[A-Za-z(]|@[a-z]|<[^<>\s]*>$|[A-Za-z][0-9A-Za-z_-]{0,12}:(?:[A-Za-z_][0-9A-Za-z_-]*|[0-9][0-9A-Za-z_-]*)$)"
CODE_MAP, CODE_LANGUAGE, CODE_ADDRESS = r'\{[^}]*:\s*"', r'"@[a-z]{2}(?:-[A-Za-z]+)?\b', r"<[^<>]{1,40}>"
IDENTIFIER_TOKEN = r"(?i)^(?:https?://\S+|[0-9a-z_-]+\.(?:org|com|net|edu|io|acm|gov)(?:/\S*)?|[0-9][0-9.\-/]{5,})$"
CAPTION = r"(?i)^(?:figure|fig\.|table|chart|diagram|listing|algorithm|scheme|example)\s*[0-9]"
ROW_END = "[.!?:;][)\"'”’]?$"
CODE_SHARE, IDENTIFIER_SHARE = 0.2, 0.25


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def code_shaped(c: Column) -> Column:
    """A listing: it opens as one, or a fifth of its tokens are code's."""
    tokens = _tokens(c)
    marks = F.size(F.filter(tokens, lambda w: w.rlike(CODE_TOKEN))) + F.regexp_count(c, F.lit(CODE_ADDRESS))
    return T.any_of(c, (CODE_OPEN, CODE_MAP, CODE_LANGUAGE)) | ((marks >= 1) & (marks >= CODE_SHARE * F.size(tokens)))


def catalogue_shaped(c: Column) -> Column:
    """A quarter of the tokens are addresses or long numbers."""
    tokens = _tokens(c)
    hits = F.size(F.filter(tokens, lambda w: w.rlike(IDENTIFIER_TOKEN)))
    return (hits >= 1) & (hits >= IDENTIFIER_SHARE * F.size(tokens))


def is_caption(c: Column) -> Column:
    """A numbered label with a separator, or with nothing in lower case behind."""
    rest = F.regexp_replace(c, CAPTION + "[0-9.]*", "")
    return c.rlike(CAPTION) & (rest.rlike(r"^\s*[:.—–-]") | ~rest.rlike(r"^\s*[a-zа-яё]"))


def welded_row(c: Column, function_words: tuple[str, ...]) -> Column:
    """A table's row that reads as prose: no end mark, fewer than two function words."""
    stops = F.size(F.filter(_tokens(c), lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").isin(*function_words)))
    return ~F.trim(c).rlike(ROW_END) & (stops < 2)


# --- boxes and flow ----------------------------------------------------------------------------


def line_boxes(words: DataFrame, line_height: Column | float, keys: tuple[str, ...] = ("book_key", "page", "idx")) -> DataFrame:
    """(keys, line, top, left, right): fragments (top, left, right) of a paragraph as its lines.

    Fragments in order of height begin a line where they stand half a line below the line's
    first; a running fold over a paragraph's few fragments says where.
    """
    h = line_height if isinstance(line_height, Column) else F.lit(float(line_height))
    parts = words.withColumn("h", h).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("top", "left", "right"))).alias("fs"), F.max("h").alias("h"))
    box = "array<struct<top:double,left:double,right:double>>"

    def put(held: Column, f: Column) -> Column:
        last = F.element_at(held, -1)
        joins = (F.size(held) > 0) & (F.abs(f["top"] - F.try_element_at(held, F.lit(-1))["top"]) < 0.5 * F.col("h"))
        both = F.struct(last["top"].alias("top"), F.least(last["left"], f["left"]).alias("left"), F.greatest(last["right"], f["right"]).alias("right"))
        return F.when(joins, F.concat(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(held, F.array(F.struct(f["top"].alias("top"), f["left"].alias("left"), f["right"].alias("right")))))

    lines = F.aggregate("fs", F.array().cast(box), put)
    return parts.select(*keys, F.posexplode(lines).alias("line", "b")).select(*keys, "line", "b.top", "b.left", "b.right")


def image_boxes(operations: DataFrame, viewports: DataFrame) -> DataFrame:
    """(book_key, page, x, y, w, h) of pictures, from a page's drawing operations (book_key, page,
    seq, op, args) and viewports (book_key, page, view: six numbers).

    save and restore keep a stack of transforms; form_begin saves too, with a transform of its own.
    A page's operations come to one task in order, behind its viewport, and are read one after the
    other: no page is a group of its own, so many short ones cost no more than a long one.  A page
    without a viewport of six numbers shows nothing; operations of one seq follow by name and numbers.
    """
    keys = ["book_key", "page"]
    seq = operations.schema["seq"].dataType
    views = viewports.select(*keys, F.lit(0).alias("side"), F.lit(None).cast(seq).alias("seq"), F.lit(None).cast("string").alias("op"), F.col("view").cast("array<double>").alias("args"))
    drawn = operations.filter(F.col("op").isin(*_DRAWING)).select(*keys, F.lit(1).alias("side"), "seq", "op", F.col("args").cast("array<double>").alias("args"))
    rows = views.unionByName(drawn).filter("book_key is not null and page is not null").repartition(*keys).sortWithinPartitions(*keys, "side", "seq", "op", "args")
    return rows.select(F.col("book_key").cast("string").alias("book_key"), F.col("page").cast("long").alias("page"), "side", "op", "args").mapInArrow(_boxes, _BOXES_DDL)


_DRAWING = ("save", "restore", "form_begin", "form_end", "transform", "image")
_BOXES = pa.schema([("book_key", pa.string()), ("page", pa.int64()), *[(c, pa.float64()) for c in "xywh"]])
_BOXES_DDL = "book_key string, page long, x double, y double, w double, h double"
_UPRIGHT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _times(a: Sequence[float], b: Sequence[float]) -> tuple[float, ...]:
    return (a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5])


def _boxes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (book_key, page, side, op, args), a page's viewport (side 0) before its operations in order."""
    page, view, now, stack = None, None, _UPRIGHT, []
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            args = batch.column(4)
            values = args.flatten().to_numpy(zero_copy_only=False).tolist()
            sizes = np.nan_to_num(args.value_lengths().to_numpy(zero_copy_only=False)).astype(int).tolist()
            found, at = [], 0
            for b, p, side, op, n in zip(*[batch.column(c).to_pylist() for c in range(4)], sizes, strict=True):
                given, at = values[at : at + n], at + n
                if (b, p) != page:
                    page, view, now, stack = (b, p), None, _UPRIGHT, []
                if not side:
                    view = given if n == 6 else None
                elif view is None:
                    continue
                elif op == "image":
                    found.append((b, p, _times(view, now)))
                elif op in ("restore", "form_end"):
                    now = stack.pop() if stack else _UPRIGHT
                else:
                    if op != "transform":
                        stack.append(now)
                    if op != "save" and n == 6:
                        now = _times(now, given)
            if found:
                m = np.array([f[2] for f in found])
                zero = np.zeros(len(m))
                xs, ys = (np.stack([zero, m[:, i], m[:, i + 2], m[:, i] + m[:, i + 2]], axis=1) + m[:, i + 4, None] for i in (0, 1))
                boxes = [xs.min(axis=1), ys.min(axis=1), np.ptp(xs, axis=1), np.ptp(ys, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), *[pa.array(x, pa.float64(), from_pandas=True) for x in boxes]], schema=_BOXES)


def flow(paragraphs: DataFrame, figures: DataFrame, body: DataFrame) -> DataFrame:
    """(book_key, page, place, kind, text, x, y): what a reflowed page shows, in order.

    Running heads, captions, continued halves and paragraphs inside a figure are left out;
    translated prose is text, anything else a crop; a figure stands before the first
    paragraph that begins below it (or beside and right of it) and all that follow.
    """
    from tomeloom.operators.search import outside_figures

    shown = outside_figures(paragraphs.filter("kind not in ('furniture', 'caption') and not coalesce(continued, false)"), figures)
    shown = shown.join(body, "book_key", "left")
    kind = F.when((F.col("kind") == "prose") & (F.coalesce("tr", F.lit("")) != ""), F.when(F.try_divide("fh", "body_fh") >= 1.15, "head").otherwise("p")).otherwise("crop")
    # a figure's place is behind the last paragraph, in order of the page, that begins before it
    items = shown.select("book_key", "page", F.col("idx").cast("double").alias("at"), F.lit(1).alias("side"), kind.alias("kind"), F.col("tr").alias("text"), "x", "y")
    f = figures.select("book_key", "page", F.col("x").alias("fx"), F.col("y").alias("fy"))
    first = f.join(shown.select("book_key", "page", "idx", "x", "y"), ["book_key", "page"], "left")
    below = (F.col("fy") < F.col("y")) | ((F.col("fy") == F.col("y")) & (F.col("fx") <= F.col("x")))
    first = first.groupBy("book_key", "page", "fx", "fy").agg(F.min(F.when(below, F.col("idx"))).cast("double").alias("at"))
    pictures = first.select("book_key", "page", F.coalesce("at", F.lit(1e18)).alias("at"), F.lit(0).alias("side"), F.lit("figure").alias("kind"), F.lit(None).cast("string").alias("text"), F.col("fx").alias("x"), F.col("fy").alias("y"))
    order = Window.partitionBy("book_key", "page").orderBy("at", "side", F.when(F.col("side") == 0, F.col("y")), F.when(F.col("side") == 0, F.col("x")))
    return items.unionByName(pictures).withColumn("place", F.row_number().over(order) - 1).select("book_key", "page", "place", "kind", "text", "x", "y")


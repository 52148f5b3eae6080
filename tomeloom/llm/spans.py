"""Substring deduplication by sliding sentence spans.

Every run of consecutive sentences (at least three, extended to 16 words) is hashed; the
hashes are joined over all documents; a run that also stands earlier (by document, then
place) is a repeat, and the sentences it covers are removed.  The first occurrence stays.

Sentences end at . ! ? and line ends; a stretch of more than 16 words without one is cut
behind words that their own hash selects (one in four), so that the cuts of a repeated
passage do not depend on what stands around it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeloom.llm.arrow import Sink, rows_of
from tomeloom.llm.store import written

SENTENCES, WORDS = 3, 16
_SENTENCE = regex.compile(r"[^.!?\n]*+(?:[.!?]++|\n|$)")
_WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words in lower case) of each sentence that has a word."""
    out = []
    for m in _SENTENCE.finditer(text):
        a, b = m.span()
        words = _WORD.findall(text[a:b].lower())
        if not words:
            continue
        if len(words) <= WORDS:
            out.append((a, b, words))
            continue
        held, start = [], a
        for w in _WORD.finditer(text, a, b):
            held.append(w.group().lower())
            if not zlib.crc32(held[-1].encode("utf-8", "surrogatepass")) & 3:
                out.append((start, w.end(), held))
                held, start = [], w.end()
        if held:
            out.append((start, b, held))
    return out


def runs(units: list[tuple[int, int, list[str]]]) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, count, 128-bit hash) of each run; a text too short for one is one run
    if it has WORDS words."""
    sizes = [len(u[2]) for u in units]
    said = [" ".join(u[2]) for u in units]
    end, words, n = 0, 0, len(units)
    for i in range(n):
        while end < n and (end - i < SENTENCES or words < WORDS):
            words += sizes[end]
            end += 1
        if end - i < SENTENCES or words < WORDS:
            if i == 0 and words >= WORDS:
                yield 0, n, xxhash.xxh3_128_digest("\n".join(said).encode("utf-8", "surrogatepass"))
            return
        yield i, end - i, xxhash.xxh3_128_digest(" ".join(said[i:end]).encode("utf-8", "surrogatepass"))
        words -= sizes[i]


#: Runs that a task combines at a time.
BLOCK = 400_000
#: place: the first sentence, times 64, and how many (WORDS at most, as each has a word).
_RUNS = pa.schema([(n, pa.int64()) for n in ("a", "b", "again", "id", "h", "place", "first_id")])
_RUNS_DDL = ", ".join(f"{n} long" for n in _RUNS.names)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places where sorted rows begin a new group."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _combined(*held: list[int]) -> pa.RecordBatch:
    """A block's runs, sorted by hash, document, place; all but a hash's first are repeats already."""
    rows = [np.array(x, np.int64) for x in held]  # a, b, id, h, place
    order = np.lexsort(rows[::-1])
    rows = [x[order] for x in rows]
    once = _starts(*rows)  # rows given twice are one document
    a, b, ids, h, places = (x[once] for x in rows)
    new = _starts(a, b)
    first = ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, (~new).astype(np.int64), ids, h, places, first)], schema=_RUNS)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with ``again`` set where the same block has an earlier one.

    A passage that a third of all documents share thus leaves a block as one row that has to
    meet other blocks' rows, however many documents it stands in.
    """
    held: tuple[list[int], ...] = ([], [], [], [], [])
    for ident, h, text in rows_of(batches, 64):
        for at, n, digest in runs(sentences(text or "")):
            for column, value in zip(held, (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), ident, h, at << 6 | n), strict=True):
                column.append(value)
        if len(held[0]) >= BLOCK:
            yield _combined(*held)
            held = ([], [], [], [], [])
    if held[0]:
        yield _combined(*held)


_REPEATS = pa.schema([(n, pa.int64()) for n in ("id", "h", "place", "first_id")])


def _not_first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by hash, again, document, place: those that stand earlier elsewhere."""
    last: tuple[int, ...] = ()  # hash, and the first document (id, h) and place of the open group
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, again, ids, h, places, first = (c.to_numpy() for c in batch.columns)
        new = _starts(a, b)
        if last and (a[0], b[0]) == last[:2]:
            new[0] = False
        begins = np.flatnonzero(new)
        group = np.cumsum(new) - 1  # -1: the group left open by the batch before
        lead = [np.append(x[begins], old)[group] for x, old in zip((ids, h, places), last[2:] or (0, 0, 0), strict=True)]
        out = (again == 1) | (ids != lead[0]) | (h != lead[1]) | (places != lead[2])
        last = (a[-1], b[-1], *(x[-1] for x in lead))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (ids, h, places, np.where(again == 1, first, lead[0]))], schema=_REPEATS)


def _document(id_col: str, text_col: str) -> list[Column]:
    """What names a document: rows with one id and different texts are different ones."""
    return [F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, place, first_id): runs that stand earlier in first_id; h tells texts of one id apart.

    One exchange by hash: the rows that must meet (one a block and hash) by the hash alone,
    settled repeats over all tasks.
    """
    rows = docs.select(*_document(id_col, text_col)).filter("id is not null and t is not null")
    found = rows.mapInArrow(_hashed, _RUNS_DDL)
    deal = F.when(F.col("again") == 1, F.col("id")).otherwise(F.lit(0))
    found = found.repartition("a", "b", deal).sortWithinPartitions("a", "b", "again", "id", "h", "place")
    return found.mapInArrow(_not_first, "id long, h long, place long, first_id long")


_OUT = pa.schema([("id", pa.int64()), ("text", pa.string()), ("removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("first_ids", pa.list_(pa.int64()))])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sink = Sink(_OUT)
    for ident, text, found, firsts in rows_of(batches, 64):
        if not found:
            yield from sink.add((ident, text, 0, [], []), len(text or ""))
            continue
        units = sentences(text)
        gone = [0] * (len(units) + 1)
        for place in found:
            gone[place >> 6] += 1
            gone[(place >> 6) + (place & 63)] -= 1
        spans, depth, n = [], 0, 0
        for (a, b, _), step in zip(units, gone, strict=False):
            depth += step
            if depth:
                n += 1
                if spans and spans[-1]["end"] == a:
                    spans[-1]["end"] = b
                else:
                    spans.append({"start": a, "end": b})
        kept, at = [], 0
        for s in spans:
            kept.append(text[at : s["start"]])
            at = s["end"]
        kept.append(text[at:])
        yield from sink.add((ident, "".join(kept), n, spans, firsts), len(text))
    yield from sink.end()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text without repeated sentences, removed (their count),
    spans (start and end of what is gone, in code points), first_ids (documents where it stands
    earlier; which of several earlier ones are named depends on how the input is dealt).

    * a null text stays null and an empty one empty; a row without an id stays as it is;
    * repeats inside a document count too: all but the first go;
    * rows that repeat an id and text are one document: neither makes the other a repeat; rows
      with one id and different texts are two, the one of the smaller text digest first;
    * whole texts are read, of any length; an empty table gives no rows.
    """
    found = repeats(docs, id_col, text_col).groupBy("id", "h").agg(F.collect_set("place").alias("found"), F.sort_array(F.collect_set("first_id")).alias("first_ids"))
    found = written(found, "repeats")
    rows = docs.select(*_document(id_col, text_col))
    schema = "id long, text string, removed long, spans array<struct<start:long,end:long>>, first_ids array<long>"
    return rows.join(found, ["id", "h"], "left").select("id", "t", "found", "first_ids").mapInArrow(_cut, schema).withColumnRenamed("id", id_col)
